"""The visit tables as SQL common table expressions, for the side-by-side check."""
from __future__ import annotations

from ..sources.adapt import THEMES, area_squares


def _num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


AREA_VALUES = ",\n".join(
    f"('{j}', {d}, {_num(x0)}, {_num(y0)}, {_num(x1)}, {_num(y1)})" for j, d, x0, y0, x1, y1 in area_squares())
TH = [f"th_{t}" for t in THEMES]
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

BASE = f"""
item AS (
 SELECT l_orderkey AS record_id, l_linenumber AS line,
  CASE WHEN l_returnflag = 'R' AND l_discount >= {_num(0.07)} THEN 'major' WHEN l_returnflag = 'R' THEN 'minor'
       WHEN l_returnflag = 'A' THEN 'grp' ELSE 'note' END AS severity,
  p_name AS item_text, lower(p_type) AS theme, p_size AS code
 FROM lineitem JOIN part ON l_partkey = p_partkey),
cnt AS (
 SELECT record_id, count(*) FILTER (severity = 'major') AS n_major, count(*) FILTER (severity = 'minor') AS n_minor,
  count(*) FILTER (severity = 'grp') AS n_grp, bool_or(severity = 'note' AND line = 1) AS permit_note,
  {', '.join(f"count(*) FILTER (severity IN ('major', 'minor') AND theme = '{t}') AS th_{t}" for t in THEMES)}
 FROM item GROUP BY record_id),
rec0 AS (
 SELECT o_orderkey AS record_id, o_custkey AS business_id, CAST(o_orderdate AS DATE) AS day,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Site Investigation' WHEN '2-HIGH' THEN 'Re-inspection' ELSE 'Routine' END AS source_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'complaint' WHEN '2-HIGH' THEN 'reinspection' ELSE 'routine' END AS visit_type,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'Ordered Closed'
       WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 1 THEN 'Approved to Reopen' ELSE 'Complete' END AS status,
  coalesce(n_major, 0) AS n_major, coalesce(n_minor, 0) AS n_minor, coalesce(n_grp, 0) AS n_grp,
  coalesce(permit_note, FALSE) AS permit_note, {', '.join(f'coalesce({t}, 0) AS {t}' for t in TH)}
 FROM orders LEFT JOIN cnt ON o_orderkey = record_id),
rec1 AS (
 SELECT *, CASE WHEN visit_type = 'routine' AND status = 'Complete' AND 100 - 5 * n_major - 3 * n_minor - n_grp > 0
   THEN 100 - 5 * n_major - 3 * n_minor - n_grp END AS score, status = 'Ordered Closed' AS is_order,
  status = 'Approved to Reopen' AS is_reopen FROM rec0),
rec AS MATERIALIZED (
 SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score IS NOT NULL THEN 'C' END AS grade FROM rec1),
merged0 AS (
 SELECT business_id, day, visit_type, min(record_id) AS record_id,
  CASE max(CASE status WHEN 'Ordered Closed' THEN 3 WHEN 'Approved to Reopen' THEN 1 ELSE 0 END)
    WHEN 3 THEN 'Ordered Closed' WHEN 1 THEN 'Approved to Reopen' ELSE 'Complete' END AS status,
  min(score) AS score, max(grade) AS grade, CAST(sum(n_major) AS BIGINT) AS n_major, CAST(sum(n_minor) AS BIGINT) AS n_minor,
  CAST(sum(n_grp) AS BIGINT) AS n_grp, bool_or(permit_note) AS permit_note, bool_or(is_order) AS is_order,
  bool_or(is_reopen) AS is_reopen, count(*) AS n_records, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in TH)}
 FROM rec GROUP BY business_id, day, visit_type),
merged AS MATERIALIZED (
 SELECT *, day - DATE '1970-01-01' AS dn, row_number() OVER (PARTITION BY business_id ORDER BY day,
   CASE WHEN is_order THEN 0 WHEN is_reopen THEN 1 ELSE 2 END, record_id) AS seq FROM merged0),
inf0 AS (
 SELECT *, visit_type = 'routine' AND grade IS NOT NULL AND NOT is_order AND NOT is_reopen AS g0,
  is_order OR is_reopen OR (visit_type = 'routine' AND grade IS NOT NULL) AS blocks FROM merged),
inf1 AS (
 SELECT *, last_value(CASE WHEN blocks OR (score IS NULL AND n_major > 0) THEN seq END IGNORE NULLS) OVER w AS mark_seq,
  last_value(CASE WHEN is_reopen THEN 'r' WHEN is_order THEN 'o' END IGNORE NULLS) OVER w AS ev,
  last_value(CASE WHEN is_order THEN dn END IGNORE NULLS) OVER w AS odn, max(CASE WHEN g0 THEN dn END) OVER w AS gdn
 FROM inf0 WINDOW w AS (PARTITION BY business_id ORDER BY seq {_BEFORE})),
tries AS (
 SELECT a.business_id, a.seq, a.dn, CASE WHEN NOT m.blocks AND a.dn - m.dn <= 14 THEN m.seq END AS found_seq,
  CASE WHEN NOT m.blocks AND a.dn - m.dn <= 14 THEN m.dn END AS found_dn
 FROM inf1 a LEFT JOIN inf0 m ON m.business_id = a.business_id AND m.seq = a.mark_seq
 WHERE a.is_reopen AND NOT a.is_order AND NOT coalesce(a.ev = 'o' AND NOT coalesce(a.gdn > a.odn, FALSE), FALSE)
  AND (a.ev IS NULL OR a.ev = 'r' OR a.dn - a.odn > 30)),
inf2 AS (
 SELECT i.*, t.seq IS NOT NULL AS tried, t.found_seq,
  last_value(CASE WHEN i.is_order THEN i.dn ELSE t.found_dn END IGNORE NULLS)
   OVER (PARTITION BY i.business_id ORDER BY i.seq {_BEFORE}) AS cdn
 FROM inf1 i LEFT JOIN tries t ON t.business_id = i.business_id AND t.seq = i.seq),
inferred AS (
 SELECT i.* EXCLUDE (ev, odn, gdn, mark_seq, found_seq, cdn, tried, g0, blocks), f.found_seq IS NOT NULL AS inferred,
  i.is_order OR f.found_seq IS NOT NULL AS any_order,
  i.tried AND i.found_seq IS NULL AND NOT coalesce(i.dn - i.cdn <= 30, FALSE) AS unplaced
 FROM inf2 i LEFT JOIN (SELECT business_id, found_seq FROM tries WHERE found_seq IS NOT NULL) f
  ON f.business_id = i.business_id AND f.found_seq = i.seq),
ep0 AS (
 SELECT *, visit_type = 'routine' AND grade IS NOT NULL AND NOT any_order AND NOT is_reopen AS graded FROM inferred),
ep1 AS (
 SELECT *, last_value(CASE WHEN is_reopen THEN 'r' WHEN any_order THEN 'o' END IGNORE NULLS) OVER w AS ev,
  last_value(CASE WHEN any_order THEN dn END IGNORE NULLS) OVER w AS odn, max(CASE WHEN graded THEN dn END) OVER w AS gdn
 FROM ep0 WINDOW w AS (PARTITION BY business_id ORDER BY seq {_BEFORE})),
ep2 AS (SELECT *, coalesce(ev = 'o' AND NOT coalesce(gdn > odn, FALSE), FALSE) AS open_before FROM ep1),
ep3 AS (
 SELECT *, any_order AND (NOT open_before OR coalesce(dn - odn > 30, FALSE)) AS closed,
  CASE WHEN any_order THEN CASE WHEN n_major > 0 THEN 'health' WHEN permit_note THEN 'permit' ELSE 'other' END END AS closure_order,
  (any_order AND NOT is_reopen) OR (open_before AND NOT is_reopen AND NOT (graded AND coalesce(dn > odn, FALSE))) AS open_after
 FROM ep2),
ep4 AS (SELECT *, sum(CAST(closed AS INT)) OVER (PARTITION BY business_id ORDER BY seq) AS episode FROM ep3),
ep_facts AS (
 SELECT business_id, episode, bool_or(n_major > 0) FILTER (any_order) AS health,
  min(day) FILTER (is_reopen AND episode > 0 AND (any_order OR open_before OR coalesce(dn - odn <= 30, FALSE))) AS reopened_on
 FROM ep4 GROUP BY business_id, episode),
ep_last AS (SELECT business_id, max(episode) AS last_episode, arg_max(open_after, seq) AS ends_open FROM ep4 GROUP BY business_id),
ev AS (
 SELECT business_id, seq, dn, visit_type = 'routine' AS routine, any_order OR (unplaced AND NOT open_before AND seq > 1) AS always,
  visit_type = 'routine' AND NOT any_order AND (coalesce(score < 90, FALSE) OR coalesce(grade IN ('B', 'C'), FALSE)) AS low FROM ep4),
ev1 AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY seq) AS k FROM ev WHERE routine OR always),
fold AS (
 SELECT business_id, k, seq, FALSE AS hit, CASE WHEN always OR low THEN dn END AS at_dn FROM ev1 WHERE k = 1
 UNION ALL
 SELECT e.business_id, e.k, e.seq, e.routine AND coalesce(e.dn - f.at_dn <= 30, FALSE),
  CASE WHEN e.always OR (e.low AND NOT coalesce(e.dn - f.at_dn <= 30, FALSE)) THEN e.dn ELSE f.at_dn END
 FROM fold f JOIN ev1 e ON e.business_id = f.business_id AND e.k = f.k + 1),
visit AS MATERIALIZED (
 SELECT * EXCLUDE (kind_text), CASE WHEN visit_no > 0 THEN kind_text END AS visit_type FROM (
 SELECT *, row_number() OVER (ORDER BY business_id, seq) AS visit_no FROM (SELECT p.* EXCLUDE (visit_type, ev, odn, gdn, open_before, open_after, inferred, any_order, graded),
  CASE WHEN f.hit THEN 'followup' ELSE p.visit_type END AS kind_text, p.visit_type AS merged_type,
  CASE WHEN p.closed THEN CASE WHEN x.health THEN 'health' ELSE p.closure_order END END AS closure,
  p.inferred AS closure_inferred, CASE WHEN p.closed THEN x.reopened_on IS NOT NULL END AS reopened,
  CASE WHEN p.closed THEN x.reopened_on END AS reopened_on,
  p.closed AND l.ends_open AND p.episode = l.last_episode AS ends_open,
  p.n_major + p.n_minor + p.n_grp AS n_items,
  CASE WHEN p.visit_type = 'routine' AND NOT coalesce(f.hit, FALSE) THEN CASE WHEN p.closure_order = 'health' THEN 70 ELSE p.score END END AS rated
 FROM ep4 p JOIN ep_facts x USING (business_id, episode) JOIN ep_last l USING (business_id)
 LEFT JOIN fold f ON f.business_id = p.business_id AND f.seq = p.seq))),
research AS (
 SELECT * EXCLUDE (score), CASE WHEN visit_type = 'routine' THEN score END AS score,
  CAST(n_major > 0 AS INT)::DOUBLE AS major, CAST(visit_type <> 'routine' AS INT) AS later FROM visit),
area (jurisdiction, district, x0, y0, x1, y1) AS (VALUES
{AREA_VALUES}),
place0 AS (
 SELECT c_custkey AS business_id, 'F' || c_custkey AS facility_id, c_name AS name, c_mktsegment AS business_type,
  (c_custkey // 3) || ' Test St' AS address, CAST(92000 + c_custkey % 40 AS VARCHAR) AS zip5,
  {_num(-117.3)} + (c_custkey * 61 % 1000) / {_num(2000.0)} AS lon, {_num(32.5)} + (c_custkey * 37 % 1000) / {_num(1600.0)} AS lat,
  CASE WHEN c_custkey % 50 = 0 THEN 'Expired' ELSE 'Issued' END AS permit_status,
  f.first_day - CAST(c_custkey % 1000 - 100 AS INT) AS opened_date,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'restaurant' WHEN 'HOUSEHOLD' THEN 'restaurant' WHEN 'MACHINERY' THEN 'limited'
    WHEN 'FURNITURE' THEN 'market' END AS kind
 FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day FROM orders GROUP BY o_custkey) f
  ON o_custkey = c_custkey),
place AS MATERIALIZED (
 SELECT p.*, (SELECT min(district) FROM area a WHERE jurisdiction = 'TESTVILLE' AND p.lon BETWEEN a.x0 AND a.x1
   AND p.lat BETWEEN a.y0 AND a.y1) AS district,
  coalesce('D' || (SELECT min(district) FROM area a WHERE jurisdiction = 'TESTVILLE' AND p.lon BETWEEN a.x0 AND a.x1
   AND p.lat BETWEEN a.y0 AND a.y1), 'Z' || substr(p.zip5, 1, 3)) AS area
 FROM place0 p),
zip_attr AS (
 SELECT DISTINCT zip5, 40000.0::DOUBLE + 1500.0::DOUBLE * (CAST(zip5 AS INT) % 40) AS income,
  (CAST(zip5 AS INT) * 7) % 40 / 40.0::DOUBLE AS pct FROM place0)"""
