"""Record views: display records, closures, grades, facts, themes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as ag, views as vw
from ..sources.adapt import TABLE_RULES
from .features import _INTERVAL, _r, routines
from .registry import LIST_DATE, TRAIN_END, Tables, query


RV = """
rv AS (SELECT v.* EXCLUDE (record_id, status, score, grade, n_major, n_minor, n_grp, is_order, is_reopen, n_records),
  r.record_id, r.source_type, r.status, r.score, r.grade, r.n_major, r.n_minor, r.n_grp, r.is_order, r.is_reopen
 FROM rec r JOIN visit v ON v.business_id = r.business_id AND v.day = r.day AND v.merged_type = r.visit_type),
starts AS (SELECT business_id, seq, coalesce(min(record_id) FILTER (is_order), min(record_id) FILTER (n_major > 0)) AS record_id FROM rv WHERE closed GROUP BY 1, 2),
disp AS (SELECT rv.business_id, rv.record_id, rv.seq, rv.day, rv.status, rv.visit_type, rv.source_type, CASE WHEN rv.visit_type IN ('routine', 'followup') THEN rv.score END AS score,
  rv.grade, rv.n_major, rv.n_minor, rv.n_grp, rv.is_order, rv.is_reopen, s.record_id IS NOT NULL AS closed, CASE WHEN s.record_id IS NOT NULL THEN rv.closure END AS closure,
  CASE WHEN s.record_id IS NOT NULL THEN rv.reopened END AS reopened, CASE WHEN s.record_id IS NOT NULL THEN rv.reopened_on END AS reopened_on,
  s.record_id IS NOT NULL AND rv.closure_inferred AND NOT rv.is_order AS closure_inferred, rv.unplaced AND rv.is_reopen AS reopen_without_closure
 FROM rv LEFT JOIN starts s ON s.business_id = rv.business_id AND s.record_id = rv.record_id),
lastday AS (SELECT business_id, max(day) AS last_day FROM visit GROUP BY 1),
its AS (SELECT i.*, rv.business_id, rv.day, rv.visit_type, l.last_day FROM item i JOIN rv USING (record_id) JOIN lastday l ON l.business_id = rv.business_id WHERE i.severity <> 'note')"""


def rv(t: Tables):
    return vw.records_with_visits(t.records, t.visits)


def display(t: Tables):
    r = rv(t)
    return vw.display_records(r, vw.closure_starts(r))


def dated_items(t: Tables):
    """Cited items with their place, day, visit type and the place's last day."""
    r = rv(t)
    last = t.visits.groupBy("business_id").agg(F.max("day").alias("last_day"))
    return (t.items.where("severity <> 'note'").join(r.select("record_id", "business_id", "day", "visit_type"), "record_id").join(last, "business_id"))


@query("vw1_closure_starts", "SELECT * FROM starts", RV)
def vw1(t: Tables):
    return vw.closure_starts(rv(t))


_DISP = ("business_id", "record_id", "status", "visit_type", "source_type", "score", "grade", "n_major", "n_minor", "n_grp", "closure")


@query("vw2_display_records", f"""SELECT {', '.join(_DISP)}, CAST(day AS VARCHAR) AS day, CAST(closed AS INT) AS closed, CAST(reopened AS INT) AS reopened, CAST(reopened_on AS VARCHAR) AS reopened_on,
 CAST(closure_inferred AS INT) AS closure_inferred, CAST(reopen_without_closure AS INT) AS reopen_without_closure FROM disp""", RV)
def vw2(t: Tables):
    return display(t).select(*_DISP, "day", "closed", "reopened", "reopened_on", "closure_inferred", "reopen_without_closure")


@query("vw3_open_closures", """SELECT e.business_id, e.seq, CAST(e.day AS VARCHAR) AS day, e.closure AS reason, s.status,
 coalesce((SELECT string_agg(DISTINCT CAST(r.day AS VARCHAR), ' ' ORDER BY CAST(r.day AS VARCHAR)) FROM rv r WHERE r.business_id = e.business_id AND r.day > e.day AND NOT r.is_order AND r.grade IS NULL), '') AS later_ungraded
FROM (SELECT * FROM visit WHERE ends_open) e LEFT JOIN (SELECT starts.business_id, starts.seq, rv.status FROM starts JOIN rv ON rv.business_id = starts.business_id AND rv.record_id = starts.record_id WHERE rv.is_order) s ON s.business_id = e.business_id AND s.seq = e.seq
WHERE NOT EXISTS (SELECT 1 FROM rv r WHERE r.business_id = e.business_id AND r.day > e.day AND r.visit_type IN ('routine', 'followup') AND r.grade IS NOT NULL)""", RV)
def vw3(t: Tables):
    r = rv(t)
    o = vw.open_closure(r, vw.closure_starts(r))
    return o.select("business_id", "seq", "day", "reason", "status", F.array_join(F.transform("later_ungraded", lambda d: d.cast("string")), " ").alias("later_ungraded"))


@query("vw4_posted_grade", """SELECT business_id, grade, score, CAST(day AS VARCHAR) AS grade_day, CASE WHEN sw THEN pg END AS replaced_grade, CASE WHEN sw THEN ps END AS replaced_score,
 CASE WHEN sw THEN CAST(pd AS VARCHAR) END AS replaced_day FROM (SELECT *, coalesce(visit_type = 'followup' AND pt = 'routine' AND pg IN ('B', 'C'), FALSE) AS sw FROM (
 SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY seq DESC, record_id DESC) AS rn, lead(grade) OVER w AS pg, lead(score) OVER w AS ps, lead(day) OVER w AS pd, lead(visit_type) OVER w AS pt
 FROM disp WHERE grade IS NOT NULL AND visit_type IN ('routine', 'followup') WINDOW w AS (PARTITION BY business_id ORDER BY seq DESC, record_id DESC))) WHERE rn = 1""", RV)
def vw4(t: Tables):
    return vw.posted_grade(display(t))


FLAGS = f"""
f1 AS (SELECT business_id, bool_or(a <= 365 AND n_major > 0) AS major, bool_or(a <= 365 AND closed AND closure = 'health') AS closed, bool_or(a <= 365 AND visit_type = 'routine' AND grade IN ('B', 'C')) AS bc,
  count(DISTINCT CASE WHEN visit_type = 'routine' AND n_major > 0 THEN day END) >= 2 AS major_2, count(*) FILTER (closed AND closure = 'health') >= 2 AS closures2,
  count(DISTINCT CASE WHEN visit_type = 'routine' AND score < 90 THEN day END) >= 2 AS lt90_2 FROM (SELECT *, DATE '{LIST_DATE}' - day AS a FROM disp) WHERE a BETWEEN 1 AND 730 GROUP BY 1),
f2 AS (SELECT business_id, count(*) >= 2 AS rep FROM visit WHERE visit_type = 'reinspection' AND DATE '{LIST_DATE}' - day BETWEEN 1 AND 365 GROUP BY 1),
f3 AS (SELECT business_id, max(d) >= 2 AS rep_item FROM (SELECT business_id, code, count(DISTINCT day) AS d FROM its WHERE severity = 'major' AND visit_type = 'routine' AND DATE '{LIST_DATE}' - day BETWEEN 1 AND 730 GROUP BY 1, 2) GROUP BY 1),
f4 AS (SELECT business_id, string_agg(DISTINCT theme, ' ' ORDER BY theme) AS themes FROM its WHERE severity = 'major' AND DATE '{LIST_DATE}' - day BETWEEN 1 AND 365 GROUP BY 1),
flags AS (SELECT b.business_id, concat_ws(' ', CASE WHEN major THEN 'major' END, CASE WHEN closed THEN 'closed' END, CASE WHEN bc THEN 'bc' END, CASE WHEN rep THEN 'repeat' END,
  CASE WHEN major_2 THEN 'major_2' END, CASE WHEN closures2 THEN 'closures2' END, CASE WHEN rep_item THEN 'repeat_item' END, CASE WHEN lt90_2 THEN 'lt90_2' END, themes) AS flags
 FROM (SELECT DISTINCT business_id FROM disp) b LEFT JOIN f1 USING (business_id) LEFT JOIN f2 USING (business_id) LEFT JOIN f3 USING (business_id) LEFT JOIN f4 USING (business_id))"""


def flags(t: Tables):
    it = dated_items(t).where("severity = 'major'").select("business_id", "day", "visit_type", "code", "theme")
    return vw.place_flags(display(t), t.visits, it, LIST_DATE)


@query("vw5_flags", "SELECT * FROM flags", RV + "," + FLAGS)
def vw5(t: Tables):
    return flags(t).select("business_id", F.array_join("flags", " ").alias("flags"))


@query("vw7_closure_ends", """SELECT business_id, record_id, CAST(reopened_on AS VARCHAR) AS reopen, CAST(ng AS VARCHAR) AS next_graded, CAST(lr AS VARCHAR) AS later_reopen, CAST(NOT reopened AND lr IS NULL AND ng IS NULL AS INT) AS open FROM (
 SELECT *, CASE WHEN NOT reopened AND (ng IS NULL OR nr <= ng) THEN nr END AS lr FROM (SELECT v.*, (SELECT min(g.day) FROM visit g WHERE g.business_id = v.business_id AND g.day > v.day AND g.visit_type IN ('routine', 'followup') AND g.grade IS NOT NULL) AS ng,
  (SELECT min(g.day) FROM visit g WHERE g.business_id = v.business_id AND g.seq > v.seq AND g.is_reopen) AS nr FROM visit v WHERE v.closed))""")
def vw7(t: Tables):
    return vw.closure_ends(t.visits)


@query("vw8_stale_places", f"SELECT business_id, CAST(max(day) AS VARCHAR) AS last_day FROM visit GROUP BY 1 HAVING DATE '{LIST_DATE}' - max(day) > 365")
def vw8(t: Tables):
    return vw.stale_places(t.visits, LIST_DATE)


@query("rk12_items_shown", """SELECT business_id, count(*) AS shown, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, CAST(min(day) AS VARCHAR) AS oldest FROM (
 SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY CASE severity WHEN 'major' THEN 0 ELSE 1 END, day DESC, record_id DESC, line DESC, severity DESC, item_text DESC) AS rn FROM its WHERE last_day - day <= 1095) WHERE rn <= 150 GROUP BY 1""", RV)
def rk12(t: Tables):
    s = vw.items_shown(dated_items(t), [F.col(c) for c in ("record_id", "line", "severity", "item_text")], TABLE_RULES)
    return s.groupBy("business_id").agg(F.count("*").alias("shown"), *[F.count_if(F.col("severity") == x).alias(x) for x in ("major", "minor")], F.min("day").alias("oldest"))


@query("rk13_cut_lists", "SELECT business_id, count(*) AS total FROM its WHERE last_day - day <= 1095 GROUP BY 1 HAVING count(*) > 150", RV)
def rk13(t: Tables):
    return vw.cut_places(dated_items(t), TABLE_RULES)


@query("ag13_place_statistics", """SELECT d.business_id, count(*) AS records, count(*) FILTER (r) AS records_36, count(*) FILTER (visit_type = 'routine') AS routines, count(*) FILTER (visit_type = 'reinspection') AS reinspections,
 count(*) FILTER (visit_type = 'followup') AS followups, count(*) FILTER (visit_type = 'complaint') AS complaints, 0::BIGINT AS status_checks,
 CAST(coalesce(sum(n_major) FILTER (r), 0) AS BIGINT) AS n_major_36, CAST(coalesce(sum(n_minor) FILTER (r), 0) AS BIGINT) AS n_minor_36, CAST(coalesce(sum(n_grp) FILTER (r), 0) AS BIGINT) AS n_grp_36,
 count(*) FILTER (closed AND closure = 'health') AS closures_health, count(*) FILTER (closed AND closure = 'permit') AS closures_permit, count(*) FILTER (closed AND closure = 'other') AS closures_other,
 count(*) FILTER (closed) AS episodes, count(*) FILTER (closed AND status = 'Ordered Closed') AS episodes_ordered, count(*) FILTER (closed AND closure_inferred) AS episodes_inferred, 0::BIGINT AS episodes_self,
 count(*) FILTER (status = 'Ordered Closed') AS ordered_records, count(*) FILTER (reopen_without_closure) AS reopened_without_closure
FROM (SELECT disp.*, (last_day - day) / 30.44::DOUBLE <= 36 AS r FROM disp JOIN lastday USING (business_id)) d GROUP BY d.business_id""", RV)
def ag13(t: Tables):
    return vw.place_statistics(display(t))


@query("ag14_theme_counts", """SELECT business_id, theme, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'grp') AS grp,
 count(*) FILTER (visit_type = 'complaint') AS complaint, CAST(max(day) AS VARCHAR) AS latest FROM its WHERE last_day - day <= 1095 GROUP BY 1, 2""", RV)
def ag14(t: Tables):
    return vw.theme_counts(dated_items(t))


@query("ag15_theme_facts", """SELECT t.business_id, t.theme, majors, minors, CAST(latest AS VARCHAR) AS latest, quotes FROM (
 SELECT business_id, theme, count(*) FILTER (severity = 'major') AS majors, count(*) FILTER (severity = 'minor') AS minors, count(DISTINCT CASE WHEN severity = 'minor' THEN day END) AS md, max(day) AS latest
 FROM y GROUP BY 1, 2) t JOIN (SELECT business_id, theme, string_agg(item_text, '; ' ORDER BY w DESC, item_text) AS quotes FROM (SELECT *, row_number() OVER (PARTITION BY business_id, theme ORDER BY w DESC, item_text) AS rn FROM (
  SELECT business_id, theme, item_text, sum(CASE severity WHEN 'major' THEN 100 ELSE 1 END) AS w FROM y GROUP BY 1, 2, 3)) WHERE rn <= 3 GROUP BY 1, 2) q ON q.business_id = t.business_id AND q.theme = t.theme
WHERE majors > 0 OR md >= 2""", RV + ", y AS (SELECT * FROM its WHERE severity IN ('major', 'minor') AND last_day - day <= 365)")
def ag15(t: Tables):
    return vw.theme_facts(dated_items(t))


@query("vw6_place_rows", """SELECT p.facility_id, p.name, p.kind, p.district, CAST(l.last_day AS VARCHAR) AS last_day, g.grade, f.flags, n.items, n.themes
FROM place p JOIN lastday l ON l.business_id = p.business_id LEFT JOIN (SELECT business_id, arg_max(grade, seq * 1000000000 + record_id) AS grade FROM disp WHERE grade IS NOT NULL AND visit_type IN ('routine', 'followup') GROUP BY 1) g ON g.business_id = p.business_id
LEFT JOIN flags f ON f.business_id = p.business_id LEFT JOIN (SELECT business_id, count(*) AS items, count(DISTINCT theme) AS themes FROM its WHERE last_day - day <= 1095 GROUP BY 1) n ON n.business_id = p.business_id""", RV + "," + FLAGS)
def vw6(t: Tables):
    from ..operators.views import posted_grade, theme_counts, theme_map
    d = display(t)
    last = d.groupBy("business_id").agg(F.max("day").alias("last_day"))
    th = theme_map(theme_counts(dated_items(t)))
    j = t.located.join(last, "business_id").join(posted_grade(d), "business_id", "left").join(flags(t), "business_id", "left").join(th, "business_id", "left")
    vals = F.map_values("theme_counts")
    return j.select("facility_id", "name", "kind", "district", "last_day", "grade", F.array_join("flags", " ").alias("flags"),
                    F.aggregate(vals, F.lit(0).cast("long"), lambda a, v: a + v["major"] + v["minor"] + v["grp"]).alias("items"), F.when(vals.isNotNull(), F.size(vals)).alias("themes"))


# ── grouped summaries of the record ──

@query("ag1_cadence", """SELECT business_id, n, round(rate, 6) + 0.0 AS rate, round(n / span, 6) + 0.0 AS per_year, business_type FROM (
 SELECT business_id, count(*) FILTER (visit_type = 'routine') AS n, avg(major) FILTER (visit_type = 'routine') AS rate, (max(day) - min(day)) / 365.25::DOUBLE AS span FROM research GROUP BY 1)
JOIN place0 USING (business_id) WHERE span >= 3 AND n > 0""")
def ag1(t: Tables):
    c = ag.cadence(t.research, t.places.select("business_id", "business_type"))
    return _r(c.select("business_id", "n", "rate", "per_year", "business_type"), "rate", "per_year")


@query("ag1_cadence_summary", """SELECT count(*) AS facilities, round(corr(rate, n / span), 6) + 0.0 AS corr, round(median(n / span), 6) + 0.0 AS median_per_year FROM (
 SELECT business_id, count(*) FILTER (visit_type = 'routine') AS n, avg(major) FILTER (visit_type = 'routine') AS rate, (max(day) - min(day)) / 365.25::DOUBLE AS span FROM research GROUP BY 1) WHERE span >= 3 AND n > 0""")
def ag1_summary(t: Tables):
    return _r(ag.cadence_summary(ag.cadence(t.research, t.places.select("business_id", "business_type"))), "corr", "median_per_year")


@query("ag2_gap_by_common_types", "SELECT business_type, count(*) AS n, median(next_gap) AS median_gap FROM rt WHERE next_gap IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", _INTERVAL)
def ag2_common(t: Tables):
    return ag.gap_by_top_types(routines(t))


@query("ag2_gap_by_record_fifth", """SELECT greatest(CAST(ceil((p - 1) * 5 / CAST(n - 1 AS DOUBLE)) AS INT), 1) AS fifth, count(*) AS n, median(next_gap) AS median_gap FROM (
 SELECT *, row_number() OVER (ORDER BY record, record_id) AS p, count(*) OVER () AS n FROM rt WHERE next_gap IS NOT NULL AND record IS NOT NULL) GROUP BY 1""", _INTERVAL)
def ag2_fifth(t: Tables):
    return ag.gap_by_record_fifth(routines(t))


@query("ag3_counts", "SELECT year(day) AS year, status, count(*) AS n FROM visit GROUP BY 1, 2")
def ag3(t: Tables):
    return t.visits.groupBy(F.year("day").alias("year"), "status").agg(F.count("*").alias("n"))


@query("ag4_leak_check", f"""SELECT CASE WHEN day <= DATE '{TRAIN_END}' THEN 'train' ELSE 'test' END AS split, count(*) FILTER (day < opened_date) AS negative,
 round(avg(major) FILTER (day < opened_date), 6) + 0.0 AS negative_rate, round(avg(major) FILTER (day >= opened_date), 6) + 0.0 AS other_rate, count(*) FILTER (opened_date IS NULL) AS missing_opened
FROM research JOIN place0 USING (business_id) WHERE visit_type = 'routine' GROUP BY 1""")
def ag4(t: Tables):
    from ..operators.history import permit_age
    rows = permit_age(t.research.where("visit_type = 'routine'").join(t.places.select("business_id", "opened_date"), "business_id"))
    return _r(ag.leak_check(rows, TRAIN_END), "negative_rate", "other_rate")


@query("ag8_rate_by_year_and_history", """SELECT year, """ + ", ".join(f"round(avg(major) FILTER (b = '{b}'), 6) + 0.0 AS {n}" for b, n in (("0", "h_0"), ("1", "h_1"), ("2", "h_2"), ("3-4", "h_3_4"), ("5+", "h_5_up"))) + """
FROM (SELECT year(day) AS year, major, CASE WHEN p = 0 THEN '0' WHEN p = 1 THEN '1' WHEN p = 2 THEN '2' WHEN p <= 4 THEN '3-4' ELSE '5+' END AS b FROM (
 SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY dn, later, seq) - 1 AS p FROM research) WHERE visit_type = 'routine') GROUP BY 1""")
def ag8(t: Tables):
    from ..operators.history import since_start
    g = ag.rate_by_year_and_history(since_start(t.research).where("visit_type = 'routine'"))
    return _r(g, *[c for c in g.columns if c != "year"])


_HITS = """
rr AS (SELECT *, n_major > 0 AS hit, lag(n_major > 0) OVER (PARTITION BY business_id ORDER BY seq) AS prev FROM visit WHERE visit_type = 'routine')"""


@query("ag9_measurement", "SELECT " + ", ".join(f"count(*) FILTER (score = {s}) AS score_{s}" for s in range(86, 93)) + """,
 round(avg(CAST(grade = 'A' AS INT)) FILTER (grade IS NOT NULL), 6) + 0.0 AS graded_a_share, round(avg(CAST(grade = 'A' AS INT)) FILTER (grade IS NOT NULL AND hit), 6) + 0.0 AS majors_graded_a_share,
 round(avg(CAST(hit AS INT)) FILTER (prev), 6) + 0.0 AS major_after_major, round(avg(CAST(hit AS INT)) FILTER (NOT prev), 6) + 0.0 AS major_after_clean FROM rr""", _HITS)
def ag9(t: Tables):
    m = ag.measurement(t.visits, t.places)
    return _r(m, "graded_a_share", "majors_graded_a_share", "major_after_major", "major_after_clean")


@query("ag9_colocated_agreement", """SELECT CAST(same_day AS INT) AS same_day, CAST(count(*) // 2 AS BIGINT) AS pairs, CASE WHEN count(*) > 60 THEN round(corr(ma, mb), 6) + 0.0 END AS corr FROM (
 SELECT a.day = b.day AS same_day, CAST(a.n_major > 0 AS INT)::DOUBLE AS ma, CAST(b.n_major > 0 AS INT)::DOUBLE AS mb FROM addr a JOIN addr b ON a.address = b.address AND a.business_id <> b.business_id
 WHERE a.day = b.day OR abs(a.day - b.day) >= 60) GROUP BY 1""",
       "addr AS MATERIALIZED (SELECT v.business_id, v.day, v.n_major, p.address FROM visit v JOIN place0 p USING (business_id) WHERE visit_type = 'routine')")
def ag9_pairs(t: Tables):
    rt = t.visits.where("visit_type = 'routine'").join(t.places.select("business_id", "address"), "business_id")
    g = ag.colocated_agreement(rt.select("business_id", "address", "dn", (F.col("n_major") > 0).alias("major")))
    return _r(g, "corr")


@query("ag9_rate_by_quarter", "SELECT year(day) || 'Q' || quarter(day) AS quarter, count(*) AS n, round(avg(CAST(n_major > 0 AS INT)), 6) + 0.0 AS rate FROM visit WHERE visit_type = 'routine' GROUP BY 1 HAVING count(*) >= 200")
def ag9_quarter(t: Tables):
    return _r(ag.rate_by_quarter(t.visits), "rate")


@query("ag9_counts_by_month", "SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (n_major > 0) AS positives FROM visit WHERE visit_type = 'routine' GROUP BY 1")
def ag9_month(t: Tables):
    return ag.counts_by_month(t.visits)


@query("ag21_yearly_totals", "SELECT year(day) AS year, count(*) AS routine, count(*) FILTER (n_major > 0) AS with_major FROM visit WHERE visit_type = 'routine' GROUP BY 1")
def ag21(t: Tables):
    return ag.yearly_totals(t.visits)
