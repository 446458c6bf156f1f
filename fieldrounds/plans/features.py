"""Point-in-time features, as-of and interval joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import history as h, joins, snapshot as sn
from ..sources.adapt import TABLE_RULES as RULES, THEMES
from .registry import LIST_DATE, TRAIN_END, Tables, query

_ROWS = "(PARTITION BY business_id ORDER BY dn, later, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _r(df, *names):
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, *[fn.r6(F.col(n)).alias(n) for n in names])


def _sql_r(*names):
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


_SINCE = f"""
since AS MATERIALIZED (SELECT *, count(*) OVER w AS prior_n, dn - lag(dn) OVER o AS days_since_last, last_value(score IGNORE NULLS) OVER w AS last_score,
 coalesce(CAST(lag(n_major) OVER o > 0 AS INT), 0) AS last_major, avg(major) OVER w AS prior_major_rate, avg(score) OVER w AS prior_mean_score,
 avg(n_items) OVER w AS prior_mean_viol, avg(rated) OVER w AS prior_mean_rated, last_value(rated IGNORE NULLS) OVER w AS last_rated
 FROM research WINDOW w AS {_ROWS}, o AS (PARTITION BY business_id ORDER BY dn, later, seq))"""


@query("wf1_prior_visits", "SELECT business_id, record_id, prior_n FROM since", _SINCE)
def wf1(t: Tables):
    return h.since_start(t.research).select("business_id", "record_id", "prior_n")


@query("wf2_days_since_last", "SELECT business_id, record_id, days_since_last FROM since", _SINCE)
def wf2(t: Tables):
    return h.since_start(t.research).select("business_id", "record_id", "days_since_last")


@query("wf3_last_scores", "SELECT business_id, record_id, last_score, last_rated FROM since", _SINCE)
def wf3(t: Tables):
    return h.since_start(t.research).select("business_id", "record_id", "last_score", "last_rated")


@query("wf4_last_major", "SELECT business_id, record_id, CAST(last_major AS DOUBLE) AS last_major FROM since", _SINCE)
def wf4(t: Tables):
    return h.since_start(t.research).select("business_id", "record_id", "last_major")


_MEANS = ("prior_major_rate", "prior_mean_score", "prior_mean_viol", "prior_mean_rated")


@query("wf5_expanding_means", f"SELECT business_id, record_id, {_sql_r(*_MEANS)} FROM since", _SINCE)
def wf5(t: Tables):
    return _r(h.since_start(t.research).select("business_id", "record_id", *_MEANS), *_MEANS)


def _year(score: str) -> str:
    """The trailing year as an equality join on the place with a day window, aggregated."""
    return f"""
pairs AS (SELECT a.business_id, a.record_id, a.dn, b.dn AS bdn, b.later AS bl, b.seq AS bs, b.{score} AS bscore, b.n_major AS bm, b.n_items AS bi
 FROM research a LEFT JOIN research b ON b.business_id = a.business_id AND b.dn BETWEEN a.dn - 365 AND a.dn - 1),
trail AS (SELECT business_id, record_id, count(bdn) AS w_prior_n, any_value(dn) - max(bdn) AS w_days_since_last,
 arg_max(bscore, bdn * 100000 + bl * 10000 + bs) FILTER (bscore IS NOT NULL) AS w_last_score,
 CAST(arg_max(bm, bdn * 100000 + bl * 10000 + bs) > 0 AS INT)::DOUBLE AS w_last_major, avg(CAST(bm > 0 AS INT)) AS w_major_rate,
 avg(bscore) AS w_mean_score, avg(bi) AS w_mean_viol, count(bscore) AS w_n_scores FROM pairs GROUP BY business_id, record_id)"""


_W = ("w_major_rate", "w_mean_score", "w_mean_viol")


@query("wf6_trailing_year", f"""SELECT business_id, record_id, w_prior_n, w_days_since_last, w_last_score, w_last_major, w_n_scores, {_sql_r(*_W)} FROM trail""",
       _year("score"))
def wf6(t: Tables):
    f = h.trailing(t.research)
    return _r(f.select("business_id", "record_id", *h.HISTORY_WINDOW, "w_n_scores"), *_W)


@query("wf7_trailing_year_rated", f"""SELECT business_id, record_id, w_prior_n, w_days_since_last, w_last_score, w_last_major, w_n_scores, {_sql_r(*_W)} FROM trail""",
       _year("rated"))
def wf7(t: Tables):
    f = h.trailing(t.research, score="rated")
    return _r(f.select("business_id", "record_id", *h.HISTORY_WINDOW, "w_n_scores"), *_W)


_PERSIST = """
persist AS (SELECT a.business_id, a.record_id,
 coalesce(sum(CAST(b.visit_type = 'routine' AND b.n_major > 0 AS INT)) FILTER (b.dn >= a.dn - 365), 0) * 1e4::DOUBLE
 + least(coalesce(sum(b.n_major) FILTER (b.dn >= a.dn - 365 AND b.visit_type IN ('routine', 'reinspection', 'followup')), 0), 99) * 10
 + (100 - coalesce(arg_max(b.score, b.dn) FILTER (b.visit_type = 'routine' AND b.score IS NOT NULL), 97::DOUBLE)) / 100::DOUBLE AS persistence
 FROM research a LEFT JOIN research b ON b.business_id = a.business_id AND b.dn BETWEEN a.dn - 730 AND a.dn - 1 GROUP BY a.business_id, a.record_id)"""


@query("wf8_persistence", "SELECT business_id, record_id, round(persistence, 6) + 0.0 AS persistence FROM persist", _PERSIST)
def wf8(t: Tables):
    return _r(h.persistence(t.research).select("business_id", "record_id", "persistence"), "persistence")


_RULE_COLS = ("rule_mean12", "rule_mean_all", "rule_last")


@query("wf9_no_model_rules", f"""SELECT business_id, record_id, round(-coalesce(t.w_mean_score, 97), 6) + 0.0 AS rule_mean12,
 round(-coalesce(prior_mean_rated, 97), 6) + 0.0 AS rule_mean_all, round(-coalesce(last_rated, 97), 6) + 0.0 AS rule_last
FROM since JOIN trail t USING (business_id, record_id)""", _SINCE + "," + _year("rated"))
def wf9(t: Tables):
    return _r(h.add_features(t.research).select("business_id", "record_id", *_RULE_COLS), *_RULE_COLS)


@query("wf10_permit_age", """SELECT business_id, record_id, round((day - opened_date) / 365.25::DOUBLE, 6) + 0.0 AS facility_age_asof_pull,
 CASE WHEN day >= opened_date THEN round((day - opened_date) / 365.25::DOUBLE, 6) + 0.0 END AS facility_age_yrs FROM research JOIN place0 USING (business_id)""")
def wf10(t: Tables):
    df = h.permit_age(t.research.join(t.places.select("business_id", "opened_date"), "business_id"))
    return _r(df.select("business_id", "record_id", "facility_age_asof_pull", "facility_age_yrs"), "facility_age_asof_pull", "facility_age_yrs")


# History of (place, T) pairs, strictly before T, for any table asked(business_id, day).
_ASKED = """
hist AS (SELECT a.business_id, a.day AS t, r.* EXCLUDE (business_id) FROM asked a LEFT JOIN research r ON r.business_id = a.business_id AND r.day < a.day),
at_t AS (SELECT business_id, t, count(dn) AS prior_n, (t - DATE '1970-01-01') - max(dn) AS days_since_last,
 arg_max(score, dn) FILTER (score IS NOT NULL) AS last_score, CAST(coalesce(arg_max(n_major, dn * 100000 + later * 10000 + seq) > 0, FALSE) AS INT)::DOUBLE AS last_major,
 avg(major) AS prior_major_rate, avg(score) AS prior_mean_score, avg(n_items) AS prior_mean_viol, avg(rated) AS prior_mean_rated,
 count(dn) FILTER (t - day <= 365) AS w_prior_n, avg(score) FILTER (t - day <= 365) AS w_mean_score, -coalesce(avg(rated) FILTER (t - day <= 365), 97) AS rule_mean12,
 -coalesce(avg(rated), 97) AS rule_mean_all,
 coalesce(sum(CAST(visit_type = 'routine' AND n_major > 0 AS INT)) FILTER (t - day <= 365), 0) * 1e4::DOUBLE
 + least(coalesce(sum(n_major) FILTER (t - day <= 365 AND visit_type <> 'complaint'), 0), 99) * 10
 + (100 - coalesce(arg_max(score, dn) FILTER (t - day <= 730 AND score IS NOT NULL), 97::DOUBLE)) / 100::DOUBLE AS persistence
 FROM hist GROUP BY business_id, t)"""
_ASOF_INT = ("prior_n", "days_since_last", "last_score", "last_major", "w_prior_n")
_ASOF_DBL = ("prior_major_rate", "prior_mean_score", "prior_mean_viol", "w_mean_score", "rule_mean12", "rule_mean_all", "persistence")
MONTH_CTES = """
asked AS (SELECT DISTINCT business_id, CAST(date_trunc('month', day) AS DATE) AS day FROM research WHERE visit_type = 'routine'),""" + _ASKED


@query("wf11_features_asof", f"SELECT business_id, {', '.join(_ASOF_INT)}, {_sql_r(*_ASOF_DBL)} FROM at_t", f"""
asked AS (SELECT business_id, DATE '{LIST_DATE}' AS day FROM research GROUP BY 1 HAVING max(day) < DATE '{LIST_DATE}'),""" + _ASKED)
def wf11(t: Tables):
    f = h.features_asof(t.research, LIST_DATE)
    return _r(f.select("business_id", *_ASOF_INT, *_ASOF_DBL), *_ASOF_DBL)


@query("wf12_month_start_features", f"SELECT business_id, CAST(t AS VARCHAR) AS month_start, {', '.join(_ASOF_INT)}, {_sql_r(*_ASOF_DBL)} FROM at_t", MONTH_CTES)
def wf12(t: Tables):
    f = h.month_start_features(t.research)
    return _r(f.select("business_id", F.col("day").alias("month_start"), *_ASOF_INT, *_ASOF_DBL), *_ASOF_DBL)


@query("j15_month_start_rows", """SELECT r.business_id, r.record_id, r.major, prior_n, round(persistence, 6) + 0.0 AS persistence
FROM research r JOIN at_t a ON a.business_id = r.business_id AND a.t = CAST(date_trunc('month', r.day) AS DATE) WHERE visit_type = 'routine'""", MONTH_CTES)
def j15(t: Tables):
    f = h.month_start_rows(t.research, ["prior_n", "persistence"])
    return _r(f.select("business_id", "record_id", "major", "prior_n", "persistence"), "persistence")


# ── snapshots ──

SNAP_FIRST, SNAP_LAST = "1996-02-01", "2000-07-01"
SNAP_DATES = sn.month_starts(SNAP_FIRST, SNAP_LAST)
_TH = [f"th_{x}" for x in THEMES]


def snap_ctes(dates_sql: str) -> str:
    """Snapshots by joining each (place, date) to its two years of history and its label year."""
    return f"""
prompt AS (SELECT v.*, v.visit_type = 'reinspection' AND EXISTS (SELECT 1 FROM visit c WHERE c.business_id = v.business_id
  AND c.visit_type = 'complaint' AND v.dn - c.dn BETWEEN 0 AND 60) AS prompted FROM visit v),
counted AS (SELECT *, visit_type IN ('routine', 'reinspection', 'followup') AND NOT prompted AS ok FROM prompt),
dates AS ({dates_sql}),
past AS (SELECT business_id, as_of, max(day) AS last_day, count(*) FILTER (y1) AS visits_year,
  avg(score) FILTER (rt) AS avg_score, arg_max(score, dn) FILTER (rt AND score IS NOT NULL) AS last_score,
  avg(rated) FILTER (rt) AS mean_rated, arg_max(rated, dn) FILTER (rt AND rated IS NOT NULL) AS last_rated,
  count(rated) FILTER (rt) AS rated_2y, count(*) FILTER (rt AND closure_order = 'health') AS closures_read,
  count(*) FILTER (y1 AND rt) AS routines, count(*) FILTER (y1 AND rt AND n_major > 0) AS routines_major,
  CAST(coalesce(sum(n_major) FILTER (y1 AND ok), 0) AS BIGINT) AS majors, count(*) FILTER (y1 AND ok AND closure = 'health') AS health_closures,
  count(*) FILTER (y1 AND ok AND visit_type = 'reinspection') AS reinspections, CAST(coalesce(sum(n_grp) FILTER (y1 AND rt), 0) AS BIGINT) AS grp,
  {', '.join(f'CAST(coalesce(sum({x}) FILTER (y1 AND ok), 0) AS BIGINT) AS {x}' for x in _TH)}
 FROM (SELECT c.*, as_of, as_of - day <= 365 AS y1, visit_type = 'routine' AND as_of - day <= 730 AS rt FROM counted c JOIN dates ON day < as_of)
 GROUP BY business_id, as_of),
lab AS (SELECT business_id, as_of, CAST(arg_min(n_major, dn) > 0 AS INT) AS y, arg_min(record_id, dn) AS event,
  CAST(arg_min(n_major, dn) FILTER (day - as_of < 90) > 0 AS INT) AS y_d90, CAST(arg_min(n_major, dn) FILTER (day - as_of < 180) > 0 AS INT) AS y_d180,
  CAST(arg_min(n_major, dn) FILTER (day - as_of < 270) > 0 AS INT) AS y_d270
 FROM visit JOIN dates ON day >= as_of AND day - as_of < 365 WHERE visit_type = 'routine' GROUP BY business_id, as_of),
snap AS (SELECT p.*, l.y, l.event, l.y_d90, l.y_d180, l.y_d270, coalesce(100 - floor(mean_rated + 0.5), 0)::DOUBLE AS avg_deficit,
  coalesce(100 - last_rated, 0)::DOUBLE AS last_deficit, CAST(mean_rated IS NULL AS INT) AS no_score,
  routines_major * 1e4::DOUBLE + least(majors, 99) * 10 + (100 - coalesce(last_score, 97::DOUBLE)) / 100::DOUBLE AS persistence
 FROM past p LEFT JOIN lab l USING (business_id, as_of) WHERE visits_year > 0),
fr AS (SELECT s.*, p.kind, p.district, p.area, p.permit_status, p.address, p.name, p.facility_id, p.zip5, p.business_type FROM snap s JOIN place p USING (business_id)
 WHERE as_of - last_day <= 550)"""


ALL_DATES = f"SELECT CAST(d AS DATE) AS as_of FROM range(DATE '{SNAP_FIRST}', DATE '{SNAP_LAST}' + 1, INTERVAL 1 MONTH) r(d)"
SNAP = snap_ctes(ALL_DATES)
_SNAP_INT = ("visits_year", "last_score", "routines", "routines_major", "majors", "health_closures", "reinspections", "grp", "rated_2y",
             "closures_read", "no_score", "avg_deficit", "last_deficit")


def snaps(t: Tables, dates=None, horizons=None, themes=False):
    v = t.theme_visits if themes else t.visits
    return sn.snapshots(v, t.places, list(dates or SNAP_DATES), RULES, horizons)


@query("wf13_snapshot_features", f"""SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, {', '.join(_SNAP_INT)}, {', '.join(_TH)}, round(avg_score, 6) + 0.0 AS avg_score FROM snap""", SNAP)
def wf13(t: Tables):
    return _r(snaps(t, themes=True).select("business_id", "as_of", *_SNAP_INT, *_TH, "avg_score"), "avg_score")


@query("wf14_eligibility", "SELECT CAST(as_of AS VARCHAR) AS as_of, count(*) AS places, count(*) FILTER (rated_2y >= 2) AS eligible FROM snap GROUP BY 1", SNAP)
def wf14(t: Tables):
    return snaps(t).groupBy("as_of").agg(F.count("*").alias("places"), F.count_if(sn.eligible()).alias("eligible"))


@query("wf15_snapshot_frame", """SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, kind, district, avg_deficit, y, event FROM fr
WHERE kind = 'restaurant' AND y IS NOT NULL""", SNAP)
def wf15(t: Tables):
    f = sn.frame(snaps(t), t.located, F.col("kind") == "restaurant", labelled=True)
    return f.select("business_id", "as_of", "kind", "district", "avg_deficit", "y", "event")


@query("wf16_event_weights", """SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, round(1.0::DOUBLE / count(*) OVER (PARTITION BY business_id, event), 6) + 0.0 AS weight
FROM fr WHERE kind = 'restaurant' AND y IS NOT NULL""", SNAP)
def wf16(t: Tables):
    f = sn.event_weights(sn.frame(snaps(t), t.located, F.col("kind") == "restaurant", labelled=True))
    return _r(f.select("business_id", "as_of", "weight"), "weight")


_USED = f"""
used AS (SELECT business_id, day, seq, rated AS score, coalesce(closure_order = 'health', FALSE) AS closure FROM visit
 WHERE visit_type = 'routine' AND rated IS NOT NULL AND day < DATE '{LIST_DATE}' AND DATE '{LIST_DATE}' - day <= 730)"""


@query("wf17_scores_used", "SELECT business_id, string_agg(score || CASE WHEN closure THEN 'c' ELSE '' END, ', ' ORDER BY day, seq) AS used FROM used GROUP BY 1", _USED)
def wf17(t: Tables):
    u = sn.scores_used(t.visits, LIST_DATE)
    text = F.transform("scores_used", lambda x: F.concat(x["score"].cast("string"), F.when(x["closure"], "c").otherwise("")))
    return u.select("business_id", F.array_join(text, ", ").alias("used"))


@query("wf18_closure_mask", "SELECT business_id, CAST(bool_or(closure) AS INT) AS closure_read FROM used GROUP BY 1", _USED)
def wf18(t: Tables):
    return sn.closure_mask(sn.scores_used(t.visits, LIST_DATE))


_INTERVAL = f"""
rt AS (SELECT r.*, p.business_type, dn - lag(dn) OVER (PARTITION BY r.business_id ORDER BY dn) AS gap, lead(dn) OVER (PARTITION BY r.business_id ORDER BY dn) - dn AS next_gap,
  lag(major) OVER (PARTITION BY r.business_id ORDER BY dn) AS prev_major, avg(rated) OVER (PARTITION BY r.business_id ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS record
 FROM research r JOIN place0 p USING (business_id) WHERE visit_type = 'routine'),
iv AS (SELECT business_type, median(gap) AS interval FROM rt WHERE day <= DATE '{TRAIN_END}' GROUP BY 1)"""


def routines(t: Tables):
    types = t.places.select("business_id", "business_type")
    return h.gaps(t.research.where("visit_type = 'routine'")).join(types, "business_id")


@query("wf19_overdue_ratio", f"""SELECT business_id, record_id, round(greatest(0.2::DOUBLE, least(2.0::DOUBLE, coalesce(CAST(date_trunc('month', day) AS DATE) - last_visit, iv) / iv)), 6) + 0.0 AS overdue
FROM (SELECT rt.business_id, rt.record_id, rt.day, greatest(coalesce(interval, (SELECT median(interval) FROM iv)), 120::DOUBLE) AS iv,
 (SELECT max(v.day) FROM research v WHERE v.business_id = rt.business_id AND v.day < CAST(date_trunc('month', rt.day) AS DATE)) AS last_visit
 FROM rt LEFT JOIN iv USING (business_type) WHERE rt.day > DATE '{TRAIN_END}')""", _INTERVAL)
def wf19(t: Tables):
    rt = routines(t)
    iv = rt.where(F.col("day") <= TRAIN_END).groupBy("business_type").agg(F.median("gap").alias("interval"))
    rows = rt.where(F.col("day") > TRAIN_END).select("business_id", "record_id", "day", "business_type")
    rows = joins.with_scalars(rows, iv.agg(F.median("interval").alias("usual")))
    out = h.overdue_ratio(rows, t.research.select("business_id", "day"), iv, F.col("usual"))
    return _r(out.select("business_id", "record_id", "overdue"), "overdue")


@query("wf20_gaps", "SELECT business_id, record_id, gap, next_gap, prev_major, round(record, 6) + 0.0 AS record FROM rt", _INTERVAL)
def wf20(t: Tables):
    return _r(h.gaps(t.research.where("visit_type = 'routine'")).select("business_id", "record_id", "gap", "next_gap", "prev_major", "record"), "record")


@query("wf21_left_truncation", """SELECT year(day) AS year, median(s.prior_n) AS median_prior_n, median(w_prior_n) AS median_w_prior_n
FROM since s JOIN trail t USING (business_id, record_id) WHERE visit_type = 'routine' GROUP BY 1""", _SINCE + "," + _year("score"))
def wf21(t: Tables):
    f = h.trailing(h.since_start(t.research)).where("visit_type = 'routine'")
    return f.groupBy(F.year("day").alias("year")).agg(F.median("prior_n").alias("median_prior_n"), F.median("w_prior_n").alias("median_w_prior_n"))


# ── joins ──

@query("j1_attribute_lookup", """SELECT business_id, income, round(pct, 6) + 0.0 AS pct, district FROM place LEFT JOIN zip_attr USING (zip5)""")
def j1(t: Tables):
    from ..sources.adapt import zip_attributes
    p = t.located.join(zip_attributes(t.places), "zip5", "left")
    return _r(p.select("business_id", "income", "pct", "district"), "pct")


@query("j2_asof_backward", """SELECT r.business_id, r.record_id, CAST((SELECT max(v.day) FROM research v WHERE v.business_id = r.business_id
 AND v.day < CAST(date_trunc('month', r.day) AS DATE)) AS VARCHAR) AS last_visit FROM research r WHERE visit_type = 'routine'""")
def j2(t: Tables):
    rows = t.research.where("visit_type = 'routine'").select("business_id", "record_id", fn.month_start(F.col("day")).alias("month_start"))
    return h.asof_backward(rows, t.research, "business_id", "month_start", "day", "last_visit").select("business_id", "record_id", "last_visit")


@query("j3_history_before", "SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, visits_year, CAST(last_day AS VARCHAR) AS last_day FROM snap", SNAP)
def j3(t: Tables):
    return snaps(t).select("business_id", "as_of", "visits_year", "last_day")


@query("j4_forward_labels", "SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, y, event, y_d90, y_d180, y_d270 FROM snap", SNAP)
def j4(t: Tables):
    f = snaps(t, horizons={"d90": 90, "d180": 180, "d270": 270})
    return f.select("business_id", "as_of", "y", "event", "y_d90", "y_d180", "y_d270")


@query("j5_interval_delete", """SELECT business_id, record_id FROM research r WHERE NOT (visit_type = 'routine' AND record_id % 3 = 0)
 AND NOT (visit_type IN ('reinspection', 'followup') AND EXISTS (SELECT 1 FROM research d WHERE d.business_id = r.business_id
  AND d.visit_type = 'routine' AND d.record_id % 3 = 0 AND r.dn - d.dn BETWEEN 0 AND 45))""")
def j5(t: Tables):
    drop = (F.col("visit_type") == "routine") & (F.col("record_id") % 3 == 0)
    return joins.censor(t.research, drop, 45).select("business_id", "record_id")


@query("j6_complaint_prompted", """SELECT DISTINCT v.business_id, v.record_id FROM merged v
JOIN merged c ON c.business_id = v.business_id AND c.visit_type = 'complaint' AND v.dn - c.dn BETWEEN 0 AND 60 WHERE v.visit_type = 'reinspection'""")
def j6(t: Tables):
    return h.prompted_by_complaint(t.visits).where("prompted").select("business_id", "record_id")


@query("j9_colocated_pairs", """SELECT address, CAST(same_day AS INT) AS same_day, count(*) AS pairs, CAST(sum(ma + mb) AS BIGINT) AS majors, CAST(sum(ma * mb) AS BIGINT) AS both FROM (
 SELECT a.address, a.day = b.day AS same_day, CAST(a.n_major > 0 AS INT) AS ma, CAST(b.n_major > 0 AS INT) AS mb FROM addr a JOIN addr b ON a.address = b.address AND a.business_id < b.business_id
 WHERE a.day = b.day OR abs(a.day - b.day) >= 60) GROUP BY 1, 2""".replace("AS both", 'AS "both"'),
       "addr AS MATERIALIZED (SELECT v.business_id, v.day, v.n_major, p.address FROM visit v JOIN place0 p USING (business_id) WHERE visit_type = 'routine')")
def j9(t: Tables):
    rt = t.visits.where("visit_type = 'routine'").join(t.places.select("business_id", "address"), "business_id")
    return joins.colocated_sums(rt.select("business_id", "address", "dn", (F.col("n_major") > 0).alias("major")))


@query("j10_archive_match", """SELECT a.facility_id, coalesce(i.business_id, f.business_id) AS matched
FROM (SELECT 'F' || business_id AS facility_id, CASE WHEN business_id % 4 = 0 THEN NULL WHEN business_id % 9 = 0 THEN -business_id ELSE business_id END AS business_id
 FROM place0 UNION ALL SELECT 'X' || business_id, NULL FROM place0 WHERE business_id % 50 = 0) a
LEFT JOIN place0 i ON i.business_id = a.business_id LEFT JOIN place0 f ON f.facility_id = a.facility_id""")
def j10(t: Tables):
    k = F.col("business_id")
    old = t.places.select(F.col("facility_id"), F.when(k % 4 == 0, None).when(k % 9 == 0, -k).otherwise(k).alias("business_id"))
    gone = t.places.where(k % 50 == 0).select(F.concat(F.lit("X"), k.cast("string")).alias("facility_id"), F.lit(None).cast("long").alias("business_id"))
    return joins.match_places(old.unionByName(gone), t.places).select("facility_id", "matched")


@query("j11_unnotified", f"""SELECT facility_id FROM place0 WHERE kind = 'restaurant' AND NOT (business_id % 3 > 0 AND DATE '{LIST_DATE}' - (DATE '{LIST_DATE}' - CAST(business_id % 30 AS INT)) >= 14)""")
def j11(t: Tables):
    k = F.col("business_id")
    sent = t.places.where(k % 3 > 0).select("facility_id", F.date_sub(F.lit(LIST_DATE).cast("date"), (k % 30).cast("int")).alias("date_sent"))
    return joins.not_notified(t.places.where("kind = 'restaurant'").select("facility_id"), sent, LIST_DATE)


@query("j12_hold_matches", """SELECT h.facility_id, l.facility_id AS listed_as FROM (SELECT CASE WHEN business_id % 2 = 0 THEN lower(facility_id) ELSE facility_id || 'z' END AS facility_id
 FROM place0 WHERE business_id % 20 < 2) h LEFT JOIN place0 l ON lower(l.facility_id) = lower(h.facility_id)""")
def j12(t: Tables):
    k = F.col("business_id")
    held = t.places.where(k % 20 < 2).select(F.when(k % 2 == 0, F.lower("facility_id")).otherwise(F.concat("facility_id", F.lit("z"))).alias("facility_id"))
    return joins.hold_matches(held, t.places.select("facility_id"))


@query("j13_index_detail_agreement", """SELECT business_id, CASE WHEN business_id % 40 = 0 THEN 'missing' ELSE 'name' END AS problem FROM place0
WHERE business_id % 40 = 0 OR business_id % 33 = 0""")
def j13(t: Tables):
    k = F.col("business_id")
    detail = t.places.where(k % 40 != 0).select("business_id", F.when(k % 33 == 0, "other").otherwise(F.col("name")).alias("name"), "address")
    return joins.disagreements(t.places.select("business_id", "name", "address"), detail, "business_id", ["name", "address"])


@query("j14_align_arms", """SELECT record_id, score_a, score_b FROM a JOIN b USING (record_id)""", _SINCE + """, a AS MATERIALIZED (SELECT record_id, last_score AS score_a FROM since WHERE visit_type = 'routine'),
b AS MATERIALIZED (SELECT record_id, last_rated AS score_b FROM since WHERE visit_type = 'routine')""")
def j14(t: Tables):
    f = h.since_start(t.research).where("visit_type = 'routine'")
    return joins.align_arms(f.select("record_id", F.col("last_score").alias("score_a")), f.select("record_id", F.col("last_rated").alias("score_b")), "record_id")
