"""Cleaning, scalar functions and the small sources."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import clean, episodes, history, snapshot
from ..sources import adapt, readers
from .registry import LIST_DATE, Tables, query

_WORDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in adapt.ITEM_WORDS.items())
_THEMES = "CASE theme WHEN 'economy' THEN 'hands' WHEN 'large' THEN 'temperature' WHEN 'medium' THEN 'sanitizing' WHEN 'promo' THEN 'sewage' WHEN 'small' THEN 'vermin' ELSE 'other' END"


@query("src3_keyed_upsert", """
SELECT o_custkey AS business_id, arg_max(o_orderkey, o_orderkey // 100 * 1000000000 + o_orderkey) AS kept_id, max(o_orderkey // 100) AS page
FROM orders GROUP BY 1""")
def src3(t: Tables):
    pages = t.table("orders").select(F.col("o_custkey").alias("business_id"), F.col("o_orderkey").alias("kept_id"),
                                     F.floor(F.col("o_orderkey") / 100).alias("page"))
    return readers.latest_by_key(pages, "business_id", ["page", "kept_id"])


@query("src3_pull_complete", """
SELECT count(DISTINCT o_custkey) AS unique_ids, (SELECT count(*) FROM customer) AS total_count,
 CAST(count(DISTINCT o_custkey) >= (SELECT count(*) FROM customer) AS INT) AS complete FROM orders""")
def src3_complete(t: Tables):
    n = t.table("customer").agg(F.count("*").alias("total_count"))
    pages = t.table("orders").select(F.col("o_custkey").alias("business_id"), F.lit(1).alias("k")).distinct()
    got = pages.groupBy("k").agg(F.count("*").alias("unique_ids"))
    return got.join(n.withColumn("k", F.lit(1)), "k").select(
        "unique_ids", "total_count", (F.col("unique_ids") >= F.col("total_count")).alias("complete"))


@query("src4_facility_dimension", """
SELECT o_custkey AS business_id, coalesce(arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'P' || o_orderkey END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END),
 CAST(o_custkey AS VARCHAR)) AS facility_id FROM orders GROUP BY 1""")
def src4(t: Tables):
    r = t.table("orders").select(
        F.col("o_custkey").alias("business_id"), F.col("o_orderkey").alias("record_pos"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("P"), F.col("o_orderkey").cast("string"))).alias("custom_id"))
    return readers.facility_ids(r)


@query("src5_permit_status", """
SELECT business_id, coalesce(nullif(CASE WHEN business_id % 9 = 0 THEN '' ELSE permit_status END, ''), '?') AS status FROM place0""")
def src5(t: Tables):
    p = t.places.withColumn("permit_status", F.when(F.col("business_id") % 9 == 0, "").otherwise(F.col("permit_status")))
    return readers.permit_status(p)


@query("cln1_parse_items", f"""
SELECT {_THEMES} AS theme, severity, CAST(code % 47 + 1 AS VARCHAR) AS code, count(*) AS n,
 sum(length(CASE theme {_WORDS} END)) AS letters
FROM item WHERE severity <> 'note' GROUP BY 1, 2, 3""")
def cln1(t: Tables):
    it = adapt.item_structs(t.spark, t.dir).select(clean.parse_item(F.col("item")).alias("i")).select("i.*")
    return (it.where(F.col("severity").isNotNull()).groupBy("theme", "severity", "code")
            .agg(F.count("*").alias("n"), F.sum(F.length("description")).alias("letters")))


@query("cln2_theme_classification", f"SELECT {_THEMES} AS theme, count(*) AS n FROM item WHERE severity <> 'note' GROUP BY 1")
def cln2(t: Tables):
    it = adapt.item_structs(t.spark, t.dir).where("severity <> 'note'").select(F.col("item.violation_accela").alias("text"))
    texts = it.groupBy("text").agg(F.count("*").alias("n"))
    return texts.groupBy(fn.theme_of(F.col("text")).alias("theme")).agg(F.sum("n").alias("n"))


_RAW = """raw AS (
 SELECT record_id, CASE WHEN record_id % 11 = 0 THEN 'Phone Call' WHEN record_id % 13 = 0 THEN 'Status Verification' ELSE source_type END AS source_type,
  CASE WHEN record_id % 7 = 0 THEN 'Self Closed' WHEN record_id % 17 = 0 THEN 'No Access' ELSE status END AS status,
  n_major, n_minor, n_grp FROM rec),
judged AS (
 SELECT *, CASE source_type WHEN 'Phone Call' THEN FALSE WHEN 'Status Verification' THEN status = 'Ordered Closed'
   OR (status <> 'No Access' AND n_major + n_minor + n_grp > 0)
  ELSE status IN ('Complete', 'Ordered Closed', 'Approved to Reopen') OR (status = 'Self Closed' AND n_major + n_minor + n_grp > 0) END AS kept FROM raw)"""


def _raw(t: Tables):
    k = F.col("record_id")
    r = t.records.select(
        "record_id", "n_major", "n_minor", "n_grp",
        F.when(k % 11 == 0, "Phone Call").when(k % 13 == 0, "Status Verification").otherwise(F.col("source_type")).alias("source_type"),
        F.when(k % 7 == 0, "Self Closed").when(k % 17 == 0, "No Access").otherwise(F.col("status")).alias("status"))
    cites = F.col("n_major") + F.col("n_minor") + F.col("n_grp")
    return r.withColumn("kept", clean.kept_record(clean.read_type(F.col("source_type")), F.col("status"), cites))


@query("cln3_kept_records", "SELECT source_type, status, CAST(kept AS INT) AS kept, count(*) AS n FROM judged GROUP BY 1, 2, 3", _RAW)
def cln3(t: Tables):
    return _raw(t).groupBy("source_type", "status", "kept").agg(F.count("*").alias("n"))


@query("cln4_drop_counts", "SELECT source_type, status, count(*) AS n FROM judged WHERE NOT kept GROUP BY 1, 2", _RAW)
def cln4(t: Tables):
    return clean.drop_counts(_raw(t))


@query("cln5_valid_scores", "SELECT visit_type, status, grade, count(score) AS scored, CAST(sum(score) AS BIGINT) AS total FROM rec GROUP BY 1, 2, 3")
def cln5(t: Tables):
    return t.records.groupBy("visit_type", "status", "grade").agg(
        F.count("score").alias("scored"), F.sum("score").cast("long").alias("total"))


@query("cln6_closure_orders", """
SELECT status, CAST(status = 'Ordered Closed' OR (status = 'Self Closed' AND n_major > 0) AS INT) AS is_order, count(*) AS n FROM judged GROUP BY 1, 2""", _RAW)
def cln6(t: Tables):
    r = _raw(t)
    return r.groupBy("status", clean.closure_order_flag(F.col("status"), F.col("n_major")).alias("is_order")).agg(F.count("*").alias("n"))


@query("cln7_same_day_merge", """
SELECT business_id, CAST(day AS VARCHAR) AS day, visit_type, record_id, status, score, grade, n_major, n_minor, n_grp, n_records FROM merged0""")
def cln7(t: Tables):
    return clean.merge_same_day(t.records).select("business_id", "day", "visit_type", "record_id", "status", "score", "grade",
                                                  "n_major", "n_minor", "n_grp", "n_records")


@query("cln8_visit_order", "SELECT business_id, record_id, seq FROM merged")
def cln8(t: Tables):
    return t.merged.select("business_id", "record_id", "seq")


@query("cln9_inferred_closures", """
SELECT business_id, record_id, CAST(inferred AS INT) AS inferred, CAST(unplaced AS INT) AS unplaced FROM inferred WHERE inferred OR unplaced""")
def cln9(t: Tables):
    v = episodes.infer_closures(t.merged, adapt.TABLE_RULES)
    return v.where("inferred or unplaced").select("business_id", "record_id", "inferred", "unplaced")


@query("cln10_followup_retyping", "SELECT business_id, record_id, visit_type FROM visit")
def cln10(t: Tables):
    return t.visits.select("business_id", "record_id", "visit_type")


@query("cln11_closure_episodes", """
SELECT business_id, record_id, episode, closure, CAST(reopened AS INT) AS reopened, CAST(reopened_on AS VARCHAR) AS reopened_on, CAST(ends_open AS INT) AS ends_open
FROM visit WHERE closed""")
def cln11(t: Tables):
    return t.visits.where("closed").select("business_id", "record_id", F.col("episode").cast("long").alias("episode"), "closure", "reopened", "reopened_on", "ends_open")


@query("cln12_closure_reasons", "SELECT closure_order, CAST(closure_inferred AS INT) AS closure_inferred, count(*) AS n FROM visit WHERE closure_order IS NOT NULL GROUP BY 1, 2")
def cln12(t: Tables):
    return t.visits.where("closure_order is not null").groupBy("closure_order", "closure_inferred").agg(F.count("*").alias("n"))


@query("cln13_tier_counts", "SELECT record_id, n_major, n_minor, n_grp FROM rec")
def cln13(t: Tables):
    return t.records.select("record_id", "n_major", "n_minor", "n_grp")


@query("cln14_theme_severity_counts", "SELECT theme, severity, count(*) AS n FROM item WHERE severity <> 'note' GROUP BY 1, 2")
def cln14(t: Tables):
    return t.items.where("severity <> 'note'").groupBy("theme", "severity").agg(F.count("*").alias("n"))


@query("cln15_kinds", "SELECT business_type, kind, count(*) AS n FROM place0 GROUP BY 1, 2")
def cln15(t: Tables):
    return t.places.groupBy("business_type", "kind").agg(F.count("*").alias("n"))


@query("cln15_unknown_types", "SELECT DISTINCT business_type FROM place0 WHERE kind IS NULL")
def cln15_unknown(t: Tables):
    return clean.unknown_types(t.places, adapt.KINDS, adapt.EXCLUDED)


@query("cln16_unique_facility_ids", """
SELECT business_id, CASE WHEN count(*) OVER (PARTITION BY fid) > 1 THEN fid || '-' || business_id ELSE fid END AS facility_id
FROM (SELECT business_id, CASE WHEN business_id % 3 = 0 THEN 'T' || business_id ELSE 'S' || business_id // 2 END AS fid FROM place0)""")
def cln16(t: Tables):
    k = F.col("business_id")
    p = t.places.select("business_id", F.when(k % 3 == 0, F.concat(F.lit("T"), k.cast("string"))).otherwise(
        F.concat(F.lit("S"), F.floor(k / 2).cast("string"))).alias("facility_id"))
    return clean.unique_facility_ids(p)


@query("cln17_research_rows", "SELECT business_id, record_id, visit_type, score, major FROM research")
def cln17(t: Tables):
    return t.research.select("business_id", "record_id", "visit_type", "score", "major")


@query("cln17_duplicate_routine_days", """
SELECT business_id, CAST(day AS VARCHAR) AS day, count(*) AS n FROM rec WHERE visit_type = 'routine' GROUP BY 1, 2 HAVING count(*) > 1""")
def cln17_dups(t: Tables):
    return clean.duplicate_routine_days(t.records)


@query("cln18_rated_scores", "SELECT business_id, record_id, rated FROM visit WHERE rated IS NOT NULL")
def cln18(t: Tables):
    return t.visits.where("rated is not null").select("business_id", "record_id", "rated")


@query("cln19_points_formula", "SELECT record_id, greatest(0, 100 - 4 * n_major - 2 * n_minor - n_grp) AS points FROM rec")
def cln19(t: Tables):
    return t.records.select("record_id", fn.points_formula(F.col("n_major"), F.col("n_minor"), F.col("n_grp")).alias("points"))


@query("cln20_history_order", """
SELECT business_id, record_id, row_number() OVER (PARTITION BY business_id ORDER BY dn, later, seq) - 1 AS prior_n FROM research""")
def cln20(t: Tables):
    return history.since_start(t.research).select("business_id", "record_id", "prior_n")


@query("cln21_routine_rows", """
SELECT r.business_id, r.record_id, coalesce(CASE WHEN r.business_id % 10 = 0 THEN NULL ELSE p.business_type END, 'NA') AS business_type
FROM research r JOIN place0 p USING (business_id) WHERE visit_type = 'routine'""")
def cln21(t: Tables):
    types = t.places.select("business_id", F.when(F.col("business_id") % 10 != 0, F.col("business_type")).alias("business_type"))
    return clean.routine_rows(t.research.join(types, "business_id"), ["business_type"]).select("business_id", "record_id", "business_type")


@query("cln22_scopes", f"""
SELECT count(*) FILTER (kind IN ('restaurant', 'limited', 'market') AND district IS NOT NULL) AS city,
 count(*) FILTER (kind = 'restaurant' AND district IS NOT NULL) AS city_bands, count(*) FILTER (kind = 'restaurant') AS train,
 count(*) FILTER (kind IN ('restaurant', 'limited', 'market')) AS county, count(*) FILTER (kind = 'restaurant') AS county_bands,
 count(*) FILTER (kind = 'restaurant' AND district IS NULL) AS outside_bands,
 count(*) FILTER (DATE '{LIST_DATE}' - last_day <= 550 AND permit_status <> 'Expired') AS active_now
FROM place LEFT JOIN (SELECT business_id, max(day) AS last_day FROM visit WHERE day < DATE '{LIST_DATE}' GROUP BY 1) USING (business_id)""")
def cln22(t: Tables):
    day = F.lit(LIST_DATE).cast("date")
    last = t.visits.where(F.col("day") < day).groupBy("business_id").agg(F.max("day").alias("last_day"))
    p = t.located.join(last, "business_id", "left")
    now = clean.active(F.col("last_day"), day, True, F.col("permit_status"))
    return p.agg(*[F.count_if(c).alias(n) for n, c in clean.scopes().items()], F.count_if(now).alias("active_now"))


# ── scalar functions ──

@query("fn1_norm_key", """
SELECT business_id, trim(regexp_replace(lower('  ' || name || ' @ ' || address || '!'), '[^a-z0-9]+', ' ', 'g')) AS key FROM place0""")
def fn1(t: Tables):
    return t.places.select("business_id", fn.norm_key(F.concat(F.lit("  "), "name", F.lit(" @ "), "address", F.lit("!"))).alias("key"))


@query("fn2_safe_int", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_quantity * 0.5::DOUBLE) AS INT) AS half FROM lineitem WHERE l_returnflag <> 'N'
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL FROM lineitem WHERE l_returnflag = 'N'""")
def fn2(t: Tables):
    text = F.when(F.col("l_returnflag") == "N", "n/a").otherwise((F.col("l_quantity") * 0.5).cast("string"))
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fn.safe_int(text).alias("half"))


@query("fn3_zip", """
SELECT business_id, CASE WHEN business_id % 5 = 0 THEN NULL ELSE zip5 END AS zip5, CASE WHEN business_id % 5 = 0 THEN NULL ELSE substr(zip5, 1, 3) END AS zip3 FROM place0""")
def fn3(t: Tables):
    text = F.when(F.col("business_id") % 5 == 0, "unknown").otherwise(F.concat(F.lit("CA "), "zip5", F.lit("-0001")))
    return t.places.select("business_id", fn.zip5(text).alias("zip5"), fn.zip3(fn.zip5(text)).alias("zip3"))


@query("fn4_calendar", """
SELECT record_id, CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS month_start, CAST(last_day(day) AS VARCHAR) AS month_end,
 year(day) || 'Q' || quarter(day) AS quarter, strftime(day, '%Y-%m') AS month FROM rec""")
def fn4(t: Tables):
    d = F.col("day")
    return t.records.select("record_id", fn.month_start(d).alias("month_start"), F.last_day(d).alias("month_end"),
                            fn.quarter_label(d).alias("quarter"), fn.month_label(d).alias("month"))


@query("fn5_origin_dates", """
SELECT CAST(a AS VARCHAR) AS first, CAST(b AS VARCHAR) AS through, CAST(a + 365 AS VARCHAR) AS snap_first, CAST(c AS VARCHAR) AS confirm,
 CAST(CAST(c - INTERVAL 6 MONTH AS DATE) AS VARCHAR) AS validate_1, CAST(CAST(c - INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS validate_2
FROM (SELECT min(day) AS a, max(day) AS b, CAST(date_trunc('month', max(day) - 365) AS DATE) AS c FROM rec)""")
def fn5(t: Tables):
    return snapshot.origin_dates(t.records)


@query("fn6_ages", """
SELECT r.record_id, round((day - opened_date) / 365.25::DOUBLE, 6) + 0.0 AS age, CASE WHEN day >= opened_date THEN round((day - opened_date) / 365.25::DOUBLE, 6) + 0.0 END AS possible_age
FROM rec r JOIN place0 USING (business_id)""")
def fn6(t: Tables):
    r = t.records.join(t.places.select("business_id", "opened_date"), "business_id")
    return r.select("record_id", fn.r6(fn.age_years(F.col("day"), F.col("opened_date"))).alias("age"),
                    fn.r6(fn.possible_age(F.col("day"), F.col("opened_date"))).alias("possible_age"))


@query("fn7_within_months", f"""
SELECT record_id, CAST((DATE '{LIST_DATE}' - day) / 30.44::DOUBLE BETWEEN 0 AND 36 AS INT) AS in_36 FROM rec""")
def fn7(t: Tables):
    return t.records.select("record_id", fn.within_months(F.col("day"), F.lit(LIST_DATE).cast("date"), 36).alias("in_36"))


@query("fn8_wilson", """
SELECT business_id, k, n, round((p + 3.8416::DOUBLE / (2 * n)) / d - h, 4) + 0.0 AS low, round((p + 3.8416::DOUBLE / (2 * n)) / d + h, 4) + 0.0 AS high
FROM (SELECT *, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / d AS h FROM (
 SELECT business_id, k, n, k / CAST(n AS DOUBLE) AS p, 1 + 3.8416::DOUBLE / n AS d FROM (
  SELECT business_id, count(*) FILTER (n_major > 0) AS k, count(*) AS n FROM rec GROUP BY 1)))""")
def fn8(t: Tables):
    g = t.records.groupBy("business_id").agg(F.count_if(F.col("n_major") > 0).alias("k"), F.count("*").alias("n"))
    low, high = fn.wilson(F.col("k"), F.col("n"))
    return g.select("business_id", "k", "n", low.alias("low"), high.alias("high"))


@query("fn9_log_odds", """
SELECT business_id, round(ln(q / (1 - q)), 6) + 0.0 AS log_odds FROM (SELECT business_id,
 greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, count(*) FILTER (n_major > 0) / CAST(count(*) AS DOUBLE))) AS q FROM rec GROUP BY 1)""")
def fn9(t: Tables):
    g = t.records.groupBy("business_id").agg((F.count_if(F.col("n_major") > 0) / F.count("*")).alias("p"))
    return g.select("business_id", fn.r6(fn.log_odds(F.col("p"))).alias("log_odds"))


@query("fn10_half_up", "SELECT business_id, CAST(floor(avg(score) + 0.5) AS BIGINT) AS mean_score FROM rec WHERE score IS NOT NULL GROUP BY 1")
def fn10(t: Tables):
    return t.records.where("score is not null").groupBy("business_id").agg(fn.half_up(F.avg("score")).alias("mean_score"))


@query("fn11_metres", """
SELECT business_id, round(sqrt(dx * dx + dy * dy), 3) + 0.0 AS meters FROM (SELECT business_id,
 (-117.1::DOUBLE - lon) * 111320.0::DOUBLE * cos(lat * 3.141592653589793::DOUBLE / 180.0::DOUBLE) AS dx, (32.8::DOUBLE - lat) * 110540.0::DOUBLE AS dy FROM place0)""")
def fn11(t: Tables):
    return t.places.select("business_id", fn.r6(fn.metres(F.col("lon"), F.col("lat"), F.lit(-117.1), F.lit(32.8)), 3).alias("meters"))


@query("fn12_search_tokens", """
SELECT business_id, lower(split_part(name, '#', 1)) || '#' || split_part(name, '#', 2) || '|' || (business_id // 3) || '|test|street' AS tokens FROM place0""")
def fn12(t: Tables):
    text = F.concat_ws(" and ", "name", "address")
    return t.places.select("business_id", F.array_join(fn.search_tokens(text), "|").alias("tokens"))


@query("fn13_visit_phrase", """
SELECT visit_type, source_type, CASE visit_type WHEN 'routine' THEN 'routine inspection' WHEN 'reinspection' THEN 'reinspection'
 ELSE 'complaint or other field visit [type read from: ' || source_type || ']' END AS phrase, count(*) AS n FROM rec GROUP BY 1, 2, 3""")
def fn13(t: Tables):
    return t.records.groupBy("visit_type", "source_type", fn.visit_phrase(F.col("visit_type"), F.col("source_type")).alias("phrase")).agg(F.count("*").alias("n"))


@query("fn14_plain_number", r"""
SELECT record_id, CASE WHEN score IS NULL THEN '' ELSE regexp_replace(printf('%.1f', score * 0.5::DOUBLE), '\.?0+$', '') END AS text FROM rec""")
def fn14(t: Tables):
    return t.records.select("record_id", fn.plain_number(F.col("score") * 0.5).alias("text"))


@query("fn15_name_group", """
SELECT name_group, count(*) AS n FROM (SELECT CASE WHEN p_name LIKE 'red %' OR p_name LIKE '% ring' THEN 'first'
 WHEN p_name LIKE 'blue %' THEN 'second' ELSE 'unclassified' END AS name_group FROM part) GROUP BY 1""")
def fn15(t: Tables):
    g = fn.name_group(F.col("p_name"), {"first": ["red", "ring"], "second": ["blue"]})
    return t.table("part").groupBy(g.alias("name_group")).agg(F.count("*").alias("n"))


@query("snk5_formula_guard", """
SELECT record_id, CASE WHEN record_id % 4 = 0 THEN '''=' || status WHEN record_id % 4 = 1 THEN '-' || record_id WHEN record_id % 4 = 2 THEN '''@' || status
 ELSE status END AS cell, CASE WHEN record_id % 4 = 0 THEN '=' || status WHEN record_id % 4 = 1 THEN '-' || record_id WHEN record_id % 4 = 2 THEN '@' || status
 ELSE status END AS back FROM rec""")
def snk5(t: Tables):
    k = F.col("record_id")
    text = (F.when(k % 4 == 0, F.concat(F.lit("="), "status")).when(k % 4 == 1, F.concat(F.lit("-"), k.cast("string")))
            .when(k % 4 == 2, F.concat(F.lit("@"), "status")).otherwise(F.col("status")))
    return t.records.select("record_id", fn.formula_safe(text).alias("cell"), fn.formula_text(fn.formula_safe(text)).alias("back"))
