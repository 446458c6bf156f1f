"""Due lists, published lists and their filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expand_streets, norm_key, search_tokens
from ..operators import aggregates as ag, bands as bd, geo, joins, ranking as rk, snapshot as sn, views as vw, worklist as wl
from ..operators.ordering import positions
from ..session import cut
from ..sources.adapt import TABLE_RULES as RULES
from .evaluation import SCORED
from .features import _USED, _r, snap_ctes, snaps
from .records import FLAGS, RV, flags
from .registry import LIST_DATE, LIST_MONTH, Tables, query

BACKTEST_MONTHS = sn.month_starts("2000-01-01", "2000-12-01")


def due_ctes(months_sql: str, status: bool = True) -> str:
    """The list of each month by joining places to their history, as CTEs ending in ``wlist``."""
    return f"""
months AS ({months_sql}),
hist AS (SELECT v.*, m.month FROM visit v JOIN months m ON v.day < m.month),
place_m AS (SELECT h.business_id, h.month, max(day) AS last_visit, max(day) FILTER (visit_type = 'routine') AS last_routine_date,
  arg_max(score, dn) FILTER (visit_type = 'routine' AND score IS NOT NULL) AS any_score, avg(rated) FILTER (visit_type = 'routine') AS mean_rated,
  count(*) FILTER (visit_type = 'routine') AS routines, count(*) FILTER (visit_type = 'routine' AND n_major > 0) AS routines_major,
  count(*) FILTER (closure = 'health' AND month - day <= 730) AS closures_24m FROM hist h GROUP BY 1, 2 HAVING max(day) FILTER (visit_type = 'routine') IS NOT NULL),
gapm AS (SELECT p.business_type, h.month, h.dn - lag(h.dn) OVER (PARTITION BY h.business_id, h.month ORDER BY h.dn) AS t, TRUE AS event FROM hist h JOIN place p ON p.business_id = h.business_id WHERE visit_type = 'routine'),
spell AS (SELECT * FROM gapm WHERE t IS NOT NULL UNION ALL SELECT p.business_type, m.month, m.month - m.last_routine_date, FALSE FROM place_m m JOIN place p ON p.business_id = m.business_id WHERE m.month - m.last_visit <= 550),
spell2 AS (SELECT business_type, month, t, event FROM spell UNION ALL SELECT '*', month, t, event FROM spell),
risk AS (SELECT month, business_type, t, count(*) FILTER (event) AS e, count(*) AS n FROM spell2 GROUP BY 1, 2, 3),
surv AS (SELECT *, product(1 - e / CAST(at_risk AS DOUBLE)) OVER (PARTITION BY month, business_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (
 SELECT *, sum(n) OVER (PARTITION BY month, business_type ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk FROM risk)),
km AS (SELECT month, business_type, CAST(min(t) FILTER (e > 0 AND s <= 0.5 + 1e-9) AS DOUBLE) AS median, CAST(sum(e) AS BIGINT) AS events FROM surv GROUP BY 1, 2),
pool AS (SELECT k.month, coalesce(k.median, (SELECT median(t) FROM gapm g WHERE g.month = k.month), 365) AS pooled FROM km k WHERE business_type = '*'),
wl0 AS (SELECT m.*, p.facility_id, p.business_type, p.district, p.kind, coalesce(CASE WHEN k.events >= 30 THEN k.median END, o.pooled) AS interval
 FROM place_m m JOIN place p ON p.business_id = m.business_id LEFT JOIN km k ON k.month = m.month AND k.business_type = p.business_type JOIN pool o ON o.month = m.month
 WHERE m.month - m.last_visit <= 550 AND p.district IS NOT NULL {"AND p.permit_status <> 'Expired'" if status else ''}),
wl1 AS (SELECT *, last_routine_date + CAST(round(interval) AS INT) AS due_estimate, last_day(month) - last_routine_date >= interval - 30 AS due, round(100 - coalesce(mean_rated, 97), 1) + 0.0 AS mean_points FROM wl0),
wlist AS (SELECT *, row_number() OVER w AS rule_order_all, CASE WHEN due THEN sum(CAST(due AS INT)) OVER w END AS rule_order FROM wl1
 WINDOW w AS (PARTITION BY month, district ORDER BY mean_points DESC, due_estimate, facility_id))"""


ONE_MONTH = due_ctes(f"SELECT DATE '{LIST_MONTH}' AS month")


def this_month(t: Tables, **kw):
    return wl.monthly(t.visits, t.located, [LIST_MONTH], RULES, **kw)


@query("wl1_monthly_worklist", """SELECT facility_id, district, business_type, CAST(last_routine_date AS VARCHAR) AS last_routine_date, interval, CAST(due_estimate AS VARCHAR) AS due_estimate, mean_points,
 closures_24m, rule_order_all, CAST(rule_order AS BIGINT) AS rule_order FROM wlist WHERE due""", ONE_MONTH)
def wl1(t: Tables):
    f = this_month(t).where("due_this_month")
    return f.select("facility_id", "district", "business_type", "last_routine_date", "interval", "due_estimate", "mean_points", "closures_24m", "rule_order_all", "rule_order")


@query("rk6_list_order", "SELECT facility_id, district, rule_order_all, CAST(rule_order AS BIGINT) AS rule_order FROM wlist", ONE_MONTH)
def rk6(t: Tables):
    return this_month(t).select("facility_id", "district", "rule_order_all", "rule_order")


@query("rk6_list_order_with_card", """SELECT facility_id, district, row_number() OVER (PARTITION BY district ORDER BY CAST(held AS INT), CAST(esc AND NOT held AS INT) DESC, CASE WHEN NOT held THEN pts END DESC NULLS LAST,
 CASE WHEN NOT held THEN mean_points END DESC NULLS LAST, due_estimate, facility_id) AS rule_order_all, CASE WHEN NOT held THEN pts END AS rule_points FROM (
 SELECT *, business_id % 25 = 0 AS held, business_id % 7 = 0 AS esc, CASE WHEN business_id % 2 = 0 THEN CAST(business_id % 30 AS DOUBLE) ELSE mean_points END AS pts FROM wlist)""", ONE_MONTH)
def rk6_card(t: Tables):
    k = F.col("business_id")
    card = t.places.select("facility_id", F.when(k % 2 == 0, (k % 30).cast("double")).alias("card_points"), F.when(k % 7 == 0, "pattern").otherwise("").alias("escalation"))
    held = t.places.where(k % 25 == 0).select("facility_id")
    return this_month(t, card=card, held=held).select("facility_id", "district", "rule_order_all", "rule_points")


@query("rk7_model_order", """SELECT facility_id, row_number() OVER w AS model_order_all, CAST(CASE WHEN due THEN sum(CAST(due AS INT)) OVER w END AS BIGINT) AS model_order FROM (
 SELECT *, business_id % 13 / 13.0::DOUBLE AS risk FROM wlist) WINDOW w AS (PARTITION BY district ORDER BY risk DESC, facility_id)""", ONE_MONTH)
def rk7(t: Tables):
    f = this_month(t).withColumn("model_risk", F.col("business_id") % 13 / 13.0)
    return wl.model_order(f).select("facility_id", "model_order_all", "model_order")


@query("wl2_due_flags", "SELECT business_id, CAST(due_estimate AS VARCHAR) AS due_estimate, CAST(due AS INT) AS due_this_month FROM wl1", ONE_MONTH)
def wl2(t: Tables):
    return this_month(t).select("business_id", "due_estimate", "due_this_month")


@query("wl3_closure_facts", f"""SELECT business_id, count(*) FILTER (day < DATE '{LIST_DATE}' AND DATE '{LIST_DATE}' - day <= 730) AS closures_24m, CAST(max(day) AS VARCHAR) AS last_closure,
 CAST(arg_max(reopened_on, seq) FILTER (seq = mx) AS VARCHAR) AS reopened_on FROM (SELECT *, max(seq) OVER (PARTITION BY business_id) AS mx FROM visit WHERE closed AND closure = 'health') GROUP BY 1""")
def wl3(t: Tables):
    return wl.closure_facts(t.visits, LIST_DATE)


@query("wl4_area_keys", "SELECT business_id, area FROM place")
def wl4(t: Tables):
    return t.located.select("business_id", geo.area_key(F.col("district"), F.col("zip5")).alias("area"))


@query("ag5_km_medians", "SELECT business_type, median, events FROM km", ONE_MONTH)
def ag5(t: Tables):
    asof = wl.as_of_months(t.visits, t.places, [LIST_MONTH], RULES)
    types = t.places.select("business_id", "business_type")
    rt = t.visits.where((F.col("visit_type") == "routine") & (F.col("day") < LIST_MONTH))
    from ..operators.history import gaps
    g = gaps(rt.withColumn("major", F.lit(0.0))).where("gap is not null").select("business_id", F.col("gap").alias("t"), F.lit(True).alias("event"))
    o = asof.where(F.datediff("month", "last_visit") <= 550).select("business_id", F.datediff("month", "last_routine_date").alias("t"), F.lit(False).alias("event"))
    every = g.unionByName(o).join(types, "business_id").select("t", "event", F.explode(F.array("business_type", F.lit("*"))).alias("business_type"))
    return ag.km_median(every, ["business_type"])


_YEAR = due_ctes("SELECT CAST(d AS DATE) AS month FROM range(DATE '2000-01-01', DATE '2000-12-02', INTERVAL 1 MONTH) r(d)", status=False)


@query("ag6_usual_intervals", """SELECT CAST(month AS VARCHAR) AS month, business_type, median AS interval FROM km WHERE business_type <> '*' AND events >= 30 AND median IS NOT NULL
UNION ALL SELECT CAST(month AS VARCHAR), NULL, pooled FROM pool""", _YEAR)
def ag6(t: Tables):
    asof = wl.as_of_months(t.visits, t.places, BACKTEST_MONTHS, RULES)
    return wl.usual_intervals(t.visits, t.places.select("business_id", "business_type"), asof, BACKTEST_MONTHS, RULES)


@query("set2_list_backtest", """SELECT CAST(w.month AS VARCHAR) AS month, count(*) FILTER (due) AS listed, count(d.business_id) AS inspected, round(count(d.business_id) FILTER (due) / CAST(greatest(count(d.business_id), 1) AS DOUBLE), 6) + 0.0 AS coverage,
 round(count(d.business_id) FILTER (due) / CAST(greatest(count(*) FILTER (due), 1) AS DOUBLE), 6) + 0.0 AS precision
FROM wlist w LEFT JOIN (SELECT DISTINCT business_id, CAST(date_trunc('month', day) AS DATE) AS month FROM visit WHERE visit_type = 'routine') d ON d.business_id = w.business_id AND d.month = w.month GROUP BY w.month""", _YEAR)
def set2(t: Tables):
    lists = wl.monthly(t.visits, t.located, BACKTEST_MONTHS, RULES, use_status=False)
    return _r(wl.backtest(lists, t.visits), "coverage", "precision")


@query("fn16_list_reasons", """SELECT w.facility_id, CASE WHEN u.used IS NULL THEN 'Mean taken as 97, for want of any score.' ELSE 'Mean ' || printf('%.1f', u.mean) || ' of: ' || u.used || '.' END
 || CASE WHEN w.routines_major > 0 THEN ' Routines with a major: ' || w.routines_major || '/' || w.routines || '.' ELSE '' END AS why
FROM wlist w LEFT JOIN (SELECT u.business_id, string_agg(u.score || CASE WHEN u.closure THEN ' [set for a closure; source: ' || coalesce(CAST(v.score AS VARCHAR), 'none') || ']' ELSE '' END, ', ' ORDER BY u.day, u.seq) AS used,
 avg(u.score) AS mean FROM used u JOIN visit v USING (business_id, seq) GROUP BY 1) u ON u.business_id = w.business_id""", ONE_MONTH + "," + _USED)
def fn16(t: Tables):
    return wl.reasons(this_month(t), sn.scores_used(t.visits, LIST_MONTH, RULES)).select("facility_id", "why")


# ── published list ──

CUTS = [14.0, 11.0, 9.0]
_NOW = snap_ctes(f"SELECT DATE '{LIST_DATE}' AS as_of")
LISTED = _NOW + "," + RV + "," + FLAGS + f""",
listed AS (SELECT fr.business_id, fr.facility_id, fr.name, fr.address, fr.kind, fr.district, f.flags, fr.last_day, CASE WHEN ok THEN avg_deficit END AS points,
  CASE WHEN ok AND avg_deficit >= {CUTS[0]} THEN '1' WHEN ok AND avg_deficit >= {CUTS[1]} THEN '2' WHEN ok AND avg_deficit >= {CUTS[2]} THEN '3' END AS band
 FROM (SELECT *, kind = 'restaurant' AND rated_2y >= 2 AS ok FROM fr WHERE kind IS NOT NULL AND permit_status <> 'Expired') fr JOIN flags f ON f.business_id = fr.business_id)"""


def published(t: Tables):
    """Every listed place with its facts, and points and a band where the rule scores it."""
    from ..operators.clean import scopes
    f = sn.frame(snaps(t, [LIST_DATE]), t.located, scopes()["county"], labelled=False, forward=True)
    ok = (F.col("kind") == "restaurant") & sn.eligible()
    f = f.withColumns({"eligible": ok, "points": F.when(ok, F.col("avg_deficit"))})
    f = f.withColumn("band", F.when(ok, bd.band_of(F.col("avg_deficit"), bd.fixed_cuts(f, CUTS))))
    return f.join(flags(t), "business_id").select("business_id", "facility_id", "name", "address", "kind", "district", "flags", "last_day", "points", "band")


@query("wl6_published_list", "SELECT facility_id, kind, district, flags, points, band FROM listed", LISTED)
def wl6(t: Tables):
    return published(t).select("facility_id", "kind", "district", F.array_join("flags", " ").alias("flags"), "points", "band")


@query("wl5_record_list", """SELECT facility_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(name, '[^A-Za-z]+', ' ', 'g')), address ORDER BY name, business_id) AS rn FROM fr
 WHERE kind IS NOT NULL AND district IS NOT NULL AND permit_status <> 'Expired') WHERE rn = 1""", _NOW)
def wl5(t: Tables):
    from ..operators.clean import scopes
    f = sn.frame(snaps(t, [LIST_DATE]), t.located, scopes()["city"], labelled=False, forward=True)
    f = f.withColumns({"full": F.col("name"), "name": F.regexp_replace("name", "[^A-Za-z]+", " ")})
    return rk.first_per_name_and_address(f, [F.col("full"), F.col("business_id")]).select("facility_id")


@query("wl7_named_places", "SELECT facility_id FROM listed WHERE band IN ('1') AND district IS NOT NULL", LISTED)
def wl7(t: Tables):
    return published(t).where(F.col("band").isin("1") & F.col("district").isNotNull()).select("facility_id")


@query("rk8_display_order", """SELECT facility_id, row_number() OVER (ORDER BY coalesce(CAST(band AS INT), 99), points DESC NULLS LAST, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), facility_id) AS position FROM listed""", LISTED)
def rk8(t: Tables):
    return positions(published(t), [], rk.display_order()).select("facility_id", "position")


@query("rk9_filtered_page", """SELECT facility_id, total FROM (SELECT facility_id, count(*) OVER () AS total, row_number() OVER (ORDER BY coalesce(CAST(band AS INT), 99), points DESC NULLS LAST, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), facility_id) AS p
 FROM listed WHERE district IN (1, 2, 3, 5) AND kind IN ('restaurant', 'limited') AND list_contains(string_split(flags, ' '), 'major') AND contains(lower(name || ' ' || address), 'test')) WHERE p BETWEEN 6 AND 15""", LISTED)
def rk9(t: Tables):
    cond = rk.list_filter(district=[1, 2, 3, 5], kind=["restaurant", "limited"], flag=["major"], q="test st")
    return rk.page(published(t), cond, rk.display_order(), 5, 10).select("facility_id", "total")


@query("rk10_text_search", """SELECT facility_id, match FROM (SELECT *, row_number() OVER (ORDER BY match, name, facility_id) AS p FROM (
 SELECT facility_id, name, (instr(t, 'street') - 1) + (instr(t, '12') - 1) + CASE WHEN instr(t, '12') > 1 AND NOT regexp_matches(substr(t, instr(t, '12') - 1, 1), '[\\s,&]') THEN 500 ELSE 0 END AS match, t
 FROM (SELECT *, regexp_replace(lower(name || ' ' || address), '\\bst\\b', 'street') AS t FROM place0) WHERE instr(t, '12') > 0 AND instr(t, 'street') > 0)) WHERE p <= 8""")
def rk10(t: Tables):
    return rk.search(t.places, search_tokens(F.lit("12 & st.")), expand_streets(F.concat_ws(" ", "name", "address"))).select("facility_id", "match")


@query("rk11_dedupe", """SELECT facility_id FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(name, '[0-9]+', '', 'g'), lower(address) ORDER BY business_id DESC) AS rn FROM place0) WHERE rn = 1""")
def rk11(t: Tables):
    p = t.places.withColumn("name", F.regexp_replace("name", "[0-9]+", ""))
    return rk.first_per_name_and_address(p, [F.col("business_id").desc()]).select("facility_id")


def _has(flag: str) -> str:
    return f"count(*) FILTER (list_contains(string_split(flags, ' '), '{flag}')) AS with_{flag}"


@query("ag11_district_summary", f"SELECT district, count(*) AS places, {', '.join(f'''count(*) FILTER (band = '{b}') AS band_{b}''' for b in '123')}, {_has('major')}, {_has('closed')}, {_has('bc')} FROM listed GROUP BY 1", LISTED)
def ag11(t: Tables):
    return ag.district_summary(published(t))


@query("ag12_band_counts", """SELECT band, CAST(sum(n) OVER (ORDER BY band) AS BIGINT) AS places FROM (SELECT band, count(*) AS n FROM listed WHERE band IS NOT NULL GROUP BY 1) UNION ALL SELECT 'all', count(*) FROM listed""", LISTED)
def ag12(t: Tables):
    return ag.cumulative_band_counts(published(t))


@query("ag12_flag_counts", "SELECT flag, count(*) AS places FROM (SELECT unnest(string_split(flags, ' ')) AS flag FROM listed WHERE flags <> '') GROUP BY 1", LISTED)
def ag12_flags(t: Tables):
    return ag.flag_counts(published(t))


@query("ag12_type_counts", "SELECT coalesce(kind, 'other') AS kind, count(*) AS places FROM place0 GROUP BY 1")
def ag12_types(t: Tables):
    return ag.type_counts(t.places)


_HELD = "business_id % 12 = 0"


@query("vw9_holds", f"SELECT facility_id, CASE WHEN NOT {_HELD} THEN points END AS points, CASE WHEN NOT {_HELD} THEN band END AS band, CAST({_HELD} AS INT) AS on_hold FROM listed".replace("NOT business_id % 12 = 0", "NOT (business_id % 12 = 0)"), LISTED)
def vw9(t: Tables):
    held = t.places.where(_HELD).select("facility_id")
    return vw.apply_holds(published(t), held).select("facility_id", "points", "band", "on_hold")


@query("vw10_hold_leaks", f"SELECT facility_id FROM listed WHERE {_HELD} AND (points IS NOT NULL OR business_id % 24 = 0)", LISTED)
def vw10(t: Tables):
    held = t.places.where(_HELD).select("facility_id")
    shown = published(t).withColumn("on_hold", F.col("business_id") % 24 != 0)
    return vw.hold_leaks(shown.withColumn("band", F.lit(None).cast("string")), held).select("facility_id")


@query("snk8_filtered_csv", """SELECT facility_id || ',' || name || ',' || address || ',' || kind || ',' || coalesce(CAST(district AS VARCHAR), '') || ',' || coalesce(band, '') || ',' || coalesce(CAST(CAST(points AS BIGINT) AS VARCHAR), '') || ',' || flags AS line FROM listed WHERE band IS NOT NULL""", LISTED)
def snk8(t: Tables):
    from ..sources.sinks import list_columns
    rows = list_columns(published(t).where("band is not null"))
    return rows.select(F.concat_ws(",", *rows.columns).alias("line"))


@query("set1_union_spells", "SELECT CAST(event AS INT) AS event, count(*) AS n, CAST(sum(t) AS BIGINT) AS days FROM spell GROUP BY 1", ONE_MONTH)
def set1(t: Tables):
    from ..operators.history import gaps
    asof = wl.as_of_months(t.visits, t.places, [LIST_MONTH], RULES)
    rt = t.visits.where((F.col("visit_type") == "routine") & (F.col("day") < LIST_MONTH)).withColumn("major", F.lit(0.0))
    closed = gaps(rt).where("gap is not null").select(F.col("gap").alias("t"), F.lit(True).alias("event"))
    still = asof.where(F.datediff("month", "last_visit") <= 550).select(F.datediff("month", "last_routine_date").alias("t"), F.lit(False).alias("event"))
    return closed.unionByName(still, allowMissingColumns=True).groupBy("event").agg(F.count("*").alias("n"), F.sum("t").alias("days"))


@query("set3_listed_not_due", "SELECT business_id FROM wlist EXCEPT SELECT business_id FROM wlist WHERE due", ONE_MONTH)
def set3(t: Tables):
    f = cut(this_month(t).select("business_id", "due_this_month"))
    return f.select("business_id").exceptAll(f.where("due_this_month").select("business_id"))


@query("set4_types_in_order", """SELECT business_id, day, string_agg(source_type, '; ' ORDER BY first) AS types FROM (SELECT business_id, CAST(day AS VARCHAR) AS day, source_type, min(record_id) AS first FROM rec GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def set4(t: Tables):
    one = t.records.groupBy("business_id", "day", "source_type").agg(F.min("record_pos").alias("_p"))
    return one.groupBy("business_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "source_type"))), lambda x: x["source_type"]), "; ").alias("types"))


# ── public aggregates ──

_PUBLIC = """
pub AS (SELECT p.business_type || ' ' || (CASE WHEN w.business_id % 40 < 2 THEN 'rare ' || w.business_id % 6 ELSE 'usual' END) AS business_type, CAST(w.due AS INT) AS due, CAST(w.routines_major > 0 AS INT) AS with_prior_major, w.mean_points
 FROM wlist w JOIN place p ON p.business_id = w.business_id)"""


def _public(t: Tables):
    k = F.col("business_id")
    f = this_month(t)
    kind = F.concat_ws(" ", "business_type", F.when(k % 40 < 2, F.concat(F.lit("rare "), (k % 6).cast("string"))).otherwise("usual"))
    return f.select(kind.alias("business_type"), F.col("due_this_month").cast("int").alias("due"), (F.col("routines_major") > 0).cast("int").alias("with_prior_major"), "mean_points")


_TYPES = _PUBLIC + """,
pt AS (SELECT CASE WHEN n < 11 THEN 'Other types' ELSE business_type END AS type, CAST(sum(n) AS BIGINT) AS facilities, CAST(sum(due) AS BIGINT) AS due, CAST(sum(wm) AS BIGINT) AS with_prior_major FROM (
 SELECT business_type, count(*) AS n, sum(due) AS due, sum(with_prior_major) AS wm FROM pub GROUP BY 1) GROUP BY 1)"""


@query("ag22_public_types", "SELECT * FROM pt", ONE_MONTH + "," + _TYPES)
def ag22(t: Tables):
    return ag.pooled_types(_public(t))


@query("ag22_risk_bins", """SELECT low, high, count(mean_points) AS facilities, CAST(coalesce(sum(due), 0) AS BIGINT) AS due FROM (VALUES (0, 5), (5, 10), (10, 15), (15, 20), (20, 30), (30, 40), (40, 100)) b(low, high)
LEFT JOIN pub ON mean_points >= low AND (mean_points < high OR (high = 100 AND mean_points <= 100)) GROUP BY 1, 2""", ONE_MONTH + "," + _PUBLIC)
def ag22_bins(t: Tables):
    return ag.risk_bins(_public(t), "mean_points", "due")


def _hide(col: str) -> str:
    return f"""CASE WHEN NOT (({col} > 0 AND {col} < 11) OR (count(*) FILTER ({col} > 0 AND {col} < 11) OVER () = 1 AND {col} >= 11
 AND row_number() OVER (ORDER BY CASE WHEN {col} >= 11 THEN 0 ELSE 1 END, {col}, type) = 1)) THEN {col} END AS {col}"""


@query("ag23_suppressed_types", f"SELECT type, {_hide('facilities')}, {_hide('due')}, with_prior_major FROM pt", ONE_MONTH + "," + _TYPES)
def ag23(t: Tables):
    return ag.suppress_small_cells(ag.pooled_types(_public(t)), ["facilities", "due"], "type")


@query("ag23_totals", """SELECT CASE WHEN NOT (count(*) FILTER (facilities BETWEEN 1 AND 10) = 1 AND count(*) FILTER (facilities > 10) = 0) THEN CAST(sum(facilities) AS BIGINT) END AS facilities,
 CASE WHEN NOT (count(*) FILTER (due BETWEEN 1 AND 10) = 1 AND count(*) FILTER (due > 10) = 0) THEN CAST(sum(due) AS BIGINT) END AS due FROM pt""", ONE_MONTH + "," + _TYPES)
def ag23_totals(t: Tables):
    return ag.withheld_totals(ag.pooled_types(_public(t)), ["facilities", "due"])


@query("ml8_point_rule", "SELECT business_id, 1.0 * avg_deficit + 2 * health_closures + 3 * routines_major AS points FROM fr WHERE kind = 'restaurant'".replace("1.0 *", "CAST(1 AS DOUBLE) *"), _NOW)
def ml8(t: Tables):
    f = sn.frame(snaps(t, [LIST_DATE]), t.located, F.col("kind") == "restaurant", labelled=False)
    w = {"avg_deficit": 1, "health_closures": 2, "routines_major": 3}
    sheet = f.select("business_id", vw.worksheet(w).alias("s"))
    return sheet.select("business_id", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["points"]).alias("points"))


@query("ml15_equal_opportunity_cuts", """SELECT business_type, round(quantile_cont(rule, 0.4) FILTER (y = 1), 6) + 0.0 AS cut FROM scored GROUP BY 1""", SCORED)
def ml15(t: Tables):
    from ..operators.models import equal_opportunity_cuts
    return _r(equal_opportunity_cuts(t.scored, "business_type", "rule", 0.6), "cut")


@query("ml15_equal_opportunity_rates", """SELECT s.business_type, round(avg(CAST(rule >= cut AS INT)), 6) + 0.0 AS flag_rate, round(avg(CAST(rule >= cut AS INT)) FILTER (y = 1), 6) + 0.0 AS recall
FROM scored s JOIN (SELECT business_type, quantile_cont(rule, 0.4) FILTER (y = 1) AS cut FROM scored WHERE year(day) = 2000 GROUP BY 1) c ON c.business_type = s.business_type WHERE year(day) > 2000 GROUP BY 1""", SCORED)
def ml15_rates(t: Tables):
    from ..operators.models import apply_group_cuts, equal_opportunity_cuts
    fit = t.scored.where(F.year("day") == 2000)
    return _r(apply_group_cuts(t.scored.where(F.year("day") > 2000), equal_opportunity_cuts(fit, "business_type", "rule", 0.6), "business_type", "rule"), "flag_rate", "recall")


@query("ml17_keep_set", """SELECT record_id, why_kept FROM (SELECT record_id, 'top' AS why_kept FROM scored WHERE rule >= (SELECT quantile_cont(rule, 0.6) FROM scored)
UNION ALL SELECT record_id, 'random' FROM (SELECT record_id, row_number() OVER (ORDER BY md5('7:' || record_id), record_id) AS p, count(*) OVER () AS n FROM scored WHERE rule < (SELECT quantile_cont(rule, 0.6) FROM scored)) WHERE p <= round(0.1::DOUBLE * n))""", SCORED)
def ml17(t: Tables):
    return wl.keep_set(t.scored.select("record_id", F.col("rule").alias("score")), "record_id", 0.4, 0.1, 7)


@query("rk10_norm_names", "SELECT business_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key FROM place0")
def rk10_names(t: Tables):
    return t.places.select("business_id", norm_key(F.col("name")).alias("key"))


@query("ag24_band_lift", """SELECT band, round(rate, 6) + 0.0 AS rate, round(share, 6) + 0.0 AS share, round(rate / rest, 6) + 0.0 AS lift, round(share - coalesce(lag(share) OVER (ORDER BY band), 0), 6) + 0.0 AS width FROM (
 SELECT band, rate, (sum(n) OVER (ORDER BY band)) / CAST(sum(n) OVER () AS DOUBLE) AS share, max(rate) FILTER (band = 'rest') OVER () AS rest FROM (SELECT coalesce(band, 'rest') AS band, count(*) AS n, avg(CAST(contains(flags, 'major') AS INT)) AS rate FROM listed WHERE points IS NOT NULL GROUP BY 1)) WHERE band <> 'rest'""", LISTED)
def ag24(t: Tables):
    p = cut(published(t).where("points is not null").select(F.coalesce("band", F.lit("rest")).alias("band"), F.exists("flags", lambda f: f.contains("major")).cast("int").alias("hit")))
    g = p.groupBy("band").agg(F.count("*").alias("n"), F.avg("hit").alias("rate"))
    g = joins.with_scalars(g, p.agg(F.count("*").alias("_all")))
    from pyspark.sql import Window as W
    # Four bands at most, so this window holds four rows.
    g = g.withColumn("share", F.sum("n").over(W.orderBy("band")) / F.col("_all"))
    return _r(ag.band_lift(g.select("band", "rate", "share")), "rate", "share", "lift", "width")


