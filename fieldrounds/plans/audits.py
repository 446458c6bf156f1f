"""Bands, curves, audits, drift, monitoring and checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands as bd, checks as ck, monitor as mo, ranking as rk, resample as rs, snapshot as sn, views as vw
from ..operators.aggregates import counts_by_month

from ..session import cut
from ..sources import sinks
from ..sources.adapt import TABLE_RULES
from .evaluation import SCORED
from .features import _r, snap_ctes, snaps
from .lists import LISTED, ONE_MONTH, _TYPES, _public, published
from .records import RV, display
from .registry import LIST_DATE, ORIGIN, ORIGINS, Tables, query
from .resampling import REPS, draw_ctes, pct

RULES = TABLE_RULES
_AT = snap_ctes(f"SELECT DATE '{ORIGIN}' AS as_of")
_ALL_AT = snap_ctes("SELECT * FROM (VALUES " + ", ".join(f"(DATE '{d}')" for d in ORIGINS) + ") v(as_of)")
CUTS = [14.0, 11.0, 9.0]
_BAND = f"CASE WHEN rated_2y >= 2 AND avg_deficit >= {CUTS[0]} THEN '1' WHEN rated_2y >= 2 AND avg_deficit >= {CUTS[1]} THEN '2' WHEN rated_2y >= 2 AND avg_deficit >= {CUTS[2]} THEN '3' END"
ORIGIN_CTE = _AT + f", o AS (SELECT *, avg_deficit AS points, rated_2y >= 2 AS eligible, {_BAND} AS band FROM fr WHERE kind = 'restaurant')"
ORIGINS_CTE = _ALL_AT + f", o AS (SELECT *, avg_deficit AS points, rated_2y >= 2 AS eligible, {_BAND} AS band FROM fr WHERE kind = 'restaurant')"


def origin(t: Tables, dates=(ORIGIN,), horizons=None):
    """Scored restaurants at the backtest origins, written once."""
    f = sn.frame(snaps(t, list(dates), horizons), t.located, F.col("kind") == "restaurant", labelled=False)
    f = sn.baselines(f).withColumns({"points": F.col("avg_deficit"), "eligible": sn.eligible()})
    return cut(f.withColumn("band", F.when(F.col("eligible"), bd.band_of(F.col("points"), bd.fixed_cuts(f, CUTS)))))


@query("bd1_band_cuts", """SELECT share, points AS cut FROM (SELECT s.share, points, row_number() OVER (PARTITION BY s.share ORDER BY abs(cum - s.share * n), points DESC) AS rn FROM (
 SELECT points, sum(count(*)) OVER (ORDER BY points DESC) AS cum, sum(count(*)) OVER () AS n FROM o WHERE eligible GROUP BY points) CROSS JOIN (VALUES (0.025::DOUBLE), (0.075::DOUBLE), (0.175::DOUBLE)) s(share)) WHERE rn = 1""", ORIGIN_CTE)
def bd1(t: Tables):
    cuts = bd.band_cuts(origin(t).where("eligible"))
    shares = F.array(*[F.lit(s) for s in RULES.band_shares])
    return cuts.select(F.explode(F.arrays_zip(shares.alias("share"), F.col("cuts").alias("cut"))).alias("x")).select("x.share", "x.cut")


@query("bd2_assigned_bands", "SELECT business_id, points, band FROM o", ORIGIN_CTE)
def bd2(t: Tables):
    return origin(t).select("business_id", "points", "band")


def _w(k: str, n: str, sign: str) -> str:
    return f"round(({k} / {n}::DOUBLE + 3.8416::DOUBLE / (2 * {n})) / (1 + 3.8416::DOUBLE / {n}) {sign} 1.96::DOUBLE * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + 3.8416::DOUBLE / (4 * {n} * {n})) / (1 + 3.8416::DOUBLE / {n}), 4) + 0.0"


@query("bd3_band_table", f"""SELECT band, min_points, max_points, places, labelled, positives, round(positives / labelled::DOUBLE, 6) + 0.0 AS rate, {_w('positives', 'labelled', '-')} AS low, {_w('positives', 'labelled', '+')} AS high FROM (
 SELECT coalesce(band, 'rest') AS band, min(points) AS min_points, max(points) AS max_points, count(*) AS places, count(y) AS labelled, CAST(coalesce(sum(y), 0) AS BIGINT) AS positives FROM o WHERE eligible GROUP BY 1)""", ORIGIN_CTE)
def bd3(t: Tables):
    return _r(bd.band_table(origin(t)), "rate")


_BASE = """, el AS (SELECT *, row_number() OVER (ORDER BY persistence DESC, coalesce(avg_score, 97), business_id) AS pos FROM o WHERE eligible),
ends AS (SELECT band, sum(count(*)) OVER (ORDER BY band) AS e FROM o WHERE band IS NOT NULL GROUP BY band),
bg AS (SELECT el.*, (SELECT min(band) FROM ends WHERE el.pos <= ends.e) AS baseline_band FROM el)"""


def _baseline(t: Tables):
    f = origin(t).withColumn("_tb", F.coalesce("avg_score", F.lit(97.0)))
    return bd.baseline_groups(f, "persistence", "_tb", "business_id")


@query("bd3_baseline_groups", "SELECT baseline_band, count(*) AS places, count(y) AS labelled, CAST(sum(y) AS BIGINT) AS positives FROM bg WHERE baseline_band IS NOT NULL GROUP BY 1", ORIGIN_CTE + _BASE)
def bd3_base(t: Tables):
    return _baseline(t).where("baseline_band is not null").groupBy("baseline_band").agg(F.count("*").alias("places"), F.count("y").alias("labelled"), F.sum("y").alias("positives"))


@query("bs5_paired_hits", f"""SELECT {pct('diff')} FROM (SELECT rep, CAST(sum(times * d) AS DOUBLE) AS diff FROM (SELECT address, sum(coalesce(y, 0) * (CAST(coalesce(band = '1', FALSE) AS INT) - CAST(coalesce(baseline_band = '1', FALSE) AS INT))) AS d FROM bg GROUP BY 1)
 JOIN wt USING (address) GROUP BY rep)""", ORIGIN_CTE + _BASE + "," + draw_ctes("bg", "address"))
def bs5(t: Tables):
    got = bd.paired_hits(cut(_baseline(t)), "address", "1", REPS).withColumn("diff", F.col("diff").cast("double"))
    return _r(rs.percentiles(got, ["diff"]), "diff_low", "diff_high")


@query("bd4_band_counts", "SELECT CAST(as_of AS VARCHAR) AS as_of, coalesce(band, 'rest') AS band, CAST(sum(y) AS BIGINT) AS k, count(*) AS n FROM o WHERE eligible AND y IS NOT NULL GROUP BY 1, 2", ORIGINS_CTE)
def bd4_counts(t: Tables):
    return bd.band_counts(origin(t, ORIGINS), CUTS)


def _validation(name: str, counts: str, cuts: int = 3, z: float = RULES.band_z) -> str:
    """The merging of bands in SQL, a turn per cut: ``{name}_map`` gives each band's group in the end."""
    out = f"""
{name}_grid AS MATERIALIZED (SELECT a.as_of, b.band, coalesce(c.k, 0) AS k, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT as_of FROM {counts}) a CROSS JOIN range(1, {cuts + 2}) b(band) LEFT JOIN {counts} c ON c.as_of = a.as_of AND c.band = b.band),
{name}_m0 AS (SELECT band, band AS g FROM range(1, {cuts + 2}) b(band)),"""
    for j in range(cuts):
        out += f"""
{name}_c{j} AS (SELECT as_of, g, sum(k)::DOUBLE AS k, sum(n)::DOUBLE AS n FROM {name}_grid JOIN {name}_m{j} USING (band) GROUP BY 1, 2),
{name}_p{j} AS (SELECT h.g, bool_and(coalesce(h.k / nullif(h.n, 0) > l.k / nullif(l.n, 0), FALSE)) AS above, sum(h.k) / nullif(sum(h.n), 0) AS ph, sum(l.k) / nullif(sum(l.n), 0) AS pl, sum(h.n) / count(*) AS nh, sum(l.n) / count(*) AS nl
 FROM {name}_c{j} h JOIN {name}_c{j} l ON l.as_of = h.as_of AND l.g = h.g + 1 GROUP BY h.g),
{name}_b{j} AS (SELECT coalesce(min(g) FILTER (NOT coalesce(above AND sqrt(ph * (1 - ph) / nh + pl * (1 - pl) / nl) > 0 AND (ph - pl) / sqrt(ph * (1 - ph) / nh + pl * (1 - pl) / nl) >= {z}, FALSE)), 99) AS b FROM {name}_p{j}),
{name}_m{j + 1} AS (SELECT band, CASE WHEN g > b THEN g - 1 ELSE g END AS g FROM {name}_m{j}, {name}_b{j}),"""
    return out + f"""
{name}_map AS (SELECT a.band, a.g < b.g AS kept FROM {name}_m{cuts} a JOIN {name}_m{cuts} b ON b.band = a.band + 1)"""


_BANDED = f"CASE {' '.join(f'WHEN points >= {c} THEN {i + 1}' for i, c in enumerate(CUTS))} ELSE {len(CUTS) + 1} END"
_CITY = f""", cc AS (SELECT as_of, {_BANDED} AS band, sum(y) AS k, count(*) AS n FROM o WHERE eligible AND y IS NOT NULL AND district IS NOT NULL GROUP BY 1, 2),""" + _validation("city", "cc")
_TRUE_CUTS = ", ".join(f"({i + 1}, {c}::DOUBLE)" for i, c in enumerate(CUTS))


def _cuts(t: Tables):
    return t.spark.createDataFrame([(CUTS,)], "cuts array<double>")


@query("bd4_validated_cuts", f"SELECT v.band, v.cut, CAST(m.kept AS INT) AS kept FROM (VALUES {_TRUE_CUTS}) v(band, cut) JOIN city_map m ON m.band = v.band", ORIGINS_CTE + _CITY)
def bd4(t: Tables):
    kept = bd.validated_cuts(origin(t, ORIGINS).where("district is not null"), _cuts(t), len(CUTS), RULES)
    each = F.posexplode(F.array(*[F.lit(c) for c in CUTS])).alias("i", "cut")
    return kept.select("cuts", each).select((F.col("i") + 1).alias("band"), "cut", F.array_contains("cuts", F.col("cut")).alias("kept"))


# Months of the record pooled, by year: enough labelled places for every split to be tried, some of them real.
_YEARS = f", yy AS (SELECT year(as_of) AS as_of, {_BANDED} AS band, sum(y) AS k, count(*) AS n FROM o WHERE eligible AND y IS NOT NULL GROUP BY 1, 2)," + _validation("yrs", "yy")
EVERY_MONTH = snap_ctes("SELECT CAST(d AS DATE) AS as_of FROM range(DATE '1996-02-01', DATE '2000-07-01' + 1, INTERVAL 1 MONTH) r(d)") + (
    f", o AS (SELECT *, avg_deficit AS points, rated_2y >= 2 AS eligible, {_BAND} AS band, closures_read > 0 AS closure_read, CASE WHEN district IS NULL THEN 'outside' ELSE 'city' END AS side FROM fr WHERE kind = 'restaurant')")


def every_month(t: Tables):
    return origin(t, sn.month_starts("1996-02-01", "2000-07-01")).withColumns(
        {"closure_read": F.col("closures_read") > 0, "side": F.when(F.col("district").isNull(), "outside").otherwise("city")})


@query("bd4_validated_cuts_by_year", f"SELECT v.band, v.cut, CAST(m.kept AS INT) AS kept FROM (VALUES {_TRUE_CUTS}) v(band, cut) JOIN yrs_map m ON m.band = v.band", EVERY_MONTH + _YEARS)
def bd4_years(t: Tables):
    rows = every_month(t).withColumn("as_of", F.year("as_of"))
    kept = bd.validated_cuts(rows, _cuts(t), len(CUTS), RULES)
    each = F.posexplode(F.array(*[F.lit(c) for c in CUTS])).alias("i", "cut")
    return kept.select("cuts", each).select((F.col("i") + 1).alias("band"), "cut", F.array_contains("cuts", F.col("cut")).alias("kept"))


_GROUPS = """, hist AS (SELECT CAST(points AS INT) AS p, count(*) AS n, sum(y) AS k, row_number() OVER (ORDER BY points DESC) AS i FROM o WHERE eligible AND y IS NOT NULL GROUP BY points),
walk AS (SELECT i, p, n, k, 1 AS g, n AS run FROM hist WHERE i = 1 UNION ALL
 SELECT h.i, h.p, h.n, h.k, CASE WHEN w.run >= 200 THEN w.g + 1 ELSE w.g END, CASE WHEN w.run >= 200 THEN h.n ELSE w.run + h.n END FROM walk w JOIN hist h ON h.i = w.i + 1),
grp0 AS (SELECT g, min(p) AS lo, max(p) AS hi, sum(n) AS n, sum(k) AS k FROM walk GROUP BY g),
grp AS (SELECT min(lo) AS lo, max(hi) AS hi, sum(n) AS n, sum(k) AS k FROM (SELECT *, CASE WHEN g > 1 AND n < 200 THEN g - 1 ELSE g END AS gg FROM grp0) GROUP BY gg)"""


@query("bd5_curve_groups", "SELECT lo, hi, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k FROM grp", ORIGIN_CTE + _GROUPS)
def bd5(t: Tables):
    g = bd.curve_groups(origin(t), RULES.curve_min)
    return g.select(F.explode("groups").alias("g")).select("g.*")


@query("bd6_risk_curve", """SELECT lo, hi, CAST(n AS BIGINT) AS labelled, CAST(k AS BIGINT) AS positives, round((SELECT max(m) FROM (SELECT a.lo AS alo, min((SELECT sum(x.k) / CAST(sum(x.n) AS DOUBLE) FROM grp x WHERE x.lo BETWEEN a.lo AND b.lo)) AS m
 FROM grp a JOIN grp b ON b.lo >= g.lo WHERE a.lo <= g.lo GROUP BY a.lo)), 6) + 0.0 AS rate FROM grp g""", ORIGIN_CTE + _GROUPS)
def bd6(t: Tables):
    c = bd.risk_curve(origin(t), "address", REPS, RULES.curve_min)
    return _r(c.select("lo", "hi", "labelled", "positives", "rate"), "rate")


_INTERVAL_SQL = _GROUPS + """, gi AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY lo) - 1 AS g FROM grp),
per AS (SELECT address, g, count(*) AS n, sum(y) AS k FROM o JOIN gi ON CAST(points AS INT) BETWEEN lo AND hi WHERE eligible AND y IS NOT NULL GROUP BY 1, 2),""" + draw_ctes("per", "address") + """,
dr AS (SELECT rep, g, sum(times * n) AS n, sum(times * k) AS k FROM per JOIN wt USING (address) GROUP BY 1, 2),
al AS MATERIALIZED (SELECT r.rep, gi.g, CAST(greatest(coalesce(d.n, 0), 1) AS DOUBLE) AS n, CAST(coalesce(d.k, 0) AS DOUBLE) AS k FROM (SELECT DISTINCT rep FROM dr) r CROSS JOIN gi LEFT JOIN dr d ON d.rep = r.rep AND d.g = gi.g
 UNION ALL SELECT -1, g, CAST(greatest(n, 1) AS DOUBLE), CAST(k AS DOUBLE) FROM gi),
me AS MATERIALIZED (SELECT a.rep, a.g AS ag, b.g AS bg, sum(x.k) / sum(x.n) AS m FROM al a JOIN al b ON a.rep = b.rep AND a.g <= b.g JOIN al x ON x.rep = a.rep AND x.g BETWEEN a.g AND b.g GROUP BY 1, 2, 3),
fit AS (SELECT rep, g, max(m) AS rate FROM (SELECT al.rep, al.g, ag, min(m) AS m FROM al JOIN me ON me.rep = al.rep AND ag <= al.g AND bg >= al.g GROUP BY 1, 2, 3) GROUP BY 1, 2),
sp AS (SELECT g, quantile_cont(rate, 0.025) AS low, quantile_cont(rate, 0.975) AS high FROM fit WHERE rep >= 0 GROUP BY g)"""


@query("bd6_risk_curve_interval", """SELECT lo, hi, CAST(n AS BIGINT) AS labelled, CAST(k AS BIGINT) AS positives, round(rate, 6) + 0.0 AS rate, round(least(rate, low), 6) + 0.0 AS low, round(greatest(rate, high), 6) + 0.0 AS high
FROM gi JOIN (SELECT g, rate FROM fit WHERE rep = -1) p USING (g) JOIN sp USING (g)""", ORIGIN_CTE + _INTERVAL_SQL)
def bd6_interval(t: Tables):
    return _r(bd.risk_curve(origin(t), "address", REPS, RULES.curve_min), "rate", "low", "high")


@query("bd6_curve_bins", f"""SELECT bin, min(points)::INT AS min_points, max(points)::INT AS max_points, count(*) AS labelled, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) + 0.0 AS rate, {_w('sum(y)', 'count(*)', '-')} AS low, {_w('sum(y)', 'count(*)', '+')} AS high FROM (
 SELECT points, y, greatest(least(len([x for x in e if x <= points]), len(e) - 1), 1)::INT AS bin FROM (SELECT points, y FROM o WHERE eligible AND y IS NOT NULL) CROSS JOIN (
  SELECT list_sort(list_distinct([CAST(floor(v) AS INT) for v in quantile_cont(points, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0])])) AS e FROM o WHERE eligible AND y IS NOT NULL)) GROUP BY bin""", ORIGIN_CTE)
def bd6_bins(t: Tables):
    return _r(bd.curve_bins(origin(t)), "rate")


def _curves(src: str, keys: list[str], min_n: int = RULES.curve_min) -> str:
    """Groups of points from the top and their monotone rates, by key: CTE ``curve`` with ``lo, hi, n, k, rate``."""
    k = ", ".join(keys)
    same = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    return f""", ch AS MATERIALIZED (SELECT {k}, CAST(points AS INT) AS p, count(*) AS n, sum(y) AS k, row_number() OVER (PARTITION BY {k} ORDER BY points DESC) AS i FROM {src} WHERE eligible AND y IS NOT NULL GROUP BY {k}, points),
cw AS (SELECT {k}, i, p, n, k, 1 AS g, n AS run FROM ch WHERE i = 1 UNION ALL
 SELECT {', '.join('h.' + x for x in keys)}, h.i, h.p, h.n, h.k, CASE WHEN w.run >= {min_n} THEN w.g + 1 ELSE w.g END, CASE WHEN w.run >= {min_n} THEN h.n ELSE w.run + h.n END FROM cw w JOIN ch h ON h.i = w.i + 1 AND {same('h', 'w')}),
cg AS (SELECT {k}, g, min(p) AS lo, max(p) AS hi, sum(n) AS n, sum(k) AS k FROM cw GROUP BY {k}, g),
cj AS MATERIALIZED (SELECT {k}, min(lo) AS lo, max(hi) AS hi, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM (SELECT *, CASE WHEN g > 1 AND n < {min_n} THEN g - 1 ELSE g END AS gg FROM cg) GROUP BY {k}, gg),
cm AS MATERIALIZED (SELECT {', '.join('a.' + x for x in keys)}, a.lo AS alo, b.lo AS blo, sum(x.k) / CAST(sum(x.n) AS DOUBLE) AS m FROM cj a JOIN cj b ON {same('a', 'b')} AND b.lo >= a.lo JOIN cj x ON {same('x', 'a')} AND x.lo BETWEEN a.lo AND b.lo GROUP BY {', '.join('a.' + x for x in keys)}, a.lo, b.lo),
curve AS MATERIALIZED (SELECT {k}, lo, hi, n, k, max(m) AS rate FROM (SELECT {', '.join('g.' + x for x in keys)}, g.lo, g.hi, g.n, g.k, c.alo, min(c.m) AS m FROM cj g JOIN cm c ON {same('c', 'g')} AND c.alo <= g.lo AND c.blo >= g.lo GROUP BY ALL) GROUP BY {k}, lo, hi, n, k)"""


_BY_ROUTE = EVERY_MONTH + _curves("o", ["side", "closure_read"])


@query("bd5_curve_groups_by_area", "SELECT side, CAST(closure_read AS INT) AS closure_read, lo, hi, n, k FROM cj", _BY_ROUTE)
def bd5_area(t: Tables):
    g = bd.curve_groups(every_month(t), RULES.curve_min, ["side", "closure_read"])
    return g.select("side", "closure_read", F.explode("groups").alias("g")).select("side", "closure_read", "g.*")


_READ = """round(coalesce((SELECT arg_max(rate, lo) FROM curve c WHERE c.side = {0}.side AND c.closure_read = {0}.closure_read AND c.lo <= {0}.points),
 (SELECT arg_min(rate, lo) FROM curve c WHERE c.side = {0}.side AND c.closure_read = {0}.closure_read)), 6) + 0.0"""


@query("bd7_estimates", f"SELECT business_id, {_READ.format('o')} AS est_rate FROM o WHERE as_of = DATE '{ORIGIN}'", _BY_ROUTE)
def bd7(t: Tables):
    rows, by = every_month(t), ["side", "closure_read"]
    curve = bd.risk_curve(rows, "address", 1, RULES.curve_min, keys=by)
    return _r(bd.estimates(rows.where(F.col("as_of") == ORIGIN), curve, by).select("business_id", "est_rate"), "est_rate")


@query("bd8_curves_by_route", "SELECT side, CAST(closure_read AS INT) AS closure_read, lo, hi, n AS labelled, k AS positives, round(rate, 6) + 0.0 AS rate FROM curve", _BY_ROUTE)
def bd8(t: Tables):
    c = bd.risk_curve(every_month(t), "address", REPS, RULES.curve_min, keys=["side", "closure_read"])
    return _r(c.select("side", "closure_read", "lo", "hi", "labelled", "positives", "rate"), "rate")


@query("bd9_named_bands", f"""SELECT cost_ratio, band, round(cost_ratio / (1 + cost_ratio), 6) + 0.0 AS bar, CAST(coalesce(low > cost_ratio / (1 + cost_ratio), FALSE) AS INT) AS named FROM (
 SELECT band, {_w('sum(y)', 'count(y)', '-')} AS low FROM o WHERE band IS NOT NULL GROUP BY band) CROSS JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) r(cost_ratio)""", ORIGIN_CTE)
def bd9(t: Tables):
    return _r(bd.named_bands(bd.band_table(origin(t))), "bar")


_OUT = _CITY + f""", oc0 AS (SELECT as_of, {_BANDED} AS band, y FROM o WHERE eligible AND y IS NOT NULL AND district IS NULL),
oc AS (SELECT as_of, g AS band, sum(y) AS k, count(*) AS n FROM oc0 JOIN city_m3 USING (band) GROUP BY 1, 2),""" + _validation("out", "oc") + """,
okay AS (SELECT (SELECT count(*) FROM city_map WHERE kept) AS held, (SELECT count(*) FROM out_map WHERE kept) AS there)"""


@query("bd10_outside_bands", f"""SELECT CASE WHEN (held > 0 AND held = there) OR district IS NOT NULL THEN o.band END AS band, CAST(district IS NULL AS INT) AS outside, count(*) AS n
FROM o, okay WHERE as_of = DATE '{ORIGIN}' GROUP BY 1, 2""", ORIGINS_CTE + _OUT)
def bd10(t: Tables):
    f = origin(t, ORIGINS)
    city = cut(bd.validated_cuts(f.where("district is not null"), _cuts(t), len(CUTS), RULES))
    named = bd.outside_bands(f, city, len(CUTS), RULES)
    return named.where(F.col("as_of") == ORIGIN).groupBy("band", F.col("district").isNull().alias("outside")).agg(F.count("*").alias("n"))


_AUDIT = """, audit AS (SELECT district, count(*) AS candidates, count(y) AS labelled, count(*) FILTER (nm) AS named, count(*) FILTER (nm AND y = 1) AS named_positive, count(*) FILTER (nm AND y = 0) AS false_named,
 count(*) FILTER (y = 0) AS neg, count(*) FILTER (nm AND y IS NOT NULL) AS nl FROM (SELECT *, coalesce(band IN ('1', '2', '3'), FALSE) AS nm FROM o WHERE eligible AND district IS NOT NULL) GROUP BY 1),
tot AS (SELECT sum(false_named) AS fa, sum(neg) AS na, sum(labelled) AS la FROM audit),
fair AS (SELECT district, candidates, labelled, named, named_positive, false_named, CASE WHEN named > 0 THEN round(named_positive / greatest(1, nl)::DOUBLE, 3) + 0.0 END AS precision,
 round((false_named / greatest(1, neg)::DOUBLE) / (fa / greatest(1, na)::DOUBLE), 2) + 0.0 AS fpr_ratio, round((false_named / fa::DOUBLE) / (labelled / la::DOUBLE), 2) + 0.0 AS false_share_ratio FROM audit, tot)"""


def _fair(t: Tables):
    return bd.district_audit(origin(t).where("eligible and district is not null"), F.coalesce(F.col("band").isin("1", "2", "3"), F.lit(False)))


@query("bs7_district_audit", "SELECT * FROM fair", ORIGIN_CTE + _AUDIT)
def bs7_audit(t: Tables):
    return _fair(t).drop("precision_low", "precision_high")


@query("bd11_fairness_problems", """SELECT district, 'share of wrongly named' AS problem FROM fair WHERE named >= 10 AND false_share_ratio > 1.25 UNION ALL SELECT district, 'false-positive rate' FROM fair WHERE named >= 10 AND fpr_ratio > 1.5""", ORIGIN_CTE + _AUDIT)
def bd11(t: Tables):
    return bd.fairness_problems(_fair(t).withColumn("high", F.lit(None).cast("double")))


@query("bd12_drift", """
SELECT CAST(n_then AS BIGINT) AS n_then, round(rt, 6) + 0.0 AS rate_then, CAST(n_now AS BIGINT) AS n_now, round(rn, 6) + 0.0 AS rate_now, CAST(lq AS VARCHAR) AS latest_quarter, CAST(ln AS BIGINT) AS latest_n, round(rl, 6) + 0.0 AS rate_latest,
 CAST(n_note AS BIGINT) AS n_note, round(rno, 6) + 0.0 AS rate_note, CAST(mv AS INT) AS rate_moved, 0 AS share_moved, CASE WHEN mv THEN 'refit' WHEN rn IS NOT NULL AND rt IS NOT NULL THEN 'ok' ELSE 'not_yet_measurable' END AS status,
 CAST(coalesce(abs(rl - rno) > greatest(0.02::DOUBLE, 3 * sqrt(rl * (1 - rl) / ln + rno * (1 - rno) / n_note)), FALSE) AS INT) AS note FROM (
 SELECT *, coalesce(abs(rn - rt) > greatest(0.02::DOUBLE, 3 * sqrt(rn * (1 - rn) / n_now + rt * (1 - rt) / n_then)), FALSE) AS mv FROM (
  SELECT n_then, k_then / n_then::DOUBLE AS rt, n_now, k_now / nullif(n_now, 0)::DOUBLE AS rn, lq, ln, lk / ln::DOUBLE AS rl, n_note, k_note / nullif(n_note, 0)::DOUBLE AS rno FROM
  (SELECT coalesce(sum(n), 0) AS n_now, coalesce(sum(k), 0) AS k_now FROM (SELECT * FROM q WHERE qs > DATE '2000-12-30' AND last_day(qs + INTERVAL 2 MONTH) + 30 <= (SELECT max(day) FROM visit) ORDER BY qs DESC LIMIT 2)),
  (SELECT max(qs) AS lq, arg_max(n, qs) AS ln, arg_max(k, qs) AS lk FROM q),
  (SELECT sum(n) AS n_then, sum(k) AS k_then, sum(n) FILTER (md < (SELECT max(qs) FROM q)) AS n_note, sum(k) FILTER (md < (SELECT max(qs) FROM q)) AS k_note FROM m WHERE md BETWEEN DATE '2000-01-01' AND DATE '2000-12-30')))""",
       "m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS md, count(*) AS n, count(*) FILTER (n_major > 0) AS k FROM visit WHERE visit_type = 'routine' GROUP BY 1), q AS (SELECT CAST(date_trunc('quarter', md) AS DATE) AS qs, sum(n) AS n, sum(k) AS k FROM m GROUP BY 1 HAVING sum(n) >= 200)")
def bd12(t: Tables):
    through = t.merged.agg(F.max("day").cast("string")).first()[0]
    d = bd.drift(counts_by_month(t.visits), ORIGIN, through, rules=RULES)
    return _r(d, "rate_then", "rate_now", "rate_latest", "rate_note")


@query("ag16_rates_by_permit_status", "SELECT permit_status, count(*) AS labelled, round(avg(y), 6) + 0.0 AS rate FROM o WHERE y IS NOT NULL GROUP BY 1", ORIGIN_CTE)
def ag16(t: Tables):
    return _r(bd.survivorship(origin(t))[0], "rate")


@query("ag16_mixture_bound", "SELECT m AS missing, round((1 - m) * (SELECT avg(y) FROM o WHERE band = '1') + m * (SELECT avg(y) FROM o WHERE permit_status = 'Expired'), 6) + 0.0 AS band_1_rate FROM (VALUES (0.05::DOUBLE), (0.10::DOUBLE)) v(m)", ORIGIN_CTE)
def ag16_bound(t: Tables):
    o = origin(t).where("y is not null")
    r = o.agg(F.avg(F.when(F.col("band") == "1", F.col("y"))).alias("b"), F.avg(F.when(F.col("permit_status") == "Expired", F.col("y"))).alias("e"))
    m = F.explode(F.array(F.lit(0.05), F.lit(0.10))).alias("missing")
    return _r(r.select("b", "e", m).select("missing", ((1 - F.col("missing")) * F.col("b") + F.col("missing") * F.col("e")).alias("band_1_rate")), "band_1_rate")


def _closers(ordering: str, share: float, reps: int = 20) -> str:
    """Capture with more rows like the expired ones, and with all of them last, for one ordering and share."""
    ex = f"CAST(round({share}::DOUBLE * (SELECT count(*) FROM scored)) AS BIGINT)"
    return f"""SELECT '{ordering}' AS ordering, {share}::DOUBLE AS share, round((SELECT avg(c) FROM (SELECT rep, sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.2::DOUBLE * an - (e - n)) / n)) * pos) / max(ap) AS c FROM (
 SELECT *, sum(n) OVER (PARTITION BY rep ORDER BY score DESC) AS e, sum(n) OVER (PARTITION BY rep) AS an, sum(pos) OVER (PARTITION BY rep) AS ap FROM (SELECT rep, score, sum(n) AS n, sum(pos) AS pos FROM (
  SELECT r.rep, {ordering} AS score, 1 AS n, y AS pos FROM scored, range(0, {reps}) r(rep) UNION ALL SELECT rep, {ordering}, 1, y FROM (
   SELECT i // {ex} AS rep, CAST(('0x' || substr(md5('1:' || i), 1, 8)) AS BIGINT) % (SELECT max(nc) FROM pool) AS code FROM range(0, {reps} * {ex}) r(i)) JOIN pool USING (code)) GROUP BY 1, 2)) GROUP BY rep)), 6) + 0.0 AS like_group,
 round((SELECT sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.2::DOUBLE * (tn + {ex}) - (e - n)) / n)) * pos) / (max(tp) + max(rate) * {ex}) FROM (SELECT {ordering}, count(*) AS n, sum(y) AS pos, sum(count(*)) OVER (ORDER BY {ordering} DESC) AS e FROM scored GROUP BY {ordering}), (SELECT count(*) AS tn, sum(y) AS tp FROM scored), (SELECT avg(y) AS rate FROM pool)), 6) + 0.0 AS worst"""


CLOSER_SHARES, CLOSER_ORDERS = (0.05, 0.1, 0.2), ("risk", "rule", "pers")


@query("ag17_missing_closers_by_share", " UNION ALL ".join(_closers(o, s) for o in CLOSER_ORDERS for s in CLOSER_SHARES),
       SCORED + ", pool AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS code, count(*) OVER () AS nc FROM scored WHERE permit_status = 'Expired')")
def ag17_shares(t: Tables):
    """Twenty draws at each share for three orderings: the model (here its stand-in ``risk``), the rule and persistence."""
    from functools import reduce

    from pyspark.sql import DataFrame
    out = []
    for ordering in CLOSER_ORDERS:
        d = t.scored.select("record_id", F.col(ordering).alias("score"), "y", "permit_status")
        for share in CLOSER_SHARES:
            r = rk.with_resampled(d, F.col("permit_status") == "Expired", share, 20)
            out.append(r.select(F.lit(ordering).alias("ordering"), F.lit(share).alias("share"), "like_group", "worst"))
    return _r(reduce(DataFrame.unionByName, out), "like_group", "worst")


@query("ag18_interim_rates", """SELECT days, grp, count(*) AS labelled, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) + 0.0 AS rate FROM (
 SELECT d.days, g.grp, CASE d.days WHEN 90 THEN y_d90 WHEN 180 THEN y_d180 ELSE y_d270 END AS y FROM o, (VALUES (90), (180), (270)) d(days), (VALUES ('all'), ('1')) g(grp) WHERE eligible AND (g.grp = 'all' OR band = '1')) WHERE y IS NOT NULL GROUP BY 1, 2""", ORIGIN_CTE)
def ag18(t: Tables):
    return _r(bd.interim_rates(origin(t, horizons={"d90": 90, "d180": 180, "d270": 270})), "rate")


@query("ag19_band_1_by_route", f"""SELECT route, count(*) AS labelled, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) + 0.0 AS rate FROM (SELECT y, CASE WHEN u.anyc AND (u.rest IS NULL OR 100 - floor(u.rest + 0.5) < {CUTS[0]}) THEN 'closure' ELSE 'scores' END AS route
 FROM o JOIN (SELECT business_id, avg(rated) FILTER (NOT coalesce(closure_order = 'health', FALSE)) AS rest, bool_or(coalesce(closure_order = 'health', FALSE)) AS anyc FROM visit WHERE visit_type = 'routine' AND rated IS NOT NULL AND day < DATE '{ORIGIN}' AND DATE '{ORIGIN}' - day <= 730 GROUP BY 1) u USING (business_id)
 WHERE band = '1' AND y IS NOT NULL) GROUP BY 1""", ORIGIN_CTE)
def ag19(t: Tables):
    return _r(bd.by_route(origin(t), t.visits, ORIGIN, CUTS[0], RULES), "rate")


_READINGS = """, rd(reading, value) AS (VALUES ('70', 70), ('80', 80), ('90', 90), ('formula', NULL)),
alt AS (SELECT reading, business_id, floor(avg(CASE WHEN closure_order = 'health' THEN coalesce(value, greatest(0, 100 - 4 * n_major - 2 * n_minor - n_grp)) ELSE score END) + 0.5) AS m FROM visit, rd
 WHERE visit_type = 'routine' AND day < DATE '%s' AND DATE '%s' - day <= 730 AND (closure_order = 'health' OR score IS NOT NULL) GROUP BY 1, 2),
arms AS (SELECT reading AS arm, 100 - m AS score, y FROM o JOIN alt USING (business_id) WHERE eligible AND y IS NOT NULL)""" % (ORIGIN, ORIGIN)


@query("ml18_closure_reading", """SELECT arm, round(sum((n - pos) * (cp - pos + pos / 2.0::DOUBLE)) / (sum(pos) * sum(n - pos)), 6) + 0.0 AS auc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n - pos) AS BIGINT) AS negatives FROM (
 SELECT *, sum(pos) OVER (PARTITION BY arm ORDER BY score DESC) AS cp FROM (SELECT arm, score, count(*) AS n, sum(y) AS pos FROM arms GROUP BY 1, 2)) GROUP BY arm""", ORIGIN_CTE + _READINGS)
def ml18(t: Tables):
    from ..operators.models import reading_scores
    alt = reading_scores(t.visits, ORIGIN, {"70": 70, "80": 80, "90": 90, "formula": None}, RULES)
    rows = origin(t).where("eligible and y is not null").select("business_id", "y").join(alt, "business_id")
    return _r(rk.auc(rows.withColumnRenamed("reading", "arm"), ["arm"]), "auc")


# ── monitor ──

LISTS = ("1999-07-01", "2000-01-01", "2000-07-01", "2001-01-01")
_MON = snap_ctes("SELECT * FROM (VALUES " + ", ".join(f"(DATE '{d}')" for d in LISTS) + ") v(as_of)") + f""",
arch AS (SELECT 'forward_' || CAST(as_of AS VARCHAR) AS run, as_of AS list_date, CASE WHEN business_id % 40 = 0 THEN 'gone' || business_id ELSE facility_id END AS facility_id, CASE WHEN business_id % 40 = 0 THEN NULL ELSE business_id END AS bid,
  avg_deficit AS points, coalesce({_BAND}, 'rest') AS band, persistence, -coalesce(avg_score, 97) AS other, district, closures_read, y, y_d90, y_d180, y_d270, address FROM fr WHERE kind = 'restaurant' AND rated_2y >= 2),
mon0 AS (SELECT *, CASE WHEN seen >= 395 THEN 365 WHEN seen >= 300 THEN 270 WHEN seen >= 210 THEN 180 WHEN seen >= 120 THEN 90 END AS win FROM (SELECT *, (SELECT max(day) FROM visit) - list_date AS seen FROM arch)),
mon AS (SELECT * EXCLUDE (y), CASE WHEN bid IS NOT NULL THEN CASE win WHEN 365 THEN y WHEN 270 THEN y_d270 WHEN 180 THEN y_d180 WHEN 90 THEN y_d90 END END AS y, CASE WHEN district IS NOT NULL THEN 'city' ELSE 'outside' END AS area FROM mon0)"""


def archive(t: Tables):
    """Rankings of four list dates, as archived; some places later gone."""
    k = F.col("business_id")
    f = sn.frame(snaps(t, LISTS), t.located, F.col("kind") == "restaurant", labelled=False).where(sn.eligible())
    f = sn.baselines(f)
    return f.select(
        F.concat(F.lit("forward_"), F.col("as_of").cast("string")).alias("run"), F.col("as_of").alias("list_date"),
        F.when(k % 40 == 0, F.concat(F.lit("gone"), k.cast("string"))).otherwise(F.col("facility_id")).alias("facility_id"), F.when(k % 40 != 0, k).alias("business_id"),
        F.col("avg_deficit").alias("points"), bd.band_of(F.col("avg_deficit"), bd.fixed_cuts(f, CUTS)).alias("band"), "persistence",
        (-F.coalesce("avg_score", F.lit(97.0))).alias("other"), "district", "closures_read")


def monitored(t: Tables):
    return cut(mo.scored_rows(archive(t), t.visits, t.places, t.visits.agg(F.max("day").alias("through")), RULES))


@query("bd13_monitor_bands", f"""SELECT run, area, band, win AS "window", count(*) AS labelled, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) + 0.0 AS rate, {_w('sum(y)', 'count(*)', '-')} AS low, {_w('sum(y)', 'count(*)', '+')} AS high
FROM mon WHERE win IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3, 4""", _MON)
def bd13(t: Tables):
    return _r(mo.band_rates(monitored(t)), "rate")


@query("bd13_monitor_missing", "SELECT run, band, count(*) AS missing FROM mon WHERE win IS NOT NULL AND bid IS NULL GROUP BY 1, 2", _MON)
def bd13_missing(t: Tables):
    return mo.missing(monitored(t))


@query("bd13_monitor_auc", """SELECT run, arm, round(sum((n - pos) * (cp - pos + pos / 2.0::DOUBLE)) / (sum(pos) * sum(n - pos)), 6) + 0.0 AS auc FROM (SELECT *, sum(pos) OVER (PARTITION BY run, arm ORDER BY score DESC) AS cp FROM (
 SELECT run, arm, score, count(*) AS n, sum(y) AS pos FROM (SELECT run, 'rule' AS arm, points AS score, y FROM mon WHERE area = 'city' AND y IS NOT NULL UNION ALL SELECT run, 'other', other, y FROM mon WHERE area = 'city' AND y IS NOT NULL) GROUP BY 1, 2, 3)) GROUP BY 1, 2""", _MON)
def bd13_auc(t: Tables):
    m = monitored(t).where("area = 'city' and y is not null")
    arms = F.explode(F.array(F.struct(F.lit("rule").alias("arm"), F.col("points").alias("score")), F.struct(F.lit("other").alias("arm"), F.col("other").alias("score")))).alias("_a")
    a = rk.auc(m.select("run", "y", arms).select("run", "y", "_a.arm", "_a.score"), ["run", "arm"])
    return _r(a.select("run", "arm", "auc"), "auc")


_CURVE_O = f", o AS (SELECT *, avg_deficit AS points, TRUE AS eligible FROM fr WHERE kind = 'restaurant' AND rated_2y >= 2 AND as_of = DATE '{LISTS[0]}'), oq AS (SELECT *, closures_read > 0 AS closure_read FROM o)" + _curves("oq", ["closure_read"])


@query("bd13_observed_over_expected", """SELECT run, area, CAST(sum(y) AS BIGINT) AS observed, round(sum(est), 6) + 0.0 AS expected, round(sum(y) / sum(est), 6) + 0.0 AS ratio FROM (SELECT mon.*, coalesce((SELECT arg_max(rate, lo) FROM curve c WHERE c.closure_read = (mon.closures_read > 0) AND c.lo <= mon.points),
 (SELECT arg_min(rate, lo) FROM curve c WHERE c.closure_read = (mon.closures_read > 0))) AS est FROM mon WHERE win = 365 AND y IS NOT NULL) WHERE est IS NOT NULL GROUP BY 1, 2""", _MON + _CURVE_O)
def bd13_oe(t: Tables):
    first = sn.frame(snaps(t, LISTS[:1]), t.located, F.col("kind") == "restaurant", labelled=False).where(sn.eligible())
    first = first.withColumns({"points": F.col("avg_deficit"), "eligible": F.lit(True), "closure_read": F.col("closures_read") > 0})
    curve = bd.risk_curve(first, "address", 1, RULES.curve_min, keys=["closure_read"])
    m = monitored(t).withColumn("closure_read", F.col("closures_read") > 0)
    return _r(mo.observed_over_expected(bd.estimates(m, curve, ["closure_read"])), "expected", "ratio")


@query("bd13_band_1_minus_persistence", """SELECT run, area, CAST(sum(y * (CAST(band = '1' AS INT) - CAST(pos <= n1 AS INT))) AS BIGINT) AS diff FROM (SELECT *, row_number() OVER (PARTITION BY run, area ORDER BY persistence DESC, facility_id) AS pos,
 count(*) FILTER (band = '1') OVER (PARTITION BY run, area) AS n1 FROM mon WHERE win IS NOT NULL AND y IS NOT NULL) GROUP BY 1, 2""", _MON)
def bd13_paired(t: Tables):
    p = mo.persistence_group(monitored(t))
    return p.groupBy("run", "area").agg(F.sum(F.col("y") * (F.col("in_band_1") - F.col("in_baseline"))).alias("diff"))


@query("bd14_monitor_districts", f"""SELECT run, district, labelled, positives, banded, banded_positives, round(positives / labelled::DOUBLE, 6) + 0.0 AS rate, round(banded_positives / nullif(banded, 0)::DOUBLE, 6) + 0.0 AS banded_rate,
 CASE WHEN banded > 0 THEN {_w('banded_positives', 'banded', '-')} END AS low, CASE WHEN banded > 0 THEN {_w('banded_positives', 'banded', '+')} END AS high FROM (
 SELECT run, district, count(*) AS labelled, CAST(sum(y) AS BIGINT) AS positives, count(*) FILTER (band IN ('1', '2', '3')) AS banded, CAST(coalesce(sum(y) FILTER (band IN ('1', '2', '3')), 0) AS BIGINT) AS banded_positives
 FROM mon WHERE area = 'city' AND win IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)""", _MON)
def bd14(t: Tables):
    return _r(mo.district_rates(monitored(t), ["1", "2", "3"]), "rate", "banded_rate")


@query("bd15_monitor_summary", """SELECT CASE WHEN bool_or(win = 365) THEN 'complete' WHEN bool_or(win IS NOT NULL) THEN 'interim' ELSE 'too early' END AS status, count(*) AS runs,
 CAST(min(CASE WHEN coalesce(win, 0) < 365 THEN list_date + CASE WHEN win IS NULL THEN 90 WHEN win = 90 THEN 180 WHEN win = 180 THEN 270 ELSE 365 END + 30 END) AS VARCHAR) AS next_window_date FROM (SELECT DISTINCT run, list_date, win FROM mon)""", _MON)
def bd15(t: Tables):
    return mo.summary(monitored(t).select("run", "list_date", "window").distinct(), RULES)


@query("bd15_monitor_alerts")
def bd15_alerts(t: Tables):
    m = monitored(t)
    runs = m.select("run", "list_date", F.lit(True).alias("current")).distinct()
    want = m.where("y is not null").groupBy("run").agg(F.avg("y").alias("expected_rate"))
    p = mo.persistence_group(m.where("area = 'city'"))
    per = p.groupBy("run", "address").agg(F.sum(F.col("y") * (F.col("in_band_1") - F.col("in_baseline"))).alias("diff"))
    paired = rs.percentiles(rs.replicate_sums(rs.dealt(per, "address"), "address", ["diff"], ["run"], REPS), ["diff"], ["run"]).withColumnRenamed("diff_high", "high")
    none = m.where("complete and y is not null").groupBy("run", "area").agg(F.sum("y").alias("observed"))
    oe = none.join(want, "run").join(m.where("complete and y is not null").groupBy("run", "area").agg(F.count("*").alias("n")), ["run", "area"]).select(
        "run", "area", (F.col("observed") / (F.col("expected_rate") * F.col("n"))).alias("ratio"))
    return mo.alerts(mo.band_rates(m), want, oe, paired, runs, RULES)


# ── checks ──

_RULES_SQL = " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS n, min(facility_id) AS example FROM planted WHERE {w}" for r, w in {
    "no name or address": "coalesce(name, '') = '' OR coalesce(address, '') = ''", "kind not allowed": "kind IS NULL OR kind NOT IN ('restaurant', 'limited', 'market')",
    "district outside 1 to 9": "NOT district BETWEEN 1 AND 9", "band not defined": "band NOT IN ('1', '2', '3')", "band without points": "band IS NOT NULL AND points IS NULL", "points not whole": "points <> floor(points)"}.items())


@query("ck1_list_checks", f"SELECT * FROM ({_RULES_SQL}) WHERE n > 0", LISTED + """, planted AS (SELECT facility_id, CASE WHEN business_id % 31 = 0 THEN '' ELSE name END AS name, address, CASE WHEN business_id % 37 = 0 THEN 'other' ELSE kind END AS kind,
 CASE WHEN business_id % 41 = 0 THEN 12 ELSE district END AS district, CASE WHEN business_id % 43 = 0 THEN '7' ELSE band END AS band, CASE WHEN business_id % 47 = 0 THEN points + 0.5::DOUBLE ELSE points END AS points FROM listed)""")
def ck1(t: Tables):
    k = F.col("business_id")
    p = published(t).withColumns({
        "name": F.when(k % 31 == 0, "").otherwise(F.col("name")), "kind": F.when(k % 37 == 0, "other").otherwise(F.col("kind")), "district": F.when(k % 41 == 0, 12).otherwise(F.col("district")),
        "band": F.when(k % 43 == 0, "7").otherwise(F.col("band")), "points": F.when(k % 47 == 0, F.col("points") + 0.5).otherwise(F.col("points")), "on_hold": F.lit(False)})
    flags = [*vw.FLAG_ORDER, *TABLE_RULES.themes]
    return ck.run_checks(p, ck.list_rules(["1", "2", "3"], ("restaurant", "limited", "market"), flags), "facility_id")


@query("ck1_record_checks", """SELECT 'grade not allowed' AS rule, count(*) AS n, min(CAST(record_id AS VARCHAR)) AS example FROM disp WHERE record_id % 997 = 0 UNION ALL
SELECT 'reopened before closed', count(*), min(CAST(record_id AS VARCHAR)) FROM disp WHERE closed AND reopened AND record_id % 3 = 0""", RV)
def ck1_records(t: Tables):
    k = F.col("record_id")
    d = display(t).withColumns({"grade": F.when(k % 997 == 0, "Z").otherwise(F.col("grade")),
                                "reopened_on": F.when(F.col("reopened") & (k % 3 == 0), F.date_sub("day", 1)).otherwise(F.col("reopened_on"))})
    return ck.run_checks(d, ck.record_rules(), "record_id")


@query("ck1_scorecard_checks")
def ck1_cards(t: Tables):
    w = {"avg_deficit": 1}
    f = sn.frame(snaps(t, [LIST_DATE]), t.located, F.col("kind") == "restaurant", labelled=False).where(sn.eligible())
    f = f.join(sn.scores_used(t.visits, LIST_DATE, RULES), "business_id").withColumns({"points": vw.rule_points(w), "score_card": vw.worksheet(w)})
    f = f.withColumns({"rate": F.col("avg_deficit") / 100, "low": F.lit(0.0), "high": F.lit(1.0)})
    return ck.run_checks(f, ck.scorecard_rules(), "business_id")


@query("ck2_public_gate", """SELECT 'small counts in facilities' AS problem, count(*) AS n FROM pt WHERE facilities BETWEEN 1 AND 10 HAVING count(*) > 0 UNION ALL SELECT 'small counts in due', count(*) FROM pt WHERE due BETWEEN 1 AND 10 HAVING count(*) > 0
UNION ALL SELECT 'small counts in with_prior_major', count(*) FROM pt WHERE with_prior_major BETWEEN 1 AND 10 HAVING count(*) > 0""", ONE_MONTH + "," + _TYPES)
def ck2(t: Tables):
    from ..operators.aggregates import pooled_types
    return ck.public_problems(pooled_types(_public(t)), RULES)


_HASH = "CAST(('0x' || substr(sha256(coalesce(band, chr(1)) || chr(31) || facility_id || chr(31) || coalesce(CAST(CAST(points AS BIGINT) AS VARCHAR), chr(1))), 1, 13)) AS BIGINT)"


@query("snk6_fingerprint", f"SELECT count(*) AS rows, CAST(sum({_HASH}) AS VARCHAR) AS fingerprint FROM listed", LISTED)
def snk6(t: Tables):
    return sinks.fingerprint(published(t).select("band", "facility_id", F.col("points").cast("long").alias("points")))


@query("snk7_run_id", f"""SELECT 'forward_{LIST_DATE}-' || substr(sha256('average' || '|' || CAST(count(*) AS VARCHAR) || '|' || CAST(sum({_HASH}) AS VARCHAR)), 1, 8) AS run FROM listed""", LISTED)
def snk7(t: Tables):
    return sinks.run_id(LIST_DATE, "average", published(t).select("band", "facility_id", F.col("points").cast("long").alias("points")))


