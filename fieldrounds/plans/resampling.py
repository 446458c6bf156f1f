"""Bootstrap intervals from md5 weights, at the rules' numbers of replicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as ag, ranking as rk, resample as rs, snapshot as sn
from ..sources.adapt import zip_attributes
from .evaluation import SCORED, _F20, slot_ctes, ties
from .features import _r, snap_ctes, snaps
from .registry import ORIGIN, Tables, query

# Replicates for facilities and addresses, for windows, and for districts.
REPS, WINDOW_REPS, DISTRICT_REPS = 1000, 2000, 10_000


def draw_ctes(src: str, key: str, name: str = "wt", reps: int = REPS, seed: int = 0) -> str:
    """Poisson weights of the clusters of ``src`` by md5, as a CTE."""
    times = " + ".join(f"CAST(u >= {c} AS INT)" for c in rs.POISSON_CUTS)
    return f"""
{name} AS MATERIALIZED (SELECT rep, {key}, times FROM (SELECT {key}, 4 * b + i AS rep, {times} AS times FROM (
  SELECT {key}, b, i, CAST(('0x' || substr(h, CAST(8 * i + 1 AS INT), 8)) AS BIGINT) AS u FROM (
   SELECT {key}, b, md5('{seed}:' || CAST({key} AS VARCHAR) || ':' || b) AS h FROM (SELECT DISTINCT {key} FROM {src} WHERE {key} IS NOT NULL), range(0, {(reps + 3) // 4}) q(b)), range(0, 4) r(i)))
 WHERE times > 0 AND rep < {reps})"""


def pct(stat: str) -> str:
    return f"round(quantile_cont({stat}, 0.025), 6) + 0.0 AS {stat}_low, round(quantile_cont({stat}, 0.975), 6) + 0.0 AS {stat}_high"


@query("bs0_draws", "SELECT rep, address, times FROM wt", "" + draw_ctes("place0", "address"))
def bs0(t: Tables):
    return rs.weights(t.places, "address", REPS)


@query("bs1_facility_interval", f"""SELECT {pct('gap')} FROM (SELECT rep, sum(times * d) / CAST(sum(times * n) AS DOUBLE) AS gap
 FROM (SELECT business_id, sum(100 * y - risk) AS d, count(*) AS n FROM scored GROUP BY 1) JOIN wt USING (business_id) GROUP BY rep)""",
       SCORED + "," + draw_ctes("scored", "business_id"))
def bs1(t: Tables):
    df = rs.cluster_interval(t.scored, "business_id", {"d": F.sum(100 * F.col("y") - F.col("risk")), "n": F.count("*")},
                             {"gap": lambda s: s["d"] / s["n"]}, reps=REPS)
    return _r(df, "gap_low", "gap_high")


@query("ag7_calibration_by_quarter", """SELECT year(day) || 'Q' || quarter(day) AS quarter, count(*) AS n, round(100 * avg(y), 6) + 0.0 AS actual_pct, round(avg(risk), 6) + 0.0 AS predicted_pct,
 round(avg(100 * y - risk), 6) + 0.0 AS gap_pts FROM scored GROUP BY 1""", SCORED)
def ag7(t: Tables):
    from ..functions import quarter_label
    d = t.scored.select("y", (F.col("risk") / 100.0).alias("p"), quarter_label(F.col("day")).alias("quarter"))
    return _r(ag.calibration(d, "quarter"), "actual_pct", "predicted_pct", "gap_pts")


@query("bs2_paired_auc", f"""SELECT {pct('auc_diff')} FROM (SELECT rep, max(auc) FILTER (arm = 'rule') - max(auc) FILTER (arm = 'pers') AS auc_diff FROM (
 SELECT rep, arm, sum((n - p) * (cp - p + p / 2.0::DOUBLE)) / (sum(p) * sum(n - p)) AS auc FROM (
  SELECT *, sum(p) OVER (PARTITION BY rep, arm ORDER BY score DESC) AS cp FROM (SELECT rep, arm, score, sum(times) AS n, sum(times * y) AS p FROM arms JOIN wt USING (business_id) GROUP BY 1, 2, 3))
 GROUP BY 1, 2) GROUP BY rep)""",
       SCORED + ", arms AS (SELECT business_id, y, 'rule' AS arm, rule AS score FROM scored UNION ALL SELECT business_id, y, 'pers', pers FROM scored)," + draw_ctes("scored", "business_id"))
def bs2(t: Tables):
    d = rs.paired_auc(t.scored.select("business_id", "y", "rule", "pers"), "business_id", "rule", "pers", REPS)
    return _r(rs.percentiles(d, ["auc_diff"]), "auc_diff_low", "auc_diff_high")


@query("bs2_paired_capture", f"""SELECT {pct('cap_diff')} FROM (SELECT rep, (sum(times * a) - sum(times * b)) / sum(times * p) AS cap_diff FROM (
 SELECT s.business_id, sum(y * {_F20.replace('e -', 't1.e -').replace('an -', 't1.an -').replace('- n)', '- t1.n)').replace('/ n', '/ t1.n')}) AS a,
  sum(y * {_F20.replace('e -', 't2.e -').replace('an -', 't2.an -').replace('- n)', '- t2.n)').replace('/ n', '/ t2.n')}) AS b, sum(y) AS p
 FROM scored s JOIN tie t1 ON t1.score = s.rule JOIN tie2 t2 ON t2.score = s.pers GROUP BY 1) JOIN wt USING (business_id) GROUP BY rep)""",
       SCORED + "," + ties("rule") + "," + ties("pers", name="tie2") + "," + draw_ctes("scored", "business_id"))
def bs2_capture(t: Tables):
    d = t.scored.select("business_id", "y", F.col("rule").alias("score"), "pers")
    w = rk.top_weights(d, 0.2, name="wa").drop("score").withColumnRenamed("pers", "score")
    w = rk.top_weights(w, 0.2, name="wb")
    sums = {"a": F.sum(F.col("y") * F.col("wa")), "b": F.sum(F.col("y") * F.col("wb")), "p": F.sum("y")}
    df = rs.cluster_interval(w, "business_id", sums, {"cap_diff": lambda s: (s["a"] - s["b"]) / s["p"]}, reps=REPS)
    return _r(df, "cap_diff_low", "cap_diff_high")


@query("bs3_address_clusters", "SELECT address, count(*) AS places FROM (SELECT lower(address) AS address FROM place0) GROUP BY 1")
def bs3(t: Tables):
    return t.places.groupBy(rs.address_cluster(F.col("address")).alias("address")).agg(F.count("*").alias("places"))


@query("bs4_catch_interval", f"""SELECT {pct('caught')} FROM (SELECT rep, sum(times * c) AS caught FROM (
 SELECT address, coalesce(sum(y) FILTER (pos <= 50), 0) AS c FROM (SELECT *, row_number() OVER (ORDER BY avg_deficit DESC, coalesce(avg_score, 97), business_id) AS pos FROM fr WHERE kind = 'restaurant') GROUP BY 1)
 JOIN wt USING (address) GROUP BY rep)""", snap_ctes(f"SELECT DATE '{ORIGIN}' AS as_of") + ", listed AS (SELECT * FROM fr WHERE kind = 'restaurant')," + draw_ctes("listed", "address"))
def bs4(t: Tables):
    f = sn.frame(snaps(t, [ORIGIN]), t.located, F.col("kind") == "restaurant", labelled=False).withColumn("tb", F.coalesce("avg_score", F.lit(97.0)))
    o = rk.ranked(f.select("business_id", "address", "y", "avg_deficit", "tb"), "tb", "business_id", "avg_deficit")
    sums = {"c": F.coalesce(F.sum(F.when(F.col("position") <= 50, F.col("y"))), F.lit(0))}
    df = rs.cluster_interval(o, "address", sums, {"caught": lambda s: s["c"].cast("double")}, reps=REPS)
    return _r(df, "caught_low", "caught_high")


_GROUPED = """
grouped AS (SELECT s.*, g.grp FROM scored s JOIN (SELECT zip5, CASE least(CAST(floor((cum - n / 2.0::DOUBLE) / al * 4) AS INT), 3) WHEN 0 THEN 'Q1' WHEN 1 THEN 'Q2' WHEN 2 THEN 'Q3' ELSE 'Q4' END AS grp
 FROM (SELECT *, sum(n) OVER (ORDER BY income, zip5) AS cum, sum(n) OVER () AS al FROM (SELECT zip5, min(income) AS income, count(*) AS n FROM scored JOIN zip_attr USING (zip5) GROUP BY 1))) g USING (zip5))"""


def grouped(t: Tables):
    g = rk.area_groups(t.scored.join(zip_attributes(t.places), "zip5"), "zip5", "income", ["Q1", "Q2", "Q3", "Q4"])
    return t.scored.join(g, "zip5")


@query("ag10_group_fairness", f"""SELECT grp, count(*) AS n, count(DISTINCT zip5) AS areas, round(100 * avg(y), 6) + 0.0 AS actual_pct, round(avg(risk), 6) + 0.0 AS mean_risk_pct,
 round(100 * avg(flag), 6) + 0.0 AS flag_flag_pct, round(100 * avg(flag) FILTER (y = 1), 6) + 0.0 AS flag_recall_pct, round(100 * avg(flag) FILTER (y = 0), 6) + 0.0 AS flag_fpr_pct,
 round(avg(dn - assigned) FILTER (y = 1), 6) + 0.0 AS days_earlier
FROM (SELECT g.*, {_F20.replace('e -', 'tie.e -').replace('an -', 'tie.an -').replace('- n)', '- tie.n)').replace('/ n', '/ tie.n')} AS flag, v.assigned
 FROM grouped g JOIN tie ON tie.score = g.rule JOIN given v ON v.record_id = g.record_id AND v.arm = 'rule') GROUP BY grp""",
       SCORED + "," + _GROUPED + "," + ties("rule") + "," + slot_ctes("month_start, area"))
def ag10(t: Tables):
    d = grouped(t).withColumnRenamed("rule", "score")
    d = rk.top_weights(d, 0.2, name="flag")
    s = rk.assigned_slots(d, ["month_start", "area"], {"rule": "score"})
    out = ag.group_table(s.withColumn("risk", F.col("risk") / 100.0), "grp", ["flag"], "zip5", "risk", ["days_earlier"])
    return _r(out, *[c for c in out.columns if c not in ("grp", "n", "areas")])


@query("bs6_area_intervals", f"""SELECT grp, {pct('recall')}, {pct('flag_rate')}, {pct('fpr')} FROM (SELECT rep, grp, 100.0::DOUBLE * sum(times * fy) / sum(times * p) AS recall, 100.0::DOUBLE * sum(times * f) / sum(times * n) AS flag_rate,
 100.0::DOUBLE * sum(times * (f - fy)) / sum(times * (n - p)) AS fpr FROM (
 SELECT zip5, grp, count(*) AS n, sum(y) AS p, sum(CAST(pers >= 10000 AS INT)) AS f, sum(CAST(pers >= 10000 AS INT) * y) AS fy FROM grouped GROUP BY 1, 2) JOIN wt USING (zip5) GROUP BY 1, 2) GROUP BY grp""",
       SCORED + "," + _GROUPED + "," + draw_ctes("scored", "zip5"))
def bs6(t: Tables):
    flag = (F.col("pers") >= 10000).cast("int")
    sums = {"n": F.count("*"), "p": F.sum("y"), "f": F.sum(flag), "fy": F.sum(flag * F.col("y"))}
    stats = {"recall": lambda s: F.lit(100.0) * s["fy"] / s["p"], "flag_rate": lambda s: F.lit(100.0) * s["f"] / s["n"],
             "fpr": lambda s: F.lit(100.0) * (s["f"] - s["fy"]) / (s["n"] - s["p"])}
    df = rs.cluster_interval(grouped(t), "zip5", sums, stats, ["grp"], REPS)
    return _r(df, *[c for c in df.columns if c != "grp"])


@query("bs7_district_share_ratios", f"""SELECT district, {', '.join(f"round(quantile_cont(ratio, {q}), 6) + 0.0 AS {n}" for q, n in ((0.025, 'low'), (0.975, 'high')))},
 round(quantile_cont(ratio, 0.025::DOUBLE / nd), 6) + 0.0 AS family_low, round(quantile_cont(ratio, 1 - 0.025::DOUBLE / nd), 6) + 0.0 AS family_high,
 round(greatest(0, median(ratio) + (quantile_cont(ratio, 0.025::DOUBLE / nd) - median(ratio)) * sqrt(2.0::DOUBLE)), 6) + 0.0 AS deff_low,
 round(greatest(0, median(ratio) + (quantile_cont(ratio, 1 - 0.025::DOUBLE / nd) - median(ratio)) * sqrt(2.0::DOUBLE)), 6) + 0.0 AS deff_high
FROM (SELECT rep, district, (wrong / CAST(tw AS DOUBLE)) / (lab / CAST(tl AS DOUBLE)) AS ratio FROM (SELECT *, sum(wrong) OVER (PARTITION BY rep) AS tw, sum(lab) OVER (PARTITION BY rep) AS tl FROM (
 SELECT rep, district, sum(times * w) AS wrong, sum(times * l) AS lab FROM per JOIN wt USING (address) GROUP BY 1, 2)) WHERE lab > 0 AND tw > 0 AND tl > 0) GROUP BY district""".replace("/ nd", "/ 9"),
       SCORED + """, inside AS (SELECT *, y = 0 AND pers >= 10000 AS wrong FROM scored WHERE district IS NOT NULL),
per AS (SELECT address, district, sum(CAST(wrong AS INT)) AS w, count(*) AS l FROM inside GROUP BY 1, 2),""" + draw_ctes("inside", "address", reps=DISTRICT_REPS))
def bs7(t: Tables):
    d = t.scored.where("district is not null")
    wrong = (F.col("y") == 0) & (F.col("pers") >= 10000)
    out = rs.share_ratios(d, "address", "district", wrong, F.lit(True), DISTRICT_REPS)
    return _r(out, *[c for c in out.columns if c != "district"])


@query("bs8_days_earlier_interval", f"""SELECT arm, {pct('days')} FROM (SELECT rep, arm, sum(times * s) / sum(times * n) AS days FROM (
 SELECT month_start, arm, sum(dn - assigned) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS n FROM given GROUP BY 1, 2) JOIN wt USING (month_start) GROUP BY 1, 2) GROUP BY arm""",
       SCORED + "," + slot_ctes("month_start, area") + "," + draw_ctes("scored", "month_start", reps=WINDOW_REPS))
def bs8(t: Tables):
    s = rk.assigned_slots(t.scored.select("record_id", "month_start", "area", "dn", "y", "rule", "pers"), ["month_start", "area"], {"rule": "rule", "pers": "pers"})
    sums = {"s": F.sum(F.when(F.col("y") == 1, F.col("days_earlier"))), "n": F.count_if(F.col("y") == 1)}
    df = rs.cluster_interval(s, "month_start", sums, {"days": lambda x: x["s"] / x["n"]}, ["arm"], WINDOW_REPS)
    return _r(df, "days_low", "days_high")


@query("bs9_window_auc_interval", f"""SELECT {pct('auc')} FROM (SELECT rep, sum(times * num) / CAST(sum(times * den) AS DOUBLE) AS auc FROM ok JOIN wt USING (month_start, area) GROUP BY rep)""".replace("USING (month_start, area)", "USING (win)"),
       SCORED + "," + ties("rule", parts="month_start, area") + """, ok AS (SELECT month_start || '|' || area AS win, num, den FROM (
 SELECT month_start, area, sum((n - pos) * (cp - pos + pos / 2.0::DOUBLE)) AS num, sum(pos) * sum(n - pos) AS den FROM tie GROUP BY 1, 2) WHERE den > 0),""" + draw_ctes("ok", "win", reps=WINDOW_REPS))
def bs9_interval(t: Tables):
    w = rk.within_window_auc(t.scored.withColumnRenamed("rule", "score"), ["month_start", "area"])
    w = w.select(F.concat_ws("|", F.col("month_start").cast("string"), "area").alias("win"), "num2", "den")
    df = rs.cluster_interval(w, "win", {"s": F.sum("num2"), "d": F.sum("den")}, {"auc": lambda x: x["s"] / 2 / x["d"]}, reps=WINDOW_REPS)
    return _r(df, "auc_low", "auc_high")


@query("bs10_spearman_interval", f"""SELECT {pct('rho')} FROM (SELECT rep, sum(times * r) / sum(times) AS rho FROM spear JOIN wt USING (month_start) GROUP BY rep)""", SCORED + """, spear AS MATERIALIZED (
 SELECT month_start, corr(-rd, rx) AS r FROM (SELECT *, rank() OVER (PARTITION BY month_start ORDER BY rule) + (count(*) OVER (PARTITION BY month_start, rule) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY month_start ORDER BY dn) + (count(*) OVER (PARTITION BY month_start, dn) - 1) / 2.0::DOUBLE AS rd FROM scored)
 GROUP BY 1 HAVING count(*) >= 10 AND min(rule) < max(rule) AND min(dn) < max(dn)),""" + draw_ctes("spear", "month_start", reps=WINDOW_REPS))
def bs10_interval(t: Tables):
    s = rk.within_window_spearman(t.scored.select("month_start", "rule", "dn"), ["month_start"], "rule", "dn")
    df = rs.cluster_interval(s, "month_start", {"r": F.sum("rho"), "n": F.count("*")}, {"rho": lambda x: x["r"] / x["n"]}, reps=WINDOW_REPS)
    return _r(df, "rho_low", "rho_high")


@query("bs11_name_group_ratio", f"""SELECT name_group, {pct('ratio')} FROM (SELECT rep, name_group, (f / CAST(n AS DOUBLE)) / max(f / CAST(n AS DOUBLE)) FILTER (name_group = 'unclassified') OVER (PARTITION BY rep) AS ratio FROM (
 SELECT rep, name_group, sum(times * f) AS f, sum(times * n) AS n FROM per JOIN wt USING (address) GROUP BY 1, 2)) WHERE name_group <> 'unclassified' GROUP BY name_group""",
       SCORED + """, clean AS (SELECT address, CASE WHEN business_type IN ('BUILDING') THEN 'first' WHEN business_type = 'HOUSEHOLD' THEN 'second' ELSE 'unclassified' END AS name_group, CAST(pers >= 10000 AS INT) AS f FROM scored WHERE y = 0),
per AS (SELECT address, name_group, sum(f) AS f, count(*) AS n FROM clean GROUP BY 1, 2),""" + draw_ctes("clean", "address"))
def bs11(t: Tables):
    from ..functions import name_group
    d = t.scored.where("y = 0").withColumn("name_group", name_group(F.col("business_type"), {"first": ["building"], "second": ["household"]}))
    per = d.groupBy("address", "name_group").agg(F.sum((F.col("pers") >= 10000).cast("int")).alias("f"), F.count("*").alias("n"))
    got = rs.replicate_sums(rs.dealt(per, "address"), "address", ["f", "n"], ["name_group"], REPS).withColumn("share", F.col("f") / F.col("n"))
    base = got.where("name_group = 'unclassified'").select("rep", F.col("share").alias("_base"))
    r = got.where("name_group <> 'unclassified'").join(base, "rep").withColumn("ratio", F.col("share") / F.col("_base"))
    return _r(rs.percentiles(r, ["ratio"], ["name_group"]), "ratio_low", "ratio_high")


# ── the group audit with all its arms ──

ARMS = ("risk", "rule12", "rule", "pers")
_ARMED = SCORED + "," + _GROUPED + "," + slot_ctes("month_start, area", ARMS) + """,
tt AS (SELECT *, sum(n) OVER (PARTITION BY arm ORDER BY score DESC) AS e, sum(n) OVER (PARTITION BY arm) AS an FROM (SELECT arm, score, count(*) AS n FROM given GROUP BY 1, 2)),
armed AS MATERIALIZED (SELECT v.arm, g.grp, g.zip5, g.y, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.2::DOUBLE * an - (e - n)) / n)) AS f, v.dn - v.assigned AS d
 FROM given v JOIN grouped g USING (record_id) JOIN tt ON tt.arm = v.arm AND tt.score = v.score)"""


def armed(t: Tables):
    """Each scored row once per arm, with its group, whether the arm's top fifth takes it, and how much earlier its slot comes."""
    s = rk.assigned_slots(grouped(t).drop("score"), ["month_start", "area"], {a: a for a in ARMS}).withColumnRenamed("arm_score", "score")
    return rk.top_weights(s, 0.2, parts=["arm"], name="flag")


@query("ag10_group_fairness_arms", """SELECT grp, arm, count(*) AS n, count(DISTINCT zip5) AS areas, round(100 * avg(y), 6) + 0.0 AS actual_pct, round(100 * avg(f), 6) + 0.0 AS flag_pct,
 round(100 * avg(f) FILTER (y = 1), 6) + 0.0 AS recall_pct, round(100 * avg(f) FILTER (y = 0), 6) + 0.0 AS fpr_pct, round(avg(d) FILTER (y = 1), 6) + 0.0 AS days_sooner FROM armed GROUP BY 1, 2""", _ARMED)
def ag10_arms(t: Tables):
    hit, miss = F.col("y") == 1, F.col("y") == 0
    out = armed(t).groupBy("grp", "arm").agg(
        F.count("*").alias("n"), F.count_distinct("zip5").alias("areas"), (100 * F.avg("y")).alias("actual_pct"), (100 * F.avg("flag")).alias("flag_pct"),
        (100 * F.avg(F.when(hit, F.col("flag")))).alias("recall_pct"), (100 * F.avg(F.when(miss, F.col("flag")))).alias("fpr_pct"),
        F.avg(F.when(hit, F.col("days_earlier"))).alias("days_sooner"))
    return _r(out, "actual_pct", "flag_pct", "recall_pct", "fpr_pct", "days_sooner")


_CUBE = _ARMED + "," + draw_ctes("scored", "zip5") + """,
per AS MATERIALIZED (SELECT zip5, grp, arm, count(*) AS n, sum(y) AS p, sum(f) AS f, sum(f * y) AS fy, sum(d * y) AS dy FROM armed GROUP BY 1, 2, 3),
cube AS MATERIALIZED (SELECT rep, grp, arm, sum(times * n)::DOUBLE AS n, sum(times * p)::DOUBLE AS p, sum(times * f) AS f, sum(times * fy) AS fy, sum(times * dy) AS dy FROM per JOIN wt USING (zip5) GROUP BY 1, 2, 3)"""


@query("bs6_arm_intervals", f"""SELECT grp, arm, {pct('recall')}, {pct('flag_rate')}, {pct('fpr')}, {pct('days')} FROM (
 SELECT grp, arm, 100 * fy / nullif(p, 0) AS recall, 100 * f / nullif(n, 0) AS flag_rate, 100 * (f - fy) / nullif(n - p, 0) AS fpr, dy / nullif(p, 0) AS days FROM cube) GROUP BY 1, 2""", _CUBE)
def bs6_arms(t: Tables):
    return _r(rs.arm_intervals(rs.arm_cube(armed(t), "zip5", "grp", REPS), "grp"), *[f"{s}_{e}" for s in ("recall", "flag_rate", "fpr", "days") for e in ("low", "high")])


@query("bs6_arm_gaps", f"""SELECT arm, {pct('recall_gap')}, {pct('flag_ratio')}, {pct('actual_ratio')} FROM (
 SELECT a.arm, 100 * (a.fy / nullif(a.p, 0) - b.fy / nullif(b.p, 0)) AS recall_gap, (a.f / nullif(a.n, 0)) / nullif(b.f / nullif(b.n, 0), 0) AS flag_ratio, (a.p / nullif(a.n, 0)) / nullif(b.p / nullif(b.n, 0), 0) AS actual_ratio
 FROM cube a JOIN cube b ON a.rep = b.rep AND a.arm = b.arm AND a.grp = 'Q1' AND b.grp = 'Q4') GROUP BY 1""", _CUBE)
def bs6_gaps(t: Tables):
    return _r(rs.arm_gaps(rs.arm_cube(armed(t), "zip5", "grp", REPS), "grp", "Q1", "Q4"), *[f"{s}_{e}" for s in ("recall_gap", "flag_ratio", "actual_ratio") for e in ("low", "high")])
