"""Rankings, ranking measures and slot re-assignment."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r6
from ..operators import aggregates as ag, ranking as rk, snapshot as sn
from ..operators.joins import with_scalars
from ..sources.adapt import zip_attributes
from .features import MONTH_CTES, _r, snap_ctes, snaps
from .registry import ORIGIN, TRAIN_END, Tables, query

SCORED = MONTH_CTES + f""",
scored AS MATERIALIZED (SELECT r.business_id, r.record_id, r.day, r.dn, a.t AS month_start, r.n_major, CAST(r.major AS INT) AS y, round(a.rule_mean_all, 6) AS rule,
 round(a.rule_mean12, 6) AS rule12, round(a.persistence, 6) AS pers, a.prior_n, a.days_since_last, CAST(round(100 * coalesce(a.prior_major_rate, 0.2::DOUBLE)) AS INT) AS risk,
 p.business_type, p.zip5, p.address, p.district, p.permit_status, p.area
 FROM research r JOIN at_t a ON a.business_id = r.business_id AND a.t = CAST(date_trunc('month', r.day) AS DATE) JOIN place p ON p.business_id = r.business_id
 WHERE r.visit_type = 'routine' AND r.day > DATE '{TRAIN_END}')"""


def ties(score: str, src: str = "scored", parts: str = "", name: str = "tie") -> str:
    """Distinct scores with running totals from the highest down, as a CTE."""
    p, pb = (f"{parts}, ", f"PARTITION BY {parts} ") if parts else ("", "")
    return f"""
{name} AS (SELECT *, sum(n) OVER ({pb}ORDER BY score DESC) AS e, sum(pos) OVER ({pb}ORDER BY score DESC) AS cp, sum(n) OVER ({pb.strip()}) AS an, sum(pos) OVER ({pb.strip()}) AS ap
 FROM (SELECT {p}{score} AS score, count(*) AS n, sum(y) AS pos FROM {src} GROUP BY {p}{score}))"""


_CLIP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({f} * an - (e - n)) / n))"
_F20 = _CLIP.format(f="0.2::DOUBLE")


def _rule(t: Tables):
    return t.scored.withColumnRenamed("rule", "score")


@query("rk1_top_fraction_weights", f"SELECT s.record_id, round({_F20}, 6) + 0.0 AS weight FROM scored s JOIN tie ON tie.score = s.rule", SCORED + "," + ties("rule"))
def rk1(t: Tables):
    return _r(rk.top_weights(_rule(t), 0.2).select("record_id", "weight"), "weight")


@query("rk2_capture", f"""SELECT f AS frac, round(sum(w * pos) / max(ap), 6) + 0.0 AS recall, round(sum(w * pos) / sum(w * n), 6) + 0.0 AS precision,
 round(sum(w * pos) / sum(w * n) / (max(ap) / max(an)::DOUBLE), 6) + 0.0 AS lift
FROM (SELECT *, {_CLIP.format(f='f')} AS w FROM tie CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) v(f)) GROUP BY f""", SCORED + "," + ties("rule"))
def rk2(t: Tables):
    return _r(rk.capture(_rule(t), [0.1, 0.2, 0.3]), "recall", "precision", "lift")


@query("rk3_gains", "SELECT score, round(e / an::DOUBLE * 100, 6) + 0.0 AS listed_pct, round(cp / ap::DOUBLE * 100, 6) + 0.0 AS caught_pct FROM tie",
       SCORED + "," + ties("rule"))
def rk3(t: Tables):
    return _r(rk.gains(_rule(t)), "listed_pct", "caught_pct")


_ORIGIN = f"SELECT DATE '{ORIGIN}' AS as_of"
_AT_ORIGIN = snap_ctes(_ORIGIN)


@query("rk4_catch_table", """SELECT k, CAST(sum(coalesce(y, 0)) FILTER (pos <= k) AS BIGINT) AS caught, CAST(sum(coalesce(y, 0)) AS BIGINT) AS total
FROM (SELECT *, row_number() OVER (ORDER BY avg_deficit DESC, coalesce(avg_score, 97), business_id) AS pos FROM fr WHERE kind = 'restaurant')
CROSS JOIN (VALUES (25), (50), (100), (200)) v(k) GROUP BY k""", _AT_ORIGIN)
def rk4(t: Tables):
    f = sn.frame(snaps(t, [ORIGIN]), t.located, F.col("kind") == "restaurant", labelled=False)
    f = f.withColumn("tb", F.coalesce("avg_score", F.lit(97.0)))
    return rk.catch_table(rk.ranked(f, "tb", "business_id", "avg_deficit"), [25, 50, 100, 200])


def slot_ctes(window: str, arms=("rule", "pers")) -> str:
    """Slots by position: each window's sorted days joined to its rows from the highest score down."""
    union = " UNION ALL ".join(f"SELECT record_id, {window}, dn, y, '{a}' AS arm, {a} AS score FROM scored" for a in arms)
    w = window.split(", ")
    on = " AND ".join(f"o.{c} = s.{c}" for c in w)
    return f"""
slot AS (SELECT {window}, dn AS slot, row_number() OVER (PARTITION BY {window} ORDER BY dn) AS pos FROM scored),
arms AS ({union}),
ord AS (SELECT *, row_number() OVER (PARTITION BY arm, {window} ORDER BY score DESC, record_id) AS pos FROM arms),
given AS (SELECT o.*, avg(s.slot) OVER (PARTITION BY o.arm, {', '.join('o.' + c for c in w)}, o.score) AS assigned FROM ord o JOIN slot s ON {on} AND s.pos = o.pos)"""


@query("rk5_slot_reassign", "SELECT record_id, arm, round(assigned, 6) + 0.0 AS assigned, round(dn - assigned, 6) + 0.0 AS days_earlier FROM given",
       SCORED + "," + slot_ctes("month_start, area"))
def rk5(t: Tables):
    s = rk.assigned_slots(t.scored.select("record_id", "month_start", "area", "dn", "y", "rule", "pers"), ["month_start", "area"], {"rule": "rule", "pers": "pers"})
    return _r(s.select("record_id", "arm", "assigned", "days_earlier"), "assigned", "days_earlier")


@query("ag27_days_earlier", f"""SELECT arm, round(avg(dn - assigned) FILTER (y = 1), 6) + 0.0 AS days_earlier, round(avg(CAST(dn - assigned > 0 AS INT)) FILTER (y = 1), 6) + 0.0 AS share_earlier,
 round(avg(dn - assigned) FILTER (y = 0), 6) + 0.0 AS clean_days, round(sum(dn - assigned) FILTER (y = 1) / (((SELECT max(day) FROM scored) - DATE '{TRAIN_END}') / 365.25::DOUBLE), 4) + 0.0 AS days_per_year
FROM given GROUP BY arm""", SCORED + "," + slot_ctes("month_start"))
def ag27(t: Tables):
    rows = t.scored.select("record_id", "month_start", "dn", "y", "rule", "pers")
    s = rk.assigned_slots(rows, ["month_start"], {"rule": "rule", "pers": "pers"})
    s = with_scalars(s, t.scored.agg((F.datediff(F.max("day"), F.lit(TRAIN_END).cast("date")) / 365.25).alias("_years")))
    out = ag.earlier_summary(s, F.max("_years"))
    return _r(out.select("*", r6(F.col("days_per_year"), 4).alias("_d")).drop("days_per_year").withColumnRenamed("_d", "days_per_year"), "days_earlier", "share_earlier", "clean_days")


@query("rk14_area_groups", """SELECT zip5, CASE least(CAST(floor((cum - n / 2.0::DOUBLE) / al * 4) AS INT), 3) WHEN 0 THEN 'Q1' WHEN 1 THEN 'Q2' WHEN 2 THEN 'Q3' ELSE 'Q4' END AS grp
FROM (SELECT *, sum(n) OVER (ORDER BY income, zip5) AS cum, sum(n) OVER () AS al FROM (SELECT zip5, min(income) AS income, count(*) AS n FROM scored JOIN zip_attr USING (zip5) GROUP BY 1))""", SCORED)
def rk14(t: Tables):
    return rk.area_groups(t.scored.join(zip_attributes(t.places), "zip5"), "zip5", "income", ["Q1", "Q2", "Q3", "Q4"])


_AUC = "sum((n - pos) * (cp - pos + pos / 2.0::DOUBLE)) / (sum(pos) * sum(n - pos))"


@query("ml9_auc", f"""SELECT arm, round({_AUC}, 6) + 0.0 AS auc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n - pos) AS BIGINT) AS negatives FROM tie GROUP BY arm""",
       SCORED + ", arms AS (SELECT y, 'rule' AS arm, rule AS score FROM scored UNION ALL SELECT y, 'rule12', rule12 FROM scored UNION ALL SELECT y, 'pers', pers FROM scored)," + ties("score", "arms", "arm"))
def ml9(t: Tables):
    s = t.scored.select("y", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("score")) for a in ("rule", "rule12", "pers")])).alias("_a"))
    return _r(rk.auc(s.select("y", "_a.arm", "_a.score"), ["arm"]), "auc")


@query("ml10_average_precision", "SELECT round(sum(pos * cp / e::DOUBLE) / max(ap), 6) + 0.0 AS average_precision FROM tie", SCORED + "," + ties("rule"))
def ml10(t: Tables):
    return _r(rk.average_precision(_rule(t)), "average_precision")


@query("ml10_log_loss", """SELECT round(avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) + 0.0 AS log_loss
FROM (SELECT y, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, risk / 100.0::DOUBLE)) AS q FROM scored)""", SCORED)
def ml10_loss(t: Tables):
    return _r(rk.log_loss(t.scored.withColumn("p", F.col("risk") / 100.0), eps=1e-6), "log_loss")


@query("ml16_threshold_table", f"""SELECT arm, f AS frac, round(sum(w * pos) / max(ap), 6) + 0.0 AS recall, round(sum(w * pos) / sum(w * n), 6) + 0.0 AS precision
FROM (SELECT *, {_CLIP.format(f='f')} AS w FROM tie CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE)) v(f)) GROUP BY arm, f""",
       SCORED + ", arms AS (SELECT y, 'rule' AS arm, rule AS score FROM scored UNION ALL SELECT y, 'rule12', rule12 FROM scored UNION ALL SELECT y, 'pers', pers FROM scored)," + ties("score", "arms", "arm"))
def ml16(t: Tables):
    s = t.scored.select("y", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("score")) for a in ("rule", "rule12", "pers")])).alias("_a"))
    out = rk.capture(s.select("y", "_a.arm", "_a.score"), [0.1, 0.2, 0.3, 0.4, 0.5], ["arm"])
    return _r(out.drop("lift"), "recall", "precision")


@query("bs9_within_window_auc", """SELECT round(sum(num) / sum(den), 6) + 0.0 AS auc, count(*) AS windows FROM (
 SELECT month_start, area, sum((n - pos) * (cp - pos + pos / 2.0::DOUBLE)) AS num, sum(pos) * sum(n - pos) AS den FROM tie GROUP BY 1, 2) WHERE den > 0""",
       SCORED + "," + ties("rule", parts="month_start, area"))
def bs9(t: Tables):
    w = rk.within_window_auc(_rule(t), ["month_start", "area"])
    return _r(w.agg((F.sum("num2") / 2 / F.sum("den")).alias("auc"), F.count("*").alias("windows")), "auc")


@query("bs10_within_window_spearman", """SELECT round(avg(rho), 6) + 0.0 AS rho, count(*) AS windows FROM (
 SELECT month_start, corr(-rd, rx) AS rho FROM (SELECT *, rank() OVER (PARTITION BY month_start ORDER BY rule) + (count(*) OVER (PARTITION BY month_start, rule) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY month_start ORDER BY dn) + (count(*) OVER (PARTITION BY month_start, dn) - 1) / 2.0::DOUBLE AS rd FROM scored)
 GROUP BY 1 HAVING count(*) >= 10 AND min(rule) < max(rule) AND min(dn) < max(dn))""", SCORED)
def bs10(t: Tables):
    s = rk.within_window_spearman(t.scored.select("month_start", "rule", "dn"), ["month_start"], "rule", "dn")
    return _r(s.agg(F.avg("rho").alias("rho"), F.count("*").alias("windows")), "rho")


@query("ag26_mean_day_of_month", "SELECT round(avg(day(day)) FILTER (y = 1), 6) + 0.0 AS major, round(avg(day(day)) FILTER (y = 0), 6) + 0.0 AS clean FROM scored", SCORED)
def ag26(t: Tables):
    d = F.dayofmonth("day")
    return _r(t.scored.agg(F.avg(F.when(F.col("y") == 1, d)).alias("major"), F.avg(F.when(F.col("y") == 0, d)).alias("clean")), "major", "clean")


@query("ag20_flagged_by_type", """SELECT business_type, count(*) AS n, count(*) FILTER (flag) AS flagged, round(avg(y) FILTER (flag), 6) + 0.0 AS precision, round(avg(y), 6) + 0.0 AS base
FROM (SELECT *, row_number() OVER (ORDER BY rule DESC, record_id) <= CAST(floor(0.2::DOUBLE * (SELECT count(*) FROM scored)) AS BIGINT) AS flag FROM scored) GROUP BY 1 HAVING count(*) >= 300 AND count(*) FILTER (flag) >= 30""", SCORED)
def ag20(t: Tables):
    from ..operators.ordering import positions
    p = positions(_rule(t).select("record_id", "business_type", "y", "score"), [], [F.col("score").desc(), F.col("record_id")])
    p = with_scalars(p, t.scored.agg(F.floor(0.2 * F.count("*")).alias("_k")))
    flag = F.col("position") <= F.col("_k")
    g = p.groupBy("business_type").agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"), F.avg(F.when(flag, F.col("y"))).alias("precision"), F.avg("y").alias("base"))
    return _r(g.where("n >= 300 and flagged >= 30"), "precision", "base")


@query("ag25_visit_inside_month", """SELECT round(avg(CAST(s.prior_n > m.prior_n AS INT)), 6) + 0.0 AS share FROM scored m JOIN (
 SELECT business_id, record_id, row_number() OVER (PARTITION BY business_id ORDER BY dn, later, seq) - 1 AS prior_n FROM research) s USING (business_id, record_id)""", SCORED)
def ag25(t: Tables):
    from ..operators.history import since_start
    own = since_start(t.research).select("record_id", F.col("prior_n").alias("_own"))
    return _r(t.scored.join(own, "record_id").agg(F.avg((F.col("_own") > F.col("prior_n")).cast("double")).alias("share")), "share")


@query("bd16_head_start", """SELECT area, CAST(month_start AS VARCHAR) AS month_start, count(*) AS n, round(avg(dn - assigned), 6) + 0.0 AS mean_days, round(stddev_samp(dn - assigned), 6) + 0.0 AS sd_days
FROM given WHERE arm = 'rule' AND y = 1 AND area LIKE 'D%' GROUP BY 1, 2""", SCORED + "," + slot_ctes("month_start, area"))
def bd16(t: Tables):
    s = rk.assigned_slots(t.scored.select("record_id", "month_start", "area", "dn", "y", "rule"), ["month_start", "area"], {"rule": "rule"})
    s = s.where("y = 1 and area like 'D%'")
    g = s.groupBy("area", "month_start").agg(F.count("*").alias("n"), F.avg("days_earlier").alias("mean_days"), F.stddev_samp("days_earlier").alias("sd_days"))
    return _r(g, "mean_days", "sd_days")
