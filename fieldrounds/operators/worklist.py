"""Monthly lists: who is due, in what order, and why; and how well past lists did."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import daynum, r6
from ..rules import RULES, Rules
from .aggregates import km_median
from .joins import with_scalars
from .ordering import running_sums
from .snapshot import stand_ins


def as_of_months(visits: DataFrame, places: DataFrame, months: list[str], rules: Rules = RULES) -> DataFrame:
    """What each place's record says on the 1st of each month, every month in one pass.

    One row per (place, month) with a routine on record: last routine and its outcome, last visit,
    mean readings, majors and health closures in two years.
    """
    c = F.col
    real = visits.select("business_id", "day", "dn", "seq", "visit_type", "status", "score", "rated", "n_major", "closure", F.lit(False).alias("asof"))
    asked = stand_ins(places, months).select("business_id", "day", daynum(c("day")).cast("int").alias("dn"), F.lit(True).alias("asof"))
    line = real.unionByName(asked, allowMissingColumns=True)
    ever = W.partitionBy("business_id").orderBy("dn").rangeBetween(W.unboundedPreceding, -1)
    two = W.partitionBy("business_id").orderBy("dn").rangeBetween(-rules.score_window_days, -1)
    rt = c("visit_type") == "routine"
    last = F.max(F.when(rt, F.struct("dn", "seq", "day", "score", "status", "closure"))).over(ever)
    return line.select(
        "business_id", c("day").alias("month"), "asof", last.alias("_last"), F.max(F.when(~c("asof"), c("day"))).over(ever).alias("last_visit"),
        F.avg(F.when(rt, c("rated"))).over(ever).alias("mean_rated"), F.count(F.when(rt, 1)).over(ever).alias("routines"),
        F.count(F.when(rt & (c("n_major") > 0), 1)).over(ever).alias("routines_major"),
        F.count(F.when(c("closure") == "health", 1)).over(two).alias("closures_24m")).where(
        c("asof") & c("_last").isNotNull()).select(
        "business_id", "month", c("_last.day").alias("last_routine_date"), c("_last.score").alias("last_routine_score"),
        F.concat(c("_last.status"), F.when(c("_last.closure") == "health", " (health closure)").otherwise("")).alias("last_routine_outcome"),
        "last_visit", "mean_rated", "routines", "routines_major", "closures_24m")


def usual_intervals(visits: DataFrame, types: DataFrame, asof: DataFrame, months: list[str], rules: Rules = RULES) -> DataFrame:
    """Usual days between routines by (month, type), Kaplan-Meier with open intervals (AG6).

    Finished gaps enter every later month, open intervals of active places the month they are open
    in. Gaps are counted by type, length and first month that sees them before later months are attached, so what is spread over
    months is a calendar of lengths, not visits. ``business_type`` is null on the pooled row of a month.
    """
    c = F.col
    w = W.partitionBy("business_id").orderBy("dn")
    gaps = (visits.where("visit_type = 'routine'").select("business_id", "day", "dn").withColumn("t", c("dn") - F.lag("dn").over(w))
            .where("t is not null").join(types, "business_id"))
    every_month = F.array(*[F.lit(m).cast("date") for m in sorted(months)])
    seen_from = F.size(F.filter(every_month, lambda m: m <= c("day")))
    counted = gaps.groupBy("business_type", "t", seen_from.alias("_from")).agg(F.count("*").alias("n"))
    at = F.explode(F.slice(every_month, c("_from") + 1, F.lit(len(months)))).alias("month")
    closed = counted.where(c("_from") < len(months)).select("business_type", "t", "n", at).withColumn("event", F.lit(True))
    live = asof.where(F.datediff("month", "last_visit") <= rules.active_days).join(types, "business_id")
    still = (live.groupBy("business_type", F.datediff("month", "last_routine_date").alias("t"), "month").agg(F.count("*").alias("n"))
             .withColumn("event", F.lit(False)))
    every = closed.unionByName(still).select("month", "t", "n", "event", F.explode(F.array(c("business_type"), F.lit("*"))).alias("business_type"))
    km = km_median(every, ["month", "business_type"], count="n")
    plain = closed.groupBy("month").agg(F.percentile("t", F.lit(0.5), c("n")).alias("_plain"))
    pooled = km.where("business_type = '*'").join(plain, "month", "left").select("month", F.coalesce("median", "_plain", F.lit(365.0)).alias("pooled"))
    kept = km.where((c("business_type") != "*") & (c("events") >= rules.min_gaps) & c("median").isNotNull()).select("month", "business_type", c("median").alias("interval"))
    return kept.unionByName(pooled.select("month", F.lit(None).cast("string").alias("business_type"), c("pooled").alias("interval")))


def monthly(visits: DataFrame, located: DataFrame, months: list[str], rules: Rules = RULES, kinds: tuple[str, ...] | None = None,
            use_status: bool = True, city_only: bool = True, card: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """The due list of each month in each district (WL1), ordered by :func:`order_list`.

    ``card`` brings ``facility_id, card_points, escalation`` (a text, empty without one) when a point
    rule's list exists; every place is on one scale, the card's points first.
    """
    c = F.col
    asof = as_of_months(visits, located, months, rules)
    types = located.select("business_id", "business_type")
    iv = usual_intervals(visits, types, asof, months, rules)
    by_type = iv.where("business_type is not null")
    pooled = iv.where("business_type is null").select("month", c("interval").alias("_pooled"))
    f = asof.where(F.datediff("month", "last_visit") <= rules.active_days).join(located, "business_id")
    if kinds:
        f = f.where(c("kind").isin(*kinds))
    if use_status:
        f = f.where(F.lower(F.coalesce("permit_status", F.lit(""))) != "expired")
    f = f.where("district is not null") if city_only else f.fillna(0, ["district"])
    f = f.join(by_type, ["month", "business_type"], "left").join(pooled, "month", "left").withColumn("interval", F.coalesce("interval", "_pooled")).drop("_pooled")
    f = due(f, rules).withColumn("mean_points", r6(100 - F.coalesce("mean_rated", F.lit(rules.fill_score)), 1))
    if card is None:
        f = f.withColumns({"card_points": F.lit(None).cast("double"), "escalation": F.lit("")})
    else:
        f = f.join(card, "facility_id", "left").fillna("", ["escalation"])
    f = f.withColumn("rule_points", F.coalesce("card_points", "mean_points"))
    if held is None:
        f = f.withColumn("held", F.lit(False))
    else:
        f = f.join(held.select("facility_id", F.lit(True).alias("held")).distinct(), "facility_id", "left").fillna(False, ["held"])
    return order_list(f)


def due(f: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Due estimate, and whether it is due by the month's end less the margin (WL2)."""
    c = F.col
    est = F.date_add("last_routine_date", F.round("interval").cast("int"))
    late = F.datediff(F.last_day("month"), "last_routine_date") >= c("interval") - rules.due_margin
    return f.withColumns({"due_estimate": est, "due_this_month": late})


def order_list(f: DataFrame) -> DataFrame:
    """Positions within (month, district) among all and among due places (RK6), in one pass.

    Held places last by due date, then places with an escalation fact, then points, the lower mean,
    the earlier due date, the id.
    """
    c = F.col
    esc = (F.length("escalation") > 0) & ~c("held")
    f = f.withColumns({"_esc": esc.cast("int"), "_pts": F.when(~c("held"), c("rule_points")), "_mean": F.when(~c("held"), c("mean_points")), "_h": c("held").cast("int")})
    keys = [c("_h"), c("_esc").desc(), c("_pts").desc_nulls_last(), c("_mean").desc_nulls_last(), c("due_estimate"), c("facility_id")]
    out = running_sums(f, ["month", "district"], keys, {"rule_order_all": F.lit(1).cast("long"), "_due": c("due_this_month").cast("long")})
    return (out.withColumn("rule_order", F.when(c("due_this_month"), c("_due")))
            .withColumn("rule_points", F.when(~c("held"), c("rule_points"))).drop("_esc", "_pts", "_mean", "_h", "_due"))


def model_order(f: DataFrame, risk: str = "model_risk") -> DataFrame:
    """Positions by a model's risk within (month, district), among all and among due (RK7)."""
    c = F.col
    out = running_sums(f, ["month", "district"], [c(risk).desc_nulls_last(), c("facility_id")],
                       {"model_order_all": F.lit(1).cast("long"), "_due": c("due_this_month").cast("long")})
    return out.withColumn("model_order", F.when(c("due_this_month"), c("_due"))).drop("_due")


def reasons(f: DataFrame, used: DataFrame) -> DataFrame:
    """The sentence behind a row: the readings its number averages and their mean (FN16).

    ``used`` holds ``business_id, scores_used``, bounded to one reading a day.
    """
    c = F.col
    d = f.join(used, "business_id", "left")
    one = F.transform("scores_used", lambda u: F.concat(u["score"].cast("string"), F.when(u["closure"], F.concat(
        F.lit(" [set for a closure; source: "), F.coalesce(u["source_score"].cast("string"), F.lit("none")), F.lit("]"))).otherwise("")))
    total = F.aggregate("scores_used", F.lit(0.0), lambda a, u: a + u["score"])
    mean = F.format_string("%.1f", F.bround(total / F.when(F.size("scores_used") > 0, F.size("scores_used")), 1))
    some = F.coalesce(F.size("scores_used") > 0, F.lit(False))
    listed = F.concat(F.lit("Mean "), mean, F.lit(" of: "), F.array_join(one, ", "), F.lit("."))
    first = F.when((F.length("escalation") > 0) & ~c("held"), F.concat(F.lit("Raised for: "), c("escalation"), F.lit(". "))).otherwise("")
    majors = F.when(c("routines_major") > 0, F.concat(F.lit(" Routines with a major: "), c("routines_major").cast("string"), F.lit("/"),
                                                     c("routines").cast("string"), F.lit("."))).otherwise("")
    text = F.concat(first, F.when(some, listed).otherwise("Mean taken as 97, for want of any score."), majors)
    return d.withColumn("why", F.when(c("held"), "Held: no number is shown.").otherwise(text)).drop("scores_used")


def closure_facts(visits: DataFrame, list_date: str, days: int = 730) -> DataFrame:
    """Health closures in two years, the last one and its reopening (WL3)."""
    day = F.lit(list_date).cast("date")
    h = visits.where("closed and closure = 'health'")
    recent = (F.col("day") < day) & (F.datediff(day, "day") <= days)
    last = F.max(F.struct("day", "seq", "reopened_on"))
    return h.groupBy("business_id").agg(F.count_if(recent).alias("closures_24m"), last.alias("_l")).select(
        "business_id", "closures_24m", F.col("_l.day").alias("last_closure"), F.col("_l.reopened_on").alias("reopened_on"))


def backtest(lists: DataFrame, visits: DataFrame) -> DataFrame:
    """Coverage and precision of each month's list, all months in one join (SET2)."""
    c = F.col
    done = visits.where("visit_type = 'routine'").select("business_id", F.trunc("day", "month").alias("month"), F.lit(1).alias("_done")).distinct()
    j = lists.select("business_id", "month", "due_this_month").join(done, ["business_id", "month"], "left")
    hit, seen, listed = c("_done").isNotNull() & c("due_this_month"), c("_done").isNotNull(), c("due_this_month")
    return j.groupBy("month").agg(F.count_if(listed).alias("listed"), F.count_if(seen).alias("inspected"),
                                  (F.count_if(hit) / F.greatest(F.count_if(seen), F.lit(1))).alias("coverage"),
                                  (F.count_if(hit) / F.greatest(F.count_if(listed), F.lit(1))).alias("precision"))


def keep_set(scored: DataFrame, key: str, share: float, base_share: float, seed: int = 0, score: str = "score") -> DataFrame:
    """The top share by score quantile, and an exact seeded share of the rest by md5 order (ML17)."""
    from .ordering import exact_quantiles, positions
    c = F.col
    cut = exact_quantiles(scored, [], score, {"_cut": 1 - share})
    s = with_scalars(scored, cut)
    top = s.where(c(score) >= c("_cut"))
    rest = s.where(c(score) < c("_cut")).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), c(key).cast("string")).cast("binary")))
    p = with_scalars(positions(rest, [], [c("_h"), c(key)], "_p"), rest.agg(F.round(F.lit(base_share) * F.count("*")).alias("_k")))
    extra = p.where(c("_p") <= c("_k"))
    return top.select(key, F.lit("top").alias("why_kept")).unionByName(extra.select(key, F.lit("random").alias("why_kept")))
