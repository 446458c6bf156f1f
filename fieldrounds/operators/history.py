"""What was known about a place before a date.

Every feature is a window over one timeline per place, partitioned once and sorted once; a date that
is not a visit (a month start, a list date) enters the timeline as a stand-in row whose values are
null, so it reads history but is never part of anyone's history. Visits are one row per place, day
and type, which bounds a timeline by the calendar.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import age_years, daynum, month_start, possible_age
from ..rules import RULES, Rules

# Names of the history features.
HISTORY = ("prior_n", "days_since_last", "last_score", "last_major", "prior_major_rate", "prior_mean_score",
           "prior_mean_viol")
HISTORY_WINDOW = ("w_prior_n", "w_days_since_last", "w_last_score", "w_last_major", "w_major_rate",
                  "w_mean_score", "w_mean_viol")


def _with_flag(df: DataFrame) -> DataFrame:
    return df if "asof" in df.columns else df.withColumn("asof", F.lit(False))


def _sort() -> list[Column]:
    """By day; a stand-in before that day's visits, a routine before the other visits of its day."""
    return [F.col("dn"), (~F.col("asof")).cast("int"), (F.col("visit_type") != "routine").cast("int"), F.col("seq")]


def rows_before():
    return W.partitionBy("business_id").orderBy(*_sort()).rowsBetween(W.unboundedPreceding, -1)


def days_before(n: int, upto: int = 1):
    """The ``n`` days before a row, strictly earlier dates by default."""
    return W.partitionBy("business_id").orderBy("dn").rangeBetween(-n, -upto)


def _real(c: Column) -> Column:
    return F.when(~F.col("asof"), c)


def _latest(value: Column, w) -> Column:
    """The latest non-null value in a frame; same-day rows in their fixed order."""
    key = F.struct(F.col("dn"), (F.col("visit_type") != "routine").cast("int").alias("l"), F.col("seq"), value.alias("v"))
    return F.max(F.when(value.isNotNull() & ~F.col("asof"), key)).over(w)["v"]


def since_start(df: DataFrame) -> DataFrame:
    """Row-based history over the whole record (WF1 to WF5)."""
    df, w, c = _with_flag(df), rows_before(), F.col
    prev = F.last(_real(F.struct("dn", "n_major")), ignorenulls=True).over(w)
    rated = F.when(c("visit_type") == "routine", c("rated"))
    return df.select(
        "*", F.count(_real(F.lit(1))).over(w).alias("prior_n"), (c("dn") - prev["dn"]).alias("days_since_last"),
        F.last("score", ignorenulls=True).over(w).alias("last_score"),
        F.coalesce((prev["n_major"] > 0).cast("double"), F.lit(0.0)).alias("last_major"),
        F.avg("major").over(w).alias("prior_major_rate"), F.avg("score").over(w).alias("prior_mean_score"),
        F.avg("n_items").over(w).alias("prior_mean_viol"), F.avg(rated).over(w).alias("prior_mean_rated"),
        F.last(rated, ignorenulls=True).over(w).alias("last_rated"))


def trailing(df: DataFrame, days: int = RULES.window_days, score: str = "score", prefix: str = "w_") -> DataFrame:
    """The same facts over the ``days`` before each row, strictly earlier dates (WF6, WF7)."""
    df, w, c = _with_flag(df), days_before(days), F.col
    n = F.count(_real(F.lit(1))).over(w)
    return df.select(
        "*", n.alias(f"{prefix}prior_n"), (c("dn") - F.max(_real(c("dn"))).over(w)).alias(f"{prefix}days_since_last"),
        _latest(c(score), w).alias(f"{prefix}last_score"),
        _latest((c("n_major") > 0).cast("double"), w).alias(f"{prefix}last_major"),
        F.avg(_real((c("n_major") > 0).cast("double"))).over(w).alias(f"{prefix}major_rate"),
        F.avg(score).over(w).alias(f"{prefix}mean_score"), F.avg(_real(c("n_items"))).over(w).alias(f"{prefix}mean_viol"),
        F.count(score).over(w).alias(f"{prefix}n_scores"))


def persistence_key(routines_major: Column, majors: Column, last_score: Column, rules: Rules = RULES) -> Column:
    last = F.coalesce(last_score, F.lit(rules.fill_score))
    return routines_major * F.lit(1e4) + F.least(majors, F.lit(99)) * 10 + (100 - last) / 100


def persistence(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Routines with a major in the year, then majors in the year, then the lowest last score (WF8)."""
    df, c = _with_flag(df), F.col
    year, two = days_before(rules.window_days), days_before(rules.score_window_days)
    hit = ((c("visit_type") == "routine") & (c("n_major") > 0)).cast("int")
    counted = F.when(c("visit_type").isin("routine", "reinspection", "followup"), c("n_major")).otherwise(0)
    return df.withColumn("persistence", persistence_key(
        F.coalesce(F.sum(_real(hit)).over(year), F.lit(0)), F.coalesce(F.sum(_real(counted)).over(year), F.lit(0)),
        _latest(F.when(c("visit_type") == "routine", c("score")), two), rules))


def no_model_rules(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One-line rules, higher first: minus a mean or last reading, a typical A without one (WF9)."""
    fill = F.lit(rules.fill_score)
    return df.select("*", (-F.coalesce("wr_mean_score", fill)).alias("rule_mean12"),
                     (-F.coalesce("prior_mean_rated", fill)).alias("rule_mean_all"),
                     (-F.coalesce("last_rated", fill)).alias("rule_last"))


def permit_age(df: DataFrame) -> DataFrame:
    return df.select("*", age_years(F.col("day"), F.col("opened_date")).alias("facility_age_asof_pull"),
                     possible_age(F.col("day"), F.col("opened_date")).alias("facility_age_yrs"))


def add_features(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Every history feature for every row, from strictly earlier dates."""
    f = persistence(trailing(since_start(df), rules.window_days), rules)
    f = trailing(f, rules.window_days, "rated", "wr_")
    drop = [f"wr_{x}" for x in ("prior_n", "days_since_last", "last_score", "last_major", "major_rate", "mean_viol")]
    return no_model_rules(f.drop(*drop), rules).withColumn("month", F.month("day"))


def _stand_ins(keys: DataFrame) -> DataFrame:
    """``business_id, day`` to rows of the timeline that hold no visit."""
    n = F.lit(None)
    return keys.select(
        "business_id", "day", daynum(F.col("day")).cast("int").alias("dn"), F.lit("routine").alias("visit_type"),
        F.lit(0).alias("seq"), n.cast("int").alias("score"), n.cast("int").alias("rated"), n.cast("int").alias("n_major"),
        n.cast("int").alias("n_items"), n.cast("double").alias("major"), F.lit(True).alias("asof"))


TIMELINE = ("business_id", "day", "dn", "visit_type", "seq", "score", "rated", "n_major", "n_items", "major")


def features_asof(df: DataFrame, at: str, rules: Rules = RULES) -> DataFrame:
    """Features of a hypothetical routine visit of each place on ``at``; places last seen before it (WF11)."""
    day = F.lit(at).cast("date")
    seen = df.groupBy("business_id").agg(F.max("day").alias("_last")).where(F.col("_last") < day)
    keys = seen.select("business_id", day.alias("day"))
    real = df.where(F.col("day") < day).select(*TIMELINE, F.lit(False).alias("asof"))
    return add_features(real.unionByName(_stand_ins(keys)), rules).where("asof")


def month_start_features(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row per (place, month with a routine), history strictly before the 1st, all months in one pass (WF12)."""
    keys = (df.where(F.col("visit_type") == "routine")
            .select("business_id", month_start(F.col("day")).alias("day")).distinct())
    real = df.select(*TIMELINE, F.lit(False).alias("asof"))
    return add_features(real.unionByName(_stand_ins(keys)), rules).where("asof")


def month_start_rows(df: DataFrame, columns: list[str], rules: Rules = RULES) -> DataFrame:
    """Routine rows with ``columns`` read as of the 1st of their month; label and date stay their own (J15)."""
    feats = month_start_features(df, rules).select("business_id", F.col("day").alias("month_start"), *columns)
    rows = (df.where(F.col("visit_type") == "routine")
            .select(*TIMELINE, "record_id", month_start(F.col("day")).alias("month_start")))
    return rows.drop("asof").join(feats, ["business_id", "month_start"], "left")


def gaps(routines: DataFrame) -> DataFrame:
    """Days to the previous and next routine, the previous outcome, and the running mean with the current row (WF20)."""
    w = W.partitionBy("business_id").orderBy("dn")
    return routines.select(
        "*", (F.col("dn") - F.lag("dn").over(w)).alias("gap"), (F.lead("dn").over(w) - F.col("dn")).alias("next_gap"),
        F.lag("major").over(w).alias("prev_major"),
        F.avg("rated").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("record"))


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, out: str) -> DataFrame:
    """The latest ``right`` day strictly before each ``left`` day, by key (J2).

    Both sides are first reduced to distinct (key, day), stacked, and read by one range frame; no
    pair of rows is ever formed.
    """
    marks = (left.select(key, F.col(left_day).alias("_d"), F.lit(None).cast("date").alias("_r")).distinct()
             .unionByName(right.select(key, F.col(right_day).alias("_d"), F.col(right_day).alias("_r")).distinct()))
    w = W.partitionBy(key).orderBy(daynum(F.col("_d"))).rangeBetween(W.unboundedPreceding, -1)
    found = marks.select(key, "_d", F.col("_r").isNull().alias("_ask"), F.max("_r").over(w).alias(out)).where("_ask")
    return left.join(found.select(key, F.col("_d").alias(left_day), out), [key, left_day], "left")


def overdue_ratio(rows: DataFrame, visits: DataFrame, interval: DataFrame, fallback: Column, floor: float = 120.0) -> DataFrame:
    """Days since the last visit before the month over the type's usual interval, within 0.2 and 2 (WF19)."""
    q = rows.withColumn("month_start", month_start(F.col("day")))
    q = asof_backward(q, visits, "business_id", "month_start", "day", "last_visit").join(interval, "business_type", "left")
    iv = F.greatest(F.coalesce("interval", fallback), F.lit(floor))
    days = F.coalesce(F.datediff("month_start", "last_visit").cast("double"), iv)
    return q.withColumn("overdue", F.greatest(F.lit(0.2), F.least(F.lit(2.0), days / iv)))


def prompted_by_complaint(visits: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``prompted``: a reinspection with a complaint in the days up to it (J6)."""
    w = days_before(rules.complaint_days, 0)
    seen = F.max(F.when(F.col("visit_type") == "complaint", F.col("dn"))).over(w).isNotNull()
    return visits.withColumn("prompted", (F.col("visit_type") == "reinspection") & seen)
