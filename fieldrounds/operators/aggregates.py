"""Grouped summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import quarter_label
from ..rules import RULES, Rules
from .joins import colocated_sums, with_scalars
from .ordering import exact_quantiles, first_rows, positions

HISTORY_BUCKETS = ((0, "0"), (1, "1"), (2, "2"), (4, "3-4"))


def bucket(n: Column, cuts=HISTORY_BUCKETS, last: str = "5+") -> Column:
    """Right-closed bins."""
    out = F.lit(last)
    for top, label in reversed(cuts):
        out = F.when(n <= top, label).otherwise(out)
    return F.when(n.isNotNull(), out)


def cadence(visits: DataFrame, types: DataFrame, min_years: float = 3.0) -> DataFrame:
    """Routine visits a year and major rate of each place on record long enough (AG1)."""
    rt = F.col("visit_type") == "routine"
    span = F.datediff(F.max("day"), F.min("day")) / F.lit(365.25)
    g = visits.groupBy("business_id").agg(F.count_if(rt).alias("n"), F.avg(F.when(rt, F.col("major"))).alias("rate"), span.alias("span"))
    g = g.where((F.col("span") >= min_years) & (F.col("n") > 0)).withColumn("per_year", F.col("n") / F.col("span"))
    return g.join(types, "business_id")


def cadence_summary(fac: DataFrame) -> DataFrame:
    """Places, correlation of rate and cadence, and the median cadence, which is read off running counts rather than held in one buffer."""
    middle = exact_quantiles(fac, [], "per_year", {"median_per_year": 0.5})
    return with_scalars(fac.agg(F.count("*").alias("facilities"), F.corr("rate", "per_year").alias("corr")), middle)


def gap_by_top_types(gaps: DataFrame, n: int = 8) -> DataFrame:
    """Median days to the next routine for the most common types (AG2)."""
    obs = gaps.where(F.col("next_gap").isNotNull())
    g = obs.groupBy("business_type").agg(F.count("*").alias("n"), F.median("next_gap").alias("median_gap"))
    return first_rows(g, [], [F.col("n").desc(), F.col("business_type")], n) if n else g


def gap_by_record_fifth(gaps: DataFrame, fifths: int = 5) -> DataFrame:
    """Median days to the next routine by fifths of the running mean score, best first (AG2)."""
    obs = gaps.where(F.col("next_gap").isNotNull() & F.col("record").isNotNull())
    p = positions(obs, [], [F.col("record"), F.col("record_id")])
    p = with_scalars(p, obs.agg(F.count("*").alias("_all")))
    # Linear quantile edges over ranks 1..N, right-closed, as a cut of ranks into equal parts.
    at = F.greatest(F.ceil((F.col("position") - 1) * fifths / (F.col("_all") - 1)), F.lit(1)).cast("int")
    return p.groupBy(at.alias("fifth")).agg(F.count("*").alias("n"), F.median("next_gap").alias("median_gap"))


def km_median(df: DataFrame, parts: list[str], t: str = "t", event: str = "event", count: str | None = None) -> DataFrame:
    """Kaplan-Meier median: first time survival is at most one half; null when it never is (AG5).

    Rows (or the ``count`` each stands for) are added up by (part, day) first, so what a part's window orders is a calendar, not its rows.
    """
    n = F.lit(1).cast("long") if count is None else F.col(count)
    d = df.groupBy(*parts, t).agg(F.sum(F.when(F.col(event), n).otherwise(0)).alias("_e"), F.sum(n).alias("_n"))
    w = W.partitionBy(*parts)
    at_risk = F.sum("_n").over(w.orderBy(F.col(t).desc()).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_s", 1 - F.col("_e") / at_risk)
    d = d.withColumn("_surv", F.product("_s").over(w.orderBy(t).rowsBetween(W.unboundedPreceding, 0)))
    hit = F.min(F.when((F.col("_e") > 0) & (F.col("_surv") <= 0.5 + 1e-9), F.col(t))).cast("double")
    return d.groupBy(*parts).agg(hit.alias("median"), F.sum("_e").alias("events"))


def calibration(df: DataFrame, group: str, p: str = "p", y: str = "y") -> DataFrame:
    """Rows, actual and predicted rate and their gap by group, in percent (AG7)."""
    return df.groupBy(group).agg(F.count("*").alias("n"), (100 * F.avg(y)).alias("actual_pct"), (100 * F.avg(p)).alias("predicted_pct"),
                                 (100 * F.avg(F.col(y) - F.col(p))).alias("gap_pts"))


def rate_by_year_and_history(rows: DataFrame) -> DataFrame:
    """Major rate by year, one column per history bucket (AG8)."""
    labels = [label for _, label in HISTORY_BUCKETS] + ["5+"]
    g = (rows.withColumn("bucket", bucket(F.col("prior_n"))).groupBy(F.year("day").alias("year"))
         .pivot("bucket", labels).agg(F.avg("major")))
    return g.select("year", *[F.col(f"`{x}`").alias(f"h_{x.replace('-', '_').replace('+', '_up')}") for x in labels])


def measurement(visits: DataFrame, places: DataFrame) -> DataFrame:
    """What the label is made of, one row: A shares and what follows a major (AG9)."""
    c = F.col
    rt = visits.where(c("visit_type") == "routine").withColumn("hit", c("n_major") > 0)
    prev = F.lag("hit").over(W.partitionBy("business_id").orderBy("seq"))
    rt = rt.withColumn("prev", prev)
    graded = c("grade").isNotNull()

    def rate(k: Column, n: Column) -> Column:
        return F.count_if(k & n) / F.when(F.count_if(n) > 0, F.count_if(n))
    return rt.agg(
        *[F.count_if(c("score") == s).alias(f"score_{s}") for s in range(86, 93)],
        rate(c("grade") == "A", graded).alias("graded_a_share"), rate(c("grade") == "A", graded & c("hit")).alias("majors_graded_a_share"),
        rate(c("hit"), c("prev") == F.lit(True)).alias("major_after_major"), rate(c("hit"), c("prev") == F.lit(False)).alias("major_after_clean"))


def colocated_agreement(routines: DataFrame) -> DataFrame:
    """Correlation of the outcomes of co-located pairs, same day against far apart, each pair taken in both orders (AG9)."""
    s = colocated_sums(routines).groupBy("same_day").agg(*[F.sum(x).alias(x) for x in ("pairs", "majors", "both")])
    mean = F.col("majors") / (2 * F.col("pairs"))
    # Outcomes are 0 or 1, so the mean of squares is the mean.
    r = F.try_divide(F.col("both") / F.col("pairs") - mean * mean, mean - mean * mean)
    return s.select("same_day", "pairs", F.when(F.col("pairs") > 30, r).alias("corr"))


def rate_by_quarter(visits: DataFrame, min_n: int = 200) -> DataFrame:
    g = visits.where("visit_type = 'routine'").groupBy(quarter_label(F.col("day")).alias("quarter")).agg(
        F.count("*").alias("n"), F.avg((F.col("n_major") > 0).cast("double")).alias("rate"))
    return g.where(F.col("n") >= min_n)


def counts_by_month(visits: DataFrame) -> DataFrame:
    return visits.where("visit_type = 'routine'").groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.count_if(F.col("n_major") > 0).alias("positives"))


def group_table(df: DataFrame, group: str, flags: list[str], area: str, risk: str, days: list[str] = (), y: str = "y") -> DataFrame:
    """Rates by group over fractional flags: flag rate, recall, false-positive rate, days sooner (AG10)."""
    c = F.col
    aggs = [F.count("*").alias("n"), F.count_distinct(area).alias("areas"), (100 * F.avg(y)).alias("actual_pct"), (100 * F.avg(risk)).alias("mean_risk_pct")]
    for f in flags:
        aggs += [(100 * F.avg(f)).alias(f"{f}_flag_pct"), (100 * F.avg(F.when(c(y) == 1, c(f)))).alias(f"{f}_recall_pct"),
                 (100 * F.avg(F.when(c(y) == 0, c(f)))).alias(f"{f}_fpr_pct")]
    aggs += [F.avg(F.when(c(y) == 1, c(d))).alias(d) for d in days]
    return df.where(c(group).isNotNull()).groupBy(group).agg(*aggs)


def district_summary(listed: DataFrame, bands=("1", "2", "3")) -> DataFrame:
    """Places, places per band and places with each record fact, by district (AG11)."""
    def has(f: str) -> Column:
        return F.count_if(F.array_contains("flags", f)).alias(f"with_{f}")
    return listed.groupBy("district").agg(F.count("*").alias("places"), *[F.count_if(F.col("band") == b).alias(f"band_{b}") for b in bands],
                                          has("major"), has("closed"), has("bc"))


def cumulative_band_counts(listed: DataFrame) -> DataFrame:
    """Places in band 1, in bands 1 and 2, and so on, and all (AG12)."""
    g = listed.where(F.col("band").isNotNull()).groupBy("band").agg(F.count("*").alias("n"))
    run = g.select("band", F.sum("n").over(W.orderBy(F.col("band").cast("int"))).alias("places"))
    return run.unionByName(listed.agg(F.lit("all").alias("band"), F.count("*").alias("places")))


def flag_counts(listed: DataFrame) -> DataFrame:
    return listed.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("places"))


def type_counts(listed: DataFrame, column: str = "kind") -> DataFrame:
    return listed.groupBy(F.coalesce(column, F.lit("other")).alias("kind")).agg(F.count("*").alias("places"))


def yearly_totals(visits: DataFrame) -> DataFrame:
    """Routine visits and those with a major, by year (AG21)."""
    return visits.where("visit_type = 'routine'").groupBy(F.year("day").alias("year")).agg(
        F.count("*").alias("routine"), F.count_if(F.col("n_major") > 0).alias("with_major"))


def pooled_types(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Types under the cell minimum pooled into one (AG22)."""
    g = df.groupBy("business_type").agg(F.count("*").alias("n"), F.sum("due").alias("due"), F.sum("with_prior_major").alias("with_prior_major"))
    pooled = F.when(F.col("n") < rules.min_cell, "Other types").otherwise(F.col("business_type"))
    return g.groupBy(pooled.alias("type")).agg(F.sum("n").alias("facilities"), F.sum("due").alias("due"), F.sum("with_prior_major").alias("with_prior_major"))


RISK_BINS = (0, 5, 10, 15, 20, 30, 40, 100)


def risk_bins(df: DataFrame, pct: str, due: str) -> DataFrame:
    """Counts by risk bin; every bin appears, the last one closed (AG22)."""
    spark = df.sparkSession
    edges = spark.createDataFrame(list(zip(RISK_BINS[:-1], RISK_BINS[1:])), "low int, high int")
    which = F.lit(None).cast("int")
    for lo, hi in zip(RISK_BINS[:-1], RISK_BINS[1:]):
        top = F.col(pct) <= hi if hi == RISK_BINS[-1] else F.col(pct) < hi
        which = F.when((F.col(pct) >= lo) & top, lo).otherwise(which)
    g = df.groupBy(which.alias("low")).agg(F.count("*").alias("facilities"), F.sum(due).alias("due"))
    return edges.join(g, "low", "left").fillna(0, ["facilities", "due"])


def suppress_small_cells(rows: DataFrame, columns: list[str], key: str, rules: Rules = RULES) -> DataFrame:
    """Hide counts from 1 to the minimum; where one cell of a column is hidden, hide its smallest
    visible neighbour too (AG23). ``rows`` is an already aggregated public table."""
    c = F.col
    everything = W.partitionBy(F.lit(0))
    out = rows
    for col in columns:
        small = (c(col) > 0) & (c(col) < rules.min_cell)
        lone = F.count_if(small).over(everything) == 1
        other = ~small & (c(col) > 0)
        pick = F.row_number().over(everything.orderBy(F.when(other, 0).otherwise(1), c(col), c(key))) == 1
        out = out.withColumn(f"_h_{col}", small | (lone & other & pick))
    return out.select(*[F.when(~c(f"_h_{x}"), c(x)).alias(x) if x in columns else c(x) for x in rows.columns])


def withheld_totals(rows: DataFrame, columns: list[str], rules: Rules = RULES) -> DataFrame:
    """Column totals; null where a single hidden cell has no neighbour to hide behind."""
    def total(col: str) -> Column:
        small = (F.col(col) > 0) & (F.col(col) < rules.min_cell)
        exposed = (F.count_if(small) == 1) & (F.count_if(~small & (F.col(col) > 0)) == 0)
        return F.when(~exposed, F.sum(col)).alias(col)
    return rows.agg(*[total(c) for c in columns])


def band_lift(rows: DataFrame) -> DataFrame:
    """Each band's rate over the rest's, and its slice of the cumulative shares (AG24)."""
    rest = rows.where("band = 'rest'").agg(F.max("rate").alias("_rest"))
    b = with_scalars(rows.where("band <> 'rest'"), rest)
    w = W.orderBy(F.col("band").cast("int"))
    return b.select("band", "rate", "share", (F.col("rate") / F.col("_rest")).alias("lift"),
                    (F.col("share") - F.coalesce(F.lag("share").over(w), F.lit(0.0))).alias("width"))


def leak_check(rows: DataFrame, train_end: str) -> DataFrame:
    """Major rates where the permit is dated after the visit, train against test (AG4)."""
    c = F.col
    return rows.groupBy(F.when(c("day") <= train_end, "train").otherwise("test").alias("split")).agg(
        F.count_if(c("facility_age_asof_pull") < 0).alias("negative"), F.avg(F.when(c("facility_age_asof_pull") < 0, c("major"))).alias("negative_rate"),
        F.avg(F.when(c("facility_age_asof_pull") >= 0, c("major"))).alias("other_rate"), F.count_if(c("opened_date").isNull()).alias("missing_opened"))


def earlier_summary(slots: DataFrame, years: Column, y: str = "y") -> DataFrame:
    """Days earlier per arm: for positives, share earlier, for the rest, and total a year (AG27)."""
    c = F.col
    return slots.groupBy("arm").agg(
        F.avg(F.when(c(y) == 1, c("days_earlier"))).alias("days_earlier"), F.avg(F.when(c(y) == 1, (c("days_earlier") > 0).cast("double"))).alias("share_earlier"),
        F.avg(F.when(c(y) == 0, c("days_earlier"))).alias("clean_days"), (F.sum(F.when(c(y) == 1, c("days_earlier"))) / years).alias("days_per_year"))
