"""Archived lists scored on later visits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import daynum, wilson
from ..rules import RULES, Rules
from .joins import match_places, with_scalars
from .ordering import positions
from .snapshot import label_frame


def window_days(list_date: Column, through: Column, rules: Rules = RULES) -> Column:
    """The label window a run can be scored over: the whole year, else the longest interim one, else null."""
    seen = F.datediff(through, list_date)
    out = F.when(seen >= rules.label_days + rules.report_lag_days, rules.label_days)
    for d in sorted(rules.interim_days, reverse=True):
        out = out.when(seen >= d + rules.report_lag_days, d)
    return out


def labels_at(asked: DataFrame, visits: DataFrame, horizons: list[int]) -> DataFrame:
    """``y_<days>`` of the first routine from each (place, day) within each horizon, in one timeline."""
    c = F.col
    real = visits.where("visit_type = 'routine'").select("business_id", "dn", "seq", "n_major")
    marks = asked.select("business_id", c("list_date"), daynum(c("list_date")).cast("int").alias("dn")).distinct()
    line = real.unionByName(marks, allowMissingColumns=True)
    first = F.when(c("seq").isNotNull(), F.struct("dn", "seq", (c("n_major") > 0).cast("int").alias("y")))
    cols = [F.min(first).over(label_frame(d)).alias(f"_{d}") for d in horizons]
    return line.select("business_id", "list_date", *cols).where("list_date is not null").select(
        "business_id", "list_date", *[c(f"_{d}.y").alias(f"y_{d}") for d in horizons])


def scored_rows(archive: DataFrame, visits: DataFrame, places: DataFrame, through: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Archived eligible rows with the outcome over their run's window; ``y`` is null without a visit,
    ``matched`` null when the place is gone from the later record (BD13). ``through`` is one row."""
    c = F.col
    a = with_scalars(archive, through).withColumn("window", window_days(c("list_date"), c("through"), rules))
    a = match_places(a, places.select("business_id", "facility_id"))
    hs = [*rules.interim_days, rules.label_days]
    lab = labels_at(a.where("matched is not null").select(c("matched").alias("business_id"), "list_date"), visits, hs)
    a = a.join(lab.withColumnRenamed("business_id", "matched"), ["matched", "list_date"], "left")
    y = F.lit(None).cast("int")
    for d in hs:
        y = F.when(c("window") == d, c(f"y_{d}")).otherwise(y)
    addr = places.select(c("business_id").alias("matched"), "address")
    return (a.join(addr, "matched", "left").withColumns({"y": y, "band": F.coalesce("band", F.lit("rest")), "complete": c("window") == rules.label_days,
                                                          "area": F.when(c("district").isNotNull(), "city").otherwise("outside")})
            .drop(*[f"y_{d}" for d in hs]))


def band_rates(rows: DataFrame) -> DataFrame:
    """Rate by run, area and band with its interval."""
    g = rows.where("window is not null and y is not null").groupBy("run", "area", "band", "window").agg(F.count("*").alias("labelled"), F.sum("y").alias("positives"))
    low, high = wilson(F.col("positives"), F.col("labelled"))
    return g.select("*", (F.col("positives") / F.col("labelled")).alias("rate"), low.alias("low"), high.alias("high"))


def missing(rows: DataFrame) -> DataFrame:
    """Places gone from the later record, counted by run and band."""
    return rows.where("window is not null and matched is null").groupBy("run", "band").agg(F.count("*").alias("missing"))


def observed_over_expected(rows: DataFrame, expected: str = "est_rate") -> DataFrame:
    """Observed positives over the sum of the estimates, complete runs only, by run and area."""
    ok = rows.where(F.col("complete") & F.col("y").isNotNull() & F.col(expected).isNotNull())
    g = ok.groupBy("run", "area").agg(F.sum("y").alias("observed"), F.sum(expected).alias("expected"))
    return g.withColumn("ratio", F.col("observed") / F.when(F.col("expected") > 0, F.col("expected")))


def persistence_group(rows: DataFrame) -> DataFrame:
    """Marks band 1 and persistence's same-size group within each run and area."""
    c = F.col
    lab = rows.where("window is not null and y is not null")
    p = positions(lab, ["run", "area"], [c("persistence").desc(), c("facility_id")], "_pos")
    n = lab.groupBy("run", "area").agg(F.count_if(c("band") == "1").alias("_n1"))
    return p.join(n, ["run", "area"]).withColumns({"in_band_1": (c("band") == "1").cast("int"), "in_baseline": (c("_pos") <= c("_n1")).cast("int")}).drop("_pos", "_n1")


def district_rates(rows: DataFrame, bands: list[str]) -> DataFrame:
    """By run and district: all scored city places, and those in the audited bands (BD14)."""
    c = F.col
    d = rows.where("area = 'city' and window is not null and y is not null")
    inb = c("band").isin(*bands)
    g = d.groupBy("run", "district").agg(F.count("*").alias("labelled"), F.sum("y").alias("positives"), F.count_if(inb).alias("banded"),
                                         F.coalesce(F.sum(F.when(inb, c("y"))), F.lit(0)).alias("banded_positives"))
    low, high = wilson(c("banded_positives"), c("banded"))
    return g.select("*", (c("positives") / c("labelled")).alias("rate"), (c("banded_positives") / F.when(c("banded") > 0, c("banded"))).alias("banded_rate"),
                    low.alias("low"), high.alias("high"))


def next_window(list_date: Column, window: Column, rules: Rules = RULES) -> Column:
    """The day the record must reach for a run's next window; null when it is complete."""
    out = F.lit(None).cast("int")
    for d in sorted([*rules.interim_days, rules.label_days], reverse=True):
        out = F.when(F.coalesce(window, F.lit(0)) < d, d).otherwise(out)
    return F.date_add(list_date, out + rules.report_lag_days)


def alerts(bands: DataFrame, expected: DataFrame, oe: DataFrame, paired: DataFrame, runs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row per kind of finding on the current rule's lists: the latest run and how many earlier ones (BD15)."""
    c = F.col
    b1 = bands.where("area = 'city' and band = '1'").join(expected, ["run"]).where(c("high") < c("expected_rate")).select("run", F.lit("band_1").alias("kind"))
    off = oe.where(~c("ratio").between(*rules.oe_range)).select("run", F.concat(F.lit("oe_"), "area").alias("kind"))
    worse = paired.where("high < 0").select("run", F.lit("persistence").alias("kind"))
    hits = b1.unionByName(off).unionByName(worse).join(runs.where("current").select("run", "list_date"), "run")
    return hits.groupBy("kind").agg(F.max_by("run", "list_date").alias("latest_run"), (F.count("*") - 1).alias("earlier"))


def summary(runs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row: status over all runs and the next window date (BD15). ``runs``: run, list_date, window."""
    c = F.col
    done = F.coalesce(c("window") == rules.label_days, F.lit(False))
    return runs.agg(
        F.when(F.bool_or(done), "complete").when(F.bool_or(c("window").isNotNull()), "interim").otherwise("too early").alias("status"),
        F.count("*").alias("runs"), F.min(F.when(~done, next_window(c("list_date"), c("window"), rules))).alias("next_window_date"))
