"""Interval, co-location and matching joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row; Spark checks that it is one row."""
    return df.withColumns({name: one_row.select(name).scalar() for name in one_row.columns})


def censor(visits: DataFrame, drop: Column, days: int = 45, triggered=("reinspection", "followup")) -> DataFrame:
    """Remove the visits in ``drop`` and the visits each would have triggered within ``days``.

    Existence within a day range is a range frame of the place's timeline: no pair is formed.
    """
    from pyspark.sql import Window as W
    w = W.partitionBy("business_id").orderBy("dn").rangeBetween(-days, 0)
    near = F.max(F.when(F.col("_drop"), 1)).over(w).isNotNull()
    v = visits.withColumn("_drop", F.coalesce(drop, F.lit(False))).withColumn("_near", near)
    return v.where(~F.col("_drop") & ~(F.col("visit_type").isin(*triggered) & F.col("_near"))).drop("_drop", "_near")


def colocated_sums(rows: DataFrame, apart_days: int = 60) -> DataFrame:
    """Pairs of visits at one address by different businesses, the same day or ``apart_days`` apart, as sums per address (J9).

    ``pairs`` counts them, ``majors`` the majors on either side, ``both`` the pairs with a major on both. No pair is formed: what
    meets a visit is the address's total less what is too near, less the same two sums of its own business. Windows run over
    days of an address or of a business, so the calendar bounds them.
    """
    from pyspark.sql import Window as W
    c = F.col
    own = rows.groupBy("address", "business_id", "dn").agg(F.count("*").alias("n"), F.count_if("major").alias("k"))
    days = own.groupBy("address", "dn").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def sums(df: DataFrame, parts: list[str], name: str) -> DataFrame:
        all_, near = W.partitionBy(*parts), W.partitionBy(*parts).orderBy("dn").rangeBetween(1 - apart_days, apart_days - 1)
        return df.select("*", *[(F.sum(x).over(all_) - F.sum(x).over(near)).alias(f"{name}_{x}") for x in ("n", "k")])
    mine = sums(own, ["address", "business_id"], "own")
    there = sums(days, ["address"], "far").select(
        c("address").alias("_address"), c("dn").alias("_dn"), c("n").alias("day_n"), c("k").alias("day_k"), "far_n", "far_k")
    met = mine.join(there, (c("address") == c("_address")) & (c("dn") == c("_dn")))

    def kind(same: bool, n: Column, k: Column) -> Column:
        return F.struct(F.lit(same).alias("same_day"), (c("n") * n).alias("pairs"), (c("k") * n).alias("majors"), (c("k") * k).alias("both"))
    both = F.explode(F.array(kind(True, c("day_n") - c("n"), c("day_k") - c("k")),
                             kind(False, c("far_n") - c("own_n"), c("far_k") - c("own_k")))).alias("s")
    # Each pair was met from both sides.
    g = met.select("address", both).select("address", "s.*").groupBy("address", "same_day").agg(
        (F.sum("pairs") / 2).cast("long").alias("pairs"), F.sum("majors").alias("majors"), (F.sum("both") / 2).cast("long").alias("both"))
    return g.where("pairs > 0")


def match_places(archive: DataFrame, places: DataFrame) -> DataFrame:
    """Find each archived row's place by business id, else by facility id; unmatched rows stay with a null."""
    by_id = places.select(F.col("business_id"), F.col("business_id").alias("_by_id"))
    by_fid = places.select("facility_id", F.col("business_id").alias("_by_fid"))
    return (archive.join(by_id, "business_id", "left").join(by_fid, "facility_id", "left")
            .withColumn("matched", F.coalesce("_by_id", "_by_fid")).drop("_by_id", "_by_fid"))


def not_notified(named: DataFrame, notices: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Named places without a notice at least ``days`` old."""
    told = notices.where(F.datediff(F.lit(today).cast("date"), "date_sent") >= days)
    return named.join(told, "facility_id", "left_anti")


def hold_matches(held: DataFrame, listed: DataFrame) -> DataFrame:
    """Held ids not on the list, with the listed id that differs only in case."""
    missing = held.join(listed, "facility_id", "left_anti").distinct()
    lower = listed.groupBy(F.lower("facility_id").alias("_k")).agg(F.min("facility_id").alias("listed_as"))
    return (missing.withColumn("_k", F.lower("facility_id")).join(lower, "_k", "left").drop("_k"))


def disagreements(index: DataFrame, detail: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys missing on one side, and fields that differ."""
    a = index.select(key, F.struct(*fields).alias("_a"))
    b = detail.select(key, F.struct(*fields).alias("_b"))
    both = a.join(b, key, "full_outer")
    gone = F.col("_a").isNull() | F.col("_b").isNull()
    wrong = F.array(*[F.when(~F.col("_a")[f].eqNullSafe(F.col("_b")[f]), F.lit(f)) for f in fields])
    problems = F.when(gone, F.array(F.lit("missing"))).otherwise(F.array_compact(wrong))
    return both.select(key, F.explode(problems).alias("problem"))


def align_arms(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join of two arms that must hold the same keys; rows of only one arm raise at run time."""
    both = a.withColumn("_in_a", F.lit(True)).join(b.withColumn("_in_b", F.lit(True)), key, "full_outer")
    whole = F.col("_in_a") & F.col("_in_b")
    return (both.where(F.assert_true(F.coalesce(whole, F.lit(False)), "arms must hold the same rows").isNull())
            .drop("_in_a", "_in_b"))
