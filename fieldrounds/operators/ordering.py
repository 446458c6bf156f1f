"""Global and per-group order without moving a group to one task.

``Window.orderBy`` puts a whole partition key into one task, so a district or a replicate that
holds a third of the rows would be sorted by one executor. Here rows are range partitioned by
(group, order), which splits a large group over many tasks; the running value is local to a range
and each range adds the totals of the ranges before it. Those totals have one row per (group,
range), a number set by the partition count and not by the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut

_PID = "_range"


def _ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_sums(df: DataFrame, parts: list[str], keys: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums in the order of ``keys`` within ``parts``.

    ``keys`` must order the rows of a part totally (aggregate to distinct keys first, or end with an
    id). ``parts`` columns must not be null.
    """
    held = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    order = [F.col(p) for p in parts] + keys
    placed = cut(held.repartitionByRange(_ranges(df), *order).withColumn(_PID, F.spark_partition_id()))
    group = parts + [_PID]
    before = W.partitionBy(*parts).orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)
    totals = (placed.groupBy(*group).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
              .select(*group, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}")
                                for n in sums]))
    local = W.partitionBy(*group).orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    out = placed.select(*df.columns, _PID, *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in sums])
    return (out.join(totals, group)
            .select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]))


def positions(df: DataFrame, parts: list[str], keys: list[Column], name: str = "position") -> DataFrame:
    """``row_number`` over ``parts`` ordered by ``keys``, spread over tasks."""
    return running_sums(df, parts, keys, {name: F.lit(1).cast("long")})


def dense_codes(df: DataFrame, key: str, name: str = "code") -> DataFrame:
    """Distinct ``key`` values numbered 0, 1, ... in key order."""
    return positions(df.select(key).distinct(), [], [F.col(key)], "_n").select(
        key, (F.col("_n") - 1).alias(name))


def first_rows(df: DataFrame, parts: list[str], keys: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each part. The limit runs on each side of the shuffle, so a large
    part sends at most ``n`` rows from each task."""
    rank = F.row_number().over(W.partitionBy(*parts).orderBy(*keys))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def exact_quantiles(df: DataFrame, parts: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles by group from distinct value counts, one row per part."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*parts, value)
              .agg(F.count("*").alias("_n")))
    ran = running_sums(counts, parts, [F.col(value)], {"_end": F.col("_n")})
    sizes = counts.groupBy(*parts).agg(F.sum("_n").alias("_all")) if parts else counts.agg(F.sum("_n").alias("_all"))
    if parts:
        ran = ran.join(sizes, parts)
    else:
        ran = ran.withColumn("_k", F.lit(0)).join(sizes.withColumn("_k", F.lit(0)), "_k").drop("_k")
    first = F.col("_end") - F.col("_n")
    picks = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_all") - 1)
        low, high = F.floor(at), F.ceil(at)
        picks += [F.max(F.when((low >= first) & (low < F.col("_end")), F.col(value))).alias(f"_a_{name}"),
                  F.max(F.when((high >= first) & (high < F.col("_end")), F.col(value))).alias(f"_b_{name}"),
                  F.max(at - low).alias(f"_f_{name}")]
    got = ran.groupBy(*parts).agg(*picks) if parts else ran.agg(*picks)
    return got.select(*parts, *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n)
                                for n in shares])
