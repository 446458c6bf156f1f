"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of all words. A source may be repeated at most ``max_epochs`` times, so its
target stops there, and the words it cannot give go to the others by weight until none is above its cap. With the
sources ordered by cap / weight this is one pass: the first k are at their caps, the others share one level.

A document is taken ``whole`` times, and once more if its seeded place in its source lies below the fraction that is
left. Places are hashed into ``BINS`` bins; sizes are summed per source and bin, so the fraction is met up to a part
of one bin and no source is ever sorted or held in one task.

Cases: a null text has size 0; a null source is a source of its own and comes last; a source of size 0 has target 0.
Rows that repeat an id are taken alike. An empty table gives an empty mix. Only the named columns are read, so extra
columns cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stored
from .common import unit_draw

BINS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place(doc_id: Column, seed: str = "mix") -> Column:
    """A document's seeded place in [0, 1)."""
    return unit_draw(seed, doc_id)


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, place`` of each document."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), place(F.col("doc_id"), seed).alias("place"))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``source, source_size, weight, target`` from one row per source (``source, source_size``).

    Sources are a catalogue, one row each, so they are ordered in one task; documents never are.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("double")
    rows = totals.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The water level of the first source that stays below its cap holds for it and for all after it.
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("level", level).withColumn("at", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every))
    target = F.least(F.coalesce(F.col("at")["level"] * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row per source: targets, whole repetitions, and the fraction's last bin with the part of it that is taken."""
    bins = sized.groupBy("source", F.floor(F.col("place") * BINS).cast("int").alias("bin")).agg(F.sum("size").alias("words"))
    totals = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, max_epochs)
    full = F.floor(F.col("target") / F.col("source_size"))
    rates = targets.select("source", "source_size", "target",
                           F.when(F.col("source_size") > 0, full).otherwise(0).cast("long").alias("whole"))
    rates = rates.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    key = rates.select(F.col("source").alias("_source"), "rest")
    reached = (bins.select("source", "bin", "words", upto.alias("upto")).join(key, F.col("source").eqNullSafe(F.col("_source")))
               .where((F.col("rest") > 0) & (F.col("words") > 0) & (F.col("upto") > F.col("rest")))
               .groupBy("source").agg(F.min(F.struct("bin", ((F.col("rest") - F.col("upto") + F.col("words")) / F.col("words")).alias("part"))).alias("last")))
    edge = reached.select(F.col("source").alias("_source"), (F.col("last")["bin"] + F.col("last")["part"]).alias("edge"))
    # Written, so that its true size decides how documents meet it: a catalogue that is small is sent to them, and they stay where they lie.
    return stored(rates.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("edge", F.lit(0.0)).alias("edge")), "mixture")


def copies() -> Column:
    """Times a document is taken, from the columns of ``plan`` and its own ``place``."""
    return F.col("whole") + F.when(F.col("place") * BINS < F.col("edge"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every document."""
    sized = stored(sizes(docs, seed), "sizes")
    by = plan(sized, weights, max_epochs).withColumnRenamed("source", "_source")
    return sized.join(by, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", copies().alias("copies"), (copies() * F.col("size")).alias("taken"))
