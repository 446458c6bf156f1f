"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, mixture.

Each stage reads what the stage before it kept, acts on all of it and returns the columns of documents; the last adds how often
each document is taken. ``run`` writes each stage's rows to the shared folder and reads them back for the next.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldrounds.llm import decontaminate, jaccard, mixing, quality, secrets
from fieldrounds.llm.common import table
from fieldrounds.session import begin_work, keep, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject. It learns from the labels of the rows given."""
    begin_work(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    begin_work(spark)
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    begin_work(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets masked."""
    begin_work(spark)
    return secrets.redact(docs, secrets.scanned(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with the number of times (``copies``) and the words taken (``taken``)."""
    begin_work(spark)
    sized = stored(mixing.sizes(docs), "sizes")
    by = mixing.plan(sized).select(F.col("source").alias("_source"), F.col("whole").alias("_whole"), F.col("edge").alias("_edge"))
    place = mixing.place(docs["doc_id"])
    copies = by["_whole"] + F.when(place * mixing.BINS < by["_edge"], 1).otherwise(0)
    taken = docs.join(by, docs["source"].eqNullSafe(by["_source"])).where(copies > 0)
    return taken.select(*[docs[c] for c in docs.columns], copies.alias("copies"), (copies * mixing.words(docs["text"])).alias("taken"))


STAGES = [("quality", good_quality), ("near_duplicates", one_per_group), ("decontaminate", without_benchmark),
          ("secrets", without_secrets), ("mix", mixed)]

ORACLE_SQL = None       # the learned scores of the first stage are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stored(stage(spark, docs, sf_dir), name))
    return docs
