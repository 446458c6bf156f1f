"""Streaming queries, drained with ``availableNow`` and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes
from ..sources.adapt import TABLE_RULES
from ..streaming import streams as st
from .registry import Tables, query


def _stream(t: Tables, name: str):
    """One table's file as a stream."""
    schema = t.table(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.dir)


@query("st1_landed_pages", """
SELECT o_custkey AS business_id, arg_max(o_orderkey, o_orderkey // 100 * 1000000000 + o_orderkey) AS kept_id, max(o_orderkey // 100) AS page
FROM orders GROUP BY 1""")
def st1(t: Tables):
    pages = _stream(t, "orders").select(F.col("o_custkey").alias("business_id"), F.col("o_orderkey").alias("kept_id"), F.floor(F.col("o_orderkey") / 100).alias("page"))
    folder = st.scratch(t.spark, "pages")
    st.land_latest(pages, "business_id", ["page", "kept_id"], folder)
    return st.latest_landed(t.spark, folder, "business_id", ["page", "kept_id"])


@query("st2_daily_counts", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS positives FROM events
GROUP BY 1 HAVING CAST(max(CAST(ts AS DATE)) + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY""")
def st2(t: Tables):
    days = st.daily_counts(_stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.col("event_type") == "error", "3 days")
    folder = st.scratch(t.spark, "days")
    st.run_to_folder(days, folder)
    return t.spark.read.parquet(f"{folder}/out")


# The three date groups in which visits land, oldest first, as they would arrive.
GROUPS = (("1990-01-01", "1997-01-01"), ("1997-01-01", "1999-06-01"), ("1999-06-01", "2100-01-01"))


def live_episodes(t: Tables, files: int | None = None):
    """Each group of visits lands and is drained before the next; a closing row then flushes what is held.

    One run reads a group whole, whatever its number of files: a batch that cut a group would have the rest of it come
    behind the watermark. ``files`` is the number of files of a group, as many as partitions when not given.
    """
    folder = st.scratch(t.spark, "visits")
    m = t.merged
    lands = [m.where((F.col("day") >= lo) & (F.col("day") < hi)) for lo, hi in GROUPS]
    for group in [*(g.repartition(files) if files else g for g in lands), st.closing_row(m)]:
        group.write.mode("append").parquet(f"{folder}/in")
        st.run_to_folder(st.closure_episodes(t.spark.readStream.schema(m.schema).parquet(f"{folder}/in")), folder)
    return st.latest_episodes(t.spark.read.parquet(f"{folder}/out"))


@query("st3_closure_episodes")
def st3(t: Tables):
    return live_episodes(t)


def batch_episodes(t: Tables):
    """The same episodes from the batch reading, orders only."""
    v = t.merged.withColumns({"inferred": F.lit(False), "unplaced": F.lit(False)})
    return episodes.read_episodes(v, TABLE_RULES).where("closed")


@query("st4_distinct_records", "SELECT event_id, user_id FROM events")
def st4(t: Tables):
    e = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(40))).otherwise(F.array(F.lit(0)))).alias("later")
    seen = e.select("event_id", "user_id", "ts", twice).withColumn("ts", F.col("ts") + F.make_interval(secs=F.col("later")))
    folder = st.scratch(t.spark, "records")
    st.run_to_folder(st.distinct_records(seen, "ts", "event_id", "1 hour"), folder)
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "user_id")
