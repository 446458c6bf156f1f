"""Streaming results against the batch ones."""
import pytest
from pyspark.sql import functions as F

from conftest import CHECK, SMALL
from fieldrounds.plans import QUERIES
from fieldrounds.plans.registry import Tables
from fieldrounds.plans.streams import batch_episodes, live_episodes


def test_episodes_match_the_batch_reading(spark):
    t = Tables(spark, SMALL)
    last = t.merged.agg(F.max("dn")).first()[0]
    safe = last - 31                         # what the watermark has certainly passed
    live = {(r.business_id, r.started): (r.closure, r.reopened_on) for r in QUERIES["st3_closure_episodes"](spark, SMALL).collect()}
    want = batch_episodes(t).where((F.col("dn") < safe - 400) & (F.col("reopened_on").isNull() | (F.unix_date("reopened_on") < safe))).collect()
    assert len(want) > 10
    for r in want:
        got = live[(r.business_id, str(r.day))]
        assert got == (r.closure, None if r.reopened_on is None else str(r.reopened_on))


@pytest.mark.parametrize("files", [1, 12, 40])
def test_all_episodes_whatever_the_number_of_files(spark, files):
    t = Tables(spark, SMALL)
    got = sorted((r.business_id, r.started, r.closure, r.reopened_on) for r in live_episodes(t, files).collect())
    assert got == sorted((r.business_id, r.day, r.closure, r.reopened_on) for r in batch_episodes(t).collect())


def test_the_last_visits_are_read_too(spark):
    assert {(r.business_id, r.started) for r in QUERIES["st3_closure_episodes"](spark, CHECK).collect()} == {
        (r.business_id, str(r.day)) for r in batch_episodes(Tables(spark, CHECK)).collect()}


def test_months_from_closed_days(spark):
    from fieldrounds.streaming.streams import by_month
    d = spark.createDataFrame([("2024-01-01", 3, 1), ("2024-01-30", 2, 0), ("2024-02-01", 1, 1)], "day string, n long, positives long").withColumn("day", F.to_date("day"))
    assert {str(r.month): (r.n, r.positives) for r in by_month(d).collect()} == {"2024-01-01": (5, 1), "2024-02-01": (1, 1)}


def test_places_are_held_in_a_bounded_number_of_groups(spark, monkeypatch, tmp_path):
    """Before, each place was a call of the state function in every batch."""
    from fieldrounds.streaming import streams as st
    monkeypatch.setattr(st, "BUCKETS", 3)
    m = Tables(spark, SMALL).merged
    m.write.parquet(f"{tmp_path}/in")
    q = (st.closure_episodes(spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    assert m.select("business_id").distinct().count() > 50
    assert {p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress} <= {1, 2, 3}
