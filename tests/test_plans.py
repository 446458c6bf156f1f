"""Shapes of plans that must hold at scale."""
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fieldrounds.operators import history, resample, snapshot
from fieldrounds.operators.episodes import read_closures
from fieldrounds.plans.registry import Tables
from fieldrounds.session import shared_folder, stored
from fieldrounds.sources.adapt import TABLE_RULES, merged


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SMALL)


@pytest.mark.parametrize("make", [
    lambda t: read_closures(t.merged, TABLE_RULES), lambda t: history.add_features(t.research), lambda t: history.month_start_features(t.research),
    lambda t: snapshot.snapshots(t.visits, t.places, ["2000-01-01", "2000-02-01"], TABLE_RULES), lambda t: t.located])
def test_no_single_partition_and_no_cross_product(t, make):
    p = plan(make(t))
    assert "SinglePartition" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_the_bucketed_record_feeds_every_history_feature_without_a_shuffle(t):
    assert plan(history.add_features(t.research)).count("Exchange") == 0


def test_one_shuffle_feeds_every_history_feature_of_a_plain_record(spark, t):
    plain = stored(t.research, "plain")
    assert plan(history.add_features(plain)).count("Exchange hashpartitioning") == 1


def test_the_record_is_written_once_and_read_as_files(spark, t):
    for name in ("merged", "visits", "scored"):
        first = plan(getattr(t, name))
        again = plan(getattr(Tables(spark, SMALL), name))
        assert "FileScan parquet" in first and "ExistingRDD" not in first
        place = re.search(r"Location: [^,]*", first)[0]
        assert place in again


def test_bootstrap_weights_are_made_where_the_clusters_lie(spark):
    per = stored(spark.range(100).selectExpr("id AS c", "id % 7 AS v"), "per")
    p = plan(resample.replicate_sums(per, "c", ["v"], reps=1000))
    assert "Join" not in p and p.count("Exchange") == 1 and p.index("HashAggregate") < p.index("Generate")
    got = resample.drawn(per, "c", 1000).agg(F.sum("times"), F.count_distinct("rep")).first()
    assert abs(got[0] / 100_000 - 1) < 0.02 and got[1] == 1000


def test_a_named_shared_folder_is_asked_for_on_a_cluster(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)


def test_only_needed_columns_are_read(spark):
    p = plan(merged(spark, SMALL))
    line = next(x for x in p.splitlines() if "l_returnflag" in x and "ReadSchema" in x)
    assert "l_extendedprice" not in line and "l_tax" not in line


def test_no_python_in_the_visit_plan(t):
    p = plan(history.add_features(t.research))
    assert "Python" not in p and "Pandas" not in p
