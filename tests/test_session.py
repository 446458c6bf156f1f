"""Shuffles that grow with their table."""
import pytest

from conftest import SMALL
from fieldrounds.plans.registry import Tables
from fieldrounds.session import dealt_finely


def test_partitions_grow_with_the_rows_and_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), dealt_finely(spark, 1_050_000, 100_000):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "11"
        raise KeyError
    with dealt_finely(spark, 10, 100_000):
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_theme_visits_are_read_from_buckets_of_their_places(spark, monkeypatch):
    """Before, the merged visits with themes lay unbucketed and were shuffled again into a fixed number of partitions."""
    from fieldrounds.plans import registry
    held = []
    real = registry.adapt.read_visits
    monkeypatch.setattr(registry.adapt, "read_visits", lambda merged: held.append(merged) or real(merged))
    monkeypatch.setattr(registry, "_KEPT", {})
    monkeypatch.setattr(registry, "dealt_finely", lambda spark, rows: dealt_finely(spark, rows, 100))
    Tables(spark, SMALL).theme_visits
    plan = held[0].groupBy("business_id").count()._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "15 out of 15" in plan
