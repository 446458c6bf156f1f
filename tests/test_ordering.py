"""Distributed order, quantiles, ties and survival against plain computations."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldrounds.operators import aggregates as ag, ranking as rk
from fieldrounds.operators.ordering import exact_quantiles, first_rows, positions, running_sums


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    # One group holds most rows, one score holds a third of them.
    return [(i, "hot" if rng.random() < 0.7 else f"g{i % 3}", -97.0 if rng.random() < 0.33 else round(rng.uniform(-100, -60), 1), int(rng.random() < 0.3)) for i in range(2000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, score double, y int")


def test_positions_split_a_hot_group(df, rows):
    got = {r.id: r.position for r in positions(df, ["g"], [F.col("score").desc(), F.col("id")]).collect()}
    for g in {r[1] for r in rows}:
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))


def test_running_sums(df, rows):
    got = {r.id: r.cum for r in running_sums(df, [], [F.col("id")], {"cum": F.col("y")}).collect()}
    want = np.cumsum([r[3] for r in rows])
    assert [got[r[0]] for r in rows] == want.tolist()


def test_quantiles(df, rows):
    got = {r.g: (r.a, r.b) for r in exact_quantiles(df, ["g"], "score", {"a": 0.31, "b": 0.8}).collect()}
    for g in got:
        v = [r[2] for r in rows if r[1] == g]
        assert got[g] == pytest.approx((np.quantile(v, 0.31), np.quantile(v, 0.8)))


def test_first_rows_limits_before_the_shuffle(df):
    plan = first_rows(df, ["g"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_top_weights_and_auc(df, rows):
    s, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    w = {r.id: r.weight for r in rk.top_weights(df, 0.2).collect()}
    k = 0.2 * len(s)
    for i, _, score, _ in rows[:200]:
        above, same = (s > score).sum(), (s == score).sum()
        assert w[i] == pytest.approx(float(np.clip((k - above) / same, 0, 1)))
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert rk.auc(df).first().auc == pytest.approx(float(want))


def test_slots_are_handed_out_highest_first(spark):
    d = spark.createDataFrame([("w", 1, 10, 0.1), ("w", 2, 12, 0.9), ("w", 3, 12, 0.5), ("w", 4, 20, 0.5)], "w string, id int, dn int, s double")
    got = {r.id: r.assigned for r in rk.assigned_slots(d, ["w"], {"a": "s"}).collect()}
    assert got == {2: 10.0, 3: 12.0, 4: 12.0, 1: 20.0}


def test_kaplan_meier_with_censoring(spark):
    d = spark.createDataFrame([("a", 10, True), ("a", 20, True), ("a", 30, False), ("a", 40, True), ("b", 5, False), ("b", 6, True), ("c", 7, True)], "k string, t int, event boolean")
    got = {r.k: r.median for r in ag.km_median(d, ["k"]).collect()}
    # a: S = 3/4 at 10, 1/2 at 20. b: S = 0 at 6. c: S = 0 at 7.
    assert got == {"a": 20.0, "b": 6.0, "c": 7.0}
    open_only = spark.createDataFrame([("z", 5, False), ("z", 9, True), ("z", 12, False), ("z", 13, False)], "k string, t int, event boolean")
    assert ag.km_median(open_only, ["k"]).first().median is None


def test_suppression_hides_a_partner(spark):
    t = spark.createDataFrame([("a", 100), ("b", 5), ("c", 40)], "type string, n long")
    got = {r.type: r.n for r in ag.suppress_small_cells(t, ["n"], "type").collect()}
    assert got == {"a": 100, "b": None, "c": None}
    lone = spark.createDataFrame([("b", 5)], "type string, n long")
    assert ag.withheld_totals(lone, ["n"]).first().n is None
