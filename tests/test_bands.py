"""Cuts, validation, curves and the count score."""
import random
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from fieldrounds.operators import bands as bd, models as md
from fieldrounds.rules import RULES


def pav(rates, weights):
    blocks = []
    for r, w in zip(rates, weights):
        blocks.append([r, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            r2, w2, n2 = blocks.pop()
            r1, w1, n1 = blocks.pop()
            blocks.append([(r1 * w1 + r2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [r for r, _, n in blocks for _ in range(n)]


def test_isotonic_pools_violators(spark):
    rng = random.Random(2)
    data = []
    for i in range(20):
        n = rng.randint(1, 9)
        w = [float(rng.randint(1, 50)) for _ in range(n)]
        data.append((i, w, [x * rng.random() for x in w]))
    got = {r.i: r.fit for r in spark.createDataFrame(data, "i int, w array<double>, s array<double>").select("i", bd.isotonic(F.col("w"), F.col("s")).alias("fit")).collect()}
    for i, w, s in data:
        assert np.allclose(got[i], pav([a / b for a, b in zip(s, w)], w))


def test_cuts_never_split_a_tie(spark):
    pts = [20] * 3 + [15] * 4 + [12] * 10 + [5] * 83
    df = spark.createDataFrame([(float(p),) for p in pts], "points double")
    assert bd.band_cuts(df).first().cuts == [20.0, 15.0, 12.0]


def test_validation_merges_and_restarts():
    good = [("o1", "1", 30, 60), ("o1", "2", 20, 80), ("o1", "3", 15, 100), ("o1", "rest", 40, 600)]
    assert bd.validate_cuts(good, [14, 11, 9], z=0.5) == [14, 11, 9]
    flat = [("o1", "1", 30, 60), ("o1", "2", 8, 80), ("o1", "3", 15, 100), ("o1", "rest", 40, 600)]
    assert bd.validate_cuts(flat, [14, 11, 9], z=0.5) == [14, 9]
    assert bd.validate_cuts([("o1", "1", 0, 0), ("o1", "rest", 1, 10)], [14]) == []


def test_bands_are_rarely_invented_under_a_flat_rate():
    rng = np.random.default_rng(3)
    kept = 0
    for _ in range(400):
        counts = []
        for o in range(3):
            for b, n in (("1", 60), ("2", 120), ("3", 240), ("rest", 1500)):
                counts.append((o, b, int(rng.binomial(n, 0.2)), n))
        kept += bool(bd.validate_cuts(counts, [14, 11, 9]))
    assert kept / 400 < 0.05


def test_curve_groups_pool_from_the_top(spark):
    pts = [9] * 3 + [7] * 4 + [5] * 6 + [2] * 5 + [0] * 2
    df = spark.createDataFrame([(float(p), 1, True) for p in pts], "points double, y int, eligible boolean")
    got = [(g.lo, g.hi, g.n) for g in bd.curve_groups(df, 5).first().groups]
    assert got == [(0, 2, 7), (5, 5, 6), (7, 9, 7)]


def test_estimates_read_the_group_below(spark):
    curve = spark.createDataFrame([(2, 4, 0.1, 0.0, 0.2), (8, 9, 0.4, 0.3, 0.5)], "lo int, hi int, rate double, low double, high double")
    pts = spark.createDataFrame([(0.0,), (3.0,), (6.0,), (8.0,), (50.0,)], "points double")
    got = {r.points: r.est_rate for r in bd.estimates(pts, curve).collect()}
    assert got == {0.0: 0.1, 3.0: 0.1, 6.0: 0.1, 8.0: 0.4, 50.0: 0.4}


def test_count_score_finds_the_signal(spark):
    rng = np.random.default_rng(1)
    n = 3000
    deficit, noise = rng.integers(0, 20, n), rng.integers(0, 3, n)
    p = 1 / (1 + np.exp(-(-3 + 0.25 * deficit)))
    y = (rng.random(n) < p).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c), 1.0) for a, b, c in zip(deficit, noise, y)], "avg_deficit double, grp double, y int, weight double")
    w = md.fit_count(df, ["avg_deficit", "grp"], path=5, multipliers=20)
    assert w["avg_deficit"] >= 1 and w["avg_deficit"] > w.get("grp", 0)


def test_rule_selection_prefers_the_sparse_rule(spark):
    rows = [("o1", "average score", 0.70), ("o1", "count score", 0.705), ("o1", "boosted", 0.708), ("o2", "average score", 0.69), ("o2", "count score", 0.70), ("o2", "boosted", 0.695)]
    m = spark.createDataFrame(rows, "origin string, model string, auc double")
    assert tuple(md.select_rule(m).first()) == ("average score", True, 1)
    worse = spark.createDataFrame([(o, m_, a + (0.05 if m_ == "boosted" else 0)) for o, m_, a in rows], "origin string, model string, auc double")
    assert tuple(md.select_rule(worse).first()) == ("average score", False, 2)


def test_the_fold_validates_as_the_plain_walk_does(spark):
    rules, cuts = replace(RULES, band_z=0.5), [14.0, 11.0, 9.0]
    rng = random.Random(5)
    planted = [
        {"o1": [(6, 10), (4, 10), (2, 10), (1, 10)], "o2": [(7, 10), (5, 10), (3, 10), (0, 10)]},                # all real
        {"o1": [(2, 10), (6, 10), (7, 10), (1, 10)], "o2": [(2, 10), (6, 10), (7, 10), (1, 10)]},                # merges twice
        {"o1": [(5, 10), (5, 10), (5, 10), (5, 10)], "o2": [(5, 10), (5, 10), (5, 10), (5, 10)]},                # nothing is left
        {"o1": [(0, 0), (6, 10), (3, 10), (1, 10)], "o2": [(3, 3), (6, 10), (3, 10), (1, 10)]},                  # a band is empty at one origin
        *[{o: [(rng.randint(0, 8), 8) for _ in range(4)] for o in ("o1", "o2", "o3")} for _ in range(6)]]
    left = []
    for table in planted:
        rows = [(o, p, int(i < k), True) for o, bands in table.items() for (k, n), p in zip(bands, (15.0, 12.0, 10.0, 1.0)) for i in range(n)]
        df = spark.createDataFrame(rows, "as_of string, points double, y int, eligible boolean")
        got = bd.validated_cuts(df, spark.createDataFrame([(cuts,)], "cuts array<double>"), 3, rules).first().cuts
        counts = [(o, "rest" if i == 3 else str(i + 1), k, n) for o, bands in table.items() for i, (k, n) in enumerate(bands) if n]
        assert got == bd.validate_cuts(counts, cuts, rules.band_z)
        left.append(len(got))
    assert left[:3] == [3, 1, 0]


def test_outside_bands_need_every_cut_to_hold_there(spark):
    city, rules = spark.createDataFrame([([14.0],)], "cuts array<double>"), replace(RULES, band_z=0.5)
    for outside, held in (((1, 6), False), ((6, 1), True)):
        rows = [("o1", where, p, int(i < k), True, b) for where, ks in (("c", (6, 1)), (None, outside)) for p, k, b in zip((15.0, 1.0), ks, ("1", None)) for i in range(10)]
        df = spark.createDataFrame(rows, "as_of string, district string, points double, y int, eligible boolean, band string")
        got = {(r.district, r.band) for r in bd.outside_bands(df, city, 1, rules).collect()}
        assert got == {("c", "1"), ("c", None), (None, None)} | ({(None, "1")} if held else set())


def test_curves_by_key_are_those_of_each_key_alone(spark):
    rng = np.random.default_rng(7)
    rows = [(f"a{i % 90}", bool(i % 3 == 0), float(rng.integers(0, 12)), int(rng.random() < 0.3), True) for i in range(900)]
    df = spark.createDataFrame(rows, "address string, closure_read boolean, points double, y int, eligible boolean")
    both = bd.risk_curve(df, "address", 20, 40, keys=["closure_read"]).collect()
    assert len(both) >= 6
    for read in (True, False):
        alone = bd.risk_curve(df.where(F.col("closure_read") == read), "address", 20, 40).collect()
        assert sorted(tuple(r)[1:] for r in both if r.closure_read == read) == sorted(tuple(r) for r in alone)
