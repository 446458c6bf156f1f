"""Batched fits against finite differences, optimality conditions and one fit at a time."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldrounds.operators import models as md, newton

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 4000
    x = np.stack([rng.integers(0, 6, n), rng.integers(0, 3, n), rng.poisson(0.4, n), np.full(n, 2)], 1).astype(float)
    p = 1 / (1 + np.exp(-(-1.5 + 0.5 * x[:, 0] - 0.6 * x[:, 1] + 0.2 * x[:, 2])))
    return x, (rng.random(n) < p).astype(int), rng.random(n) + 0.5, rng.poisson(1.0, (n, 3))


@pytest.fixture(scope="module")
def vectors(spark, rows):
    x, y, w, times = rows
    data = [(*map(float, a), int(b), float(c), [int(v) for v in d]) for a, b, c, d in zip(x, y, w, times)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, y int, weight double, times array<int>")
    return newton.Vectors.of(df, NAMES, times=F.col("times"), reps=3)


def objective(rows, r, params, penalty, sd):
    """Mean loss of one weighting at weights per standard deviation."""
    x, y, w, times = rows
    z = params[0] + (x / sd) @ params[1:]
    weight = w * times[:, r]
    return (weight @ (np.logaddexp(0, z) - y * z)) / weight.sum() + penalty * params[1:].sum()


def test_moments_and_weights(rows, vectors):
    x, y, w, times = rows
    for r in range(3):
        mean = np.average(x, axis=0, weights=times[:, r])
        sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=times[:, r]))
        assert np.allclose(vectors.mean[r], mean) and np.allclose(vectors.sd[r], np.where(sd > 0, sd, 1))
        assert np.isclose(vectors.total[r], w @ times[:, r]) and np.isclose(vectors.positive[r], (w * y) @ times[:, r])


def test_sums_agree_with_finite_differences(rows, vectors):
    rep, at = np.array([0, 2]), np.array([[-1.0, 0.3, 0.0, 0.1, 0.0], [0.5, -0.2, 0.4, 0.0, 0.1]])
    loss, gradient, hessian = newton.sums_at(vectors, rep, at)
    one = np.ones(4)
    for m, r in enumerate(rep):
        total = vectors.total[r]
        f = lambda p: objective(rows, r, p, 0.0, one) * total  # noqa: E731, B023
        assert np.isclose(loss[m], f(at[m]))
        for i in range(5):
            e = np.eye(5)[i] * 1e-5
            assert np.isclose(gradient[m, i], (f(at[m] + e) - f(at[m] - e)) / 2e-5, rtol=1e-5, atol=1e-3)
            low, high = newton.sums_at(vectors, rep[m:m + 1], (at[m] - e)[None])[1][0], newton.sums_at(vectors, rep[m:m + 1], (at[m] + e)[None])[1][0]
            assert np.allclose(hessian[m, i], (high - low) / 2e-5, rtol=1e-4, atol=1e-2)


def test_fits_meet_the_conditions_of_an_optimum(rows, vectors):
    rep, penalty = np.repeat([0, 1, 2], 4), np.tile([0.2, 0.02, 0.002, 0.0], 3)
    start = newton.first_guess(vectors)[rep]
    got = newton.nonneg_fits(vectors, rep, penalty, start, np.ones_like(start, bool))
    assert (got[:, 1:] >= 0).all()
    for m, r in enumerate(rep):
        for i in range(5):
            e = np.eye(5)[i] * 1e-4
            f = lambda p: objective(rows, r, p, penalty[m], vectors.sd[r])  # noqa: E731, B023
            slope = (f(got[m] + e) - f(got[m] - e)) / 2e-4
            assert abs(slope) < 1e-5 if i == 0 or got[m, i] > 1e-6 else slope > -1e-5
    alone = newton.nonneg_fits(vectors, rep[5:6], penalty[5:6], start[5:6], np.ones((1, 5), bool))
    assert np.allclose(alone, got[5], atol=1e-5)


def test_a_point_likelihood_is_that_of_a_plain_search(rows, vectors):
    x, y, w, times = rows
    tries = [(0, [1, 0, 0, 0]), (0, [3, 0, 1, 0]), (2, [1, 0, 0, 0]), (1, [0, 1, 0, 0])]
    for (r, pts), got in zip(tries, newton.points_likelihood(vectors, tries)):
        t, weight = x @ np.array(pts), w * times[:, r]
        f = lambda a, b: weight @ (y * (a + b * t) - np.logaddexp(0, a + b * t))  # noqa: E731, B023
        a, b, step = 0.0, 0.0, 1.0
        while step > 1e-7:
            moves = [(a + i * step, max(0.0, b + j * step)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            best = max(moves, key=lambda m: f(*m))
            if f(*best) <= f(a, b) + 1e-12:
                step /= 2
            else:
                a, b = best
        assert np.isclose(got, f(a, b), rtol=1e-7)


def test_all_weightings_together_are_as_each_alone(spark, rows):
    x, y, w, times = rows
    names = ["avg_deficit", "grp", "majors"]
    make = lambda t: spark.createDataFrame([(*map(float, a[:3]), int(b), 1.0, [int(v) for v in d]) for a, b, d in zip(x, y, t)],
                                           "avg_deficit double, grp double, majors double, y int, weight double, times array<int>")
    both = md.fit_counts(newton.Vectors.of(make(times), names, times=F.col("times"), reps=3))
    assert all("avg_deficit" in b and "grp" not in b for b in both)          # grp lowers the odds, and weights are at least 0
    for r in range(3):
        assert md.fit_counts(newton.Vectors.of(make(times[:, r:r + 1]), names, times=F.col("times"), reps=1)) == [both[r]]


def test_one_class_gives_no_rule(spark):
    df = spark.createDataFrame([(1.0, 0, 1.0), (2.0, 0, 1.0)], "avg_deficit double, y int, weight double")
    assert md.fit_count(df, ["avg_deficit"]) == {}


def test_stability_recuts_bands_at_todays_shares(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), float(d), int(rng.random() < 0.05 + 0.04 * d), 1.0) for i, d in enumerate(rng.integers(0, 20, 3000))]
    train = spark.createDataFrame(rows, "business_id long, avg_deficit double, y int, weight double")
    now = spark.createDataFrame([(i, float(i % 20), i % 10 > 0, ("1" if i % 20 >= 18 else "2" if i % 20 >= 12 else None) if i % 10 > 0 else None) for i in range(400)],
                                "business_id long, avg_deficit double, eligible boolean, band_now string")
    got = {r["business_id"]: r["kept"] for r in md.stability(train, now, 4, ["avg_deficit"]).collect()}
    assert len(got) == 400 and set(got.values()) == {1.0}        # one feature: every refit orders the places alike
