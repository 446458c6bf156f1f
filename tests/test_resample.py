"""Bootstrap weights and sums against plain Python."""
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from fieldrounds.operators import resample


def weight(key, rep: int, seed: int = 0) -> int:
    u = int(hashlib.md5(f"{seed}:{key}:{rep // 4}".encode()).hexdigest()[8 * (rep % 4):][:8], 16)
    return sum(u >= k for k in resample.POISSON_CUTS)


def test_weights_are_the_digests_of_every_length_of_key():
    keys = ["", "7", "12 Test St", "é", "x" * 45, "x" * 52, "x" * 90]
    got = resample.times_of(keys, 1002, 3)
    assert got.tolist() == [[weight(k, r, 3) for r in range(1002)] for k in keys]
    assert resample.times_of(keys[:4], 41).tolist() == [[weight(k, r) for r in range(41)] for k in keys[:4]]


def test_sums_are_those_of_the_drawn_clusters_with_nulls_left_out(spark):
    rows = [(k, g, v, x) for k, g, v, x in zip("abcdab", ["p", "p", None, "p", "q", "p"], [1, None, 5, 2 ** 40, 7, 1], [0.5, None, None, 2.0, 1.5, 0.25])] + [(None, "p", 9, 9.0)]
    df = spark.createDataFrame(rows, "c string, g string, v long, x double")
    got = {(r["rep"], r["g"]): (r["v"], r["x"]) for r in resample.replicate_sums(df, "c", ["v", "x"], ["g"], 50).collect()}
    want = {}
    for rep in range(50):
        for k, g, v, x in rows[:-1]:
            if n := weight(k, rep):
                a, b = want.get((rep, g), (None, None))
                want[rep, g] = (a if v is None else (a or 0) + n * v, b if x is None else (b or 0) + n * x)
    assert got == want


def test_a_replicate_makes_no_row_for_a_cluster(spark):
    """Before, each cluster was a row for each quad of replicates and again for each replicate."""
    per = spark.range(100).selectExpr("id AS c", "id AS v")
    plan = resample.replicate_sums(per, "c", ["v"], reps=1000)._jdf.queryExecution().toString()
    below = plan[plan.index("== Physical Plan =="):]
    assert below.index("Generate") < below.index("MapInArrow") and below.count("Generate posexplode") == 1


def test_paired_auc_with_ties_across_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), rng.randrange(2), rng.choice([1.0, 1.0, 2.0, rng.random()]), float(rng.randrange(3))) for _ in range(600)] + [(3, 1, None, 1.0), (4, 0, 1.0, None)]
    df = spark.createDataFrame(rows, "c long, y int, a double, b double")
    got = {r["rep"]: (r["auc_a"], r["auc_b"], r["auc_diff"]) for r in resample.paired_auc(df, "c", "a", "b", 20).collect()}
    low = float("-inf")
    for rep in range(20):
        both = []
        for j in (2, 3):
            w = np.array([weight(r[0], rep) for r in rows], float)
            s, y = np.array([low if r[j] is None else r[j] for r in rows]), np.array([r[1] for r in rows])
            p, q = w * y, w * (1 - y)
            won = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
            both.append(p @ won @ q / (p.sum() * q.sum()))
        assert np.allclose(got[rep], [*both, both[0] - both[1]], atol=1e-12)


def test_grouped_clusters_are_dealt_over_tasks(spark):
    """Before, the dealing fell away after a grouping by the same column, and all clusters were drawn in one task."""
    per = spark.range(4000).selectExpr("id % 400 AS c").groupBy("c").count()
    assert resample.dealt(per, "c").select(F.spark_partition_id().alias("p")).distinct().count() > 1
