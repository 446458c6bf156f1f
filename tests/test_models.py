"""The model queries run at the rules' own sizes."""
import inspect

import pytest

from conftest import SMALL
from fieldrounds.operators import models as md
from fieldrounds.plans import QUERIES
from fieldrounds.plans.models import COUNTED, FEATURES


class Asked(Exception):
    pass


def asked(monkeypatch, spark, query, name):
    """The arguments, defaults included, of the first call that a query makes."""
    real = inspect.signature(getattr(md, name))

    def spy(*a, **k):
        got = real.bind(*a, **k)
        got.apply_defaults()
        raise Asked(got.arguments)
    monkeypatch.setattr(md, name, spy)
    with pytest.raises(Asked) as e:
        QUERIES[query](spark, SMALL).count()
    monkeypatch.undo()
    return e.value.args[0]


@pytest.mark.parametrize("query", ["ml1_boosted_trees", "ml3_as_deployed", "ml4_rolling_origins", "bs12_permutation_importance"])
def test_boosting_may_take_300_rounds(monkeypatch, spark, query):
    assert asked(monkeypatch, spark, query, "BoostedTrees")["max_iter"] == 300


def test_comparators_and_the_count_score_are_whole(monkeypatch, spark):
    got = asked(monkeypatch, spark, "ml6_boosted_and_additive", "fit_trees")
    assert (got["rounds"], got["additive"]) == (200, (False, True))
    assert "th_small" in FEATURES and "kind_market" in FEATURES and "th_small" in COUNTED
    signs = dict(zip(FEATURES, md.monotone_signs(FEATURES)))
    assert (signs["avg_score"], signs["majors"], signs["th_small"], signs["routines"], signs["kind_market"]) == (-1, 1, 1, 0, 0)
    got = asked(monkeypatch, spark, "ml7_count_score", "fit_count")
    assert (got["path"], got["multipliers"], got["features"]) == (40, 320, COUNTED)
    got = asked(monkeypatch, spark, "ml14_stability", "stability")
    assert (got["reps"], got["path"], got["multipliers"], got["features"]) == (30, 40, 320, COUNTED)


def test_the_origin_run_has_the_boosted_and_additive_arms(monkeypatch, spark):
    got = asked(monkeypatch, spark, "ml13_rule_selection", "fit_trees")
    assert (got["rounds"], got["reps"], got["additive"]) == (200, 2, (False, True))


class Linear:
    """A stand-in for a fitted model: the score is a known function of two columns."""

    def predict(self, rows, name="p"):
        from pyspark.sql import functions as F
        return rows.withColumn(name, F.col("a") + 0.1 * F.col("b"))


def test_importance_is_the_drop_of_each_shuffled_column(spark):
    import numpy as np
    from pyspark.sql import functions as F
    rng = np.random.default_rng(1)
    rows = [(int(i), float(rng.random()), float(rng.random()), float(rng.random())) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, n, int(a + 0.3 * b > 0.6)) for i, a, b, n in rows], "record_id long, a double, b double, noise double, y int")
    got = {r["feature"]: r["auc_drop"] for r in md.permutation_importance(Linear(), df, ["a", "b", "noise"], repeats=3).collect()}
    table = df.withColumns({f"h{r}": F.xxhash64("record_id", F.lit(r)) for r in range(3)}).orderBy("record_id").toPandas()

    def auc(score):
        p, n = score[table["y"] == 1].to_numpy(), score[table["y"] == 0].to_numpy()
        return (p[:, None] > n).mean() + (p[:, None] == n).mean() / 2
    full = auc(table["a"] + 0.1 * table["b"])
    for x in ("a", "b", "noise"):
        means = []
        for r in range(3):
            mixed = table.copy()
            mixed[x] = table.sort_values([f"h{r}", "record_id"])[x].to_numpy()
            means.append(auc(mixed["a"] + 0.1 * mixed["b"]))
        assert abs(got[x] - (full - np.mean(means))) < 1e-9
    assert got["noise"] == 0 and got["a"] > 0.3 > got["b"]


def test_the_cutoffs_of_the_rolling_origins_are_fitted_together(monkeypatch, spark):
    """Before, each fit waited for the one before it."""
    import threading
    met = threading.Barrier(3)

    class Fake:
        def __init__(self, *a, **k):
            pass

        def fit(self, rows):
            met.wait(60)
            raise Asked({})
    monkeypatch.setattr(md, "BoostedTrees", Fake)
    with pytest.raises(Asked):
        QUERIES["ml4_rolling_origins"](spark, SMALL)


def test_training_rows_are_shuffled_into_more_partitions_as_they_grow(monkeypatch, spark):
    from fieldrounds.plans import models as pm
    from fieldrounds.session import dealt_finely

    def spy(df):
        raise Asked(int(spark.conf.get("spark.sql.shuffle.partitions")))
    monkeypatch.setattr(pm, "dealt_finely", lambda s, rows, per: dealt_finely(s, rows, 100))
    monkeypatch.setattr(pm, "cut", spy)
    with pytest.raises(Asked) as e:
        QUERIES["ml7_score_equations"](spark, SMALL)
    assert e.value.args[0] >= (1500 + 36 * 150) // 100


def test_trees_pass_over_distinct_rows(monkeypatch, spark):
    """Rows that are alike are one weighted row for the trees, which come out as from all rows."""
    from pyspark.ml.classification import GBTClassifier
    rows = spark.range(1200).selectExpr("id", "id % 200 AS k").selectExpr(
        "IF(k % 3 = 0, 'a', 'b') AS kind", "IF(k % 7 = 0, NULL, k % 20) AS x", "(k * 13) % 50 AS z", "CAST((k * 13) % 50 + k % 3 > 25 AS DOUBLE) AS major",
        "DATE '1999-01-01' + CAST(IF(id < 800, 0, 200) AS INT) AS day")
    real, seen = GBTClassifier.fit, []

    def spy(self, data, *a):
        seen.append(data.count())
        return real(self, data, *a)
    monkeypatch.setattr(GBTClassifier, "fit", spy)
    m = md.BoostedTrees(["kind"], ["x", "z"], max_iter=4).fit(rows, min_fit=100, min_val=100)
    monkeypatch.undo()
    assert len(seen) == 2 and max(seen) <= 200
    whole = GBTClassifier(labelCol="major", maxIter=m.rounds, maxDepth=4, stepSize=0.08, seed=0, maxBins=256)
    vectors = m._prepare(rows)
    for stage in m.model.stages[:-1]:
        vectors = stage.transform(vectors)
    from pyspark.ml.functions import vector_to_array
    want = [r.p for r in whole.fit(vectors).transform(vectors).select("day", "kind", "x", "z", vector_to_array("probability")[1].alias("p")).orderBy("day", "kind", "x", "z").collect()]
    got = [r.p for r in m.predict(rows).orderBy("day", "kind", "x", "z").collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_trees_take_no_more_tasks_than_the_distinct_rows_are_worth(monkeypatch, spark):
    """Before, each of the thousands of stages had as many tasks as there are shuffle partitions."""
    from pyspark.ml.classification import GBTClassifier
    rows = spark.range(1200).selectExpr("'a' AS kind", "id % 50 AS x", "CAST(id % 50 + id % 3 > 25 AS DOUBLE) AS major", "DATE '1999-01-01' + CAST(IF(id < 800, 0, 200) AS INT) AS day")
    real, seen = GBTClassifier.fit, []

    def spy(self, data, *a):
        seen.append(data.rdd.getNumPartitions())
        return real(self, data, *a)
    monkeypatch.setattr(GBTClassifier, "fit", spy)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for per, tasks in ((md.TREE_ROWS, 1), (50, 2)):
            monkeypatch.setattr(md, "TREE_ROWS", per)
            md.BoostedTrees(["kind"], ["x"], max_iter=2).fit(rows, min_fit=100, min_val=100)
            assert seen == [tasks, tasks]
            seen.clear()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert spark.sparkContext.getCheckpointDir()
