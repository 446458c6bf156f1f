"""Models and the rules fitted on snapshots."""
from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import boost, newton
from ..functions import half_up, log_odds, points_formula
from ..rules import RULES, Rules
from ..session import discard, shared_folder, stored
from .bands import band_of, falling_cuts, nearest_cut
from .clean import theme_columns
from .ordering import exact_quantiles

TREE_ROWS = 16384                           # distinct rows for which another task of MLlib's trees is worth its while


def equal_opportunity_cuts(df: DataFrame, group: str, score: str, target: float, y: str = "y") -> DataFrame:
    """Per group, the score that flags ``target`` of its positives (ML15)."""
    return exact_quantiles(df.where(F.col(y) == 1), [group], score, {"cut": 1 - target})


def apply_group_cuts(df: DataFrame, cuts: DataFrame, group: str, score: str, y: str = "y") -> DataFrame:
    """Flag rate and recall by group when each group has its own cut."""
    flag = (F.col(score) >= F.col("cut")).cast("double")
    return df.join(cuts, group).groupBy(group).agg(F.avg(flag).alias("flag_rate"), F.avg(F.when(F.col(y) == 1, flag)).alias("recall"))




def reading_scores(visits: DataFrame, at: str, readings: dict[str, int | None], rules: Rules = RULES) -> DataFrame:
    """The average rule's points at ``at`` with a closure read several ways, every reading in one pass (ML18).

    ``None`` reads a closure by the point formula. ``business_id, reading, score``.
    """
    day = F.lit(at).cast("date")
    c = F.col
    rows = visits.where((c("visit_type") == "routine") & (c("day") < day) & (F.datediff(day, "day") <= rules.score_window_days))
    closed = F.coalesce(c("closure_order") == "health", F.lit(False))
    formula = points_formula(c("n_major"), c("n_minor"), c("n_grp"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("reading"), F.when(closed, formula if v is None else F.lit(v)).otherwise(c("score")).cast("int").alias("s"))
                               for k, v in readings.items()])).alias("_x")
    g = rows.select("business_id", each).select("business_id", "_x.reading", "_x.s").groupBy("business_id", "reading").agg(F.avg("s").alias("_m"))
    return g.where("_m is not null").select("business_id", "reading", (100 - half_up(c("_m"))).alias("score"))


# ── fitted models: MLlib on Spark frames; the driver holds coefficients and metrics ──

# Names of the features of the fitted models.
NUMERIC = ("avg_score", "last_score", "routines", "routines_major", "majors", "health_closures", "reinspections", "grp")
COUNT_FEATURES = ("avg_deficit", "last_deficit", "routines_major", "majors", "health_closures", "reinspections", "grp")
# Kinds with an indicator in the fitted comparators; the count score has none.
MODEL_KINDS = ("restaurant", "limited", "market")


def count_features(rules: Rules = RULES) -> tuple[str, ...]:
    """What the count score may choose from: the record and its themes."""
    return (*COUNT_FEATURES, *theme_columns(rules))


def model_features(rules: Rules = RULES) -> tuple[str, ...]:
    """What the comparators read: the record, its themes and the kind of place."""
    return (*NUMERIC, *theme_columns(rules), *[f"kind_{k}" for k in MODEL_KINDS])


def with_kinds(frame: DataFrame) -> DataFrame:
    return frame.withColumns({f"kind_{k}": F.coalesce((F.col("kind") == k).cast("int"), F.lit(0)) for k in MODEL_KINDS})


def training_rows(rows: DataFrame, end: str, start: str | None = None) -> DataFrame:
    """Rows up to ``end``, and from ``start`` when given (ML2)."""
    out = rows.where(F.col("day") <= F.lit(end).cast("date"))
    return out.where(F.col("day") >= F.lit(start).cast("date")) if start else out


def _with_missing(df: DataFrame, numeric: list[str], fill: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """Nulls become a fill value plus an indicator: MLlib takes no missing values."""
    cols = {f"{c}_na": F.col(c).isNull().cast("double") for c in numeric}
    cols |= {f"{c}_v": F.coalesce(F.col(c).cast("double"), F.lit(float(fill.get(c, -1.0)))) for c in numeric}
    return df.withColumns(cols), [x for c in numeric for x in (f"{c}_v", f"{c}_na")]


class BoostedTrees:
    """Gradient-boosted trees on one set of columns (ML1).

    Categories are ordinal codes with one extra code for unseen values. The number of rounds is the
    one with the lowest log loss on the last 90 days of training, then the model is refit on every
    row. Too few rows for that split: the full number of rounds.
    """

    def __init__(self, categories: list[str], numeric: list[str], max_iter: int = 300, depth: int = 4, seed: int = 0, val_days: int = 90):
        self.categories, self.numeric = list(categories), list(numeric)
        self.max_iter, self.depth, self.seed, self.val_days = max_iter, depth, seed, val_days
        self.rounds = None

    def _index(self, rows: DataFrame):
        """Codes of the categories, by their number of rows, and the vector of all columns."""
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import StringIndexer, VectorAssembler
        index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in self.categories]
        cols = [f"{c}_i" for c in self.categories] + [x for c in self.numeric for x in (f"{c}_v", f"{c}_na")]
        return Pipeline(stages=[*index, VectorAssembler(inputCols=cols, outputCol="features")]).fit(rows)

    def _trees(self, iters: int, weight: str):
        from pyspark.ml.classification import GBTClassifier
        return GBTClassifier(labelCol="label", featuresCol="features", weightCol=weight, maxIter=iters, maxDepth=self.depth, stepSize=0.08, seed=self.seed, maxBins=256)

    def _prepare(self, rows: DataFrame) -> DataFrame:
        return _with_missing(rows.fillna("NA", self.categories or None), self.numeric, {})[0]

    def fit(self, rows: DataFrame, y: str = "major", min_fit: int = 1000, min_val: int = 300) -> "BoostedTrees":
        from pyspark.ml import PipelineModel
        c = F.col
        data = self._prepare(rows).withColumn("label", c(y).cast("double"))
        last = data.agg(F.date_sub(F.max("day"), self.val_days).alias("cut")).first()["cut"]
        # A pass over the rows is made for each level of each tree: rows that are alike are one row with their number as weight.
        alike = [*self.categories, *[x for n in self.numeric for x in (f"{n}_v", f"{n}_na")], "label"]
        whole = stored(data.groupBy(*alike).agg(F.count_if(c("day") <= last).cast("double").alias("_early"), F.count_if(c("day") > last).cast("double").alias("_late"),
                                                F.count("*").cast("double").alias("_all")), "packed")
        sizes = whole.agg(F.sum("_early").alias("f"), F.sum("_late").alias("v"), F.count("*").alias("n")).first()
        # A round is some eight stages, whose tasks take longer to start than to do their work: no more of them than the rows are worth.
        packed = whole.coalesce(max(1, -(-sizes.n // TREE_ROWS))).persist()
        spark = rows.sparkSession
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_folder(spark))       # else each round's lineage holds all earlier ones
        self.rounds = self.max_iter
        if (sizes.f or 0) >= min_fit and (sizes.v or 0) >= min_val:
            index = self._index(data.where(c("day") <= last))
            first = self._trees(self.max_iter, "_early").fit(index.transform(packed.where("_early > 0")))
            val = index.transform(packed.where("_late > 0").drop("_early").withColumnRenamed("_late", "_early"))
            losses = list(first.evaluateEachIteration(val))
            self.rounds = losses.index(min(losses)) + 1
        index = self._index(data)
        self.model = PipelineModel([*index.stages, self._trees(self.rounds, "_all").fit(index.transform(packed))])
        packed.unpersist()
        discard(whole)
        return self

    def predict(self, rows: DataFrame, name: str = "p") -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        out = self.model.transform(self._prepare(rows))
        return out.withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def fit_logistic(frame: DataFrame, numeric=NUMERIC, y: str = "y", weight: str = "weight", c: float = 0.5):
    """Median imputation with missing indicators, standardized, ridge penalty 1 / (C * sum of weights) (ML5)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    data, names = _numeric(frame, numeric, y)
    total = data.agg(F.sum(weight)).first()[0]
    stages = [Imputer(strategy="median", inputCols=[f"{n}_d" for n in numeric], outputCols=[f"{n}_m" for n in numeric]),
              VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
              LogisticRegression(labelCol="label", weightCol=weight, regParam=1.0 / (c * total), standardization=False, maxIter=200)]
    return Pipeline(stages=stages).fit(data)


def _numeric(frame: DataFrame, numeric, y: str | None) -> tuple[DataFrame, list[str]]:
    cols = {f"{n}_d": F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in numeric}
    cols |= {f"{n}_na": F.col(n).isNull().cast("double") for n in numeric}
    data = frame.withColumns(cols)
    data = data.withColumn("label", F.col(y).cast("double")) if y else data
    return data, [f"{n}_m" for n in numeric] + [f"{n}_na" for n in numeric]


# Which way a feature of the comparators may move the odds, where it may move them one way only.
FALLING, RISING = ("avg_score", "last_score"), ("routines_major", "majors", "health_closures", "reinspections", "grp")


def monotone_signs(names) -> tuple[int, ...]:
    """1 for a feature that may only raise the odds (findings and themes), -1 for one that may only lower them (scores), else 0."""
    return tuple(-1 if n in FALLING else 1 if n in RISING or n.startswith("th_") else 0 for n in names)


def fit_trees(frame: DataFrame, names, additive: tuple[bool, ...] = (False, True), y: str = "y", weight: str = "weight", rounds: int = 200,
              each: Column | None = None, reps: int = 1) -> list[boost.Boosted]:
    """The boosted and the additive comparator (ML6), monotone, missing values as they are; for each weighting in turn, all in the same passes."""
    packs = newton.packed_vectors(frame, list(names), y, weight, None, reps, each)
    rule = boost.Growth(rounds=rounds, monotone=monotone_signs(names))
    return boost.fit(packs, list(names), [(r, replace(rule, additive=a)) for r in range(reps) for a in additive])


def predict(model, frame: DataFrame, numeric=NUMERIC, name: str = "p") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(_numeric(frame, numeric, None)[0]).withColumn(name, vector_to_array("probability")[1]).select(*frame.columns, name)


def monotone_breaks(scored: DataFrame, feature: str, p: str = "p", bins: int = 10) -> DataFrame:
    """Mean prediction by value of a feature, with the steps that fall."""
    from pyspark.sql import Window as W
    g = scored.where(F.col(feature).isNotNull()).groupBy(F.round(feature).cast("int").alias("value")).agg(F.avg(p).alias("mean_p"), F.count("*").alias("n"))
    # One row per whole value of a count feature.
    return g.withColumn("falls", F.col("mean_p") < F.lag("mean_p").over(W.orderBy("value")))


def recalibration(scored: DataFrame, p: str = "p", y: str = "y", steps: int = 30) -> tuple[float, float]:
    """Slope and intercept of the labels on the log odds (ML11), by Newton steps over distinct log odds."""
    packs = newton.packed_vectors(scored.select(log_odds(F.col(p)).alias("z"), y, F.lit(1.0).alias("weight")), ["z"], y)
    at = np.zeros((1, 2))
    for _ in range(steps):
        _, gradient, hessian = newton.sums_over(packs, 1, 1, np.zeros(1, int), at)
        step = np.linalg.lstsq(hessian[0], gradient[0], rcond=None)[0]
        at = at - step
        if np.abs(step).max() < 1e-12:
            break
    return float(at[0, 1]), float(at[0, 0])


def point_tries(names: list[str], unit: list[float], multipliers: int = 320, rules: Rules = RULES) -> list[list[int]]:
    """Whole points by feature, one list for each multiplier that gives new and admissible ones."""
    tries = []
    for j in range(multipliers):
        k = 0.5 * (400 / 0.5) ** (j / (multipliers - 1))
        pts = [int(round(u * k)) for u in unit]
        deficits = [p for f, p, u in zip(names, pts, unit) if f in ("avg_deficit", "last_deficit") and u > 0]
        if max(pts) in range(1, rules.max_weight + 1) and (not deficits or max(deficits) >= 1) and pts not in tries:
            tries.append(pts)
    return tries


def fit_counts(vectors: newton.Vectors, rules: Rules = RULES, path: int = 40, multipliers: int = 320) -> list[dict[str, int]]:
    """The count score (ML7) of every weighting: whole points per unit for at most ``max_features`` features.

    A non-negative lasso path on standardized features picks the features, an unpenalized refit weighs them, and the multiplier that keeps the most
    likelihood rounds the weights. All weightings go together, in a few tens of passes.
    """
    chosen = newton.sparse_paths(vectors, rules.max_features, path)
    units = newton.refits(vectors, chosen)
    tries = [(r, p) for r in range(vectors.reps) if chosen[r] for p in point_tries(vectors.names, units[r].tolist(), multipliers, rules)]
    likelihood = newton.points_likelihood(vectors, tries)
    out: list[dict[str, int]] = [{} for _ in range(vectors.reps)]
    best = [float("-inf")] * vectors.reps
    for (r, pts), ll in zip(tries, likelihood):
        if ll > best[r] + 1e-9:
            best[r] = ll
            out[r] = {f: p for f, p in sorted(zip(vectors.names, pts), key=lambda x: -x[1]) if p > 0}
    return out


def fit_count(frame: DataFrame, features=COUNT_FEATURES, y: str = "y", weight: str = "weight", rules: Rules = RULES, path: int = 40, multipliers: int = 320) -> dict[str, int]:
    """The count score of the rows as they are; nothing if only one class is there."""
    return fit_counts(newton.Vectors.of(frame, list(features), y, weight), rules, path, multipliers)[0]


def select_rule(metrics: DataFrame, publishable=("average score", "count score"), epsilon: float = RULES.epsilon) -> DataFrame:
    """The sparsest publishable rule within ``epsilon`` of the best model at every origin; else of the
    best publishable one; else the most accurate on average (ML13).

    ``metrics``: ``origin, model, auc``, a few rows. ``publishable`` is sparsest first.
    """
    c = F.col
    pub = c("model").isin(*publishable)
    best = metrics.groupBy("origin").agg(F.max("auc").alias("_any"), F.max(F.when(pub, c("auc"))).alias("_pub"))
    m = metrics.where(pub).join(best, "origin").groupBy("model").agg(
        F.bool_and(F.coalesce(c("auc") >= c("_any") - epsilon, F.lit(False))).alias("near_any"),
        F.bool_and(F.coalesce(c("auc") >= c("_pub") - epsilon, F.lit(False))).alias("near_pub"), F.avg("auc").alias("mean_auc"))
    sparse = F.array_position(F.array(*[F.lit(p) for p in publishable]), c("model"))
    tier = F.when(c("near_any"), 1).when(c("near_pub"), 2).otherwise(3)
    key = F.struct(tier, F.when(tier < 3, sparse.cast("double")).otherwise(-c("mean_auc")))
    return m.agg(F.min_by("model", key).alias("chosen"), F.min(tier).alias("tier")).select("chosen", (c("tier") == 1).alias("within_epsilon"), "tier")


def permutation_importance(model, rows: DataFrame, columns: list[str], y: str = "y", repeats: int = 5, share: float = 1.0, seed: int = 0) -> DataFrame:
    """Mean drop in AUC when a column is shuffled (BS12): ``feature, auc_drop``.

    A repeat is one order of the rows by hash; the row at a place of that order lends its values to the row at the same place of the order by id. One numbering
    and one join serve all columns and repeats, every shuffled row is scored in one pass, and one aggregate gives all AUCs. No row set is gathered.
    """
    from ..session import cut
    from .joins import with_scalars
    from .ordering import positions
    from .ranking import auc
    c = F.col
    base = cut(rows.sample(share, seed) if share < 1 else rows)
    full = auc(model.predict(base).select(c("p").alias("score"), y), y=y).select(c("auc").alias("_full"))
    numbered = positions(base, [], [c("record_id")], "_i")
    every = base.select("record_id", F.struct(*columns).alias("_m"), F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat"))
    hashed = every.withColumn("_h", F.xxhash64("record_id", F.lit(seed * 1000) + c("repeat")))
    lent = positions(hashed, ["repeat"], [c("_h"), c("record_id")], "_i").select("_i", "repeat", "_m")
    wide = cut(numbered.join(lent, "_i"))
    mixed = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), *[(c("_m")[n] if n == x else c(n)).alias(n) for n in columns]) for x in columns])).alias("_x")
    others = [n for n in base.columns if n not in columns]
    shuffled = wide.select(*others, "repeat", mixed).select(*others, "repeat", "_x.*")
    scored = model.predict(shuffled).select("feature", "repeat", c("p").alias("score"), y)
    drops = auc(scored, ["feature", "repeat"], y=y).groupBy("feature").agg(F.avg("auc").alias("_mean"))
    return with_scalars(drops, full).select("feature", (c("_full") - c("_mean")).alias("auc_drop"))


def stability(train: DataFrame, now: DataFrame, reps: int = 30, features=COUNT_FEATURES, seed: int = 0, rules: Rules = RULES,
              path: int = 40, multipliers: int = 320) -> DataFrame:
    """How often each place keeps its band (``band_now``) when the count score is refit on resampled places (ML14).

    All refits are one batch of weightings. Bands are cut again, in each refit, at the shares of the eligible list that today's bands hold.
    """
    from ..session import cut
    from .resample import weights
    c = F.col
    drawn = weights(train, "business_id", reps, seed).groupBy("business_id").agg(F.map_from_entries(F.collect_list(F.struct("rep", "times"))).alias("_of"))
    often = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.coalesce(F.try_element_at("_of", r.cast("int")), F.lit(0)))
    fits = fit_counts(newton.Vectors.of(train.join(drawn, "business_id").withColumn("_times", often), list(features), times=c("_times"), reps=reps), rules, path, multipliers)
    ordered = now.where("eligible").groupBy("band_now").agg(F.count("*").alias("n")).collect()     # a row per band
    size = sum(r["n"] for r in ordered)
    held = sorted((int(r["band_now"]), r["n"]) for r in ordered if r["band_now"] is not None)
    shares = [sum(n for b, n in held if b <= k) / size for k, _ in held]
    points = F.array(*[sum((F.lit(float(w)) * c(f) for f, w in fit.items()), F.lit(0.0)) for fit in fits])
    each = cut(now.select("business_id", "eligible", "band_now", F.posexplode(points).alias("rep", "points")))
    # A row per refit and whole number of points: a short table.
    hist = each.where("eligible").groupBy("rep", "points").agg(F.count("*").alias("_n"))
    down, whole = W.partitionBy("rep").orderBy(c("points").desc()), W.partitionBy("rep")
    hist = hist.withColumns({"_cum": F.sum("_n").over(down), "_all": F.sum("_n").over(whole)})
    cuts = hist.groupBy("rep").agg(falling_cuts([nearest_cut(s) for s in shares]).alias("cuts"))
    band = F.when(c("eligible"), band_of(c("points"), c("cuts")))
    return each.join(cuts, "rep", "left").groupBy("business_id").agg(F.avg(band.eqNullSafe(c("band_now")).cast("double")).alias("kept"))
