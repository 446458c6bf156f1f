"""Quality classifier by positive-unlabelled learning.

Inputs are shapes of the text, not its words: shares of neighbouring character classes and how tokens repeat. They do
not depend on the language. Trusted positives are rows labelled good; the unlabelled side is any text.

Cases: a null text counts as empty. An empty text has all shares zero and gets whatever score the model gives that row.
Repeated rows score alike. Without positive labels every row scores the prior. Extra columns pass through ``score``
untouched; names that clash with its outputs are the caller's to rename (``score_table`` reads only the id and the text).
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_remainder, lowest_part
from .pu import Linear, fit_nnpu, prior_from_labels

LOWER, UPPER, LETTER, DIGIT, SPACE, LINE, STOP, SYMBOL = range(8)
N_FEATURES = 64 + 8
MAX_POSITIVE, MAX_UNLABELLED = 6000, 12000      # bounds of the fitting sample, in rows


def _class_table() -> np.ndarray:
    """Character class by code point; those beyond the first plane are letters."""
    out = np.full(65536, SYMBOL, np.uint8)
    for c in range(65536):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LM":
            out[c] = {"Ll": LOWER, "Lu": UPPER}.get(kind, LETTER)
        elif kind[0] == "N":
            out[c] = DIGIT
        elif kind[0] == "Z":
            out[c] = SPACE
    for c in "\t\v\f\r":
        out[ord(c)] = SPACE
    out[ord("\n")] = LINE
    for c in ".,;:!?'\"()-":
        out[ord(c)] = STOP
    return out


CLASSES = _class_table()


def features(text: str | None) -> np.ndarray:
    text = text or ""
    out = np.zeros(N_FEATURES)
    tokens = text.split()
    if tokens:
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        kind = np.where(code < 65536, CLASSES[np.minimum(code, 65535)], LETTER).astype(np.int64)
        pairs = np.bincount(kind[:-1] * 8 + kind[1:], minlength=64)
        out[:64] = np.sqrt(pairs / max(1, len(kind) - 1))
        n = len(tokens)
        again = sum(map(eq, tokens, tokens[1:]))
        once = len(set(tokens))
        lines = [x for x in text.split("\n") if x.strip()]
        out[64:] = (np.log1p(n), once / n, once / np.sqrt(n), np.sqrt(again / n), np.log1p(again), len(text) / n,
                    1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))))
    return out


def matrix(texts: pd.Series) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))


def _expand(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each input and its hinges at the knots, so that a linear model can bend."""
    return np.concatenate([x, *[np.maximum(x - k, 0) for k in knots]], axis=1)


def sampled_texts(docs: DataFrame, ids: DataFrame, seed: str, rows: int) -> pd.Series:
    """Texts of at most ``rows`` ids, the first in a seeded order. ``ids`` has the one column ``doc_id``."""
    known = ids.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    first = known.where(lowest_part(F.col("h"), rows, known.count())).distinct().orderBy("h", "doc_id").limit(rows)
    # At most ``rows`` ids of eight bytes: the bound is the parameter above.
    few = docs.sparkSession.createDataFrame([(r[0],) for r in first.collect()], "few_id long")
    return docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("few_id"))


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, max_positive: int = MAX_POSITIVE,
        max_unlabelled: int = MAX_UNLABELLED) -> tuple[Linear, np.ndarray]:
    """Fit on a bounded, seeded sample outside the held-out remainder; features are made on the executors."""
    open_labels = labels.select("doc_id", "quality").where((id_remainder(F.col("doc_id"), fold) != held) & F.col("quality").isNotNull())
    n = open_labels.agg(F.count("*"), F.sum(F.col("quality").cast("long"))).first()
    open_docs = docs.select("doc_id").where(id_remainder(F.col("doc_id"), fold) != held)

    def sample(ids: DataFrame, seed: str, rows: int) -> np.ndarray:
        made = sampled_texts(docs, ids, seed, rows).select("text").mapInPandas(_packed, "x binary").toPandas()
        return np.stack([np.frombuffer(v) for v in made["x"]]) if len(made) else np.zeros((0, N_FEATURES))

    pos = sample(open_labels.where("quality = 1"), "quality-positive", max_positive)
    unl = sample(open_docs, "quality-unlabelled", max_unlabelled)
    knots = np.quantile(unl, [0.1, 0.25, 0.5, 0.75, 0.9, 0.97], axis=0) if len(unl) else np.zeros((6, N_FEATURES))
    return fit_nnpu(_expand(pos, knots), _expand(unl, knots), prior_from_labels(n[1] or 0, n[0] or 0), steps=600), knots


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"x": [features(t).tobytes() for t in b["text"]]})


def scorer(model: tuple[Linear, np.ndarray]):
    """A vectorised function of the text: P(good)."""
    linear, knots = model

    @F.pandas_udf("double")
    def quality_score(texts: pd.Series) -> pd.Series:
        return pd.Series(linear.score(_expand(matrix(texts), knots)), dtype="float64")
    return quality_score


def score_table(docs: DataFrame, model: tuple[Linear, np.ndarray], cut: float = 0.3, fold: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    return _decided(docs.select("doc_id", scorer(model)(F.col("text")).alias("score")), cut, fold, held)


def _decided(scored: DataFrame, cut: float, fold: int, held: int) -> DataFrame:
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: tuple[Linear, np.ndarray], cut: float = 0.3) -> DataFrame:
    """The rows that score at least ``cut``, with the columns they came with."""
    good: Column = scorer(model)(docs["text"]) >= cut
    return docs.where(good)
