"""Toxicity classifier by non-negative positive-unlabelled learning over words and word beginnings.

Words and their first 4, 5 and 6 letters are hashed into a fixed space. On the fitting sample the entries that are
clearly commoner in confirmed toxic texts than in unlabelled ones are kept; the model is linear in the logarithm of
their counts.

Cases: a null text counts as empty. A text without any kept entry, the empty one included, scores the base value of the
model. Repeated rows score alike. Without toxic labels every row scores the prior. Only the id and the text are read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import id_remainder
from .pu import Linear, fit_nnpu, prior_from_labels
from .quality import sampled_texts, _decided

WORD = re.compile(r"\w+")
SPACE = 1 << 22
MAX_POSITIVE, MAX_UNLABELLED, MAX_ENTRIES = 5000, 10000, 1024
MIN_ROWS, MIN_Z = 5, 5.0     # toxic sample rows that hold a kept entry, and its lead in standard errors
MIN_PRECISION = 0.5         # a kept entry is toxic at least this often, by the prior and the two samples


def entries(word: str) -> list[int]:
    """Hashed entries of one word: itself and its beginnings."""
    parts = [word] + [word[:k] + "*" for k in (4, 5, 6) if len(word) > k]
    return [crc32(p.encode("utf-8", "replace")) % SPACE for p in parts]


def counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for e in entries(word):
            out[e] += n
    return out


@dataclass(frozen=True)
class Model:
    column: dict[int, int]      # hashed entry -> input of the linear model
    linear: Linear


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [counts(t) for t in b["text"]]
        yield pd.DataFrame({"e": [np.fromiter(c.keys(), np.int32, len(c)).tobytes() for c in got],
                            "n": [np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in got]})


def fit(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, max_positive: int = MAX_POSITIVE,
        max_unlabelled: int = MAX_UNLABELLED, max_entries: int = MAX_ENTRIES) -> Model:
    """Fit on a bounded, seeded sample of rows outside the held-out remainder."""
    open_labels = labels.select("doc_id", "toxic").where((id_remainder(F.col("doc_id"), fold) != held) & F.col("toxic").isNotNull())
    n = open_labels.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    open_docs = docs.select("doc_id").where(id_remainder(F.col("doc_id"), fold) != held)

    def sample(ids: DataFrame, seed: str, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
        made = sampled_texts(docs, ids, seed, rows).select("text").mapInPandas(_packed, "e binary, n binary").toPandas()
        made = made.drop_duplicates()       # copies of one text would make its rare words look telling
        return [(np.frombuffer(e, np.int32), np.frombuffer(c, np.int32)) for e, c in zip(made["e"], made["n"])]

    pos = sample(open_labels.where("toxic = 1"), "toxic-positive", max_positive)
    unl = sample(open_docs, "toxic-unlabelled", max_unlabelled)
    return fit_rows(pos, unl, prior_from_labels(n[1] or 0, n[0] or 0), max_entries)


def fit_rows(pos: list, unl: list, prior: float, max_entries: int = MAX_ENTRIES) -> Model:
    seen_p, seen_u = np.zeros(SPACE), np.zeros(SPACE)
    for e, _ in pos:
        seen_p[e] += 1
    for e, _ in unl:
        seen_u[e] += 1
    a, b = max(1, len(pos)), max(1, len(unl))
    rate = (seen_p + seen_u) / (a + b)
    z = (seen_p / a - seen_u / b) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / a + 1 / b))
    # By Bayes' rule prior * (share in P) / (share in U) is the estimated P(toxic | entry).
    z[(seen_p < MIN_ROWS) | (prior * seen_p / a < MIN_PRECISION * seen_u / b)] = 0
    best = np.argsort(-z, kind="stable")[:max_entries]
    best = best[z[best] > MIN_Z]
    column = {int(e): i for i, e in enumerate(best)}
    where = np.full(SPACE, -1, np.int32)
    where[best] = np.arange(len(best))

    def dense(rows: list) -> np.ndarray:
        x = np.zeros((len(rows), len(best)), np.float32)
        for i, (e, c) in enumerate(rows):
            at = where[e]
            x[i, at[at >= 0]] = np.log1p(c[at >= 0])
        return x
    linear = fit_nnpu(dense(pos), dense(unl), prior, steps=300, l2=3e-4, standardise=False)
    return Model(column, linear)


def scorer(model: Model):
    column, linear = model.column, model.linear

    @F.pandas_udf("double")
    def toxic_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, base = linear.weight / linear.scale, linear.bias - float((linear.mean / linear.scale) @ linear.weight)
        known: dict[str, list[int]] = {}                        # word -> inputs it feeds, for this task
        for texts in batches:
            out = []
            for text in texts:
                got: dict[int, int] = {}
                for word in WORD.findall((text or "").lower()):
                    cols = known.get(word)
                    if cols is None:
                        if len(known) > 500_000:
                            known.clear()
                        cols = known[word] = [column[e] for e in entries(word) if e in column]
                    for c in cols:
                        got[c] = got.get(c, 0) + 1
                z = base + sum(weight[c] * np.log1p(n) for c, n in got.items())
                out.append(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))
            yield pd.Series(out, dtype="float64")
    return toxic_score


def score_table(docs: DataFrame, model: Model, cut: float = 0.3, fold: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    return _decided(docs.select("doc_id", scorer(model)(F.col("text")).alias("score")), cut, fold, held)
