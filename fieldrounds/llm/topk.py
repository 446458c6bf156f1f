"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights (term = position). Candidates are dealt into blocks, queries into groups, and
each (block, group) pair is one unit of work: the block is inverted into postings, every posting of a term scatters
weight * query weight into the rows of a dense score array, and a partition selection takes the k best of each query
in the block. The lists of a query's blocks are then merged. Block and group sizes bound a task's memory whatever the table's size.

Cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. A query's own
id is no candidate of it, however many rows bear it; other repeated rows rank one by one. Ties go to the smaller id. Vectors of
different lengths meet on the positions both have. Sums that leave 64 bits stop at their limits. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK, GROUP, BATCH = 4096, 1024, 64
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, bad)


def _sparse(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of all non-zero entries, by term."""
    n = np.fromiter((len(v) for v in vectors), np.int64, len(vectors))
    flat = np.concatenate([np.asarray(v, np.int64) for v in vectors]) if len(vectors) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    there = flat != 0
    order = np.argsort(term[there], kind="stable")
    return row[there][order], term[there][order], flat[there][order]


def _number(a: np.ndarray, b: np.ndarray, width: int):
    """The narrowest type that holds every partial sum; Python integers where 64 bits may not."""
    top = int(max(np.abs(a.astype(object)).max(initial=0), 1)) * int(max(np.abs(b.astype(object)).max(initial=0), 1)) * max(width, 1)
    return np.int32 if top < 1 << 31 else np.int64 if top < 1 << 63 else object


def block_top(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best rows of one block for each query of one group."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(block):
        block = block.sort_values("vec_id", kind="stable")
        ids, q_ids = block["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
        rows, terms, weights = _sparse(block["v"])
        q_rows, q_terms, q_weights = _sparse(queries["v"])
        width = int(max(terms.max(initial=-1), q_terms.max(initial=-1))) + 1
        kind = _number(weights, q_weights, width)
        edges = np.searchsorted(terms, np.arange(width + 1))
        weights, dense = weights.astype(kind), np.zeros((width, len(q_ids)), kind)
        dense[q_terms, q_rows] = q_weights
        for at in range(0, len(q_ids), BATCH):
            few = dense[:, at:at + BATCH]
            scores = np.zeros((len(ids), few.shape[1]), kind)
            for t in range(width):
                a, b = edges[t], edges[t + 1]
                if b > a and few[t].any():
                    if b - a == len(ids):               # every row has the term: its postings are the rows in order
                        scores += weights[a:b, None] * few[t]
                    else:
                        scores[rows[a:b]] += weights[a:b, None] * few[t]
            for j, own in enumerate(q_ids[at:at + BATCH]):
                s, other = scores[:, j], np.flatnonzero(ids != own)
                s = s[other]
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k] if kind is not object else sorted(s)[-k]
                    at_least = np.flatnonzero(s >= least)
                else:
                    at_least = np.arange(len(s))
                # Rows are in id order, so a stable sort by score leaves ties with the smaller id first.
                best = at_least[np.argsort(-s[at_least], kind="stable")][:k]
                out["query_id"] += [int(own)] * len(best)
                out["vec_id"] += ids[other[best]].tolist()
                out["score"] += [min(max(int(x), LOW), HIGH) for x in s[best]]
    return pd.DataFrame({c: np.array(v, np.int64) for c, v in out.items()})


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (``vec_id, embedding``) where ``is_query`` holds."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), is_query.alias("q"))
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks, groups = max(1, -(-n // block)), max(1, -(-n_queries // group))
    hashed = F.xxhash64("vec_id")
    # Each candidate goes to its block once per group of queries, each query to its group once per block.
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "v", F.pmod(hashed, F.lit(blocks)).cast("int").alias("b"), deal(groups).alias("g"))
    queries = rows.where("q").select("vec_id", "v", F.pmod(hashed, F.lit(groups)).cast("int").alias("g"), deal(blocks).alias("b"))
    run: Callable = lambda q, c: block_top(q, c, k)
    parts = (queries.groupBy("g", "b").cogroup(candidates.groupBy("g", "b"))
             .applyInPandas(run, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
