"""N-gram Jaccard join by chosen paths.

Documents become sets of five-word shingles; equal sets are one class member from the start. Each set is embedded as ``COORDINATES``
minhash values, so that two sets agree on a coordinate with probability equal to their Jaccard similarity. In each of many
independent runs the sets are split on a sampled coordinate: sets that have the same value there share a bucket. A bucket of more than ``small``
members is split again on a coordinate sampled for its own path, to ``depth`` levels. What is left is compared by brute force on the minhash vectors,
in square blocks where a bucket is still large, with a bar low enough that a pair at the threshold fails it less than once in a million. Sets
that pass are joined into candidate groups. A few runs come first; in the others a bucket whose members are all of one candidate group
already has nothing to add and is dropped, so a large group of near copies is not compared again in every run.

Links are then counted exactly: within each candidate group, all pairs of true shingle sets are compared in square blocks of
``block`` members. Pairs never leave a task; a set's link counts and a spanning tree of its links do. Classes are the connected components of the links.

Recall: a run that splits a pair's buckets k times keeps a pair of similarity s together with probability s ** k. At the threshold that is 0.8 in
buckets that are small at once and 0.51 in the most crowded; twenty runs all part such a pair once in 10**14 and once in 10**6 times.

Cases: words are ``\\w+`` of the lower-cased text; one to four words make one shingle; a text without words has no set, is its own
class and has no links. A null text counts as empty. Rows that repeat an id are rows of their own, with links to one another.
A null id has a null class only if its whole class has. An empty table gives an empty result. Only the id and the text are read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import discard, release, stored
from .common import parted, segments, together

WORD = re.compile(r"\w+")
WORDS, THRESHOLD = 5, 0.8
COORDINATES, SMALL, DEPTH, RUNS, BLOCK = 64, 64, 3, (3, 17), 1024
LEAST_AGREE = 35            # of 64: a pair at 0.8 agrees on 51 on average, and on fewer than 35 once in a million
SEED = 20240229


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


MULTIPLY = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)
ADD = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) + np.uint64(SEED))


def shingles(text: str | None, known: dict[str, int], n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text. ``known`` caches word hashes."""
    ids = []
    for w in WORD.findall((text or "").lower()):
        h = known.get(w)
        if h is None:
            if len(known) > 400_000:
                known.clear()
            h = known[w] = int.from_bytes(blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        ids.append(h)
    if not ids:
        return np.zeros(0, np.uint64)
    a = np.array(ids, np.uint64)
    width = min(n, len(a))
    with np.errstate(over="ignore"):
        h = np.full(len(a) - width + 1, width, np.uint64)
        for k in range(width):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + a[k:len(a) - width + 1 + k])
    return np.unique(h)


def minhashes(s: np.ndarray) -> np.ndarray:
    """The embedding of a non-empty set: ``COORDINATES`` 32-bit minima."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            h = s[at:at + 4096, None] * MULTIPLY + ADD
            out = np.minimum(out, (h ^ (h >> np.uint64(29))).min(0))
    return (_mix(out) >> np.uint64(32)).astype(np.uint32)


def _set_key(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for b in batches:
        keys, vectors = [], []
        for text in b["text"]:
            s = shingles(text, known)
            keys.append(_set_key(s) if len(s) else None)
            vectors.append(minhashes(s).tobytes() if len(s) else None)
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"], "set_key": keys, "vector": vectors})


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, set_key, vector`` for every row; key and vector are null where there are no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInPandas(_described, "doc_id long, text_key long, set_key binary, vector binary")


def sets_of(rows: DataFrame) -> DataFrame:
    """One row per distinct set: how many rows have it, where its text can be read again, and its vector."""
    return rows.where("set_key is not null").groupBy("set_key").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("vector").alias("vector"))


def _step(paths: np.ndarray, coordinate: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The paths that go on from ``paths`` by the given values of the given coordinates."""
    with np.errstate(over="ignore"):
        token = values.astype(np.uint64) | (coordinate.astype(np.uint64) << np.uint64(32))
        return _mix(paths * np.uint64(0x9E3779B97F4A7C15) + _mix(token))


def _vectors(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, COORDINATES) if len(column) else np.zeros((0, COORDINATES), np.uint32)


def first_level(sets: DataFrame, runs: range) -> DataFrame:
    """``path, set_key, grp``: the buckets of the given runs after one split. Runs take the coordinates in a seeded order, each once before any again."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.argsort(_mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(SEED)))
        for b in batches:
            v = _vectors(b["vector"])
            for r in runs:
                k = order[r % COORDINATES]
                path = _step(np.full(len(v), r + 1, np.uint64), np.full(len(v), k), v[:, k])
                yield pd.DataFrame({"path": path.view(np.int64), "set_key": b["set_key"], "grp": b["grp"]})
    return sets.select("set_key", "vector", "grp").mapInPandas(split, "path long, set_key binary, grp long")


def next_level(members: DataFrame) -> DataFrame:
    """The members of large buckets (``path, set_key, vector, grp``) in their next buckets: each path samples one coordinate."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths, v = b["path"].to_numpy(np.int64).view(np.uint64), _vectors(b["vector"])
            k = (_mix(paths + np.uint64(SEED)) % np.uint64(COORDINATES)).astype(np.int64)
            yield pd.DataFrame({"path": _step(paths, k, v[np.arange(len(v)), k]).view(np.int64), "set_key": b["set_key"], "grp": b["grp"]})
    return members.mapInPandas(split, "path long, set_key binary, grp long")


def mixed_buckets(members: DataFrame) -> DataFrame:
    """Members (``path, set_key, grp``) of buckets that hold more than one ``grp``, with the bucket's ``size``."""
    sizes = members.groupBy(F.col("path").alias("_path")).agg(F.count("*").alias("size"), F.min("grp").alias("_low"), F.max("grp").alias("_high"))
    return members.join(sizes.where("_low <> _high").select("_path", "size"), F.col("path") == F.col("_path")).drop("_path")


def in_blocks(members: DataFrame, group: str, key: str, block: int) -> DataFrame:
    """Each member once for each block pair of its group that it takes part in: ``lo``, ``hi`` and its own ``mine``."""
    parts = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64(key), parts).cast("int")
    other = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return other.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _joined(rows: np.ndarray, cols: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the given pairs as (member, root)."""
    forest = Forest(n)
    for a, b in zip(rows.tolist(), cols.tolist()):
        forest.join(a, b)
    return [(i, forest.find(i)) for i in range(n) if forest.find(i) != i]


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate edges of each bucket or block pair, by agreeing coordinates.

    A bucket, or a block with itself, gives a spanning forest. Two blocks give only what joins pieces that their own forests leave apart.
    """
    for bucket in segments(batches, ["path", "lo", "hi"]):
        v, keys, n, mine = _vectors(bucket["vector"]), bucket["set_key"].to_numpy(), len(bucket), bucket["mine"].to_numpy()
        rows, cols = [], []
        for i in range(n - 1):
            near = np.flatnonzero((v[i + 1:] == v[i]).sum(1) >= LEAST_AGREE)
            if len(near):
                rows.append(np.full(len(near), i))
                cols.append(near + i + 1)
        if rows:
            i, j = np.concatenate(rows), np.concatenate(cols)
            if bucket["lo"].iloc[0] == bucket["hi"].iloc[0]:
                edges = _joined(i, j, n)
            else:
                forest, within = Forest(n), mine[i] == mine[j]
                for a, b in zip(i[within].tolist(), j[within].tolist()):
                    forest.join(a, b)
                edges = [(a, b) for a, b in zip(i[~within].tolist(), j[~within].tolist()) if forest.join(a, b)]
            yield pd.DataFrame({"a": [keys[a] for a, _ in edges], "b": [keys[b] for _, b in edges]}, dtype=object)


def candidate_edges(sets: DataFrame, runs: range, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """``a, b``: sets that met in a bucket and agree on enough coordinates, as a spanning forest of each bucket.

    ``sets`` has ``set_key, vector, grp``, the group a set is known to be in or a number of its own.
    """
    vectors = sets.select(F.col("set_key").alias("_set_key"), "vector")
    level, out = stored(first_level(sets, runs), "paths"), []
    for at in range(1, depth + 1):
        # Vectors join only what is left of the buckets.
        mixed = mixed_buckets(level).join(vectors, F.col("set_key") == F.col("_set_key")).drop("_set_key")
        sized = stored(mixed, "buckets")
        discard(level)
        leaves = sized if at == depth else sized.where(F.col("size") <= small)
        found = together(in_blocks(leaves, "path", "set_key", BLOCK).select("path", "lo", "hi", "mine", "set_key", "vector"), "path", "lo", "hi").mapInPandas(
            _alike, "a binary, b binary")
        out.append(stored(found.distinct(), "met"))
        level = stored(next_level(sized.where(F.col("size") > small).select("path", "set_key", "vector", "grp")), "paths") if at < depth else None
        discard(sized)
        del mixed, found, leaves, sized
        release(sets.sparkSession)
    edges = stored(reduce(DataFrame.unionByName, out).distinct(), "met")
    discard(*out)
    return edges


def candidate_groups(sets: DataFrame, runs: tuple[int, ...] = RUNS, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """``node, root`` of every set that has a candidate, after all rounds of runs."""
    groups, done = None, 0
    for n in runs:
        now, done = range(done, done + n), done + n
        if groups is None:
            known = sets.select("set_key", "vector", F.xxhash64("set_key").alias("grp"))
            edges = candidate_edges(known, now, small, depth)
            groups = components(edges)
            discard(edges)
        else:
            known = sets.select("set_key", "vector").join(groups, F.col("set_key") == F.col("node"), "left").select(
                "set_key", "vector", F.xxhash64(F.coalesce("root", "set_key")).alias("grp"))
            known = stored(known, "sets")
            edges, before = candidate_edges(known, now, small, depth), groups
            groups = components(edges.unionByName(before.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
            discard(known, edges, before)
        release(sets.sparkSession)
    return groups


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges: the least node it is connected to.

    In each round every node points at its least neighbour, or at itself if it is less than all of them; pointers are followed to their ends,
    and edges are drawn again between the ends, of which there are at most half as many. Edges are met twice in a round, nodes a few times.
    """
    left = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    out = None
    while True:
        ends = left.select(F.col("a").alias("n"), F.col("b").alias("m")).union(left.select("b", "a"))
        step = stored(ends.groupBy("n").agg(F.min("m").alias("m")).select(F.col("n").alias("node"), F.least("n", "m").alias("root")), "roots")
        while True:
            on, before = step.select(F.col("node").alias("_n"), F.col("root").alias("_r")), step
            step = stored(step.select("node", "root").join(on, F.col("root") == F.col("_n")).select(
                "node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")), "roots")
            discard(before)
            if step.where("moved").limit(1).count() == 0:
                break
        on = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        before, edges = out, left
        out = stored(step.select("node", "root") if out is None else
                     out.join(on, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "groups")
        for side, other in (("a", "b"), ("b", "a")):
            left = left.join(on, F.col(side) == F.col("_n")).select(F.col("_r").alias(side), other)
        left = stored(left.select("a", "b").where("a <> b").distinct(), "edges")
        discard(before, edges, step)
        if left.limit(1).count() == 0:
            discard(left)
            return out


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the ``left`` with the ``right`` sets."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    # Only shingles that at least two sets have can be shared; they are taken a few thousand at a time.
    term = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    often = np.bincount(term)[term] > 1
    term, owner = term[often], owner[often]
    if len(term):
        term = np.unique(term, return_inverse=True)[1]
        cuts = np.searchsorted(term, np.arange(0, term[-1] + 4097, 4096))
        for a, b in zip(cuts[:-1], cuts[1:]):
            m = np.zeros((len(sets), int(term[b - 1] - term[a]) + 1), np.float32)
            m[owner[a:b], term[a:b] - term[a]] = 1
            out += m[left] @ m[right].T
    return out.astype(np.int64)


def _linked(threshold: float, words: int):
    """Exact comparison of each block pair of the candidate groups."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for group in segments(batches, ["grp", "lo", "hi"]):
            group = group.drop_duplicates("set_key")        # rows that repeat an id and a text were read once each
            sets = [shingles(t, known, words) for t in group["text"]]
            sizes, n = np.array([len(s) for s in sets], np.int64), len(sets)
            mine, copies, keys = group["mine"].to_numpy(), group["n"].to_numpy(np.int64), group["set_key"].to_numpy()
            lo, hi = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
            left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
            both = _shared(sets, left, right)
            alike = both / (sizes[left][:, None] + sizes[right][None, :] - both) >= threshold
            links, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if lo == hi:
                np.fill_diagonal(alike, False)
            else:
                links[right] += alike.sum(0)
                rows[right] += copies[left] @ alike
            links[left] += alike.sum(1)
            rows[left] += alike @ copies[right]
            i, j = np.nonzero(alike)
            up = np.arange(n)
            for a, r in _joined(left[i], right[j], n):
                up[a] = r
            there = links > 0
            yield pd.DataFrame({"set_key": keys[there], "root": keys[up[there]], "links": links[there], "rows": rows[there]})
    return run


def linked(docs: DataFrame, sets: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """``set_key, root, links, rows``: partial exact link counts of every set in a candidate group, from its block pairs."""
    sizes = groups.groupBy(F.col("root").alias("grp")).agg(F.count("*").alias("size"))
    members = stored(groups.select("node", F.col("root").alias("_root")).join(sizes, F.col("_root") == F.col("grp"))
                     .join(sets.select("set_key", "n", "at"), F.col("node") == F.col("set_key")).select("grp", "size", "set_key", "n", "at"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64("text").alias("_text_key"), "text")
    # Only texts that are compared move.
    texts, _ = parted(texts, F.xxhash64("_doc_id", "_text_key"), members, F.xxhash64("at.doc_id", "at.text_key"))
    read = members.join(texts, F.col("at")["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.col("at")["text_key"] == F.col("_text_key")))
    dealt = in_blocks(read.select("grp", "size", "set_key", "n", "text"), "grp", "set_key", block)
    return together(dealt, "grp", "lo", "hi").mapInPandas(_linked(threshold, words), "set_key binary, root binary, links long, rows long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, runs: tuple[int, ...] = RUNS, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, text_key, class_id, links, set_links``.

    ``class_id`` is the least id of the class, ``links`` the other rows with similarity of at least ``threshold`` (equal sets included), and
    ``set_links`` the different sets among them. ``threshold`` may not be under the one that ``LEAST_AGREE`` is made for.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"threshold {threshold} is under {THRESHOLD}")
    rows = stored(described(docs), "described")
    sets = stored(sets_of(rows), "sets")
    groups = candidate_groups(sets, runs, small, depth)
    found = stored(linked(docs, sets, groups, threshold, WORDS, block), "links")
    discard(groups)
    release(docs.sparkSession)
    counts = found.groupBy("set_key").agg(F.sum("links").alias("links"), F.sum("rows").alias("rows"))
    roots = components(found.where(F.col("set_key") != F.col("root")).select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    known = (sets.select("set_key", "n", "first_id")
             .join(counts.withColumnRenamed("set_key", "_k1"), F.col("set_key") == F.col("_k1"), "left")
             .join(roots, F.col("set_key") == F.col("node"), "left")
             .select("set_key", "first_id", F.coalesce("root", "set_key").alias("class_key"), F.coalesce("links", F.lit(0)).alias("set_links"),
                     (F.coalesce("rows", F.lit(0)) + F.col("n") - 1).alias("links")))
    first = known.groupBy(F.col("class_key").alias("_class")).agg(F.min("first_id").alias("class_id"))
    per_set = known.join(first, F.col("class_key") == F.col("_class")).select(F.col("set_key").alias("_set_key"), "class_id", "links", "set_links")
    joined = rows.select("doc_id", "text_key", "set_key").join(per_set, F.col("set_key") == F.col("_set_key"), "left")
    alone = F.col("set_key").isNull()
    return joined.select("doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                         F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("set_links", F.lit(0)).cast("long").alias("set_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose class has a smaller id. Rows that repeat the smallest id are versions of one document and all stay, whatever
    their texts; a row without an id goes if its class has one."""
    gone = stored(classes(docs, **options).where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(
        F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).distinct(), "gone")
    row = docs["doc_id"].cast("long"), F.xxhash64(docs["text"])
    # Rows that stay for sure do not move.
    some, rest = parted(docs, F.xxhash64(*row), gone, F.xxhash64("_doc_id", "_text_key"))
    return some.join(gone, row[0].eqNullSafe(gone["_doc_id"]) & (row[1] == gone["_text_key"]), "left_anti").union(rest)
