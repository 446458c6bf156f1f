"""Ranked lexical search: accumulators from short lists as one bounded iterator in a document-at-a-time pass over long lists.

``index`` inverts documents where they are read: consecutive documents of a partition form a block until they hold ``BLOCK`` postings, and a block
becomes one row per term with the places of its documents, in order of their ids, and the term's occurrences there. No text is shuffled. Numbers of documents and
terms, and each searched term's document count, are aggregates of those rows.

``search`` sends the lists of the searched terms to parts by block, and the items to every part, in groups of ``GROUP`` items so that a task
holds one group and one block. In a block an item's lists are split: the shortest ones, up to ``SHORT`` postings in all, are summed term at a time
into accumulators. These then are one iterator with a bound of its own beside the long lists. Documents are passed in windows in their order; each iterator
has its greatest score per window, and a window whose bounds together stay below the k-th best score so far is skipped in all lists. Inside a window
candidates are those whose summed score reaches that score. The best k go on from block to block of a part, so later blocks skip more; the parts'
lists are merged by a window limit.

Cases: terms are maximal stretches of ASCII letters and digits and of all characters beyond ASCII; only A to Z are lower-cased. Null and empty texts have no
terms, and are neither counted nor found. Documents without an id count in the statistics but cannot be returned. Repeated documents rank one by one; equal
scores go by ascending id. Repeated items are answered one by one; null item ids are carried. Terms that all documents hold may weigh 0; a document
with score 0 is not returned. Empty tables give an empty result. Only ids and texts are read, so other columns may have any name. A very long text needs the memory
of its text and term counts in one task and is a block of its own, or the last of one.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stored

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(TERM_PATTERN)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
BLOCK, GROUP, SHORT, WINDOW = 2_000_000, 4096, 4096, 512
INDEX = pa.schema([("block", pa.int64()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())),
                   ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
INDEX_SQL = "block long, term string, docs array<int>, tfs array<int>, doc_ids array<long>, sizes array<long>"


def term_counts(text: str | None) -> dict[str, int]:
    out: dict[str, int] = {}
    for term, n in Counter(TERM.findall(text or "")).items():
        term = term.lower() if term.isascii() else term.translate(LOWERED)
        out[term] = out.get(term, 0) + n
    return out


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM_PATTERN), F.lit(0))


class _Block:
    """Documents of one block while they are gathered."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.sizes, self.terms, self.tfs, self.postings = [], [], [], [], 0

    def add(self, doc_id: int | None, counts: dict[str, int]) -> None:
        number = self.number
        self.ids.append(doc_id)
        self.sizes.append(sum(counts.values()))
        self.terms.append(np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int32, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.postings += len(counts)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0))
        held = np.concatenate([self.terms[i] for i in order])
        tfs = np.concatenate([self.tfs[i] for i in order])
        docs = np.repeat(np.arange(len(order), dtype=np.int32), [len(self.terms[i]) for i in order])
        by_term = np.argsort(held, kind="stable")
        docs, tfs = docs[by_term], tfs[by_term]
        edges = np.concatenate([[0], np.cumsum(np.bincount(held, minlength=len(self.number)))]).astype(np.int32)
        names = list(self.number)
        yield pa.RecordBatch.from_pylist([{"block": block, "doc_ids": [self.ids[i] for i in order], "sizes": [self.sizes[i] for i in order]}], schema=INDEX)
        for at in range(0, len(names), 1 << 16):
            end = min(len(names), at + (1 << 16))
            off, lo, hi = pa.array(edges[at:end + 1] - edges[at]), edges[at], edges[end]
            nothing = pa.nulls(end - at, INDEX.field("doc_ids").type)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(end - at, block)), pa.array(names[at:end]), pa.ListArray.from_arrays(off, pa.array(docs[lo:hi])),
                pa.ListArray.from_arrays(off, pa.array(tfs[lo:hi])), nothing, nothing], schema=INDEX)


def _inverted(block_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = _Block(), None
        for b in batches:
            for first, doc_id, text in zip(*(b.column(i) for i in range(3))):
                counts = term_counts(text.as_py())
                if not counts:
                    continue
                number = first.as_py() if number is None else number        # a block is named after its first row
                block.add(doc_id.as_py(), counts)
                if block.postings >= block_postings:
                    yield from block.rows(number)
                    block, number = _Block(), None
        yield from block.rows(number)
    return run


def index(docs: DataFrame, block_postings: int = BLOCK) -> DataFrame:
    """The inverted blocks of ``docs`` (``doc_id, text``), written. A row without a term holds its block's ids and sizes."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return stored(rows.mapInArrow(_inverted(block_postings), INDEX_SQL), "lexical_index")


class Postings:
    """One list in one block: places, scores, and the greatest score in each window of places."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, windows: int, window: int):
        self.docs, self.scores = docs, scores
        self.edges = np.searchsorted(docs, np.arange(windows + 1) * window)
        self.most = np.zeros(windows, np.int64)
        there = np.flatnonzero(self.edges[1:] > self.edges[:-1])
        if len(there):
            self.most[there] = np.maximum.reduceat(scores, self.edges[there])


class Best:
    """The k best of one item so far: by score, then smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        """A document with a lower score is not among the best."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[best], ids[best]


def pass_block(lists: list[tuple[int, Postings]], ids: np.ndarray, named: np.ndarray, best: Best, short: int = SHORT, window: int = WINDOW) -> int:
    """Bring one item's best up to date with a block, given ``(weight, list)`` of its terms. Returns the number of windows passed over."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: len(x[1].docs))
    windows = -(-len(ids) // window)
    sums, taken, held = np.zeros(len(ids), np.int64), 0, 0
    while taken < len(lists) and held + len(lists[taken][1].docs) <= short:     # term at a time
        weight, p = lists[taken]
        sums[p.docs] += weight * p.scores
        held += len(p.docs)
        taken += 1
    bounds = np.zeros(windows, np.int64)
    if taken:                                                                # one iterator, with its own bound in each window
        bounds += np.maximum.reduceat(sums, np.arange(windows) * window)
        known = sums[named]
        if len(known) >= best.k:
            known = np.partition(known, len(known) - best.k)[len(known) - best.k:]
    else:
        known = np.zeros(0, np.int64)
    # The k-th best of what is known: sums so far are lower bounds of scores of documents that are not yet among the best.
    known = np.concatenate([best.scores, known])
    floor = max(best.floor, int(np.partition(known, len(known) - best.k)[len(known) - best.k])) if len(known) >= best.k else best.floor
    long = lists[taken:]
    for weight, p in long:
        bounds += weight * p.most
    skipped = 0
    for w in range(windows):                                                 # documents in order, a window at a time
        if bounds[w] < floor:
            skipped += 1
            continue
        at = w * window
        scores = sums[at:at + window].copy()
        for weight, p in long:
            a, b = p.edges[w], p.edges[w + 1]
            scores[p.docs[a:b] - at] += weight * p.scores[a:b]
        reach = np.flatnonzero((scores >= floor) & named[at:at + window])
        if len(reach):
            best.take(scores[reach], ids[at + reach])
            floor = max(floor, best.floor)
    return skipped


def _searched(k: int, n_docs: int, n_terms: int, short: int, window: int):
    """Streams rows sorted by part: a group's items, then for each block its documents and its lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, items, best, block, ids, named, length, lists = None, [], [], None, None, None, None, {}

        def settle() -> None:
            if block is not None:
                for (_, _, own), b in zip(items, best):
                    found = [(weight, lists[t]) for t, weight in own if t in lists]
                    if found:
                        pass_block(found, ids, named, b, short, window)

        def results() -> Iterator[pa.RecordBatch]:
            settle()
            for (row, item_id, _), b in zip(items, best):
                if len(b.ids):
                    n = len(b.ids)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(b.ids), pa.array(b.scores)],
                                                     names=["item_row", "item_id", "doc_id", "score"])

        def numbers(column: pa.Array, i: int) -> np.ndarray:
            return column[i].values.to_numpy(zero_copy_only=False)

        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            keys = list(zip(c["part"].to_pylist(), c["grp"].to_pylist()))
            for i, (key, kind) in enumerate(zip(keys, c["kind"].to_pylist())):
                if key != part:
                    yield from results()
                    part, items, best, block, lists = key, [], [], None, {}
                if kind == 0:
                    items.append((c["item_row"][i].as_py(), c["item_id"][i].as_py(), list(zip(c["own_terms"][i].as_py(), c["weights"][i].as_py()))))
                    best.append(Best(k))
                elif kind == 1:
                    settle()
                    block, lists = c["block"][i].as_py(), {}
                    given = c["doc_ids"][i].values
                    ids, named = given.fill_null(0).to_numpy(zero_copy_only=False), given.is_valid().to_numpy(zero_copy_only=False)
                    length = 75 + 25 * numbers(c["sizes"], i) * n_docs // n_terms
                else:
                    docs, tfs = numbers(c["docs"], i).astype(np.int64), numbers(c["tfs"], i).astype(np.int64)
                    scores = 1_000_000_000 * tfs // (1000 * tfs + 12 * length[docs])
                    lists[c["term"][i].as_py()] = Postings(docs, scores, -(-len(ids) // window), window)
        yield from results()
    return run


def search(inverted: DataFrame, items: DataFrame, k: int = 20, group: int = GROUP, short: int = SHORT, window: int = WINDOW) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``inverted`` (from ``index``) for each row of ``items`` (``item_id, text``)."""
    spark = inverted.sparkSession
    heads, lists = inverted.where(F.col("term").isNull()), inverted.where(F.col("term").isNotNull())
    n_docs, n_terms = heads.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)),
                                F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    asked = stored(items.select(F.monotonically_increasing_id().alias("item_row"), items["item_id"].cast("long").alias("item_id"), terms(items["text"]).alias("t")), "items")
    groups = max(1, -(-asked.count() // group))
    said = asked.select("item_row", F.pmod(F.xxhash64("item_row"), F.lit(groups)).cast("int").alias("grp"), F.explode("t").alias("term"))
    said = said.groupBy("item_row", "grp", "term").agg(F.count("*").alias("times"))
    wanted = said.select("term", "grp").distinct()
    df = lists.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    own = said.join(df, "term").groupBy("item_row", "grp").agg(F.collect_list(F.struct("term", (F.col("times") * weight).alias("weight"))).alias("own"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = own.join(asked.select("item_row", "item_id"), "item_row").select(
        every(parts).alias("part"), "grp", F.lit(0).alias("kind"), "item_row", "item_id", F.col("own.term").alias("own_terms"), F.col("own.weight").alias("weights"))
    rows = rows.unionByName(heads.select(part, every(groups).alias("grp"), F.lit(1).alias("kind"), "block", "doc_ids", "sizes"), allowMissingColumns=True)
    rows = rows.unionByName(lists.join(wanted, "term").select(part, "grp", F.lit(2).alias("kind"), "block", "term", "docs", "tfs"), allowMissingColumns=True)
    placed = rows.repartition(parts, "part", "grp").sortWithinPartitions("part", "grp", F.when(F.col("kind") > 0, 1).otherwise(0), "block", "kind")
    found = placed.mapInArrow(_searched(k, int(n_docs), int(n_terms), short, window), "item_row long, item_id long, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item_row").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
