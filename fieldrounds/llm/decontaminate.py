"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document share seeds: runs of ``MIN_MATCH`` words, found by Karp-Rabin hashes. For items that share
one, tiles are marked greedily: the search length starts at the longest a match can have and halves; at each length the rolling hashes
of unmarked windows are matched, extended to the longest match, and marked longest first where nothing is marked yet. A
document is contaminated by an item if tiles cover at least ``MIN_COVERAGE`` of the item's words. Order between tiles does not
matter, so passages whose parts were moved are found.

The benchmark is cut into blocks of at most ``BLOCK_WORDS`` words (an item that is longer is a block alone); each block is sent to
the tasks, and documents are read once per block. A usual benchmark is one block.

Cases: words are ``\\w+`` of the lower-cased text; null and empty texts have none. Items under ``MIN_MATCH`` words take no part. Repeated
documents and items are reported alike, once per row. Null ids are carried as null. Only the named columns are read.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

WORD = re.compile(r"\w+")
MIN_MATCH, MIN_COVERAGE = 5, 0.5
BLOCK_WORDS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = "array<struct<item_id:bigint,item_words:bigint,covered:bigint,tiles:bigint,coverage:double>>"


def window_hashes(a: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of ``n`` values; equal windows have equal hashes.

    By doubling: the hash of 2m values is that of the first m, shifted, plus that of the last m.
    """
    if len(a) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        out, width, power, have = None, 1, BASE, 0
        while True:
            if n & width:
                if out is None:
                    out = x.copy()
                else:
                    size = len(a) - have - width + 1
                    out = out[:size] * power + x[have:have + size]
                have += width
            if have == n:
                return out[:len(a) - n + 1]
            size = len(a) - 2 * width + 1
            x = x[:size] * power + x[width:width + size]
            power = power * power
            width *= 2


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Whether the window of ``n`` places from each place has no mark."""
    c = np.concatenate([[0], np.cumsum(marked)])
    return c[n:] == c[:-n]


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles ``(place in item, place in doc, length)``, longest first within each search length."""
    tiles: list[tuple[int, int, int]] = []
    used_i, used_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    n = min(len(item), len(doc))
    if n < least:
        return tiles
    length = n
    while True:
        found = True
        while found:                    # again at this length: a cut match may leave a rest that is still long enough
            found = False
            ok_i, ok_d = _free(used_i, length), _free(used_d, length)
            at_i, at_d = np.flatnonzero(ok_i), np.flatnonzero(ok_d)
            if len(at_i) and len(at_d):
                hi, hd = window_hashes(item, length)[at_i], window_hashes(doc, length)[at_d]
                here = np.isin(hd, hi)
                where = defaultdict(list)
                for h, i in zip(hi.tolist(), at_i.tolist()):
                    where[h].append(i)
                matches = []
                for h, d in zip(hd[here].tolist(), at_d[here].tolist()):
                    for i in where[h]:
                        # A match that goes on to the left was met at an earlier place.
                        if i and d and not used_i[i - 1] and not used_d[d - 1] and item[i - 1] == doc[d - 1]:
                            continue
                        m = 0
                        while i + m < len(item) and d + m < len(doc) and not used_i[i + m] and not used_d[d + m] and item[i + m] == doc[d + m]:
                            m += 1
                        if m >= length:
                            matches.append((-m, i, d))
                for m, i, d in sorted(matches):
                    if used_i[i:i - m].any() or used_d[d:d - m].any():
                        found = True    # its free rest, if any, is looked for again
                        continue
                    used_i[i:i - m] = used_d[d:d - m] = True
                    tiles.append((i, d, -m))
                found = found and bool(matches) and not used_i.all()
        if length == least or used_i.all():
            return tiles
        length = max(least, length // 2)


class Block:
    """Items of a benchmark block, and which of them hold each seed."""

    def __init__(self, items: list[tuple], least: int = MIN_MATCH):
        self.least, self.word, self.items = least, {}, []
        seeds, owners = [], []
        for item_id, text in items:
            ids = np.array([self.word.setdefault(w, len(self.word)) for w in WORD.findall((text or "").lower())], np.int64)
            if len(ids) >= least:
                h = np.unique(window_hashes(ids, least))
                seeds.append(h)
                owners.append(np.full(len(h), len(self.items)))
                self.items.append((item_id, ids))
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owners = self.seeds[order], (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]

    def ids_of(self, text: str | None) -> np.ndarray:
        """Word numbers of a text; words that no item has are -1 and match nothing."""
        get = self.word.get
        return np.array([get(w, -1) for w in WORD.findall((text or "").lower())], np.int64)

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        """Numbers of the items that share a seed with a document."""
        n = self.least
        if len(doc) < n or not len(self.seeds):
            return np.zeros(0, np.int64)
        known = _free(doc < 0, n)
        if not known.any():
            return np.zeros(0, np.int64)
        h = np.unique(window_hashes(doc, n)[known])
        a, b = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        hit = np.flatnonzero(b > a)
        return np.unique(np.concatenate([self.owners[a[i]:b[i]] for i in hit])) if len(hit) else np.zeros(0, np.int64)

    def found(self, text: str | None, coverage: float = MIN_COVERAGE) -> list[dict]:
        doc = self.ids_of(text)
        out = []
        for c in self.candidates(doc).tolist():
            item_id, item = self.items[c]
            tiles = tile(item, doc, self.least)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(item):
                out.append({"item_id": item_id, "item_words": len(item), "covered": covered, "tiles": len(tiles), "coverage": covered / len(item)})
        return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size, read partition by partition."""
    held, words = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text")).toLocalIterator():
        n = len(WORD.findall(r[1] or ""))
        if held and words + n > block_words:
            yield held
            held, words = [], 0
        held.append((r[0], r[1]))
        words += n
    if held:
        yield held


def matcher(items: list[tuple], coverage: float = MIN_COVERAGE, least: int = MIN_MATCH):
    """A vectorised function of the text: the items of one block that contaminate it."""
    @F.pandas_udf(RESULT)
    def benchmark_items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = Block(items, least)
        for texts in batches:
            yield pd.Series([block.found(t, coverage) for t in texts], dtype=object)
    return benchmark_items


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = MIN_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item with at least ``coverage``: ``doc_id, item_id, item_words, covered, tiles, coverage``."""
    out = None
    for items in blocks(benchmark, block_words):
        rows = docs.select("doc_id", F.explode(matcher(items, coverage)(F.col("text"))).alias("m")).select("doc_id", "m.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        empty = docs.where(F.lit(False)).select("doc_id", F.explode(F.array().cast(RESULT)).alias("m"))
        return empty.select("doc_id", "m.*")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = MIN_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with the columns they came with."""
    for items in blocks(benchmark, block_words):
        hits: Column = matcher(items, coverage)(docs["text"])
        docs = docs.where(F.size(hits) == 0)
    return docs
