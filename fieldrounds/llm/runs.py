"""Runs of repeated words in documents, found on tiles of every scale and stitched by document and period.

A run is a stretch of words that repeats with a smallest period q, at least ``TIMES`` times over and at least ``LEAST`` words long, and that no neighbouring
word extends. Where it lies, the words q apart are equal over an unbroken interval of at least 2q places.

Periods are taken octave by octave. For an octave with step B (periods B to 2B; the first octave has step 8 and periods 1 to 15) a document is cut
into tiles: one around each multiple b of B, from b - B to b + 4B, so that they overlap. A run of that octave has a multiple of B in its first B places, and there the
next B words are equal to those q further on. A tile is solved alone: periods whose first 8 words agree are looked up, the Z-function of the words
from b on gives how far equality goes to the right and whether q is a smallest period, the Z-function of the reversed words how far to the left. That
makes a fragment of the interval, and fragments of one period that touch are one.

A document of up to ``STRIP`` words is solved where it is read. A longer one is exploded into strips of consecutive tiles (with their margins), which are dealt
over the cluster, each octave whose tiles outgrow a strip in strips of its own. All fragments are then shuffled by document and period and
stitched with a window, so that a run as long as its document costs a few rows and no task sees more than one strip.

Cases: words are what is not ASCII white space. A null or empty text has no words, no run, and collapses to an empty text. Repeated rows and repeated
or null ids are treated row by row. Ties for the strongest run go to the smallest start, then period. An empty table gives an empty result; only the id and the
text are read, so other columns may have any name. A very long text needs the memory of its text and word numbers where it is read and where it is collapsed.
"""
from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TIMES = 24, 3
SMALL, STRIP = 8, 1 << 15
FRAGMENT = "struct<period:int,start:int,stop:int>"
RUN = "struct<start:bigint,length:bigint,period:bigint>"
SOLVED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("digest", pa.string()), ("text", pa.string()),
                    ("fragments", pa.list_(pa.struct([("period", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))),
                    ("step", pa.int32()), ("first", pa.int32()), ("stop", pa.int32()), ("before", pa.int32()), ("words", pa.binary())])
SOLVED_SQL = f"key long, doc_id long, n_words long, digest string, text string, fragments array<{FRAGMENT}>, step int, first int, stop int, before int, words binary"


def z_function(s: list[int]) -> list[int]:
    """For each place, how far the list from there on agrees with its beginning."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def shorter(q: int) -> tuple[int, ...]:
    """The periods q / d for the primes d that divide q: if q is no smallest period, one of them is a period."""
    out, rest, d = [], q, 2
    while d * d <= rest:
        if rest % d == 0:
            out.append(q // d)
            while rest % d == 0:
                rest //= d
        d += 1
    return tuple(out + ([q // rest] if rest > 1 else []))


def needed(q: int) -> int:
    """Places over which words q apart are equal in the shortest run of period q."""
    return max(LEAST, TIMES * q) - q


def tile_fragments(words: np.ndarray, b: int, step: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """``period, start, stop`` of equality around place ``b`` for those ``periods`` that are smallest and reach ``step`` words to the right."""
    ahead = z_function(words[b:b + 4 * step].tolist())
    reach = [(q, min(ahead[q], 2 * step)) for q in periods if ahead[q] >= step and all(ahead[p] < q for p in shorter(q))]
    if not reach:
        return []
    before = words[max(0, b - step):b][::-1].tolist()
    if not before:
        return [(q, b, b + r) for q, r in reach]
    around = words[max(0, b - step):b + 2 * step][::-1].tolist()
    back = z_function([*before, -1, *around])
    end = len(before) + 1 + min(b + 2 * step, len(words))      # where the reversed words from place 0 would end
    return [(q, b - min(back[end - b - q], step), b + r) for q, r in reach]


def strip_fragments(words: np.ndarray, origin: int, first: int, stop: int, steps: list[int]) -> list[tuple[int, int, int]]:
    """Fragments from the tiles at ``first <= b < stop`` of a document whose words from ``origin`` on are ``words``.

    Kept are those that are runs, or that go on beyond the strip.
    """
    out = []
    n = len(words)
    if n <= SMALL:
        return out
    with np.errstate(over="ignore"):                            # a hash of each 8 words, which only rules places out
        seen = np.zeros(n - SMALL + 1, np.uint64)
        for j in range(SMALL):
            seen = seen * np.uint64(0x9E3779B97F4A7C15) + words[j:n - SMALL + 1 + j].astype(np.uint64) + np.uint64(1)
    for step in steps:
        at = -(-first // step) * step - origin                  # the first tile, as a place in ``words``
        tiles = -(-(stop - origin - at) // step)
        grid = seen[at:at + (tiles + 1) * step]
        if tiles <= 0 or len(grid) <= (1 if step == SMALL else step):
            continue
        grid = np.pad(grid, (0, (tiles + 1) * step - len(grid))).reshape(tiles + 1, step)
        row, col = np.nonzero(grid[1:] == grid[:-1, :1])
        col = col + step
        if step == SMALL:
            row_0, col_0 = np.nonzero(grid[:-1, 1:] == grid[:-1, :1])
            row, col = np.concatenate([row, row_0]), np.concatenate([col, col_0 + 1])
        there = at + row * step + col < len(seen)
        row, col = row[there], col[there]
        if not len(row):
            continue
        order = np.lexsort((col, row))
        row, col = row[order], col[order]
        held: dict[int, list[int]] = {}

        def let_go(q: int, a: int, z: int) -> None:
            if z - a >= needed(q) or a < first or z > stop:
                out.append((q, a, z))

        for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row)) + 1):
            for q, a, z in tile_fragments(words, at + int(row[part[0]]) * step, step, col[part].tolist()):
                a, z = a + origin, z + origin
                last = held.get(q)
                if last and a <= last[1]:
                    last[1] = max(last[1], z)
                else:
                    if last:
                        let_go(q, *last)
                    held[q] = [a, z]
        for q, (a, z) in held.items():
            let_go(q, a, z)
    return out


def steps_for(n: int) -> list[int]:
    """The steps of the octaves that hold the periods a run within ``n`` words can have."""
    out = [SMALL]
    while TIMES * 2 * out[-1] <= n:
        out.append(2 * out[-1])
    return out if n >= LEAST else []


def strips(n: int, size: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """``first, stop, margin, steps`` of the strips of a document of ``n`` words: small octaves together, larger ones each in wider strips."""
    low = [s for s in steps_for(n) if 8 * s <= size]
    for group in ([low] if low else []) + [[s] for s in steps_for(n) if 8 * s > size]:
        width = max(size, 8 * group[-1])
        for first in range(0, n, width):
            yield first, min(n, first + width), group[-1], group


def numbered(words: list[str]) -> np.ndarray:
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def _solve_documents(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        weight = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=SOLVED)

        for b in batches:
            for key, doc_id, text in zip(*(b.column(i) for i in range(3))):
                words = WORD.findall(text.as_py() or "")
                n = len(words)
                plain = " ".join(words)
                row = {"key": key.as_py(), "doc_id": doc_id.as_py(), "n_words": n, "digest": hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest()}
                numbers = numbered(words) if n >= LEAST else None
                found = strip_fragments(numbers, 0, 0, n, steps_for(n)) if LEAST <= n <= size else []
                if found:
                    row["fragments"] = [{"period": q, "start": a, "stop": z} for q, a, z in found]
                if found or n > size:
                    row["text"] = plain
                rows.append(row)
                weight += 100 + (len(plain) if found or n > size else 0)
                if n > size:
                    for first, stop, margin, steps in strips(n, size):
                        lo, hi = max(0, first - margin), min(n, stop + 4 * margin)
                        rows.append({"key": row["key"], "step": steps[-1] if len(steps) == 1 else 0, "first": first, "stop": stop, "before": lo,
                                     "words": numbers[lo:hi].tobytes()})
                        weight += 4 * (hi - lo)
                        if weight > 1 << 24:
                            yield batch()
                            rows, weight = [], 0
                if weight > 1 << 24:
                    yield batch()
                    rows, weight = [], 0
        if rows:
            yield batch()
    return run


def _solve_strips(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                words = np.frombuffer(r.words, np.int32)
                steps = [r.step] if r.step else [s for s in steps_for(1 << 31) if 8 * s <= size]
                found = strip_fragments(words, r.before, r.first, r.stop, steps)
                yield pd.DataFrame({"key": np.full(len(found), r.key), "period": [f[0] for f in found], "start": [f[1] for f in found],
                                    "stop": [f[2] for f in found]}).astype({"period": "int32", "start": "int32", "stop": "int32"})
    return run


def _stitched(fragments: DataFrame) -> DataFrame:
    """Fragments of one document and period that touch, as one; those that are long enough, as runs."""
    by = W.partitionBy("key", "period").orderBy("start", "stop")
    upto = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    opened = fragments.withColumn("opens", F.when(F.col("start") <= upto, 0).otherwise(1))
    islands = opened.withColumn("island", F.sum("opens").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = islands.groupBy("key", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    return whole.where(length >= F.greatest(F.lit(LEAST), TIMES * F.col("period"))).select(
        "key", F.col("start").cast("long").alias("start"), length.cast("long").alias("length"), F.col("period").cast("long").alias("period"))


def without_repeats(texts: pd.Series, runs: pd.Series) -> pd.Series:
    """Texts of single-spaced words without the words that a run holds after its first period."""
    out = []
    for text, found in zip(texts, runs):
        words = text.split(" ")
        edges = np.zeros(len(words) + 1, np.int64)
        for r in found:
            edges[r["start"] + r["period"]] += 1
            edges[r["start"] + r["length"]] -= 1
        out.append(" ".join(w for w, dropped in zip(words, np.cumsum(edges).tolist()) if not dropped))
    return pd.Series(out)


def find(docs: DataFrame, strip: int = STRIP) -> DataFrame:
    """``doc_id, n_words, runs, text, digest`` for every row of ``docs`` (``doc_id, text``).

    ``runs`` are ``start, length, period`` in words, by start, then period. ``text`` is the collapsed text of a row with runs, and null for
    one without, which keeps its words. ``digest`` is the sha256 of the collapsed text, words joined by one space.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("key"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    solved = stored(rows.mapInArrow(_solve_documents(strip), SOLVED_SQL), "solved")
    apart = solved.where(F.col("words").isNotNull()).select("key", "step", "first", "stop", "before", "words")
    apart = apart.repartition("key", "step", "first").mapInPandas(_solve_strips(strip), "key long, period int, start int, stop int")
    at_once = solved.where(F.size("fragments") > 0).select("key", F.explode("fragments").alias("f")).select("key", "f.*")
    ordered = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    runs = _stitched(at_once.unionByName(apart)).groupBy("key").agg(ordered.alias("runs"))
    runs = runs.select("key", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    collapse = F.pandas_udf(without_repeats, "string")
    documents = solved.where(F.col("n_words").isNotNull())
    none = F.array().cast(f"array<{RUN}>")
    plain = documents.where(F.col("text").isNull()).select("doc_id", "n_words", none.alias("runs"), F.lit(None).cast("string").alias("text"), "digest")
    with_text = documents.where(F.col("text").isNotNull()).join(runs, "key", "left")
    there = F.col("runs").isNotNull()
    left = with_text.where(~there).select("doc_id", "n_words", none.alias("runs"), F.lit(None).cast("string").alias("text"), "digest")
    new = with_text.where(there).select("doc_id", "n_words", "runs", collapse("text", "runs").alias("text"))
    return plain.unionByName(left).unionByName(new.withColumn("digest", F.sha2("text", 256)))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; of equal ones the first. Null without runs."""
    none = F.lit(None).cast(RUN)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
