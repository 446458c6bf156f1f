"""Small pieces shared by the operators of this package."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``. A null id counts as empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def unit_draw(seed: str, *cols: Column) -> Column:
    """A repeatable draw in [0, 1) for each distinct tuple of ``cols``; nulls count as empty text."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def lowest_part(hashed: Column, rows: int, total: int) -> Column:
    """Whether a 64-bit hash lies in the lowest part, expected to hold half as many again as ``rows`` of ``total``.

    Taking the first ``rows`` in hash order after this filter sends few rows beyond them to one place, from however many partitions.
    """
    share = min(1.0, (1.5 * rows + 100) / max(total, 1))
    return hashed <= F.lit(min((1 << 63) - 1, int((2 * share - 1) * (1 << 63))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def prefix_sums(lengths: Column, chunk: int = 64) -> Column:
    """Exclusive running sums of a non-empty array of longs, with array functions only.

    Sums within chunks plus the totals of earlier chunks: n * (chunk + n / chunk**2) steps, not n**2.
    """
    def over(a: Column) -> Column:
        last = F.floor((F.size(a) - 1) / chunk).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(a, c * chunk + 1, F.lit(chunk)))

        def summed(ch: Column) -> Column:
            def placed(totals: Column) -> Column:
                offsets = F.transform(totals, lambda _, i: _total(F.slice(totals, F.lit(1), i)))
                return F.flatten(F.zip_with(ch, offsets, lambda c, o: F.transform(c, lambda _, i: o + _total(F.slice(c, F.lit(1), i)))))
            return let(F.transform(ch, _total), placed)
        return let(chunks, summed)
    return let(lengths, over)


def parted(df: DataFrame, key: Column, few: DataFrame, few_key: Column, bits: int = 16) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` may be among the ``few_key`` of ``few``, and those whose key is not.

    Wide rows then meet ``few`` without a shuffle of all of them: about one row in ``bits`` is among the first without being met there. ``few`` (a table that is read
    twice) becomes bitmaps of 32,768 hashes, two bytes a row, small enough to be broadcast below Spark's threshold for some millions of rows. A null key is a key.
    """
    size = max(1, -(-few.count() * bits // 32768)) * 32768
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(size))
    number = lambda k: F.floor(place(k) / 32768).cast("long")
    at = few.select(number(few_key).alias("_number"), (place(few_key) % 32768).alias("_at"))
    maps = stored(at.repartition("_number").groupBy("_number").agg(F.bitmap_construct_agg("_at").alias("_bits")), "bitmaps")
    at = place(key) % 32768
    byte = F.conv(F.hex(F.substring(maps["_bits"], (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = (number(key) == maps["_number"]) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return df.join(maps, there, "left_semi"), df.join(maps, there, "left_anti")


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal ``keys`` in one partition and next to each other, for ``segments``."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def segments(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of equal ``keys`` of rows that come sorted by them, whole across batches.

    Many small groups cost a slice each, where a grouped map would cost a call each.
    """
    held: list[pd.DataFrame] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        new = np.zeros(len(b), bool)
        for k in keys:
            v = b[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        first = tuple(b[k].iloc[0] for k in keys)
        if held and first != last:
            yield pd.concat(held, ignore_index=True)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), len(b)]
        for at, end in zip(cuts[:-2], cuts[1:-1]):
            part = b.iloc[at:end]
            yield pd.concat([*held, part], ignore_index=True) if held else part
            held = []
        held.append(b.iloc[cuts[-2]:])
        last = tuple(b[k].iloc[-1] for k in keys)
    if held:
        yield pd.concat(held, ignore_index=True)
