"""Cluster bootstrap: Poisson weights by md5, statistics from per-cluster sums.

A replicate gives each cluster a Poisson(1) weight, the limit of drawing as many clusters as there are with replacement. The
weight is a hash of seed, cluster and replicate, so every task makes the weights of its own clusters where they lie: no draw is
stored, joined or shuffled. Each cluster is first reduced to the sums a statistic needs. A task holds the weights of a block of clusters as a
matrix and multiplies it into their sums, so that no row is made for a cluster and a replicate; what is shuffled is a row per replicate, part and task.
"""
from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import norm_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# 32-bit cut points of the Poisson(1) distribution: a uniform number at or above the k-th counts k or more.
POISSON_CUTS = tuple(int(sum(math.exp(-1) / math.factorial(i) for i in range(k)) * 2 ** 32) for k in range(1, 11))
# md5 words made at once, and numbers a task holds before it passes its totals on.
BLOCK, HELD = 40_000, 8_000_000
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4


def md5_words(prefixes: list[bytes], ends: list[bytes]) -> np.ndarray:
    """The four big-endian 32-bit words of md5(prefix + end), for every pair: prefixes x ends x 4.

    hashlib takes a microsecond a call; one block of md5 over arrays takes a quarter of that.
    """
    room = 55 - max(map(len, ends))
    if max(map(len, prefixes)) > room:
        return np.frombuffer(b"".join(hashlib.md5(p + e).digest() for p in prefixes for e in ends), ">u4").astype(np.uint32).reshape(len(prefixes), len(ends), 4)
    out = np.empty((len(prefixes), len(ends), 4), np.uint32)
    for size in set(map(len, prefixes)):
        at = [i for i, p in enumerate(prefixes) if len(p) == size]
        text = b"".join((bytes(size) + e + b"\x80").ljust(56, b"\0") + (8 * (size + len(e))).to_bytes(8, "little") for e in ends)
        blocks = np.repeat(np.frombuffer(text, np.uint8).reshape(1, len(ends), 64), len(at), 0)
        blocks[:, :, :size] = np.frombuffer(b"".join(prefixes[i] for i in at), np.uint8).reshape(len(at), 1, size)
        w = np.ascontiguousarray(blocks.view("<u4").reshape(-1, 16).T)
        start = [np.full(w.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = start
        for i in range(64):
            f, g = _mix(i, b, c, d)
            f = f + a + w[g] + np.uint32(_SINES[i])
            a, d, c, b = d, c, b, b + ((f << np.uint32(_TURNS[i])) | (f >> np.uint32(32 - _TURNS[i])))
        for k, x in enumerate((a, b, c, d)):
            out[at, :, k] = (x + start[k]).byteswap().reshape(len(at), len(ends))
    return out


def _mix(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, int]:
    if i < 16:
        return d ^ (b & (c ^ d)), i
    if i < 32:
        return c ^ (d & (b ^ c)), (5 * i + 1) % 16
    if i < 48:
        return b ^ c ^ d, (3 * i + 5) % 16
    return c ^ (b | ~d), 7 * i % 16


def times_of(keys: list[str], reps: int, seed: int = 0) -> np.ndarray:
    """How often each replicate draws each cluster, keys x replicates. One md5 holds the numbers of four replicates."""
    u = md5_words([f"{seed}:{k}:".encode() for k in keys], [str(b).encode() for b in range((reps + 3) // 4)])
    u = u.reshape(len(keys), -1)[:, :reps]
    out = np.zeros(u.shape, np.uint8)
    for k in POISSON_CUTS:
        out += u >= np.uint32(k)
    return out


def _blocks(batch: pa.RecordBatch, reps: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A batch's rows some clusters at a time: row numbers, the place of each row's cluster, and the clusters' times."""
    keys: dict[str, int] = {}
    code = np.array([keys.setdefault(k, len(keys)) for k in batch.column("_key").to_pylist()], np.int64)
    order, names, step = np.argsort(code, kind="stable"), list(keys), max(1, 4 * BLOCK // reps)
    for low in range(0, len(names), step):
        rows = order[slice(*np.searchsorted(code[order], [low, low + step]))]
        yield rows, code[rows] - low, times_of(names[low:low + step], reps, seed)


def drawn(df: DataFrame, key: str, reps: int, seed: int = 0) -> DataFrame:
    """``df`` once for each replicate that draws its cluster, with ``rep`` and ``times`` (BS0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, at, times in _blocks(b, reps, seed):
                each = times[at]
                i, rep = np.nonzero(each)
                got = b.select(names).take(pa.array(rows[i]))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(rep.astype(np.int32)), pa.array(each[i, rep].astype(np.int32))], [*names, "rep", "times"])
    names = df.columns
    shape = T.StructType([*df.schema.fields, T.StructField("rep", T.IntegerType()), T.StructField("times", T.IntegerType())])
    return df.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string")).mapInArrow(run, shape)


def weights(clusters: DataFrame, key: str, reps: int, seed: int = 0) -> DataFrame:
    """``rep, key, times`` for the distinct keys of ``clusters``."""
    return drawn(dealt(clusters.select(key).distinct(), key), key, reps, seed).select("rep", key, "times")


def address_cluster(address: Column) -> Column:
    """Places at one address share visit days, so they are drawn together (BS3)."""
    return norm_key(address)


def dealt(per: DataFrame, key: str) -> DataFrame:
    """Rows dealt by cluster over all tasks: few bytes make many weights.

    By a hash of the cluster: dealt by the column itself, rows that a grouping has just dealt so would stay in the few tasks their bytes are put into.
    """
    return per.repartition(max(1, int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(key))


def _listed(columns: list[np.ndarray], names: list[str]) -> pa.Array:
    """One list of structs: an element per replicate."""
    fields = [pa.array(c, mask=np.isnan(c)) for c in columns]
    return pa.ListArray.from_arrays(pa.array([0, len(columns[0])], pa.int32()), pa.StructArray.from_arrays(fields, names))


def replicate_sums(sums: DataFrame, key: str, names: list[str], parts: list[str] = (), reps: int = 1000, seed: int = 0) -> DataFrame:
    """Per replicate (and part), the drawn total of each per-cluster sum."""
    parts, k = list(parts), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for p, t in held.items():
                total = [np.where(t[:, 1 + k + i] > 0, t[:, 1 + i], np.nan) for i in range(k)]
                yield pa.RecordBatch.from_arrays([*[pa.array([x], f) for x, f in zip(p, kinds)], _listed([t[:, 0], *total], ["_k", *names])], [*parts, "_all"])
            held.clear()
        kinds: list[pa.DataType] = []
        for b in batches:
            kinds = [b.schema.field(p).type for p in parts]
            codes: dict[tuple, int] = {}
            labels = list(zip(*[b.column(p).to_pylist() for p in parts])) if parts else [()] * b.num_rows
            part = np.array([codes.setdefault(x, len(codes)) for x in labels], np.int64)
            v = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], 1)
            there = np.stack([b.column(n).is_valid().to_numpy(zero_copy_only=False) for n in names], 1)
            # How many rows are drawn, their sums, and how many of them have a value.
            v = np.hstack([np.ones((len(v), 1)), np.where(there, v, 0.0), there])
            label = list(codes)
            for rows_, at, times in _blocks(b, reps, seed):
                mine = part[rows_]
                for p in np.unique(mine):
                    here = mine == p
                    t = times[at[here]].astype(float).T @ v[rows_[here]]
                    held[label[p]] = held[label[p]] + t if label[p] in held else t
                if len(held) * reps * (1 + 2 * k) > HELD:
                    yield from rows()
        yield from rows()
    typed = {f.name: f for f in sums.schema.fields}
    shape = T.StructType([*[typed[p] for p in parts], T.StructField("_all", T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("_k", *names)])))])
    rows = sums.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key"), *parts, *names).mapInArrow(run, shape)
    each = rows.select(*parts, F.posexplode("_all").alias("rep", "_s")).where("_s._k > 0")
    whole = lambda n: isinstance(typed[n].dataType, T.IntegralType)
    return each.groupBy("rep", *parts).agg(*[F.sum(F.col("_s")[n].cast("long") if whole(n) else F.col("_s")[n]).alias(n) for n in names])


def percentiles(df: DataFrame, stats: list[str], parts: list[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of each statistic over replicates (linear)."""
    aggs = []
    for s in stats:
        p = F.percentile(s, F.array(F.lit(low), F.lit(high)))
        aggs += [F.element_at(p, 1).alias(f"{s}_low"), F.element_at(p, 2).alias(f"{s}_high")]
    return df.groupBy(*parts).agg(*aggs)


def cluster_interval(df: DataFrame, key: str, sums: dict[str, Column], stats: dict[str, Callable[[dict], Column]],
                     parts: list[str] = (), reps: int = 1000, seed: int = 0) -> DataFrame:
    """Interval of statistics written over per-cluster sums (BS1): ``stats`` maps a name to a function
    from the drawn sums to a Column, and ``sums`` are aggregates of the rows of a cluster."""
    per = df.groupBy(key, *parts).agg(*[c.alias(n) for n, c in sums.items()])
    got = replicate_sums(dealt(per, key), key, list(sums), parts, reps, seed)
    cols = {n: F.col(n) for n in sums}
    return percentiles(got.select("rep", *parts, *[f(cols).alias(n) for n, f in stats.items()]), list(stats), parts)


def _auc_pieces(reps: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``arm, score, y`` in descending order to what an AUC needs of them, for every replicate.

    Scores that only this task holds become one piece: its positives, negatives, and pairs ranked right within it. The first and the last score of
    an arm in a task may go on in the next one; each is a piece of its own, whose pairs are counted when its parts are together.
    """
    def piece(arm: str, score: float, pos: np.ndarray, neg: np.ndarray, num: np.ndarray | None) -> pa.RecordBatch:
        held = _listed([pos, neg, np.full(reps, np.nan) if num is None else num], ["pos", "neg", "num"])
        return pa.RecordBatch.from_arrays([pa.array([arm]), pa.array([score]), held], ["arm", "score", "_all"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arm = last = None           # the arm, and the score that is not complete yet
        for b in batches:
            arms, scores, ys = (b.column(n).to_numpy(zero_copy_only=False) for n in ("arm", "score", "y"))
            keys = b.column("_key").to_pylist()
            step = max(1, 4 * BLOCK // reps)
            cuts = sorted({0, len(keys), *range(0, len(keys), step), *(np.flatnonzero(arms[1:] != arms[:-1]) + 1).tolist()})
            for lo, hi in zip(cuts, cuts[1:]):
                if arms[lo] != arm:
                    if last:
                        yield from closed(arm, last, inner)
                    arm, last, inner, first = arms[lo], None, None, True
                code: dict[str, int] = {}
                at = [code.setdefault(x, len(code)) for x in keys[lo:hi]]
                times = times_of(list(code), reps, seed)[at].astype(float)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(scores[lo:hi]) != 0) + 1]) if hi - lo > 1 else np.array([0])
                level = scores[lo:hi][starts]
                pos = np.add.reduceat(times * ys[lo:hi, None], starts, axis=0)
                neg = np.add.reduceat(times, starts, axis=0) - pos
                if last and last[0] == level[0]:
                    pos[0] += last[1]
                    neg[0] += last[2]
                elif last:
                    level, pos, neg = np.concatenate([[last[0]], level]), np.vstack([last[1], pos]), np.vstack([last[2], neg])
                last = (float(level[-1]), pos[-1].copy(), neg[-1].copy())
                level, pos, neg = level[:-1], pos[:-1], neg[:-1]
                if first and len(level):
                    yield piece(arm, float(level[0]), pos[0], neg[0], None)
                    level, pos, neg, first = level[1:], pos[1:], neg[1:], False
                if len(level):
                    top, p, n, num = inner or (float(level[0]), np.zeros(reps), np.zeros(reps), np.zeros(reps))
                    above = np.cumsum(pos, axis=0) - pos / 2
                    inner = (top, p + pos.sum(0), n + neg.sum(0), num + (neg * (above + p)).sum(0))
        if last:
            yield from closed(arm, last, inner)

    def closed(arm: str, last: tuple, inner: tuple | None) -> Iterator[pa.RecordBatch]:
        if inner:
            yield piece(arm, *inner)
        yield piece(arm, *last, None)
    return run


def paired_auc(df: DataFrame, key: str, a: str, b: str, reps: int = 1000, seed: int = 0, y: str = "y") -> DataFrame:
    """Per replicate, AUC of ``a`` minus AUC of ``b`` on the same drawn clusters (BS2).

    Rows lie in ranges of score and cluster, so a score of many rows is split too, and each range is reduced to a few pieces per replicate. A missing score ranks last.
    """
    c = F.col
    score = lambda n: F.coalesce(F.when(F.isnan(c(n).cast("double")), F.lit(float("inf"))).otherwise(c(n).cast("double")), F.lit(float("-inf")))
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), score(n).alias("score")) for n in (a, b)])).alias("_a")
    rows = df.where(c(key).isNotNull()).select(c(key).cast("string").alias("_key"), F.coalesce(c(y).cast("int"), F.lit(0)).alias("y"), arms).select("_key", "y", "_a.*")
    order = [c("arm"), c("score").desc(), c("_key")]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _auc_pieces(reps, seed), "arm string, score double, _all array<struct<pos:double,neg:double,num:double>>")
    each = held.select("arm", "score", F.posexplode("_all").alias("rep", "_s")).groupBy("rep", "arm", "score").agg(
        *[F.sum(c("_s")[x]).alias(x) for x in ("pos", "neg", "num")])
    # A few pieces for each task; a replicate's are in one place.
    above = F.coalesce(F.sum("pos").over(W.partitionBy("rep", "arm").orderBy(c("score").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    won = F.coalesce(c("num"), c("pos") * c("neg") / 2) + c("neg") * c("_above")
    both = F.sum("pos") * F.sum("neg")
    got = each.withColumn("_above", above).groupBy("rep", "arm").agg((F.sum(won) / F.when(both > 0, both)).alias("auc"))
    g = got.groupBy("rep").agg(F.max(F.when(c("arm") == a, c("auc"))).alias("auc_a"), F.max(F.when(c("arm") == b, c("auc"))).alias("auc_b"))
    return g.select("rep", "auc_a", "auc_b", (c("auc_a") - c("auc_b")).alias("auc_diff"))


def widened(value: Column, median: Column, deff: float) -> Column:
    """A draw spread about the median by a design effect; a ratio is never negative."""
    return F.greatest(F.lit(0.0), median + (value - median) * F.sqrt(F.lit(deff)))


def share_ratios(df: DataFrame, key: str, group: str, wrong: Column, labelled: Column, reps: int, seed: int = 0, deff: float = 2.0) -> DataFrame:
    """Each group's share of the wrongly named over its share of the labelled, by replicate, with the
    95% interval, the family-wise one and that one widened by a design effect (BS7)."""
    per = df.groupBy(key, group).agg(F.sum(wrong.cast("int")).alias("wrong"), F.sum(labelled.cast("int")).alias("lab"))
    got = replicate_sums(dealt(per, key), key, ["wrong", "lab"], [group], reps, seed)
    total = got.groupBy("rep").agg(F.sum("wrong").alias("_w"), F.sum("lab").alias("_l")).where("_w > 0 and _l > 0")
    ratio = (F.col("wrong") / F.col("_w")) / (F.col("lab") / F.col("_l"))
    r = got.where("lab > 0").join(total, "rep").select("rep", group, ratio.alias("ratio"))
    n = df.select(group).distinct().count()
    a = 0.05 / max(1, n)
    q = F.percentile("ratio", F.array(*[F.lit(x) for x in (0.025, 0.975, a / 2, 1 - a / 2, 0.5)]))
    g = r.groupBy(group).agg(q.alias("q"))
    low, high, mid = F.element_at("q", 3), F.element_at("q", 4), F.element_at("q", 5)
    # Widening is monotone, so the widened percentile is the percentile widened.
    return g.select(group, F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"), low.alias("family_low"),
                    high.alias("family_high"), widened(low, mid, deff).alias("deff_low"), widened(high, mid, deff).alias("deff_high"))


def arm_cube(armed: DataFrame, area: str, group: str, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Sums by replicate, group and arm, whole areas drawn (BS6): rows, positives, flagged, flagged positives, days sooner of positives.

    ``armed`` has a row per record and arm with ``y, flag, days_earlier``. It is reduced to a row per area, group and arm before anything is drawn.
    """
    sums = {"n": F.count("*"), "p": F.sum("y"), "f": F.sum("flag"), "fy": F.sum(F.col("flag") * F.col("y")), "dy": F.sum(F.col("days_earlier") * F.col("y"))}
    per = armed.groupBy(area, group, "arm").agg(*[c.alias(n) for n, c in sums.items()])
    return replicate_sums(dealt(per, area), area, list(sums), [group, "arm"], reps, seed)


def _over(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def arm_intervals(cube: DataFrame, group: str) -> DataFrame:
    """Intervals of recall, flag rate and false-positive rate (in percent) and of days sooner, by group and arm."""
    c = F.col
    stats = {"recall": 100 * _over(c("fy"), c("p")), "flag_rate": 100 * _over(c("f"), c("n")), "fpr": 100 * _over(c("f") - c("fy"), c("n") - c("p")), "days": _over(c("dy"), c("p"))}
    return percentiles(cube.select("rep", group, "arm", *[v.cast("double").alias(n) for n, v in stats.items()]), list(stats), [group, "arm"])


def arm_gaps(cube: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """Intervals of what lies between the lowest and the highest group, by arm: recall gap in points, ratios of flag rates and of actual rates."""
    c = F.col
    pick = lambda g, v: F.max(F.when(c(group) == g, v))
    parts = {"rec": 100 * _over(c("fy"), c("p")), "flg": _over(c("f"), c("n")), "act": _over(c("p"), c("n"))}
    both = cube.groupBy("rep", "arm").agg(*[pick(g, v).cast("double").alias(f"{n}_{e}") for n, v in parts.items() for e, g in (("a", low), ("b", high))])
    stats = {"recall_gap": c("rec_a") - c("rec_b"), "flag_ratio": _over(c("flg_a"), c("flg_b")), "actual_ratio": _over(c("act_a"), c("act_b"))}
    return percentiles(both.select("rep", "arm", *[v.alias(n) for n, v in stats.items()]), list(stats), ["arm"])
