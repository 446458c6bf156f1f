"""Streaming forms. Each takes a streaming DataFrame and returns one, or writes to a folder."""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..rules import RULES
from ..session import shared_folder
from ..sources.readers import latest_by_key


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, on storage every executor sees."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_folder(df: DataFrame, folder: str) -> None:
    """Drain what has landed into Parquet; the checkpoint makes a rerun continue where it stopped."""
    q = (df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()


def land_latest(pages: DataFrame, key: str, order: list[str], folder: str) -> None:
    """Landed page files to a log of the latest row per key of each batch (ST1).

    A replayed batch overwrites its own part of the log, so each batch counts once. The log is
    reduced on read by :func:`latest_landed`; it is never rewritten as a whole.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        latest_by_key(batch, key, order).write.mode("overwrite").parquet(f"{folder}/log/epoch={epoch}")
    q = (pages.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()


def latest_landed(spark: SparkSession, folder: str, key: str, order: list[str]) -> DataFrame:
    return latest_by_key(spark.read.parquet(f"{folder}/log").drop("epoch"), key, order)


def daily_counts(events: DataFrame, ts: str, positive, lag: str = f"{RULES.report_lag_days} days") -> DataFrame:
    """Closed days with their events and positives; a day closes ``lag`` after it ends (ST2)."""
    return (events.withWatermark(ts, lag).groupBy(F.window(ts, "1 day").alias("w"))
            .agg(F.count("*").alias("n"), F.count_if(positive).alias("positives"))
            .select(F.to_date("w.start").alias("day"), "n", "positives"))


def by_month(days: DataFrame) -> DataFrame:
    """Closed days summed to months when read; a calendar month is not a window length."""
    return days.groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


def distinct_records(records: DataFrame, ts: str, key: str, within: str) -> DataFrame:
    """One row per key among repeats that come within a delay of each other (ST4)."""
    return records.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


EPISODE_OUT = "business_id bigint, started date, closure string, reopened_on date, ended boolean"
EPISODE_STATE = "places string"
# Fixed value: places are held together in this many groups, as one call of the state function costs far more than one visit.
BUCKETS = 1024


def _advance(state: dict, v: dict, gap: int) -> bool:
    """Read one visit into a place's state; true when its episode changed."""
    d = v["dn"]
    if v["order"]:
        if not state["is_open"] or d - state["last_order"] > gap:
            state.update(started=d, closure=v["reason"], reopened=False, is_open=True, on=None)
        elif v["reason"] == "health":
            state["closure"] = "health"
        state["last_order"] = d
        if v["reopen"]:
            state.update(is_open=False, reopened=True, on=d)
        return True
    if v["reopen"] and state["started"] is not None and not state["reopened"] and (state["is_open"] or d - state["last_order"] <= gap):
        state.update(is_open=False, reopened=True, on=d)
        return True
    if state["is_open"] and v["graded"] and d > state["last_order"]:
        state["is_open"] = False
        return True
    return False


_FIELDS = ("dn", "rank", "record_id", "order", "reopen", "graded", "reason")
_STATE = ("started", "last_order", "is_open", "reopened", "closure")


def _episodes(gap: int):
    def update(key: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        # By place: its state and the visits that wait. A place of which nothing is known or waits is not held.
        places = json.loads(store.get[0]) if store.exists else {}
        for f in frames:
            for place, *v in zip(*[f[c].tolist() for c in ("business_id", *_FIELDS)]):
                # Other visits change nothing.
                if place is not None and (v[3] or v[4] or v[5]):
                    places.setdefault(place, [[None, None, False, True, None], []])[1].append(v)
        ready = store.getCurrentWatermarkMs() // 86_400_000
        out, kept, wait = [], {}, None
        for place, (held, visits) in places.items():
            rest = [v for v in visits if v[0] >= ready]
            if len(rest) < len(visits):
                state = {**dict(zip(_STATE, held)), "on": None}
                for v in sorted((v for v in visits if v[0] < ready), key=lambda v: v[:3]):
                    if _advance(state, dict(zip(_FIELDS, v)), gap):
                        out.append((int(place), state["started"], state["closure"], state["on"], not state["is_open"]))
                held = [state[c] for c in _STATE]
            if rest or held[0] is not None:
                kept[place] = (held, rest)
            if rest:
                first = min(v[0] for v in rest)
                wait = first if wait is None else min(wait, first)
        store.update((json.dumps(kept),))
        if wait is not None:
            store.setTimeoutTimestamp((wait + 1) * 86_400_000)
        day = lambda n: None if n is None else date.fromordinal(719_163 + n)
        yield pd.DataFrame([(b, day(s), c, day(on), e) for b, s, c, on, e in out], columns=["business_id", "started", "closure", "reopened_on", "ended"])
    return update


def closure_episodes(visits: DataFrame, delay: str = "30 days", gap: int = RULES.episode_gap_days) -> DataFrame:
    """Closure episodes as visits arrive (ST3): a row each time an episode starts, changes or ends.

    A visit waits until the watermark has passed its day, so late visits are read in order; what a
    place holds back is at most the visits of that delay. ``visits`` carries ``business_id, day, dn,
    record_id, visit_type, grade, is_order, is_reopen, n_major, permit_note``.
    """
    c = F.col
    flag = lambda x: F.coalesce(x, F.lit(False))
    rows = visits.select(
        F.pmod(F.xxhash64("business_id"), F.lit(BUCKETS)).alias("bucket"), c("business_id").cast("string").alias("business_id"),
        c("day").cast("timestamp").alias("at"), c("dn").cast("int").alias("dn"), F.when(c("is_order"), 0).when(c("is_reopen"), 1).otherwise(2).alias("rank"),
        "record_id", flag(c("is_order")).alias("order"), flag(c("is_reopen")).alias("reopen"),
        flag(c("visit_type").isin("routine", "followup") & c("grade").isNotNull()).alias("graded"),
        F.when(c("n_major") > 0, "health").when(c("permit_note"), "permit").otherwise("other").alias("reason"))
    return (rows.withWatermark("at", delay).groupBy("bucket")
            .applyInPandasWithState(_episodes(gap), EPISODE_OUT, EPISODE_STATE, "append", GroupStateTimeout.EventTimeTimeout))


def closing_row(visits: DataFrame, delay_days: int = 30) -> DataFrame:
    """One row that ends a feed of visits (ST3): of no place and no kind, and dated so late that the watermark passes every visit."""
    blank = {f.name: F.lit(None).cast(f.dataType) for f in visits.schema.fields}
    last = visits.agg((F.max("dn") + delay_days + 3).cast("int").alias("_at")).where("_at is not null")
    blank |= {"dn": F.col("_at").cast(visits.schema["dn"].dataType), "day": F.date_from_unix_date("_at"), "is_order": F.lit(False), "is_reopen": F.lit(False)}
    return last.select(*[v.alias(c) for c, v in blank.items()])


def latest_episodes(log: DataFrame) -> DataFrame:
    """The last word on each episode from the change log."""
    done = F.struct(F.col("reopened_on").isNotNull(), F.col("ended"), F.col("closure") == "health")
    return log.groupBy("business_id", "started").agg(
        F.when(F.max(F.col("closure") == "health"), "health").otherwise(F.min_by("closure", F.col("ended"))).alias("closure"),
        F.max("reopened_on").alias("reopened_on"), F.max_by("ended", done).alias("ended"))
