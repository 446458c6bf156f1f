"""Closures read from a place's ordered visits.

The reading is sequential, yet almost every state it needs is "the last event of some kind before
this row", which is a window frame. One part truly feeds back on itself, the retyping of routine
visits soon after a trigger (a retyped visit does not trigger through its score); that is a fold
over a short array of events per place. Input is one row per place, day and type, so a window or an
array is bounded by the calendar.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..rules import RULES, Rules


def _windows():
    place = W.partitionBy("business_id")
    ordered = place.orderBy("seq")
    return place, ordered, ordered.rowsBetween(W.unboundedPreceding, -1)


def _last(c: Column, w) -> Column:
    return F.last(c, ignorenulls=True).over(w)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def infer_closures(visits: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Place a closure that only a later reopening shows.

    Adds ``inferred`` (the visit the closure is placed on) and ``unplaced`` (a reopening with no
    visit to place it on). A visit is found when it is the latest one before the reopening that
    either blocks the search (an order, a reopening, a graded routine) or can carry the closure
    (unscored, cites a major), it can carry it, and it is recent enough.
    """
    _, ordered, before = _windows()
    c = F.col
    graded = (c("visit_type") == "routine") & c("grade").isNotNull()
    blocks = c("is_order") | c("is_reopen") | graded
    carries = ~blocks & c("score").isNull() & (c("n_major") > 0)
    mark = F.when(blocks | carries, F.struct(c("seq"), c("dn"), carries.alias("ok")))
    event = F.when(c("is_reopen"), "r").when(c("is_order"), "o")
    plain_graded = graded & ~c("is_order") & ~c("is_reopen")
    v = visits.select(
        "*", _last(mark, before).alias("_mark"), _last(event, before).alias("_event"),
        _last(F.when(c("is_order"), c("dn")), before).alias("_order_dn"),
        F.max(F.when(plain_graded, c("dn"))).over(before).alias("_graded_dn"))
    is_open = _yes(c("_event") == "o") & ~_yes(c("_graded_dn") > c("_order_dn"))
    stale = c("_event").isNull() | (c("_event") == "r") | (c("dn") - c("_order_dn") > rules.episode_gap_days)
    tries = c("is_reopen") & ~c("is_order") & ~is_open & stale
    found = tries & _yes(c("_mark.ok")) & (c("dn") - c("_mark.dn") <= rules.infer_days)
    v = v.select(*visits.columns, tries.alias("_tries"),
                 F.when(found, c("_mark.seq")).alias("_found_seq"), F.when(found, c("_mark.dn")).alias("_found_dn"))
    closed_dn = F.when(c("is_order"), c("dn")).otherwise(c("_found_dn"))
    backward = W.partitionBy("business_id").orderBy(c("seq").desc()).rowsBetween(W.unboundedPreceding, -1)
    v = v.select("*", _last(closed_dn, before).alias("_closed_dn"), _last(c("_found_seq"), backward).alias("_next_found"))
    again = _yes(c("dn") - c("_closed_dn") <= rules.episode_gap_days)
    return v.select(*visits.columns, _yes(c("_next_found") == c("seq")).alias("inferred"),
                    (c("_tries") & c("_found_seq").isNull() & ~again).alias("unplaced"))


def read_episodes(visits: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Number the closure episodes and give each its reason, reopening and whether it is still open."""
    place, ordered, before = _windows()
    c = F.col
    order = c("is_order") | c("inferred")
    v = visits.withColumn("_order", order)
    event = F.when(c("is_reopen"), "r").when(c("_order"), "o")
    graded = (c("visit_type") == "routine") & c("grade").isNotNull() & ~c("_order") & ~c("is_reopen")
    v = v.select("*", graded.alias("_graded"), _last(event, before).alias("_event"),
                 _last(F.when(c("_order"), c("dn")), before).alias("_order_dn"),
                 F.max(F.when(graded, c("dn"))).over(before).alias("_graded_dn"))
    is_open = _yes(c("_event") == "o") & ~_yes(c("_graded_dn") > c("_order_dn"))
    v = v.withColumn("_open_before", is_open)
    late = _yes(c("dn") - c("_order_dn") > rules.episode_gap_days)
    starts = c("_order") & (~c("_open_before") | late)
    reason = F.when(c("n_major") > 0, "health").when(c("permit_note"), "permit").otherwise("other")
    v = v.select("*", starts.alias("closed"), F.when(c("_order"), reason).alias("closure_order"),
                 F.sum(starts.cast("int")).over(ordered.rowsBetween(W.unboundedPreceding, 0)).alias("episode"))
    episode = W.partitionBy("business_id", "episode")
    attaches = c("is_reopen") & (c("episode") > 0) & (
        c("_order") | c("_open_before") | _yes(c("dn") - c("_order_dn") <= rules.episode_gap_days))
    open_after = (c("_order") & ~c("is_reopen")) | (
        c("_open_before") & ~c("is_reopen") & ~(c("_graded") & _yes(c("dn") > c("_order_dn"))))
    v = v.select(
        "*", F.max(F.when(c("_order"), c("n_major") > 0)).over(episode).alias("_ep_health"),
        F.min(F.when(attaches, c("day"))).over(episode).alias("_ep_reopened"),
        F.max_by(open_after, c("seq")).over(place).alias("_ends_open"),
        F.max("episode").over(place).alias("_last_episode"))
    return v.select(
        *[x for x in visits.columns if x != "inferred"], "episode", "closed", "closure_order",
        F.when(c("closed"), F.when(c("_ep_health"), "health").otherwise(c("closure_order"))).alias("closure"),
        c("inferred").alias("closure_inferred"),
        F.when(c("closed"), c("_ep_reopened").isNotNull()).alias("reopened"),
        F.when(c("closed"), c("_ep_reopened")).alias("reopened_on"),
        (c("closed") & c("_ends_open") & (c("episode") == c("_last_episode"))).alias("ends_open"),
        (c("_order") | (c("unplaced") & ~c("_open_before") & (c("seq") > 1))).alias("_trigger"),
        c("_order").alias("_any_order"))


def retype_followups(visits: DataFrame, rules: Rules = RULES) -> DataFrame:
    """A routine soon after a trigger becomes a ``followup``.

    Triggers are closures, unplaced reopenings and low routine visits that were not themselves
    retyped. The fold runs over routine visits and triggers only and returns the few positions it
    retyped, which meet their rows again on the place id the rows are already partitioned by.
    """
    c = F.col
    low = ((c("visit_type") == "routine") & ~c("_any_order")
           & (_yes(c("score") < rules.trigger_score) | _yes(c("grade").isin("B", "C"))))
    events = (visits.where((c("visit_type") == "routine") | c("_trigger"))
              .groupBy("business_id").agg(F.array_sort(F.collect_list(F.struct(
                  "seq", "dn", (c("visit_type") == "routine").alias("routine"),
                  c("_trigger").alias("always"), low.alias("low")))).alias("events")))
    start = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<int>").alias("hits"))

    def step(acc: Column, e: Column) -> Column:
        hit = e["routine"] & _yes(e["dn"] - acc["at"] <= rules.followup_days)
        at = F.when(e["always"] | (e["low"] & ~hit), e["dn"]).otherwise(acc["at"])
        hits = F.when(hit, F.concat(acc["hits"], F.array(e["seq"]))).otherwise(acc["hits"])
        return F.struct(at.alias("at"), hits.alias("hits"))
    hits = events.select("business_id", F.aggregate("events", start, step, lambda a: a["hits"]).alias("_hits"))
    out = visits.join(hits, "business_id", "left")
    again = _yes(F.array_contains("_hits", c("seq")))
    keep = [x for x in visits.columns if x not in ("_trigger", "_any_order")]
    return out.select(*[F.when(again, "followup").otherwise(c(x)).alias(x) if x == "visit_type" else c(x) for x in keep],
                      c("visit_type").alias("merged_type"))


def read_closures(visits: DataFrame, rules: Rules = RULES) -> DataFrame:
    """All three readings in order, from visits that carry ``seq`` and ``dn``."""
    # The fold meets its rows again on the place id; with the same filter on both sides of that join
    # the two branches read one shuffle.
    visits = visits.where(F.col("business_id").isNotNull())
    return retype_followups(read_episodes(infer_closures(visits, rules), rules), rules)
