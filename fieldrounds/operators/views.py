"""What a list shows of a place: its records, closures, grade, facts and themes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import months_between_30_44
from ..rules import RULES, Rules
from .ordering import first_rows

_VISIT_COLS = ("business_id", "day", "merged_type", "seq", "visit_type", "closed", "closure", "closure_order", "closure_inferred",
               "reopened", "reopened_on", "ends_open", "unplaced")


def records_with_visits(records: DataFrame, visits: DataFrame) -> DataFrame:
    """Each source record with the reading of the visit it was merged into."""
    v = visits.select(*_VISIT_COLS)
    r = records.where("kept").select("business_id", "record_id", "record_pos", "day", F.col("visit_type").alias("merged_type"), "source_type", "status",
                                     "score", "grade", "n_major", "n_minor", "n_grp", "is_order", "is_reopen")
    return r.join(v, ["business_id", "day", "merged_type"])


def closure_starts(rv: DataFrame) -> DataFrame:
    """The record shown as the start of each closure episode (VW1): ``business_id, seq, record_id``.

    A visit that starts an episode shows its own first ordered-closed record; without one, the i-th
    such visit of a day takes the i-th ordered-closed record of that day's other visits; failing
    that, its own first record read as a closure (the first citing a major when it was inferred).
    """
    c = F.col
    order = F.struct("seq", "record_pos")
    is_oc = c("status") == "Ordered Closed"
    own_order = c("is_order") | (c("closure_inferred") & (c("n_major") > 0))
    starts = rv.where("closed").groupBy("business_id", "day", "seq").agg(
        F.min_by("record_id", F.when(c("is_order") & is_oc, order)).alias("_own_oc"),
        F.min_by("record_id", F.when(own_order, order)).alias("_own"))
    # Per place and day only visits of different types meet, so these numberings stay tiny.
    day = W.partitionBy("business_id", "day")
    spare = (first_rows(rv.where(~c("closed") & c("is_order") & is_oc), ["business_id", "day"], [c("seq"), c("record_pos")], 5)
             .select("business_id", "day", c("record_id").alias("_spare"), F.row_number().over(day.orderBy("seq", "record_pos")).alias("_i")))
    needy = starts.withColumn("_i", F.when(c("_own_oc").isNull(), F.sum(c("_own_oc").isNull().cast("int")).over(day.orderBy("seq"))))
    return (needy.join(spare, ["business_id", "day", "_i"], "left")
            .select("business_id", "seq", F.coalesce("_own_oc", "_spare", "_own").alias("record_id")))


def display_records(rv: DataFrame, starts: DataFrame) -> DataFrame:
    """One row per source record, with the episode it starts (VW2)."""
    c = F.col
    ep = (rv.where("closed").select("business_id", "seq", "closure", "reopened", "reopened_on", "closure_inferred").distinct()
          .join(starts, ["business_id", "seq"]).select(
              "business_id", "record_id", c("closure").alias("e_closure"), c("reopened").alias("e_reopened"), c("reopened_on").alias("e_on"),
              c("closure_inferred").alias("e_inferred")))
    d = rv.join(ep, ["business_id", "record_id"], "left")
    closed = c("e_closure").isNotNull()
    scored = c("visit_type").isin("routine", "followup")
    return d.select(
        "business_id", "record_id", "record_pos", "seq", "day", "status", "visit_type", "source_type", F.when(scored, c("score")).alias("score"), "grade",
        "n_major", "n_minor", "n_grp", "is_order", "is_reopen", closed.alias("closed"), c("e_closure").alias("closure"), c("e_reopened").alias("reopened"),
        c("e_on").alias("reopened_on"), (closed & c("e_inferred") & ~c("is_order")).alias("closure_inferred"),
        (c("unplaced") & c("is_reopen")).alias("reopen_without_closure"))


def open_closure(rv: DataFrame, starts: DataFrame) -> DataFrame:
    """The last closure nothing on the record ended, with the later ungraded days (VW3)."""
    c = F.col
    ep = rv.where("ends_open").groupBy("business_id").agg(F.max(F.struct("day", "seq", "closure")).alias("_e"))
    d = rv.join(ep, "business_id")
    after = c("day") > c("_e.day")
    graded = after & c("visit_type").isin("routine", "followup") & c("grade").isNotNull()
    ungraded = F.when(after & ~c("is_order") & c("grade").isNull(), c("day"))
    g = d.groupBy("business_id", "_e").agg(F.bool_or(graded).alias("_g"), F.array_sort(F.collect_set(ungraded)).alias("later_ungraded")).where("not _g")
    s = starts.join(rv.select("business_id", "record_id", "status", "is_order").distinct(), ["business_id", "record_id"]).where("is_order").select(
        "business_id", "seq", "status")
    return (g.select("business_id", c("_e.seq").alias("seq"), c("_e.day").alias("day"), c("_e.closure").alias("reason"), "later_ungraded")
            .join(s, ["business_id", "seq"], "left"))


def posted_grade(display: DataFrame) -> DataFrame:
    """The latest letter, and the B or C that a re-grade directly replaced (VW4)."""
    c = F.col
    two = first_rows(display.where(c("grade").isNotNull() & c("visit_type").isin("routine", "followup")), ["business_id"],
                     [c("seq").desc(), c("record_pos").desc()], 2)
    g = two.groupBy("business_id").agg(F.array_sort(F.collect_list(F.struct(
        -c("seq"), -c("record_pos"), "grade", "score", "day", "visit_type"))).alias("_g"))
    last, prev = F.try_element_at("_g", F.lit(1)), F.try_element_at("_g", F.lit(2))
    swapped = F.coalesce((last["visit_type"] == "followup") & (prev["visit_type"] == "routine") & prev["grade"].isin("B", "C"), F.lit(False))
    return g.select("business_id", last["grade"].alias("grade"), last["score"].alias("score"), last["day"].alias("grade_day"),
                    F.when(swapped, prev["grade"]).alias("replaced_grade"), F.when(swapped, prev["score"]).alias("replaced_score"),
                    F.when(swapped, prev["day"]).alias("replaced_day"))


FLAG_ORDER = ("major", "closed", "bc", "repeat", "major_2", "closures2", "repeat_item", "lt90_2")


def place_flags(display: DataFrame, visits: DataFrame, major_items: DataFrame, as_of: str, rules: Rules = RULES) -> DataFrame:
    """Record facts measured back from a list date (VW5).

    ``major_items`` holds the major items: ``business_id, day, visit_type, code, theme``. Escalation
    facts count distinct days, so a day recorded twice counts once.
    """
    c = F.col
    day = F.lit(as_of).cast("date")
    age = F.datediff(day, "day")
    in1, in2 = age.between(1, rules.window_days), age.between(1, rules.eligible_days)
    rt = c("visit_type") == "routine"
    d = display.where(in2).groupBy("business_id").agg(
        F.bool_or(in1 & (c("n_major") > 0)).alias("major"), F.bool_or(in1 & c("closed") & (c("closure") == "health")).alias("closed"),
        F.bool_or(in1 & rt & F.coalesce(c("grade").isin("B", "C"), F.lit(False))).alias("bc"),
        (F.count_distinct(F.when(rt & (c("n_major") > 0), c("day"))) >= 2).alias("major_2"),
        (F.count_if(c("closed") & (c("closure") == "health")) >= 2).alias("closures2"),
        (F.count_distinct(F.when(rt & (c("score") < rules.trigger_score), c("day"))) >= 2).alias("lt90_2"))
    rep = visits.where(in1 & (c("visit_type") == "reinspection")).groupBy("business_id").agg((F.count("*") >= 2).alias("repeat"))
    codes = (major_items.where(in2 & rt & c("code").isNotNull()).groupBy("business_id", "code").agg(F.count_distinct("day").alias("_d"))
             .groupBy("business_id").agg((F.max("_d") >= 2).alias("repeat_item")))
    themes = (major_items.where(in1 & (c("theme") != "other")).groupBy("business_id").agg(F.array_sort(F.collect_set("theme")).alias("_themes")))
    j = display.select("business_id").distinct()
    for part in (d, rep, codes, themes):
        j = j.join(part, "business_id", "left")
    facts = F.array_compact(F.array(*[F.when(F.coalesce(c(f), F.lit(False)), F.lit(f)) for f in FLAG_ORDER]))
    return j.select("business_id", F.concat(facts, F.coalesce("_themes", F.array().cast("array<string>"))).alias("flags"))


def window_items(items: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Items of the 36 months before a place's last record. ``items``: ``business_id, day, ..., last_day``."""
    return items.where(F.datediff("last_day", "day") <= rules.record_days)


def items_shown(items: DataFrame, keys: list[Column], rules: Rules = RULES) -> DataFrame:
    """Majors first; when the cap cuts, the oldest other items go first (RK12).

    The cap is the feature (a place file lists so many items); counts come from all items (AG14).
    """
    newest = [F.when(F.col("severity") == "major", 0).otherwise(1), F.col("day").desc(), *[k.desc() for k in keys]]
    return first_rows(window_items(items, rules), ["business_id"], newest, rules.max_items)


def cut_places(items: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Places whose window holds more items than a list shows (RK13)."""
    return (window_items(items, rules).groupBy("business_id").agg(F.count("*").alias("total"))
            .where(F.col("total") > rules.max_items))


def theme_counts(items: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Items by theme and severity, those at complaint visits, and the latest day, per place (AG14)."""
    c = F.col
    return window_items(items, rules).groupBy("business_id", "theme").agg(
        *[F.count_if(c("severity") == s).alias(s) for s in ("major", "minor", "grp")],
        F.count_if(c("visit_type") == "complaint").alias("complaint"), F.max("day").alias("latest"))


def theme_map(counts: DataFrame) -> DataFrame:
    """Theme counts as one map per place, in theme order (D14)."""
    value = F.struct("major", "minor", "grp", "complaint", F.col("latest").cast("string").alias("latest"))
    return counts.groupBy("business_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("theme", value)))).alias("theme_counts"))


def theme_facts(items: DataFrame, quotes: int = 3) -> DataFrame:
    """Themes of the last 12 months worth a line: a major, or minors on two days; with the most cited
    wordings (AG15)."""
    c = F.col
    rows = items.where(c("severity").isin("major", "minor") & (F.datediff("last_day", "day") <= RULES.window_days))
    t = rows.groupBy("business_id", "theme").agg(
        F.count_if(c("severity") == "major").alias("majors"), F.count_if(c("severity") == "minor").alias("minors"),
        F.count_distinct(F.when(c("severity") == "minor", c("day"))).alias("_days"), F.max("day").alias("latest"))
    t = t.where((c("majors") > 0) | (c("_days") >= 2)).drop("_days")
    w = rows.groupBy("business_id", "theme", "item_text").agg(F.sum(F.when(c("severity") == "major", 100).otherwise(1)).alias("_w"))
    top = first_rows(w, ["business_id", "theme"], [c("_w").desc(), c("item_text")], quotes)
    said = top.groupBy("business_id", "theme").agg(F.array_sort(F.collect_list(F.struct(-c("_w"), "item_text"))).alias("_q"))
    return t.join(said, ["business_id", "theme"]).select(
        "business_id", "theme", "majors", "minors", "latest", F.array_join(F.transform("_q", lambda x: x["item_text"]), "; ").alias("quotes"))


def place_statistics(display: DataFrame) -> DataFrame:
    """The record in numbers: by type, closures by reason and route, and 36-month sums (AG13)."""
    c = F.col
    last = display.groupBy("business_id").agg(F.max("day").alias("_last"))
    d = display.join(last, "business_id")
    recent = months_between_30_44(c("day"), c("_last")) <= 36

    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)

    def total(col: str) -> Column:
        return F.sum(F.when(recent, c(col)).otherwise(0)).alias(f"{col}_36")
    types = {"routine": "routines", "reinspection": "reinspections", "followup": "followups", "complaint": "complaints", "status_check": "status_checks"}
    return d.groupBy("business_id").agg(
        F.count("*").alias("records"), n(recent, "records_36"), *[n(c("visit_type") == k, v) for k, v in types.items()],
        total("n_major"), total("n_minor"), total("n_grp"),
        *[n(c("closed") & (c("closure") == r), f"closures_{r}") for r in ("health", "permit", "other")], n(c("closed"), "episodes"),
        n(c("closed") & (c("status") == "Ordered Closed"), "episodes_ordered"), n(c("closed") & c("closure_inferred"), "episodes_inferred"),
        n(c("closed") & (c("status") == "Self Closed"), "episodes_self"), n(c("status") == "Ordered Closed", "ordered_records"),
        n(c("reopen_without_closure"), "reopened_without_closure"))


def closure_ends(visits: DataFrame) -> DataFrame:
    """For each episode start: its reopening, the next graded visit, a later reopening, open or not (VW7)."""
    c = F.col
    w = W.partitionBy("business_id").orderBy(c("seq").desc()).rowsBetween(W.unboundedPreceding, -1)
    # Reading backwards, the frame before a row is what comes after it; the last value set is the nearest.
    graded = c("visit_type").isin("routine", "followup") & c("grade").isNotNull()
    day_graded = W.partitionBy("business_id").orderBy(c("dn").desc()).rangeBetween(W.unboundedPreceding, -1)
    v = visits.select("*", F.min(F.when(graded, c("day"))).over(day_graded).alias("next_graded"),
                      F.last(F.when(c("is_reopen"), c("day")), ignorenulls=True).over(w).alias("_next_reopen")).where("closed")
    later = F.when(~c("reopened") & (c("next_graded").isNull() | (c("_next_reopen") <= c("next_graded"))), c("_next_reopen"))
    v = v.withColumn("later_reopen", later)
    return v.select("business_id", "record_id", c("reopened_on").alias("reopen"), "next_graded", "later_reopen",
                    (~c("reopened") & c("later_reopen").isNull() & c("next_graded").isNull()).alias("open"))


def stale_places(visits: DataFrame, through: str, days: int = 365) -> DataFrame:
    """Places not seen for more than a year before the record's end (VW8)."""
    last = visits.groupBy("business_id").agg(F.max("day").alias("last_day"))
    return last.where(F.datediff(F.lit(through).cast("date"), "last_day") > days)


def apply_holds(listed: DataFrame, held: DataFrame) -> DataFrame:
    """A held place loses its points and band and goes to the end in id order (VW9)."""
    d = listed.join(held.select("facility_id", F.lit(True).alias("on_hold")).distinct(), "facility_id", "left")
    on = F.coalesce("on_hold", F.lit(False))
    return d.withColumns({"on_hold": on, "points": F.when(~on, F.col("points")), "band": F.when(~on, F.col("band"))})


def held_order() -> list[Column]:
    return [F.col("on_hold").cast("int"), F.when(F.col("on_hold"), F.col("facility_id"))]


def hold_leaks(published: DataFrame, held: DataFrame) -> DataFrame:
    """Held rows that still show points or a band, or are not marked (VW10)."""
    bad = F.col("points").isNotNull() | F.col("band").isNotNull() | ~F.coalesce("on_hold", F.lit(False))
    return published.join(held, "facility_id", "left_semi").where(bad)


def worksheet(weights: dict[str, int]) -> Column:
    """``array<struct<item, weight, value, points, met>>`` of a point rule (ML8)."""
    return F.array(*[F.struct(F.lit(k).alias("item"), F.lit(w).alias("weight"), F.col(k).cast("double").alias("value"),
                              (F.lit(w) * F.col(k)).cast("double").alias("points"), (F.lit(w) * F.col(k) > 0).alias("met")) for k, w in weights.items()])


def rule_points(weights: dict[str, int]) -> Column:
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + F.lit(float(w)) * F.col(k)
    return out
