"""From source records to one row per place, day and visit type."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import daynum, norm_key, safe_int, theme_of
from ..rules import (EXCLUDED_TYPES, ITEM_STATUS, OK_STATUS, RULES, STATUS_RANK, VISIT_TYPES, Rules)


def _map_of(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def read_type(source_type: Column) -> Column:
    return _map_of(VISIT_TYPES)[source_type]


def item_severity(item: Column) -> Column:
    """Severity of a nested item, null for a note."""
    status = F.trim(F.coalesce(item["status"], F.lit("")))
    return (F.when(~status.startswith("Out of Compliance"), F.lit(None).cast("string"))
            .when(status.endswith("Major") | (item["major_violation"] == "Y"), "major")
            .when(status.endswith("Minor"), "minor").otherwise("grp"))


def item_text(item: Column) -> Column:
    return F.trim(F.coalesce(F.when(item["violation_accela"] != "", item["violation_accela"]),
                             item["violation"], F.lit("")))


def parse_item(item: Column) -> Column:
    """One nested item as ``{code, theme, severity, description}``; a note has a null severity."""
    text = item_text(item)
    code = F.regexp_extract(text, r"^\s*(\d+[a-z]?)\.\s*(.*)", 1)
    said = F.when(code != "", F.regexp_extract(text, r"^\s*(\d+[a-z]?)\.\s*(.*)", 2)).otherwise(text)
    return F.struct(F.when(code != "", code).alias("code"), theme_of(text).alias("theme"),
                    item_severity(item).alias("severity"), F.trim(said).alias("description"), text.alias("text"))


def kept_record(kind: Column, status: Column, n_items: Column) -> Column:
    """Which source records are visits; the rest are counted by :func:`drop_counts`."""
    cites = n_items > 0
    check = (status == "Ordered Closed") | (status.isin(*OK_STATUS, *ITEM_STATUS) & cites)
    other = status.isin(*OK_STATUS) | (status.isin(*ITEM_STATUS) & cites)
    return F.coalesce(kind.isNotNull() & F.when(kind == "status_check", check).otherwise(other), F.lit(False))


def valid_score(kind: Column, status: Column, score: Column) -> Column:
    return F.when((kind == "routine") & (status == "Complete") & (score > 0), score)


def valid_grade(status: Column, grade: Column) -> Column:
    letter = F.upper(F.trim(F.coalesce(grade, F.lit(""))))
    return F.when(letter.isin("A", "B", "C") & ~status.isin(*ITEM_STATUS), letter)


def closure_order_flag(status: Column, n_major: Column) -> Column:
    return (status == "Ordered Closed") | (status.isin(*ITEM_STATUS) & (n_major > 0))


def records_from_documents(docs: DataFrame) -> DataFrame:
    """Nested business documents to one row per source record, kept or not (``kept``)."""
    flat = docs.select("business_id", F.posexplode_outer("inspections").alias("record_pos", "i"))
    flat = flat.where(F.col("i").isNotNull())
    raw = F.coalesce(F.col("i.violations"), F.array())
    flat = flat.select(
        F.col("business_id").cast("string").alias("business_id"), "record_pos",
        F.coalesce(F.col("i.inspection_id"), F.lit("")).alias("record_id"),
        F.col("i.type").alias("source_type"), read_type(F.col("i.type")).alias("visit_type"),
        F.trim(F.coalesce(F.col("i.status"), F.lit(""))).alias("status"),
        F.col("i.completed_date").alias("_date"), safe_int(F.col("i.score")).alias("_score"),
        F.col("i.grade").alias("_grade"), raw.alias("_raw"), F.transform(raw, item_severity).alias("_tiers"))
    # Counts come from the severities alone, so texts are parsed only where ``items`` or ``notes`` are read.
    cited = F.transform(F.filter("_raw", lambda x: item_severity(x).isNotNull()), parse_item)
    notes = F.transform(F.filter("_raw", lambda x: item_severity(x).isNull()), item_text)

    def tier(name: str) -> Column:
        return F.size(F.filter("_tiers", lambda x: x == name))
    flat = flat.select("*", cited.alias("items"), notes.alias("notes"), tier("major").alias("n_major"),
                       tier("minor").alias("n_minor"), tier("grp").alias("n_grp"))
    day = F.try_to_date(F.substring("_date", 1, 10), "yyyy-MM-dd")
    kept = kept_record(F.col("visit_type"), F.col("status"), F.col("n_major") + F.col("n_minor") + F.col("n_grp")) & day.isNotNull()
    permit = F.exists("notes", lambda n: norm_key(n).contains("permit"))
    return flat.select(
        "business_id", "record_id", "record_pos", "source_type", "visit_type", "status", day.alias("day"),
        valid_score(F.col("visit_type"), F.col("status"), F.col("_score")).alias("score"),
        valid_grade(F.col("status"), F.col("_grade")).alias("grade"),
        "n_major", "n_minor", "n_grp", permit.alias("permit_note"),
        closure_order_flag(F.col("status"), F.col("n_major")).alias("is_order"),
        (F.col("status") == "Approved to Reopen").alias("is_reopen"), "items", "notes", kept.alias("kept"))


def drop_counts(records: DataFrame) -> DataFrame:
    """How many records of each source type and status were left out."""
    return (records.where(~F.col("kept"))
            .groupBy("source_type", F.when(F.col("status") == "", "blank").otherwise(F.col("status")).alias("status"))
            .agg(F.count("*").alias("n")))


def theme_columns(rules: Rules = RULES) -> list[str]:
    return [f"th_{t}" for t in rules.themes]


def merge_same_day(records: DataFrame, extra_sums: list[str] = ()) -> DataFrame:
    """One visit per (place, day, type): worst score and letter, strongest status, flags ored.

    A grouped aggregate with map-side partials, so a place that holds a third of the records is
    reduced before the shuffle. What leaves is at most one row per place, day and type: every later
    per-place window or fold is bounded by the calendar, not by the number of records.
    """
    rank = F.coalesce(_map_of(STATUS_RANK)[F.col("status")], F.lit(0))
    letter = F.when(F.col("grade") == "A", 1).when(F.col("grade") == "B", 2).when(F.col("grade") == "C", 3)
    # Every buffer is a number or a flag, so both sides of the shuffle aggregate by hash, not by sort.
    g = records.groupBy("business_id", "day", "visit_type").agg(
        F.min_by("record_id", "record_pos").alias("record_id"), F.max(rank).alias("_rank"), F.min("score").alias("score"),
        F.max(letter).alias("_letter"), *[F.sum(c).cast("int").alias(c) for c in ("n_major", "n_minor", "n_grp", *extra_sums)],
        F.bool_or("permit_note").alias("permit_note"), F.bool_or("is_order").alias("is_order"),
        F.bool_or("is_reopen").alias("is_reopen"), F.count("*").cast("int").alias("n_records"))
    status = F.coalesce(_map_of({r: s for s, r in STATUS_RANK.items()})[F.col("_rank")], F.lit("Complete"))
    grade = F.when(F.col("_letter") == 1, "A").when(F.col("_letter") == 2, "B").when(F.col("_letter") == 3, "C")
    return g.select("business_id", "day", "visit_type", "record_id", status.alias("status"), "score", grade.alias("grade"),
                    *[c for c in g.columns if c not in ("business_id", "day", "visit_type", "record_id", "_rank", "score", "_letter")])


def visit_order(visits: DataFrame) -> DataFrame:
    """``seq`` within a place: by day, a closure first, then a reopening, then the rest, then id."""
    rank = F.when(F.col("is_order"), 0).when(F.col("is_reopen"), 1).otherwise(2)
    return visits.select("*", daynum(F.col("day")).alias("dn"), F.row_number().over(
        W.partitionBy("business_id").orderBy("day", rank, "record_id")).alias("seq"))


def with_kind(places: DataFrame, kinds: dict) -> DataFrame:
    return places.withColumn("kind", _map_of(kinds)[F.col("business_type")])


def unknown_types(places: DataFrame, kinds: dict, excluded=EXCLUDED_TYPES) -> DataFrame:
    """Business types in neither list."""
    known = [*kinds, *excluded]
    return places.where(~F.col("business_type").isin(*known)).select("business_type").distinct()


def unique_facility_ids(places: DataFrame) -> DataFrame:
    """A facility id used by several businesses gets its business id appended."""
    shared = places.groupBy("facility_id").agg(F.count("*").alias("_n")).where("_n > 1").select("facility_id", F.lit(True).alias("_shared"))
    return (places.join(shared, "facility_id", "left")
            .withColumn("facility_id", F.when(F.col("_shared"), F.concat_ws("-", "facility_id", F.col("business_id").cast("string")))
                        .otherwise(F.col("facility_id"))).drop("_shared"))


def rated_score(v: DataFrame, reading: Column | int = RULES.closure_score) -> DataFrame:
    """``rated``: the score a rule reads. A routine that started a closure for a health hazard is
    read as ``reading`` whatever was recorded that day; other visit types have none."""
    value = reading if isinstance(reading, Column) else F.lit(reading)
    return v.withColumn("rated", F.when(F.col("visit_type") == "routine",
                                        F.when(F.col("closure_order") == "health", value).otherwise(F.col("score"))))


def research_rows(visits: DataFrame) -> DataFrame:
    """Visits as the history features read them: status checks dropped, a score only on a routine."""
    return (visits.where(F.col("visit_type") != "status_check")
            .withColumn("score", F.when(F.col("visit_type") == "routine", F.col("score")))
            .withColumn("major", (F.col("n_major") > 0).cast("double")))


def duplicate_routine_days(records: DataFrame) -> DataFrame:
    """Same-day routine rows of one place, which the history features must not be given."""
    return (records.where(F.col("visit_type") == "routine").groupBy("business_id", "day")
            .agg(F.count("*").alias("n")).where("n > 1"))


def require_one_routine_a_day(records: DataFrame) -> DataFrame:
    """Return ``records``, or raise when :func:`duplicate_routine_days` finds any."""
    if duplicate_routine_days(records).take(1):
        raise ValueError("same-day duplicate routine rows: merge them first (merge_same_day)")
    return records


def routine_rows(df: DataFrame, categories: list[str] = ()) -> DataFrame:
    return df.where(F.col("visit_type") == "routine").fillna("NA", list(categories) or None)


#: Who is in scope: predicates over the place columns ``kind`` and ``district``.
def scopes(public=("restaurant", "limited", "market"), banded=("restaurant",)) -> dict[str, Column]:
    listed, rated = F.col("kind").isin(*public), F.col("kind").isin(*banded)
    inside = F.col("district").isNotNull()
    return {"city": listed & inside, "city_bands": rated & inside, "train": rated, "county": listed,
            "county_bands": rated, "outside_bands": rated & ~inside}


def active(last_day: Column, at: Column, forward: bool = False, status: Column | None = None, rules: Rules = RULES) -> Column:
    """Seen within the active window before ``at``; for today's list also not expired."""
    seen = F.datediff(at, last_day) <= rules.active_days
    if forward:
        seen = seen & (F.lower(F.coalesce(status, F.lit(""))) != "expired")
    return F.coalesce(seen, F.lit(False))
