"""Readers for the raw and published files, and the small dimensions read from them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators import geo


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested business documents, one JSON object per line, plain or gzip; bad lines keep their text."""
    return spark.read.schema(schemas.DOCUMENT).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def lines_from_array(spark: SparkSession, path: str, out: str) -> None:
    """Rewrite a file that is one JSON array as one object per line, so that later reads split."""
    spark.read.schema(schemas.DOCUMENT).option("multiLine", True).json(path).write.json(out)


def read_inspections(spark: SparkSession, path: str) -> DataFrame:
    """The flat visit table as CSV: text first, then typed; undated rows dropped, ZIP stays text.

    Columns an older file lacks become typed nulls, so later steps see one schema.
    """
    raw = spark.read.option("header", True).csv(path)
    cols = []
    for f in schemas.INSPECTION.fields:
        if f.name not in raw.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.dataType.simpleString() == "date":
            cols.append(F.try_to_date(F.substring(f.name, 1, 10), "yyyy-MM-dd").alias(f.name))
        elif f.dataType.simpleString() == "int":
            cols.append(F.col(f.name).try_cast("double").try_cast("int").alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return raw.select(*cols).na.drop(subset=["completed_date"])


def latest_by_key(pages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last page wins: one row per key, by a grouped ``max_by`` that combines before the shuffle."""
    rest = [c for c in pages.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return pages.groupBy(key).agg(best).select(key, "_r.*")


def pull_complete(pages: DataFrame, key: str, total: str) -> DataFrame:
    """Unique ids, the reported total, and whether the pull holds them all."""
    return pages.agg(F.count_distinct(key).alias("unique_ids"), F.max(total).alias("total_count")).withColumn(
        "complete", F.col("unique_ids") >= F.col("total_count"))


def facility_ids(records: DataFrame) -> DataFrame:
    """Permit id of a business: its last non-blank ``custom_id``, else the business id."""
    named = F.when(F.trim("custom_id") != "", F.col("record_pos"))
    return records.groupBy("business_id").agg(
        F.coalesce(F.max_by("custom_id", named), F.col("business_id").cast("string")).alias("facility_id"))


def facilities(docs: DataFrame) -> DataFrame:
    """Facility dimension from nested documents; one row per business."""
    ids = F.filter(F.transform("inspections", lambda i: i["custom_id"]), lambda x: F.trim(x) != "")
    rows = docs.select(
        "business_id", F.coalesce(F.try_element_at(ids, F.lit(-1)), F.col("business_id")).alias("facility_id"),
        F.trim(F.coalesce("name", F.lit(""))).alias("name"), F.trim(F.coalesce("address", F.lit(""))).alias("address"),
        F.coalesce("status", F.lit("")).alias("status"))
    return latest_by_key(rows, "business_id", ["facility_id", "name", "address", "status"])


def permit_status(places: DataFrame) -> DataFrame:
    return places.select("business_id", F.coalesce(F.nullif(F.col("permit_status"), F.lit("")), F.lit("?")).alias("status"))


def read_shapes(spark: SparkSession, path: str, jurisdiction: str) -> DataFrame:
    """GeoJSON polygons of one jurisdiction as ``district, ring`` (outer ring of each polygon)."""
    raw = spark.read.schema(schemas.SHAPES).option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f"))
    f = f.where(F.upper(F.coalesce("f.properties.JUR_NAME", F.lit(""))) == jurisdiction.upper())
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    shapes = f.select(F.col("f.properties.DISTRICT").cast("int").alias("district"), ring.alias("ring"))
    bad = geo.check_districts(shapes).take(1)
    if bad:
        raise ValueError(f"expected districts 1..N, got {bad[0].n} shapes numbered {bad[0].lo} to {bad[0].hi}")
    return shapes


def read_zip_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Cached ZIP attributes: two JSON maps to ``zip5, income, pct``."""
    raw = spark.read.schema("inc map<string,double>, hisp map<string,double>").option("multiLine", True).json(path)
    inc = raw.select(F.explode("inc").alias("zip5", "income"))
    return inc.join(raw.select(F.explode("hisp").alias("zip5", "pct")), "zip5", "full_outer")


def read_archive(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """Every archived ranking, eligible rows only. Only attempts that a manifest names are read, and of those only the runs asked for."""
    named = spark.read.schema(schemas.MANIFEST).json(f"{path}/manifests").select("run", "attempt")
    there = (named.where(F.col("run").isin(*runs)) if runs else named).collect()        # one short row a run
    folders = [f"{path}/rankings/run={r['run']}/attempt={r['attempt']}" for r in there]
    a = spark.read.option("mergeSchema", True).option("basePath", f"{path}/rankings").parquet(*folders).drop("attempt")
    if "eligible" not in a.columns:
        a = a.withColumn("eligible", F.lit(None).cast("int"))
    return a.where("eligible = 1 or eligible is null")


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select("facility_id", F.try_to_date("date_sent", "yyyy-MM-dd").alias("date_sent"))


def read_card(spark: SparkSession, index_path: str, place_path: str, meta: dict, held: DataFrame | None = None) -> DataFrame:
    """A published point-rule list read back: points, band, flags, grade and closure facts per facility.

    A sample export is refused. A held facility keeps its record and loses points, band and readings.
    """
    if meta.get("sample"):
        raise ValueError("a sample export is not a list")
    through = F.lit(meta["inspections_through"]).cast("date")
    list_date = F.date_add(through, 1)
    index = spark.read.schema(schemas.INDEX).json(index_path)
    place = spark.read.schema(schemas.PLACE_FILE).json(place_path)
    health = F.filter("inspections", lambda r: r["closed"] & (r["closure"] == "health"))
    recent = F.filter(health, lambda r: (F.to_date(r["date"]) >= F.date_sub(list_date, 730)) & (F.to_date(r["date"]) < list_date))
    facts = place.select("facility_id", "scores_used", F.size(recent).alias("closures_24m"),
                         F.try_element_at(health, F.lit(-1)).alias("last"))
    rows = index.join(facts, "facility_id", "left")
    if held is not None:
        rows = rows.join(held.select("facility_id", F.lit(True).alias("held")).distinct(), "facility_id", "left")
    else:
        rows = rows.withColumn("held", F.lit(False))
    shown = ~F.coalesce("held", F.lit(False))
    letter = F.concat(F.col("grade.grade"), F.lit(" ("), F.col("grade.date"), F.lit(")"))
    return rows.select(
        "facility_id", F.when(shown, F.col("points")).alias("card_points"), F.when(shown, F.col("band")).alias("card_band"),
        "flags", F.coalesce(letter, F.lit("")).alias("posted_grade"),
        F.coalesce(F.col("grade.open_closure.date"), F.lit("")).alias("no_reopen_on_record"),
        F.when(shown & F.col("points").isNotNull(), F.col("scores_used")).alias("scores_used"),
        F.coalesce("closures_24m", F.lit(0)).alias("closures_24m"), F.coalesce(F.col("last.date"), F.lit("")).alias("last_closure"),
        F.coalesce(F.col("last.reopened_on"), F.lit("")).alias("reopened_on"), (~shown).alias("held"))
