"""Readers and writers over a run folder: each query writes files from the tables, reads them back and returns what it read."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

from ..operators import clean
from ..session import dealt_finely, shared_folder
from ..sources import adapt, readers, sinks
from .lists import ONE_MONTH, this_month
from .registry import LIST_DATE, Tables, query

LIST_THROUGH = "2000-12-31"         # the day before the list date: what a published list has seen


def folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/files/{name}-{uuid.uuid4().hex}"


@query("src1_raw_documents", """SELECT record_id, business_id, CAST(day AS VARCHAR) AS day, visit_type, status, n_major, n_minor, n_grp, CAST(is_order AS INT) AS is_order, CAST(is_reopen AS INT) AS is_reopen FROM rec""")
def src1(t: Tables):
    path = folder(t, "documents")
    with dealt_finely(t.spark, t.table("orders").count()):
        adapt.documents(t.spark, t.dir).write.option("compression", "gzip").json(path)
    r = clean.records_from_documents(readers.read_documents(t.spark, path))
    return r.select(F.col("record_id").cast("long").alias("record_id"), F.col("business_id").cast("long").alias("business_id"), "day", "visit_type", "status",
                    *[F.col(c).cast("long").alias(c) for c in ("n_major", "n_minor", "n_grp")], "is_order", "is_reopen")


_FLAT = """SELECT CAST(v.business_id AS VARCHAR) AS business_id, CAST(v.record_id AS VARCHAR) AS inspection_id, zip5 AS zip, CAST(day AS VARCHAR) AS completed_date, status, score, grade,
 CASE visit_type WHEN 'routine' THEN 'Routine' WHEN 'reinspection' THEN 'Re-inspection' WHEN 'followup' THEN 'Follow-up' ELSE 'Site Investigation' END AS insp_type,
 n_items AS n_violations, n_major, closure, closure_order, CAST(closure_inferred AS INT) AS closure_inferred FROM visit v JOIN place0 p USING (business_id)"""
_FLAT_COLUMNS = ("business_id", "inspection_id", "zip", "completed_date", "status", "score", "grade", "insp_type", "n_violations", "n_major", "closure", "closure_order", "closure_inferred")


def _flat(t: Tables):
    return sinks.flat_visits(t.visits, t.records, t.places)


@query("src2_flat_csv", _FLAT)
def src2(t: Tables):
    path = folder(t, "flat-csv")
    sinks.write_inspections(_flat(t), path, csv=True)
    return readers.read_inspections(t.spark, path).select(*_FLAT_COLUMNS)


@query("snk1_flat_table", _FLAT.replace(" FROM visit v", ", year(day) AS year FROM visit v"))
def snk1(t: Tables):
    path = folder(t, "flat")
    sinks.write_inspections(_flat(t), path)
    return t.spark.read.parquet(path).select(*_FLAT_COLUMNS, "year")


@query("src6_polygons", "SELECT business_id, district FROM place WHERE district IS NOT NULL")
def src6(t: Tables):
    """Areas are a handful of shapes, so one GeoJSON object holds them all; places are put in the areas read back."""
    from ..operators import geo
    path = folder(t, "shapes")
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    one = F.struct(F.struct(F.col("jurisdiction").alias("JUR_NAME"), F.col("district").cast("string").alias("DISTRICT")).alias("properties"),
                   F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    adapt.areas(t.spark).agg(F.collect_list(one).alias("features")).write.json(path)
    shapes = readers.read_shapes(t.spark, path, "testville")
    return geo.point_in_polygon(t.places.select("business_id", "lon", "lat"), shapes, "business_id", 0.1)


@query("src7_zip_maps", "SELECT zip5, income, pct FROM zip_attr")
def src7(t: Tables):
    """ZIP codes are a few tens of thousands at most, so a map of them is a bounded row."""
    path = folder(t, "zips")
    pairs = lambda c: F.map_from_entries(F.collect_list(F.struct("zip5", c)))
    adapt.zip_attributes(t.places).agg(pairs("income").alias("inc"), pairs("pct").alias("hisp")).write.json(path)
    return readers.read_zip_attributes(t.spark, path)


def _archived(t: Tables) -> str:
    path = folder(t, "archive")
    k = F.col("business_id")
    for i, run in enumerate(("2000-07", "2000-08", "2000-09")):
        rows = t.places.select("facility_id", (k * (i + 3) % 23).cast("double").alias("points"), (k % 3 > 0).cast("int").alias("eligible"))
        sinks.archive(rows if i else rows.drop("eligible"), run, path, {"generated": run, "list_date": LIST_DATE})
    return path


_RUNS = "(VALUES (0, '2000-07'), (1, '2000-08'), (2, '2000-09')) r(i, run)"


@query("src8_archived_runs", f"SELECT run, facility_id, CAST(business_id * (i + 3) % 23 AS DOUBLE) AS points FROM place0, {_RUNS} WHERE run IN ('2000-07', '2000-09') AND (i = 0 OR business_id % 3 > 0)")
def src8(t: Tables):
    return readers.read_archive(t.spark, _archived(t), ["2000-07", "2000-09"]).select("run", "facility_id", "points")


@query("snk4_archive_counts", f"SELECT run, count(*) AS places, CAST(sum(business_id * (i + 3) % 23) AS DOUBLE) AS points, 1 AS kept, 0 AS changed FROM place0, {_RUNS} WHERE i = 0 OR business_id % 3 > 0 GROUP BY run")
def snk4(t: Tables):
    """Every run as archived and read back, that a second write of a run is refused, and that its files are those of the manifest."""
    path = _archived(t)
    try:
        sinks.archive(t.places.select("facility_id"), "2000-08", path)
        kept = 0
    except FileExistsError:
        kept = 1
    changed = sinks.verify_archive(t.spark, path, "2000-08").count()
    a = readers.read_archive(t.spark, path)
    return a.groupBy("run").agg(F.count("*").alias("places"), F.sum("points").alias("points"), F.lit(kept).alias("kept"), F.lit(changed).alias("changed"))


def _site(t: Tables) -> str:
    """An index of all places and their visits as place files."""
    path, k = folder(t, "site"), F.col("business_id")
    index = t.places.select("facility_id", "name", "address", (k % 15).cast("int").alias("points"), F.when(k % 15 > 11, "1").alias("band"),
                            F.when(k % 2 == 0, F.array(F.lit("major"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    one = F.struct("seq", F.col("day").cast("string").alias("date"), "closed", "closure", F.col("reopened_on").cast("string").alias("reopened_on"))
    visits = t.visits.groupBy("business_id").agg(F.array_sort(F.collect_list(one)).alias("v"))
    used = F.array(F.struct(F.lit(LIST_THROUGH).alias("date"), (80 + k % 20).cast("int").alias("score"), F.lit(False).alias("closure"), F.lit(None).cast("int").alias("source_score")))
    place = t.places.join(visits, "business_id").select("facility_id", F.transform("v", lambda x: x.dropFields("seq")).alias("inspections"), used.alias("scores_used"))
    sinks.write_export(index, place, path)
    return path


@query("snk3_export", "SELECT facility_id, CAST(business_id % 15 AS INT) AS points, CAST(coalesce(n, 0) AS BIGINT) AS visits, CAST(coalesce(c, 0) AS BIGINT) AS closures FROM place0 LEFT JOIN (SELECT business_id, count(*) AS n, count(*) FILTER (closed) AS c FROM visit GROUP BY 1) USING (business_id)")
def snk3(t: Tables):
    from .. import schemas
    path = _site(t)
    index = t.spark.read.schema(schemas.INDEX).json(f"{path}/index").select("facility_id", "points")
    place = t.spark.read.schema(schemas.PLACE_FILE).json(f"{path}/place").select(
        "facility_id", F.size("inspections").cast("long").alias("visits"), F.size(F.filter("inspections", lambda r: r["closed"])).cast("long").alias("closures"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return index.join(place, "facility_id", "left").select("facility_id", "points", zero("visits"), zero("closures"))


@query("src9_published_card", f"""SELECT facility_id, CASE WHEN business_id % 7 > 0 THEN CAST(business_id % 15 AS INT) END AS card_points, CASE WHEN business_id % 7 > 0 AND business_id % 15 > 11 THEN '1' END AS card_band,
 CAST(coalesce(recent, 0) AS INT) AS closures_24m, coalesce(CAST(last_day AS VARCHAR), '') AS last_closure, coalesce(CAST(back AS VARCHAR), '') AS reopened_on, CAST(business_id % 7 = 0 AS INT) AS held
FROM place0 LEFT JOIN (SELECT business_id, count(*) FILTER (day < DATE '{LIST_DATE}' AND DATE '{LIST_DATE}' - day <= 730) AS recent, arg_max(day, seq) AS last_day, last(reopened_on ORDER BY seq) AS back
 FROM visit WHERE closed AND closure = 'health' GROUP BY 1) USING (business_id)""")
def src9(t: Tables):
    path = _site(t)
    held = t.places.where("business_id % 7 = 0").select("facility_id")
    c = readers.read_card(t.spark, f"{path}/index", f"{path}/place", {"inspections_through": LIST_THROUGH}, held)
    return c.select("facility_id", "card_points", "card_band", "closures_24m", "last_closure", "reopened_on", "held")


@query("src10_notices", "SELECT facility_id, CASE WHEN business_id % 5 > 0 THEN CAST(DATE '2000-03-01' + CAST(business_id % 200 AS INT) AS VARCHAR) END AS date_sent FROM place0 WHERE business_id % 3 > 0")
def src10(t: Tables):
    path, k = folder(t, "notices"), F.col("business_id")
    sent: Column = F.when(k % 5 > 0, F.date_add(F.lit("2000-03-01").cast("date"), (k % 200).cast("int")).cast("string")).otherwise("not yet")
    t.places.where(k % 3 > 0).select("facility_id", sent.alias("date_sent"), F.lit("by hand").alias("how")).write.option("header", True).csv(path)
    return readers.read_notices(t.spark, path)


@query("snk2_month_files", "SELECT facility_id, district, CAST(last_routine_date AS VARCHAR) AS last_routine_date, CAST(due_estimate AS VARCHAR) AS due_estimate, CAST(rule_order AS BIGINT) AS rule_order, CAST(scoring AS BIGINT) AS scoring FROM wlist, (SELECT count(*) AS scoring FROM wlist) WHERE due", ONE_MONTH)
def snk2(t: Tables):
    """The month's files read back: the rows of each district's list, and how many rows the scoring table has."""
    path = folder(t, "month")
    sinks.write_month(this_month(t), path)
    rows = t.spark.read.option("header", True).csv(f"{path}/lists")
    scoring = t.spark.read.parquet(f"{path}/scoring").agg(F.count("*").alias("scoring"))
    from ..operators.joins import with_scalars
    return with_scalars(rows.select("facility_id", F.col("district").cast("int").alias("district"), "last_routine_date", "due_estimate", F.col("rule_order").cast("long").alias("rule_order")), scoring)
