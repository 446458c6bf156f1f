"""Writers. Folders are partitioned by what is read back; nothing is gathered to write it."""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions import formula_safe, plain_number


def guard_text(df: DataFrame) -> DataFrame:
    """Every text column made safe to open in a spreadsheet (SNK5)."""
    return df.select(*[formula_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def write_inspections(visits: DataFrame, path: str, csv: bool = False) -> None:
    """The flat visit table by year (SNK1)."""
    rows = visits.withColumn("year", F.year("completed_date"))
    (guard_text(rows).write.partitionBy("year").option("header", True).csv(path) if csv else rows.write.partitionBy("year").parquet(path))


def flat_visits(visits: DataFrame, records: DataFrame, places: DataFrame) -> DataFrame:
    """One row per visit with the 20 columns of the flat table; source types joined in record order."""
    names = {"routine": "Routine", "reinspection": "Re-inspection", "followup": "Follow-up", "status_check": "Status Verification"}
    first = records.groupBy("business_id", "day", F.col("visit_type").alias("merged_type"), "source_type").agg(F.min("record_pos").alias("_p"))
    types = first.groupBy("business_id", "day", "merged_type").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_p", "source_type"))), lambda x: x["source_type"]).alias("_types"))
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("visit_type")]
    c = F.col
    return (visits.join(types, ["business_id", "day", "merged_type"]).join(places, "business_id").select(
        c("business_id").cast("string").alias("business_id"), "business_type", c("zip5").alias("zip"), "lat", c("lon").alias("lng"), "opened_date",
        c("record_id").cast("string").alias("inspection_id"), F.when(c("visit_type") == "complaint", c("_types")[0]).otherwise(label).alias("insp_type"),
        F.array_join("_types", "; ").alias("county_type"), "status", "score", "grade", c("day").alias("completed_date"),
        c("n_items").alias("n_violations"), "n_major", "n_minor", "n_grp", "closure", "closure_order", "closure_inferred"))


def write_visits(visits: DataFrame, table: str, buckets: int = 512) -> None:
    """The cleaned visits as a table bucketed and sorted by place: later per-place windows need no shuffle."""
    visits.write.bucketBy(buckets, "business_id").sortBy("business_id", "dn").saveAsTable(table)


# The columns of a monthly list, in order.
LIST_COLUMNS = ("facility_id", "name", "address", "business_type", "last_routine_date", "last_routine_score", "rule_mean", "due_estimate",
                "rule_order", "rule_points", "why", "last_routine_outcome", "closures_24m", "escalation", "last_closure", "reopened_on", "posted_grade",
                "no_reopen_on_record")


def write_month(lists: DataFrame, path: str) -> None:
    """Due rows of each month and district in list order, and the scoring table beside them (SNK2)."""
    text = [c for c in ("month", "district", *LIST_COLUMNS) if c in lists.columns]
    due = lists.where("due_this_month")
    rows = due.select(*[plain_number(F.col(c), 1).alias(c) if dict(lists.dtypes)[c] == "double" else F.col(c) for c in text])
    (guard_text(rows).repartition("month", "district").sortWithinPartitions("month", "district", "rule_order")
     .write.partitionBy("month", "district").option("header", True).csv(f"{path}/lists"))
    lists.write.partitionBy("month").parquet(f"{path}/scoring")


def bad_file_ids(df: DataFrame, key: str = "facility_id") -> DataFrame:
    """Ids that are not safe as file names."""
    return df.where(~F.col(key).rlike(r"^[A-Za-z0-9][A-Za-z0-9_.\-]*$") | F.col(key).isNull()).select(key)


def write_export(index: DataFrame, details: DataFrame, path: str, buckets: int = 64) -> None:
    """Index and place documents as JSON lines, places by hash bucket (SNK3)."""
    bad = bad_file_ids(index).take(1)
    if bad:
        raise ValueError(f"unsafe facility_id: {bad[0][0]!r}")
    index.write.json(f"{path}/index")
    bucket = F.pmod(F.xxhash64("facility_id"), F.lit(buckets)).alias("bucket")
    details.select("*", bucket).repartition("bucket").write.partitionBy("bucket").json(f"{path}/place")


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not be there yet; of two writers one fails."""
    fs, at = _place(spark, path)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def archive(ranking: DataFrame, run: str, path: str, meta: dict | None = None) -> dict:
    """A write-once copy of one run's ranking, with its meta data and a manifest of hashes (SNK4). Returns the manifest.

    The ranking goes to a folder of this attempt, its files are hashed where they lie, and the manifest comes last: a run counts as archived once it is
    there, an attempt that broke off is never read, and a run that has a manifest stops the write before it begins.
    """
    spark = ranking.sparkSession
    manifest = f"{path}/manifests/{run}.json"
    fs, at = _place(spark, manifest)
    if fs.exists(at):
        raise FileExistsError(f"run {run} is archived already")
    attempt = uuid.uuid4().hex
    rows, hashes = f"{path}/rankings/run={run}/attempt={attempt}", f"{path}/hashes/run={run}/attempt={attempt}"
    ranking.write.parquet(rows)
    # Of each file its name and hash; the manifest holds the hash of that list.
    file_hashes(spark, rows).where(F.col("file").like("part-%")).write.parquet(hashes)
    listed = spark.read.parquet(hashes).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "file", "sha256"))), "\n"), 256).alias("h"), F.count("*").alias("n")).first()
    said = json.dumps(meta or {}, indent=2, sort_keys=True)
    _create(spark, f"{path}/meta/{run}-{attempt}.json", said)
    out = {"run": run, "attempt": attempt, "files": listed["n"], "ranking_sha256": listed["h"], "meta_sha256": hashlib.sha256(said.encode()).hexdigest(),
           "generated": (meta or {}).get("generated")}
    _create(spark, manifest, json.dumps(out))
    return out


def verify_archive(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Files of an archived run that are missing, changed or unknown (SNK6): ``file, problem``. A changed list of hashes or meta file raises."""
    said = spark.read.schema(schemas.MANIFEST).json(f"{path}/manifests/{run}.json").first()
    known = spark.read.parquet(f"{path}/hashes/run={run}/attempt={said['attempt']}")
    listed = known.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "file", "sha256"))), "\n"), 256)).first()[0]
    meta = spark.read.format("binaryFile").load(f"{path}/meta/{run}-{said['attempt']}.json").select(F.sha2("content", 256)).first()[0]
    if (listed, meta) != (said["ranking_sha256"], said["meta_sha256"]):
        raise ValueError(f"run {run}: the hashes or the meta data are not those of the manifest")
    return verify_files(spark, f"{path}/rankings/run={run}/attempt={said['attempt']}", known)


def row_hash(df: DataFrame) -> Column:
    """52 bits of the sha-256 of a row's texts in column order, as a number that can be summed."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in sorted(df.columns)])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint: rows and the sum of their hashes (SNK6)."""
    return df.agg(F.count("*").alias("rows"), F.sum(row_hash(df)).cast("string").alias("fingerprint"))


def run_id(list_date: str, rule_json: str, ranking: DataFrame) -> DataFrame:
    """``run``: the date and 8 hex digits of the rule and the list (SNK7)."""
    f = fingerprint(ranking)
    word = F.substring(F.sha2(F.concat_ws("|", F.lit(rule_json), F.col("rows").cast("string"), "fingerprint"), 256), 1, 8)
    return f.select(F.concat(F.lit(f"forward_{list_date}-"), word).alias("run"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha-256 of each file under a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files of a manifest that are missing or changed, and files it does not name (SNK6)."""
    now = file_hashes(spark, path).where(~F.col("file").rlike(r"^[._]")).withColumnRenamed("sha256", "_now")
    j = manifest.join(now, "file", "full_outer")
    problem = (F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("_now") != F.col("sha256"), "changed"))
    return j.select("file", problem.alias("problem")).where("problem is not null")


def list_columns(df: DataFrame) -> DataFrame:
    """The filtered list as text columns in fixed order (SNK8)."""
    c = F.col
    cols = {"facility_id": c("facility_id"), "name": c("name"), "address": c("address"), "facility_type": c("kind"),
            "council_district": c("district").cast("string"), "band": c("band"), "points": c("points").cast("long").cast("string"), "flags": F.array_join("flags", " ")}
    return df.select(*[formula_safe(F.coalesce(v, F.lit(""))).alias(k) for k, v in cols.items()])


def write_list_csv(df: DataFrame, path: str, dates: dict[str, str]) -> None:
    """The filtered list with the list's dates on every row."""
    list_columns(df).select("*", *[F.lit(v).alias(k) for k, v in dates.items()]).write.option("header", True).csv(path)
