"""The star-schema test tables read as visit records (orders), items (lines) and places (customers)."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import clean, episodes
from ..rules import RULES

THEMES = ("economy", "large", "medium", "promo", "small", "standard")
KINDS = {"BUILDING": "restaurant", "HOUSEHOLD": "restaurant", "MACHINERY": "limited", "FURNITURE": "market"}
EXCLUDED = ("",)
TABLE_RULES = replace(RULES, themes=THEMES, kinds=KINDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def severity() -> Column:
    major = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= F.lit(0.07))
    return (F.when(major, "major").when(F.col("l_returnflag") == "R", "minor")
            .when(F.col("l_returnflag") == "A", "grp").otherwise("note"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cited item or note."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("p_partkey"), severity().alias("severity"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("item_text"),
                                                F.lower("p_type").alias("theme"), F.col("p_size").alias("code"))
    return lines.join(parts, "p_partkey")


def _item_counts(spark: SparkSession, sf_dir: str, themes: bool) -> DataFrame:
    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).cast("int").alias(name)
    if themes:
        it = items(spark, sf_dir)
        cited = F.col("severity").isin("major", "minor")
        extra = [n(cited & (F.col("theme") == t), f"th_{t}") for t in THEMES]
    else:
        it = table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("line"), severity().alias("severity"))
        extra = []
    return it.groupBy("record_id").agg(
        *[n(F.col("severity") == s, f"n_{s}") for s in ("major", "minor", "grp")],
        F.bool_or((F.col("severity") == "note") & (F.col("line") == 1)).alias("permit_note"), *extra)


def records(spark: SparkSession, sf_dir: str, themes: bool = False) -> DataFrame:
    """One row per source record, all of them kept."""
    counts = _item_counts(spark, sf_dir, themes)
    zero = {k: 0 for k in counts.columns if k.startswith(("n_", "th_"))}
    key = F.col("o_orderkey") % 10
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("business_id"),
        F.to_date("o_orderdate").alias("day"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Site Investigation")
        .when(F.col("o_orderpriority") == "2-HIGH", "Re-inspection").otherwise("Routine").alias("source_type"),
        F.when((F.col("o_orderstatus") == "F") & (key == 0), "Ordered Closed")
        .when((F.col("o_orderstatus") == "P") & (key == 1), "Approved to Reopen").otherwise("Complete").alias("status"))
    r = o.join(counts, "record_id", "left").fillna(zero).fillna(False, ["permit_note"])
    r = r.withColumn("visit_type", clean.read_type(F.col("source_type")))
    points = 100 - 5 * F.col("n_major") - 3 * F.col("n_minor") - F.col("n_grp")
    r = r.withColumn("score", clean.valid_score(F.col("visit_type"), F.col("status"), points))
    letter = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score").isNotNull(), "C")
    return r.select(
        "*", letter.alias("grade"), F.col("record_id").alias("record_pos"),
        clean.closure_order_flag(F.col("status"), F.col("n_major")).alias("is_order"),
        (F.col("status") == "Approved to Reopen").alias("is_reopen"), F.lit(True).alias("kept"))


def merged(spark: SparkSession, sf_dir: str, themes: bool = False) -> DataFrame:
    extra = clean.theme_columns(TABLE_RULES) if themes else []
    return clean.visit_order(clean.merge_same_day(records(spark, sf_dir, themes), extra))


def read_visits(merged_visits: DataFrame) -> DataFrame:
    """Closures read, re-grades retyped, ``rated`` set."""
    v = episodes.read_closures(merged_visits, TABLE_RULES)
    return clean.rated_score(v.withColumn("n_items", F.col("n_major") + F.col("n_minor") + F.col("n_grp")))


def visits(spark: SparkSession, sf_dir: str, themes: bool = False) -> DataFrame:
    """Cleaned visits, straight from the tables."""
    return read_visits(merged(spark, sf_dir, themes))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per place."""
    key = F.col("c_custkey")
    first = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
             .agg(F.to_date(F.min("o_orderdate")).alias("_first")))
    cust = table(spark, sf_dir, "customer").join(first, "c_custkey", "left")
    return clean.with_kind(cust.select(
        key.alias("business_id"), F.concat(F.lit("F"), key.cast("string")).alias("facility_id"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("business_type"),
        F.concat_ws(" ", F.floor(key / 3).cast("string"), F.lit("Test St")).alias("address"),
        (92000 + key % 40).cast("string").alias("zip5"),
        (F.lit(-117.3) + (key * 61 % 1000) / F.lit(2000.0)).alias("lon"),
        (F.lit(32.5) + (key * 37 % 1000) / F.lit(1600.0)).alias("lat"),
        F.when(key % 50 == 0, "Expired").otherwise("Issued").alias("permit_status"),
        F.date_sub("_first", (key % 1000 - 100).cast("int")).alias("opened_date")), KINDS)


def area_squares() -> list[tuple[str, int, float, float, float, float]]:
    """Nine squares and one of another jurisdiction: (jurisdiction, district, x0, y0, x1, y1)."""
    out = [("TESTVILLE", 3 * r + q + 1, -117.25 + 0.1 * q, 32.55 + 0.15 * r, -117.25 + 0.1 * (q + 1), 32.55 + 0.15 * (r + 1))
           for r in range(3) for q in range(3)]
    return out + [("ELSEWHERE", 1, -117.3, 32.5, -116.8, 32.6)]


def areas(spark: SparkSession) -> DataFrame:
    """The squares as polygons: ``jurisdiction, district, ring``."""
    rows = [(j, d, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]) for j, d, x0, y0, x1, y1 in area_squares()]
    return spark.createDataFrame(rows, "jurisdiction string, district int, ring array<struct<x:double,y:double>>")


def zip_attributes(zips: DataFrame) -> DataFrame:
    """``zip5, income, pct`` for the ZIP codes of ``zips``."""
    z = zips.select("zip5").distinct()
    n = F.col("zip5").cast("int")
    return z.select("zip5", (40000.0 + 1500.0 * (n % 40)).alias("income"), ((n * 7) % 40 / 40.0).alias("pct"))


# A sample item wording for each part type, to exercise the item parser.
ITEM_WORDS = {"economy": "Hands clean and properly washed; gloves used properly",
              "large": "Proper hot & cold holding temperatures", "medium": "Food contact surfaces: clean and sanitized",
              "promo": "Sewage and wastewater properly disposed", "small": "No rodents, insects, birds, or animals",
              "standard": "Employee lockers"}


def item_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as the nested source shape: ``record_id, line, item{violation, major_violation, status, ...}``."""
    it = items(spark, sf_dir)
    words = F.create_map(*[F.lit(x) for kv in ITEM_WORDS.items() for x in kv])
    text = F.when(F.col("severity") == "note", F.col("item_text")).otherwise(
        F.concat((F.col("code") % 47 + 1).cast("string"), F.lit(". "), words[F.col("theme")]))
    status = (F.when(F.col("severity") == "major", "Out of Compliance - Major")
              .when(F.col("severity") == "minor", "Out of Compliance - Minor")
              .when(F.col("severity") == "grp", "Out of Compliance").otherwise("Note"))
    return it.select("record_id", "line", "severity", "theme", F.struct(
        F.lit(None).cast("string").alias("violation"), F.lit("N").alias("major_violation"), status.alias("status"),
        text.alias("violation_accela")).alias("item"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested business documents, the raw shape that arrives as JSON; used to test the readers."""
    its = item_structs(spark, sf_dir).groupBy("record_id").agg(F.collect_list("item").alias("violations"))
    r = records(spark, sf_dir).join(its, "record_id", "left")
    text = [F.col(c).cast("string").alias(c) for c in ("score", "grade")]
    one = F.struct("record_pos", F.lit(None).cast("string").alias("custom_id"), F.col("record_id").cast("string").alias("inspection_id"),
                   F.col("source_type").alias("type"), *text, F.col("day").cast("string").alias("completed_date"), "status", "violations")
    nested = r.groupBy("business_id").agg(F.array_sort(F.collect_list(one)).alias("inspections"))
    p = places(spark, sf_dir)
    return p.join(nested, "business_id").select(
        F.col("business_id").cast("string").alias("business_id"), "name", "business_type", "address", F.lit("Testville").alias("city"),
        F.col("zip5").alias("zip"), F.col("permit_status").alias("status"), F.col("lat").cast("string").alias("lat"),
        F.col("lon").cast("string").alias("long"), F.col("opened_date").cast("string").alias("opened_date"),
        F.transform("inspections", lambda i: i.dropFields("record_pos")).alias("inspections"))
