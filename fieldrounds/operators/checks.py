"""Checks on published tables: every rule in one pass, and the gate for public aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..rules import RULES, Rules

# Column names that only make sense for one place or one visit.
ROW_LEVEL_COLUMNS = ("worklist", "facility_id", "business_id", "custom_id", "inspection_id", "name", "address", "city", "lat", "lng", "lon",
                     "latitude", "longitude", "zip", "months_since", "days_since", "last_visit", "prior_band", "major_band", "due_estimate", "rule_points")
# Names of count columns in public tables.
COUNT_COLUMNS = ("n", "count", "facilities", "due", "with_prior_major", "active", "places", "inspections", "majors")


def run_checks(df: DataFrame, rules: dict[str, Column], example: str) -> DataFrame:
    """``rule, n, example`` for each rule some row breaks: one aggregate over the table (CK1)."""
    aggs = []
    for i, bad in enumerate(rules.values()):
        hit = F.coalesce(bad, F.lit(False))
        aggs += [F.count_if(hit).alias(f"n{i}"), F.min(F.when(hit, F.col(example).cast("string"))).alias(f"e{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("example")) for i, r in enumerate(rules)]))
    return df.agg(*aggs).select(rows.alias("r")).select("r.*").where("n > 0")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def list_rules(bands: list[str], kinds: tuple[str, ...], flags: list[str]) -> dict[str, Column]:
    """Rules of a published list row."""
    c = F.col
    return {
        "no facility_id": c("facility_id").isNull() | (c("facility_id") == ""), "no name or address": (F.coalesce("name", F.lit("")) == "") | (F.coalesce("address", F.lit("")) == ""),
        "kind not allowed": ~F.coalesce(c("kind").isin(*kinds), F.lit(False)), "district outside 1 to 9": ~c("district").between(1, 9),
        "flag not allowed": F.exists("flags", lambda f: ~f.isin(*flags)), "band not defined": ~c("band").isin(*bands),
        "band without points": c("band").isNotNull() & c("points").isNull(), "no last visit": c("last_day").isNull(),
        "held with points or band": F.coalesce("on_hold", F.lit(False)) & (c("band").isNotNull() | c("points").isNotNull()),
        "points not whole": c("points") != F.floor("points")}


def record_rules() -> dict[str, Column]:
    """Rules of a display record."""
    c = F.col
    items = c("n_major") + c("n_minor") + c("n_grp")
    reopen = c("status") == "Approved to Reopen"
    return {
        "no status": F.coalesce("status", F.lit("")) == "", "type not allowed": ~c("visit_type").isin("routine", "reinspection", "followup", "complaint", "status_check"),
        "grade not allowed": ~c("grade").isin("A", "B", "C"), "closure not allowed": ~c("closure").isin("health", "permit", "other"),
        "closed and closure disagree": c("closed") != c("closure").isNotNull(), "reopened_on without closure": c("reopened_on").isNotNull() & ~c("closed"),
        "reopened_on without reopened": c("reopened_on").isNotNull() & ~F.coalesce("reopened", F.lit(False)), "reopened before closed": c("reopened_on") < c("day"),
        "inferred on an order": c("closure_inferred") & (c("status") == "Ordered Closed"),
        "inferred without its reopening": c("closure_inferred") & ~F.coalesce(c("reopened") & c("reopened_on").isNotNull(), F.lit(False)),
        "unplaced on another status": c("reopen_without_closure") & (~reopen | c("closed")),
        "closure not ordered, self or inferred": c("closed") & ~c("status").isin("Ordered Closed", "Self Closed") & ~c("closure_inferred"),
        "self closed without a major": c("closed") & (c("status") == "Self Closed") & (c("n_major") == 0),
        "kept without items": ((c("status") == "Self Closed") | (c("visit_type") == "status_check")) & (items == 0) & (c("status") != "Ordered Closed"),
        "status check with a score": (c("visit_type") == "status_check") & c("score").isNotNull()}


def scorecard_rules(closure_score: int = RULES.closure_score) -> dict[str, Column]:
    """Rules of a worksheet and the readings it averages. Columns: ``points, score_card, scores_used, low, rate, high``."""
    c = F.col
    total = F.aggregate("score_card", F.lit(0.0), lambda a, r: a + r["points"])
    mean = F.aggregate("scores_used", F.lit(0.0), lambda a, u: a + u["score"]) / F.size("scores_used")
    avg = F.filter("score_card", lambda r: r["item"] == "avg_deficit")
    return {
        "row points are not weight x value": F.exists("score_card", lambda r: F.abs(r["points"] - r["weight"] * r["value"]) > 1e-9),
        "met disagrees with points": F.exists("score_card", lambda r: r["met"] != (r["points"] > 0)), "rows do not add up": F.abs(total - c("points")) > 1e-9,
        "score outside 0 to 100": F.exists("scores_used", lambda u: ~u["score"].between(0, 100)),
        "closure not read as set": F.exists("scores_used", lambda u: u["closure"] & (u["score"] != closure_score)),
        "mean does not match": (F.size(avg) > 0) & (F.size("scores_used") > 0) & (F.try_element_at(avg, F.lit(1))["value"] != 100 - F.floor(mean + 0.5)),
        "estimate out of order": ~((c("low") >= 0) & (c("low") <= c("rate") + 1e-9) & (c("rate") <= c("high") + 1e-9) & (c("high") <= 1))}


def public_problems(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """What keeps a table from being public: row-level columns, too many rows, small counts (CK2)."""
    spark = df.sparkSession
    named = [c for c in df.columns if c.lower() in ROW_LEVEL_COLUMNS]
    counts = [c for c in df.columns if c.lower() in COUNT_COLUMNS]
    aggs = [F.count("*").alias("_rows"), *[F.count_if((F.col(c) > 0) & (F.col(c) < rules.min_cell)).alias(f"_c_{c}") for c in counts]]
    found = [F.struct(F.lit("more rows than a public table").alias("problem"), F.when(F.col("_rows") > rules.max_records, F.col("_rows")).otherwise(0).alias("n"))]
    found += [F.struct(F.concat(F.lit("small counts in "), F.lit(c)).alias("problem"), F.col(f"_c_{c}").alias("n")) for c in counts]
    out = df.agg(*aggs).select(F.explode(F.array(*found)).alias("p")).select("p.problem", "p.n").where("n > 0")
    if named:
        out = out.unionByName(spark.createDataFrame([(f"row-level column {c}", 1) for c in named], "problem string, n bigint"))
    return out


def require_public(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Return the table, or raise with every problem."""
    bad = [r.problem for r in public_problems(df, rules).collect()]
    if bad:
        raise ValueError("not public: " + "; ".join(sorted(bad)))
    return df
