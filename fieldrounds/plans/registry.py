"""The query registry: a name, a function of :class:`Tables`, and the SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import clean, geo, history
from ..session import dealt_finely, stored_by
from ..sources import adapt
from .base_sql import BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TRAIN_END = "1999-12-31"
LIST_MONTH = "2001-01-01"
LIST_DATE = "2001-01-01"
ORIGIN = "2000-01-01"
ORIGINS = ("1999-07-01", "1999-10-01", "2000-01-01")


_KEPT: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
    """A table made once per source folder and application, bucketed by ``key``; every query that needs it reads it.

    A source folder is taken as it was at first use, as a query takes its files. Made again if its files are gone.
    """
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at in _KEPT:
        try:
            return spark.read.table(_KEPT[at])
        except AnalysisException:
            pass
    records = spark.read.parquet(f"{sf_dir}/orders.parquet").count()        # from the files' footers
    with dealt_finely(spark, records):
        df, _KEPT[at] = stored_by(build(), name, key)
    return df


class Tables:
    """The test tables as visits, places and items."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return adapt.table(self.spark, self.dir, name)

    @cached_property
    def records(self) -> DataFrame:
        return adapt.records(self.spark, self.dir)

    # The merged and the cleaned visits are tables that all queries read, each with other columns. They are
    # written once, bucketed by place, so that a window over places needs no shuffle of its own.
    @cached_property
    def merged(self) -> DataFrame:
        return kept(self.spark, self.dir, "merged", lambda: adapt.merged(self.spark, self.dir), "business_id")

    @cached_property
    def visits(self) -> DataFrame:
        return kept(self.spark, self.dir, "visits", lambda: adapt.read_visits(self.merged), "business_id")

    @cached_property
    def theme_visits(self) -> DataFrame:
        return kept(self.spark, self.dir, "theme_visits", lambda: adapt.read_visits(
            stored_by(adapt.merged(self.spark, self.dir, themes=True), "theme_merged", "business_id")[0]), "business_id")

    @cached_property
    def items(self) -> DataFrame:
        return adapt.items(self.spark, self.dir)

    @cached_property
    def places(self) -> DataFrame:
        return adapt.places(self.spark, self.dir)

    @cached_property
    def districts(self) -> DataFrame:
        """``business_id, district`` for the places inside an area."""
        shapes = adapt.areas(self.spark).where(F.upper("jurisdiction") == "TESTVILLE")
        return geo.point_in_polygon(self.places.select("business_id", "lon", "lat"), shapes, "business_id", 0.1)

    @cached_property
    def located(self) -> DataFrame:
        return self.places.join(self.districts, "business_id", "left")

    @cached_property
    def scored(self) -> DataFrame:
        return kept(self.spark, self.dir, "scored", self._scored, "business_id")

    def _scored(self) -> DataFrame:
        """Routine visits of the test years with the rules read as of the 1st of their month."""
        cols = ["rule_mean_all", "rule_mean12", "persistence", "prior_n", "prior_major_rate", "days_since_last"]
        rows = history.month_start_rows(self.research, cols).where(F.col("day") > TRAIN_END)
        dims = self.located.select("business_id", "business_type", "zip5", "address", "district", "permit_status")
        risk = F.round(100 * F.coalesce("prior_major_rate", F.lit(0.2))).cast("int")
        return rows.join(dims, "business_id").select(
            "business_id", "record_id", "day", "dn", "month_start", "n_major", F.col("major").cast("int").alias("y"),
            F.round("rule_mean_all", 6).alias("rule"), F.round("rule_mean12", 6).alias("rule12"), F.round("persistence", 6).alias("pers"), "prior_n",
            "days_since_last", risk.alias("risk"), "business_type", "zip5", "address", "district", "permit_status",
            geo.area_key(F.col("district"), F.col("zip5")).alias("area"))

    @cached_property
    def research(self) -> DataFrame:
        return clean.research_rows(self.visits)


def edge(df: DataFrame) -> DataFrame:
    """Plain output types: dates as text, flags as 0 and 1."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            cols.append(F.col(f.name).cast("int").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(Tables) -> DataFrame``; ``sql`` reads the shared CTEs and ``ctes``."""
    def wrap(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = lambda spark, sf_dir: edge(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {BASE}{',' + ctes.strip().rstrip(',') if ctes.strip() else ''}\n{sql.strip()}"
        return fn
    return wrap
