"""Session settings, the shared folder, and the one place where lineage is cut."""
from __future__ import annotations

import contextlib
import contextvars
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("fieldrounds")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (builder.config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", memory))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a single-machine session may do without it and gets a temporary folder; on a cluster a local folder would be a
    different one on each machine, so there its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


# Paths of the tables that ``stored`` wrote for the piece of work under way in this context; none outside such a piece.
_WORK: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("work", default=None)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``stored`` wrote and that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_stored_at", None):
            delete(t.sparkSession, t._stored_at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote and that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM finds that no frame uses them; ask it to look now, before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def begin_work(spark: SparkSession) -> None:
    """Start a piece of work whose tables go when the next one starts in this context (a thread has its own).

    What the earlier piece returned must have been written by then; a table of it that is still wanted is taken out with ``keep``.
    """
    for path in _WORK.get() or []:
        delete(spark, path)
    _WORK.set([])
    release(spark)


def keep(table: DataFrame) -> DataFrame:
    """Take a table that ``stored`` wrote out of the piece of work under way."""
    work = _WORK.get()
    if work and getattr(table, "_stored_at", None) in work:
        work.remove(table._stored_at)
    return table


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it from there.

    For frames that several branches read, or whose rows depend on their placement. Unlike a checkpoint of rows it
    keeps column pruning, filters and sizes, and a lost executor costs a re-read, not a re-run.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    work = _WORK.get()
    if work is not None:
        work.append(path)
    return out


@contextlib.contextmanager
def dealt_finely(spark: SparkSession, rows: int, per_task: int = 100_000) -> Iterator[None]:
    """While it lasts, shuffles have at least a partition for each ``per_task`` of ``rows``, so that a task's share does not grow with the table."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(before), -(-rows // per_task))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def stored_by(df: DataFrame, name: str, key: str | None) -> tuple[DataFrame, str]:
    """``stored`` as a table of this session, in as many buckets of ``key`` as there are shuffle partitions, sorted by it.

    Returns the table and its name.
    """
    spark = df.sparkSession
    called = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/tables/{called}"
    writer = df.write.format("parquet").option("path", path)
    if key is not None:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Dealt as the buckets are, so that each task writes one bucket's file.
        writer = df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key)
    writer.saveAsTable(called)
    return spark.read.table(called), called


def cut(df: DataFrame) -> DataFrame:
    """``stored``, under the name that earlier code uses."""
    return stored(df, "cut")
