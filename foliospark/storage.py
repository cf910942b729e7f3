"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Paths stored in the innermost scratch() of this thread.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names in spark.checkpoint.dir.

    Only where that is unset and everything runs in this one process (tests) a
    local folder is set; on a cluster, where executors would each write to
    their own disk, it is an error.
    """
    at = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        at = "file:///tmp/checkpoints"
        spark.conf.set(_SETTING, at)
    return at.rstrip("/")


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def store(df: DataFrame, name: str, scoped: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to a new table (in folders by some of its last columns) in the shared folder and read it back.

    Cuts the lineage in a way that outlives the loss of any executor. The table
    is removed at the end of the innermost scratch() it is stored in, or else
    when the driver ends; with scoped=False only then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    files, at = _located(spark, path)
    files.deleteOnExit(at)
    if scoped and (held := _held.get()) is not None:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stage_table(df: DataFrame, path: str) -> DataFrame:
    """df as it is stored under path; written only if no run before has written it whole."""
    spark = df.sparkSession
    files, done = _located(spark, f"{path}/_SUCCESS")
    if not files.exists(done):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Remove a stored table, once nothing that is read later depends on it; any other is left alone."""
    if path := getattr(table, "stored_at", None):
        files, at = _located(table.sparkSession, path)
        files.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are stored inside, once nothing that is read later depends on them.

    Scopes may be nested, and each thread has its own.
    """
    held: list[str] = []
    outer = _held.set(held)
    try:
        yield
    finally:
        _held.reset(outer)
        for path in held:
            files, at = _located(spark, path)
            files.delete(at, True)


def bound_batches(spark: SparkSession, rows: int) -> None:
    """At most so many rows in an Arrow batch, as rows are whole documents or images.

    Very long ones are bounded by Spark itself, which ends a batch at
    spark.sql.execution.arrow.maxBytesPerBatch (64 MB). Plans run later than they are made, so the session keeps the least number
    that any operator asked for: it is never raised again.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if now <= 0 or now > rows:
        spark.conf.set(setting, str(rows))
