"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bound_batches
from ..storage import store as materialize  # noqa: F401  the operators' name for it

#: White space of the word contracts: blank, tab, newline, vertical tab, form feed, return.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a file scan dealt over all cores where it has fewer parts than there are cores; large inputs are left as they lie."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: Rows of an Arrow batch: they are whole documents, some of them very long.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Keep the memory of Python workers low where rows are documents."""
    bound_batches(spark, BATCH_ROWS)


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, so that further columns of any name cannot clash; null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep filters on costly columns above them.

    The optimizer would move such a filter below the projections that make the
    column and repeat them there, inside lambdas once for each element. It does
    not move filters below a nondeterministic projection, which these columns
    are made to depend on.
    """
    out = df.withColumn("__fence", F.monotonically_increasing_id())
    return out.withColumns({c: F.when(F.col("__fence") >= 0, F.col(c)) for c in columns}).drop("__fence")


#: What one operator's tasks remember in this worker, to be dropped when another operator's task comes.
_kept: dict[str, Callable[[], None]] = {}


def _claim(owner: str, forget: Callable[[], None] | None) -> None:
    for name in [k for k in _kept if k != owner]:
        _kept.pop(name)()
    if forget is not None:
        _kept[owner] = forget


def remembering(run: Callable[[Iterator], Iterator], owner: str, forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """run, whose memory is kept for the owner's next task and dropped by any other that claims the worker."""

    def wrapped(batches: Iterator) -> Iterator:
        _claim(owner, forget)
        yield from run(batches)

    return wrapped


def forgetting(run: Callable[[Iterator], Iterator], forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """run, after which forget() is called: workers outlive their tasks, what they remember should not."""

    def wrapped(batches: Iterator) -> Iterator:
        _claim("", None)
        try:
            yield from run(batches)
        finally:
            forget()

    return wrapped
