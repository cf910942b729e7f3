"""Uploads as a stream: files that arrive in a folder are read once, as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import OCR_SCHEMA
from ..sources.readers import has_extension, with_path_parts


def stream_files(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """Image files with their bytes."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    return with_path_parts(files.where(has_extension(F.col("path"))))


def stream_ocr(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """OCR documents."""
    rows = spark.readStream.schema(OCR_SCHEMA).option("multiLine", "true").option("maxFilesPerTrigger", max_files).json(folder)
    valid = F.col("tokens").isNotNull() & F.col("bboxes").isNotNull() & (F.size("tokens") == F.size("bboxes"))
    return with_path_parts(rows.withColumn("path", F.input_file_name())).withColumn("valid", F.coalesce(valid, F.lit(False)))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give every micro-batch to a function of batch tables; the checkpoint remembers what has been read."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
