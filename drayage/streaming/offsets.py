"""How far streams have come, read from their checkpoints as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"(\d+)(?:\.compact)?$"


def _log(spark: SparkSession, checkpoints: str, part: str) -> DataFrame:
    """Lines of a log of all streams below a folder: stream, batch_id, value."""
    lines = spark.read.text(f"{checkpoints}/*/{part}")
    path = F.col("_metadata.file_path")
    return lines.select(
        F.regexp_extract(path, rf"([^/]+)/{part}/[^/]+$", 1).alias("stream"),
        F.regexp_extract(path, _NUMBER, 1).cast("bigint").alias("batch_id"), "value")


def planned_offsets(spark: SparkSession, checkpoints: str) -> DataFrame:
    """Per stream and batch, the end offset of its source as it was planned: stream, batch_id, log_offset."""
    return _log(spark, checkpoints, "offsets").select(
        "stream", "batch_id", F.get_json_object("value", "$.logOffset").cast("bigint").alias("log_offset")
    ).filter("log_offset IS NOT NULL")


def committed_batches(spark: SparkSession, checkpoints: str) -> DataFrame:
    """Per stream, the batches whose end is on record: stream, batch_id."""
    return _log(spark, checkpoints, "commits").filter(F.startswith("value", F.lit("{"))).select("stream", "batch_id")


def committed_offsets(spark: SparkSession, checkpoints: str) -> DataFrame:
    """The last committed batch of every stream, with its offset: stream, batch_id, log_offset.

    A batch that was planned and not committed does not count: it is run again after a restart.
    """
    last = committed_batches(spark, checkpoints).groupBy("stream").agg(F.max("batch_id").alias("batch_id"))
    return last.join(planned_offsets(spark, checkpoints), ["stream", "batch_id"])


def source_files(spark: SparkSession, checkpoints: str) -> DataFrame:
    """Every file that a stream has taken in, and in which batch: stream, batch_id, path."""
    entries = _log(spark, checkpoints, "sources/0").filter(F.startswith("value", F.lit("{")))
    return entries.select(
        "stream", F.get_json_object("value", "$.batchId").cast("bigint").alias("batch_id"),
        F.get_json_object("value", "$.path").alias("path")).distinct()
