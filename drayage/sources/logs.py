"""Text lines with their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file as (``line_no``, ``line``); the file is still read in pieces.

    Lines have no number before the whole file is counted, but they have an order: by the start of
    the piece, and inside a piece, which one task reads from front to back, by a rising id.
    Compare ``line_no`` values, do not count with them.
    """
    return spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
        F.col("value").alias("line"))
