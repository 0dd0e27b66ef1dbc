"""Monthly file sets: one file (or folder of part files) per month, read for a month window."""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.functions.months import Month, span

# The last published month and how many months can be asked for.
LAST_MONTH = Month(2024, 12)
MAX_MONTHS = 192
# A month as it stands in a path, not inside a longer name.
MONTH = r"(?<![0-9A-Za-z])\d{4}-(?:0[1-9]|1[0-2])(?![0-9A-Za-z])"


def window_start(months: int, last: Month = LAST_MONTH, longest: int = MAX_MONTHS) -> Month:
    """First month of a window of ``months`` months that ends with ``last``."""
    if not 1 <= months <= longest:
        raise ValueError(f"{months} months asked for, 1 to {longest} can be")
    return last.plus(1 - months)


def month_paths(template: str, prefix: str, lo: Month, hi: Month) -> list[str]:
    """One path per month. The template names ``{prefix}`` and ``{month}`` (yyyy-mm)."""
    return [template.format(prefix=prefix, month=m) for m in span(lo, hi)]


def with_position(df: DataFrame) -> DataFrame:
    """Add each row's file and its position in that file, taken before any filter."""
    return df.select(
        "*", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def month_scan(spark: SparkSession, template: str, prefix: str, lo: Month, hi: Month) -> DataFrame:
    """Rows of every month file in the inclusive window.

    Months outside the window are never listed or opened; a month that is not there is an error.
    All months must have the layout of the first one; ``month_scans`` reads those that do not.
    """
    paths = month_paths(template, prefix, lo, hi)
    if not paths:
        raise ValueError(f"{prefix}: the window holds no month")
    return spark.read.parquet(*paths)


def month_scans(spark: SparkSession, template: str, prefix: str, lo: Month, hi: Month) -> list[DataFrame]:
    """The months of a window as one scan per distinct file layout.

    Column types change over the years (integers become doubles, and back), and one scan can have
    one type per column only. Footers are read side by side; layouts are few.
    """
    paths = month_paths(template, prefix, lo, hi)
    if not paths:
        raise ValueError(f"{prefix}: the window holds no month")
    layout = inheritable_thread_target(spark)(lambda path: spark.read.parquet(path).schema)
    with ThreadPoolExecutor(max_workers=8) as pool:
        layouts = list(pool.map(layout, paths))
    alike: dict[str, list[str]] = {}
    for path, schema in zip(paths, layouts, strict=True):
        alike.setdefault(schema.json(), []).append(path)
    return [
        with_position(spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*group))
        for schema, group in alike.items()
    ]


def listed_files(df: DataFrame) -> list[str]:
    """Files behind a scan, in month order: zero-padded months sort as text.

    The spelling is the one ``_metadata.file_path`` uses (``file:/x``, not ``file:///x``).
    """
    return sorted(re.sub(r"^file:/+", "file:/", path) for path in df.inputFiles())


def numbered(files: list[str], first: int = 0) -> dict[str, int]:
    """Ordinals of files, from ``first`` on, in listing order."""
    return {path: first + i for i, path in enumerate(sorted(files))}


def with_file_ordinal(spark: SparkSession, df: DataFrame, ordinals: dict[str, int]) -> DataFrame:
    """Add the ordinal of each row's file; a row of a file that is not listed is an error.

    Where a month is one file the ordinal is a function of the month in the path, and months are
    few. Months of many part files are looked up in the listing, a local table whose size Spark
    knows when it plans the join.
    """
    months = {m[-1]: n for path, n in ordinals.items() if (m := re.findall(MONTH, path))}
    unlisted = F.raise_error(F.concat(F.lit("file is not in the listing: "), F.col("file_path"))).cast("bigint")
    if len(months) == len(ordinals) <= MAX_MONTHS:
        found = F.element_at(F.regexp_extract_all("file_path", F.lit(f"({MONTH})")), -1)
        ordinal = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
        return df.withColumn("file_ordinal", F.coalesce(F.try_element_at(ordinal, found).cast("bigint"), unlisted))
    listing = pa.table({
        "file_path": list(ordinals), "file_ordinal": pa.array(ordinals.values(), pa.int64())})
    joined = df.join(spark.createDataFrame(listing), "file_path", "left")
    return joined.withColumn("file_ordinal", F.coalesce("file_ordinal", unlisted))


def stable_id() -> Column:
    """File ordinal in the high bits, row position in the low 32: no global sort, no counter."""
    position = F.when(F.col("row_index") < F.lit(1 << 32), F.col("row_index")).otherwise(
        F.raise_error(F.lit("a file has more rows than an id has room for")).cast("bigint"))
    return F.shiftleft(F.col("file_ordinal"), 32) + position
