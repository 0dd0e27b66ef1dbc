"""File sinks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.functions.names import check_identifier, slug
from drayage.sinks.claims import LEASE_SECONDS, SharedFolder, claim, release


# Fixed value: bytes that one delivered file may hold.
FILE_BYTES = 3_000_000
FILE_COLUMN = "file_no"


@dataclass(frozen=True)
class Batching:
    """Bounds on what one round trip reads, one batch writes and one file holds."""

    write_rows: int
    fetch_rows: int = 10_240
    file_rows: int = 100_000
    writers: int = 16
    file_bytes: int = FILE_BYTES

    def jdbc_write(self) -> dict[str, str]:
        return {"batchsize": str(self.write_rows), "numPartitions": str(self.writers)}

    def jdbc_read(self) -> dict[str, str]:
        return {"fetchsize": str(self.fetch_rows)}

    def files(self) -> dict[str, str]:
        return {"maxRecordsPerFile": str(self.file_rows)}


# Batch sizes of the known movers, smallest to largest.
BATCHING = {
    "small": Batching(write_rows=8_192),
    "medium": Batching(write_rows=25_000, writers=32),
    "large": Batching(write_rows=100_000),
}


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{check_identifier(name)}"


def write_replace(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """The destination holds the source's content and nothing else."""
    df.write.format(fmt).options(**options).mode("overwrite").save(path)


def write_insert(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Plain insert: no key, no upsert. The table takes its columns from the data."""
    df.write.format(fmt).options(**options).mode("append").save(path)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in a text format, names and separators included."""
    return F.octet_length(F.to_json(F.struct(*[_named(f) for f in df.schema.fields]))).cast("bigint")


def file_numbers(df: DataFrame, batching: Batching, ranges: int) -> DataFrame:
    """Rows with the number of the file that they go to, so that no file passes the bounds on rows and
    bytes (a row that is too big alone has a file of its own).

    Every task deals its rows out evenly to ``ranges`` ranges, and to as many new ones whenever these hold
    as many rows as a file may, so that a range stays as small on a large table as on a small one. Each
    range is numbered by running sums: a file begins where it does, and where the sum of the bytes before
    a row crosses a multiple of half the bound, so that it holds less than half a bound and one row, which
    is big enough to stand alone otherwise.
    """
    half = batching.file_bytes // 2
    sized = df.withColumns({"_bytes": row_bytes(df), "_at": F.monotonically_increasing_id()})
    # The number of a row is that of its task and, in the lower 33 bits, its place there.
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sized = sized.withColumn("_range", F.concat_ws(
        "-", F.shiftright("_at", 33), F.floor(place / (ranges * batching.file_rows)), place % ranges))
    order = Window.partitionBy("_range").orderBy("_at")
    before = F.coalesce(F.sum(F.when(F.col("_bytes") <= half, F.col("_bytes"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = F.concat_ws("-", "_range", F.floor(before / half))
    alone = F.concat_ws("-", "_range", F.lit("row"), "_at")
    return sized.withColumn(FILE_COLUMN, F.when(F.col("_bytes") > half, alone).otherwise(small)).drop("_bytes", "_range", "_at")


def write_bounded(df: DataFrame, path: str, batching: Batching, ranges: int, fmt: str = "json") -> None:
    """Writes files within the bounds on rows and bytes, each in a folder of its number."""
    file_numbers(df, batching, ranges).repartition(F.col(FILE_COLUMN)).write.format(fmt).options(
        **TIME_OPTIONS if fmt in ("json", "csv") else {}).partitionBy(FILE_COLUMN).mode("overwrite").save(path)


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """A table whose inserts brought columns over time: the union of all of them."""
    return spark.read.option("mergeSchema", "true").parquet(path)


# Times keep their microseconds in every text format.
TIME_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
# Fixed values of the CSV format. An explicit NULL marker keeps NULL and '' apart, quotes are
# doubled, and edge spaces and line ends of any kind are data.
CSV_OPTIONS = TIME_OPTIONS | {
    "lineSep": "\n",
    "header": "false", "nullValue": r"\N", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def csv_export(df: DataFrame, path: str, file_rows: int = 100_000) -> None:
    """Headerless comma CSV in part files of at most ``file_rows`` rows.

    Values may hold line breaks, and a file of such values cannot be cut for reading, so the files
    are kept small when they are written. A text that begins with a backslash gets a second one, so
    that none can be taken for the NULL marker.
    """
    escaped = df.select([
        F.when(F.startswith(_named(f), F.lit("\\")), F.concat(F.lit("\\"), _named(f))).otherwise(_named(f)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else _named(f) for f in df.schema.fields])
    escaped.write.options(**CSV_OPTIONS).option("maxRecordsPerFile", file_rows) \
        .mode("overwrite").csv(path)


def csv_import(spark: SparkSession, path: str, schema: T.StructType,
               line_breaks: bool = True) -> DataFrame:
    """Positional, typed read. Without line breaks in values the files are cut by byte range."""
    raw = spark.read.schema(schema).options(**CSV_OPTIONS) \
        .option("multiLine", str(line_breaks).lower()).option("mode", "FAILFAST").csv(path)
    return raw.select([
        F.when(F.startswith(_named(f), F.lit("\\")), F.substring(_named(f), 2, 1 << 30)).otherwise(_named(f)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else _named(f) for f in schema.fields])


def _named(field: T.StructField) -> Column:
    return F.col(f"`{field.name}`")


RESULT_FOLDERS = ["day", "cohort", "tool"]
_STAGED, _PUBLISHED = "_staged", "_published"


def write_once(results: DataFrame, root: str, wait_seconds: float = 600.0, lease_seconds: float = LEASE_SECONDS) -> None:
    """Add results that are not there yet; one that is, or that comes twice, is an error.

    A result is found under ``day/cohort/tool`` and its slugged name. The results are evaluated once
    and written aside. Their days, a few names, are then claimed, so of two writers of one name the
    second finds what the first has published; only folders of those days are read. Files take their
    places by renaming. A write that fails takes back what it has published; what a writer that died
    has left is removed by the next one of the same day.
    """
    spark, identity, mark = results.sparkSession, [*RESULT_FOLDERS, "name"], uuid.uuid4().hex
    name = F.concat_ws("-", *[slug(F.col(c)) for c in ("scenario", "route", "dataset", "topology")])
    placed = results.withColumns({c: slug(F.col(c)) for c in RESULT_FOLDERS} | {"name": name})
    folder = SharedFolder(spark, root)
    aside = folder.path(_STAGED, mark)
    try:
        # Rebalancing gathers a folder's rows into few files and splits a folder that is too big.
        placed.hint("rebalance", *RESULT_FOLDERS).write.options(**TIME_OPTIONS).partitionBy(*RESULT_FOLDERS) \
            .json(aside.toString())
        days = folder.folders(aside)
        if not days:
            return
        identities = ", ".join(f"{c} STRING" for c in identity)
        new = spark.read.schema(identities).json(aside.toString())
        twice = new.groupBy(*identity).count().filter("count > 1").limit(1).collect()
        held = claim(folder, days, mark, lambda holder, day: _take_back(folder, holder, day), wait_seconds, lease_seconds)
        try:
            there = [folder.path(day).toString() for day in days if folder.exists(folder.path(day))]
            if there and not twice:
                existing = spark.read.schema(identities).option("basePath", root).json(there).select(*identity).distinct()
                twice = new.join(existing, identity, "left_semi").limit(1).collect()
            if twice:
                raise FileExistsError("there is already " + "/".join(twice[0][c] for c in identity))
            try:
                for file in folder.files(aside):
                    place, _, short = file.rpartition("/")
                    if place:
                        folder.move(folder.path(_STAGED, mark, file), folder.path(place, f"{mark}-{short}"))
                folder.create(folder.path(_PUBLISHED, mark), "")
            except BaseException:
                for day in days:
                    _take_back(folder, mark, day)
                raise
        finally:
            release(folder, held)
    finally:
        folder.remove(aside)
        folder.remove(folder.path(_PUBLISHED, mark))


def _take_back(folder: SharedFolder, holder: str, day: str) -> None:
    """Removes what a writer has left of a day, unless it had published all of its results."""
    if holder and not folder.exists(folder.path(_PUBLISHED, holder)) and folder.exists(folder.path(day)):
        for file in folder.files(folder.path(day)):
            if file.rpartition("/")[2].startswith(f"{holder}-"):
                folder.remove(folder.path(day, file))
    if holder:
        folder.remove(folder.path(_STAGED, holder))
