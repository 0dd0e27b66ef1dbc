"""Did everything arrive: manifests, parity, consistency, publication."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.functions.names import check_identifier
from drayage.operators.ordering import null_safe_join
from drayage.schemas import MANIFEST

# Fixed value: the count of a sink table that cannot be counted.
UNCOUNTABLE = -1


class MissingFromManifest(ValueError):
    """A table to check has no expected row count."""


def manifest(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table. A file count reads no column, only row-group sizes."""
    if not tables:
        return spark.createDataFrame([], MANIFEST)
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(check_identifier(name)).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):/+"


def file_manifest(spark: SparkSession, locations: dict[str, str]) -> DataFrame:
    """Row count of every table, from one scan over the Parquet files of all of them.

    No column is read, only row-group sizes, and the plan is the same for one table and for thousands:
    files are counted each, and a file belongs to the table whose folder (or file) it lies in. A table
    without a row has 0 rows, one without a folder is an error.
    """
    if not locations:
        return spark.createDataFrame([], MANIFEST)
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def qualified(location: str) -> str:
        path = path_of(location)
        return path.getFileSystem(conf).makeQualified(path).toUri().toString()

    names = spark.createDataFrame(
        [(check_identifier(n), qualified(p)) for n, p in locations.items()], "table STRING, place STRING").select(
        "table", F.regexp_replace("place", _SCHEME, "$1:/").alias("place"))
    counted = (
        spark.read.schema(T.StructType([])).option("recursiveFileLookup", "true").parquet(*locations.values())
        .groupBy(F.regexp_replace("_metadata.file_path", _SCHEME, "$1:/").alias("file")).agg(F.count(F.lit(1)).alias("rows")))
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    found = counted.select(F.explode(above).alias("place"), "rows")
    return names.join(found, "place", "left").groupBy("table").agg(
        F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("rows"))


def manifest_total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"))


def save_manifest(counts: DataFrame, root: str, source: str, label: str) -> None:
    """Keep the counts of a loaded dataset, so that later loads never rescan the source.

    Replaces what was saved for the same source and label and nothing else.
    """
    counts.select("table", "rows", F.lit(source).alias("source"), F.lit(label).alias("label")) \
        .write.partitionBy("source", "label").mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").parquet(root)


def saved_manifest(spark: SparkSession, root: str, source: str, label: str) -> DataFrame:
    """The saved counts of one source and label; only their folder is read."""
    saved = spark.read.schema(f"{MANIFEST}, source STRING, label STRING").parquet(root)
    return saved.filter((F.col("source") == source) & (F.col("label") == label)).select("table", "rows")


def sink_counts(spark: SparkSession, names: Iterable[str],
                read: Callable[[str], DataFrame]) -> DataFrame:
    """Counts of the sink tables that can be opened and counted; the others are simply absent.

    Every table is counted by a job of its own, so one that breaks takes no other with it.
    """
    def counted(name: str) -> int | None:
        try:
            return read(name).count()
        except Exception:  # noqa: BLE001 - whatever is wrong with a sink table, it has no count
            return None

    names = list(names)
    with ThreadPoolExecutor(max_workers=8) as pool:
        counts = list(pool.map(inheritable_thread_target(spark)(counted), names))
    return spark.createDataFrame(
        [(check_identifier(n), c) for n, c in zip(names, counts, strict=True) if c is not None], MANIFEST)


def require_expected(names: Iterable[str], expected: DataFrame) -> None:
    known = {r["table"] for r in expected.select("table").collect()}  # table names, never rows
    for name in names:
        if name not in known:
            raise MissingFromManifest(f"{name}: how many rows to expect is not known")


def count_parity(expected: DataFrame, delivered: DataFrame, on: list[str] | None = None,
                 tables: Iterable[str] | None = None) -> DataFrame:
    """Expected against delivered rows, one line per expected table. Counts only.

    ``tables`` names what was asked for: one of them without an expected count is an error.
    """
    if tables is not None:
        require_expected(tables, expected)
    keys = on or ["table"]
    sink = F.coalesce(F.col("delivered"), F.lit(UNCOUNTABLE).cast("bigint"))
    arrived = delivered.select(*keys, F.col("rows").alias("delivered"))
    equal = F.col("source") == F.col("sink")
    return (
        expected.join(arrived, keys, "left")
        .select(*keys, F.col("rows").alias("source"), sink.alias("sink"))
        .withColumn("count_match", equal)
        .withColumn("match", equal)
    )


def parity_pass(parity: DataFrame) -> DataFrame:
    """One line: do all tables match."""
    return parity.agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if(~F.coalesce("match", F.lit(False))).alias("mismatches"),
        F.coalesce(F.bool_and(F.coalesce("match", F.lit(False))), F.lit(True)).alias("parity_pass"),
    )


def convergence(expected: DataFrame, delivered: DataFrame, run: list[str] | None = None) -> DataFrame:
    """State of every table, and whether the check gets as far as that table.

    ``expected`` carries ``seed_pos``. Tables are checked in seed order and the check stops at the
    first that is not complete, so a later overshoot is seen only once the earlier ones converged.
    The windows run over tables of one load, never over table rows.
    """
    run = run or []
    got = delivered.select(*run, "table", F.col("rows").alias("delivered"))
    have = F.coalesce(F.col("delivered"), F.lit(UNCOUNTABLE).cast("bigint"))
    state = (
        F.when(have < F.col("rows"), "pending").when(have == F.col("rows"), "converged")
        .otherwise("overshoot")
    )
    earlier = Window.partitionBy(*run).orderBy("seed_pos").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.max(F.when(F.col("state") != "converged", 1).otherwise(0)).over(earlier)
    return (
        expected.join(got, [*run, "table"], "left")
        .select(*run, "table", "seed_pos", F.col("rows").alias("expected"),
                have.alias("delivered"), state.alias("state"))
        .withColumn("checked", F.coalesce(stopped, F.lit(0)) == 0)
    )


class NotConverged(RuntimeError):
    """A load ended with tables that are not complete."""


class Overshoot(NotConverged):
    """A table holds more rows than its source."""


def require_convergence(states: DataFrame) -> DataFrame:
    """The states, if every table has converged; else the first that has not is the error."""
    order = ["seed_pos", "table"]
    open_tables = states.filter("state <> 'converged'").orderBy(*order).limit(1).collect()
    too_many = states.filter("checked AND state = 'overshoot'").orderBy(*order).limit(1).collect()
    for line in too_many or open_tables:
        kind = Overshoot if too_many else NotConverged
        raise kind(f"{line['table']}: {line['delivered']} of {line['expected']} rows")
    return states


def rep_consistency(reps: DataFrame, result: list[str], rep: str = "rep",
                    rows: str = "rows") -> DataFrame:
    """Does every repetition of a result load what its first one loaded; who is first not to.

    A result has as many row totals as it has opinions, so repetitions collapse to one line per
    total before they are compared. Of those the earliest is the first repetition's and the next
    one belongs to the first offender; the rank limit is applied before the shuffle.
    """
    totals = reps.groupBy(*result, rows).agg(F.min(rep).alias("since"))
    order = Window.partitionBy(*result).orderBy("since")
    two = totals.withColumn("nth", F.row_number().over(order)).filter("nth <= 2")
    return two.groupBy(*result).agg(
        F.max(F.when(F.col("nth") == 1, F.col(rows))).alias("first_rows"),
        F.max(F.when(F.col("nth") == 2, F.col("since"))).alias("first_offender"),
        (F.max("nth") == 1).alias("consistent"),
    )


def publish_gate(reps: DataFrame, result: list[str], passed: str = "parity_pass") -> DataFrame:
    """Repetitions of the results in which every repetition passed parity; unknown is not passed.

    The few results with a failure are taken out, so a result of any size is no hot key.
    """
    failing = reps.filter(~F.coalesce(passed, F.lit(False))).select(*result).distinct()
    return null_safe_join(reps, failing, result, "left_anti")
