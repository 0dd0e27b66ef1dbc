"""Full loads, seed reuse and overwrite by generation."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from drayage.functions.names import check_identifier
from drayage.operators.verify import manifest
from drayage.schemas import OUTCOME
from drayage.sinks.tables import MARKER_TABLE, reset_namespace, save_table

# Fixed value: the longest dataset label, in bytes.
LABEL_BYTES = 255
DONE, FAILED = "done", "failed"


class LoadFailed(RuntimeError):
    """At least one table did not load. ``outcomes`` has a line for every table."""

    def __init__(self, outcomes: DataFrame, failed: list[str]):
        super().__init__("failed: " + ", ".join(failed))
        self.outcomes = outcomes


def spread(df: DataFrame, workers: int) -> DataFrame:
    """Rows of a source that is read unsplit, dealt out to ``workers`` partitions."""
    return df.repartition(workers) if workers > 1 else df


def full_load(spark: SparkSession, tables: list[str], read: Callable[[str], DataFrame],
              write: Callable[[str, DataFrame], None],
              shape: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
              parallel: int = 8, budget: int | None = None) -> DataFrame:
    """Move every table once, several at a time, and report each one's outcome.

    Each table is one Spark job submitted by its own driver thread. ``shape`` turns what was read
    into what is written. A worker budget (``WORKER_BUDGET``) is for a source that is read unsplit,
    such as a table through one connection: it is shared evenly by the tables, and each table's rows
    are dealt out to its share. Without one, as for files and split reads, the partitions stay as
    they are read and nothing is shuffled. Rows are counted by
    the write itself, so the source is read once. Every table gets its chance before a failure is
    raised.
    """
    if not tables:
        raise ValueError("no tables to load")
    for name in tables:
        check_identifier(name)
    workers = max(1, budget // len(tables)) if budget else 1

    def move(name: str) -> tuple:
        started = time.monotonic()
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            rows = Observation()
            ready = shape(name, spread(read(name), workers))
            write(name, ready.observe(rows, F.count(F.lit(1)).alias("rows")))
            return name, DONE, rows.get["rows"], time.monotonic() - started, None
        except Exception as e:  # noqa: BLE001 - any error of one table is that table's outcome
            return name, FAILED, None, time.monotonic() - started, str(e)

    with ThreadPoolExecutor(max_workers=min(parallel, len(tables))) as pool:
        work = inheritable_thread_target(spark)(move)
        lines = list(pool.map(work, tables))
    outcomes = spark.createDataFrame(lines, OUTCOME)
    failed = [line[0] for line in lines if line[1] != DONE]
    if failed:
        raise LoadFailed(outcomes, failed)
    return outcomes


def replace_tables(spark: SparkSession, namespace: str, tables: list[str], read: Callable[[str], DataFrame],
                   **options) -> DataFrame:
    """A full load that leaves the tables of a namespace as they are unless all of it succeeds.

    Everything is written under staging names first. Only then do the old tables step aside and the new
    ones take their places, and the old ones go when all of them stand. Whatever fails, the old tables
    get their names back and the staged ones are dropped; after a crash in between, the old tables are
    there under their names or with ``__old_`` behind them.
    """
    mark = uuid.uuid4().hex[:8]
    staged = {name: f"{check_identifier(name)}__load_{mark}" for name in tables}
    try:
        outcomes = full_load(
            spark, tables, read, lambda name, df: save_table(df, namespace, staged[name]), **options)
    except LoadFailed:
        for name in staged.values():
            spark.sql(f"DROP TABLE IF EXISTS {namespace}.{name}")
        raise
    old = {name: f"{name}__old_{mark}" for name in tables if spark.catalog.tableExists(f"{namespace}.{name}")}
    moved: list[tuple[str, str]] = []

    def rename(before: str, after: str) -> None:
        spark.sql(f"ALTER TABLE {namespace}.{before} RENAME TO {namespace}.{after}")
        moved.append((before, after))

    try:
        for name in tables:
            if name in old:
                rename(name, old[name])
            rename(staged[name], name)
    except BaseException:
        for before, after in reversed(moved):
            spark.sql(f"ALTER TABLE {namespace}.{after} RENAME TO {namespace}.{before}")
        for name in staged.values():
            spark.sql(f"DROP TABLE IF EXISTS {namespace}.{name}")
        raise
    for name in old.values():
        spark.sql(f"DROP TABLE {namespace}.{name}")
    return outcomes


def outcome_manifest(outcomes: DataFrame) -> DataFrame:
    """What was read from the source, as counted while it was moved."""
    return outcomes.filter(F.col("status") == DONE).select("table", "rows")


# --- reuse of a loaded dataset -----------------------------------------------------------------

def tpch_label(sf: float) -> str:
    return f"tpch-sf{sf:g}"


def taxi_label(months: int) -> str:
    return f"taxi-{months}mo"


def check_label(label: str) -> str:
    if not label:
        raise ValueError("a dataset needs a label that is not empty")
    if len(label.encode()) > LABEL_BYTES:
        raise ValueError(f"a label of {len(label.encode())} bytes does not fit into {LABEL_BYTES}")
    return label


def loaded_label(spark: SparkSession, namespace: str) -> str:
    """Label of the dataset a namespace holds; '' when the marker cannot be read."""
    marker = f"{namespace}.{MARKER_TABLE}"
    try:
        row = spark.table(marker).first() if spark.catalog.tableExists(marker) else None
    except AnalysisException:
        return ""
    return row["label"] if row else ""


def mark_loaded(spark: SparkSession, namespace: str, label: str) -> None:
    marker = spark.createDataFrame([(check_label(label),)], "label STRING")
    save_table(marker, namespace, MARKER_TABLE)


def reuse_seed(spark: SparkSession, namespace: str, label: str, tables: list[str],
               read: Callable[[str], DataFrame], location: str | None = None) -> DataFrame:
    """Manifest of a dataset, loaded only if the namespace does not hold it already.

    The marker is written last: a load that failed half-way is loaded again from the start.
    """
    check_label(label)
    reused = loaded_label(spark, namespace) == label
    if reused:
        counts = manifest(spark, {t: spark.table(f"{namespace}.{t}") for t in tables})
    else:
        reset_namespace(spark, namespace, location)
        outcomes = full_load(
            spark, tables, read, lambda name, df: save_table(df, namespace, name))
        mark_loaded(spark, namespace, label)
        counts = outcome_manifest(outcomes)
    return counts.withColumn("reused", F.lit(reused))


# --- overwrite by generation -------------------------------------------------------------------

def current_generation(df: DataFrame, minimum: int, column: str = "generation_id") -> DataFrame:
    """Rows that no later generation has superseded."""
    return df.filter(F.col(column) >= F.lit(minimum))
