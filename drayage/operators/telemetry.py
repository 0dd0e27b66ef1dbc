"""Raw counters, metric points and logs into per-run usage, deltas and series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.functions.casts import minute_of, parse_number, zoneless

# ---------------------------------------------------------------- fixed values
# Server status variables that are kept, and the names they get.
STATUS_NAMES = {
    "Bytes_received": "bytesReceived",
    "Bytes_sent": "bytesSent",
    "Created_tmp_disk_tables": "tempDiskTables",
    "Innodb_buffer_pool_read_requests": "bufferPoolReadRequests",
    "Innodb_buffer_pool_reads": "bufferPoolReads",
    "Innodb_data_reads": "dataReads",
    "Innodb_data_writes": "dataWrites",
    "Innodb_os_log_written": "logBytesWritten",
    "Threads_connected": "threadsConnected",
    "Threads_running": "threadsRunning",
}
STATUS_PREFIX = "mysql"

# Statistic columns of a wide database snapshot, per group, and the names they get.
DATABASE_COUNTERS = {
    "blks_read": "blocksRead", "blks_hit": "blocksHit", "temp_files": "tempFiles",
    "temp_bytes": "tempBytes", "deadlocks": "deadlocks", "tup_returned": "tuplesReturned",
    "tup_fetched": "tuplesFetched", "tup_inserted": "tuplesInserted",
    "tup_updated": "tuplesUpdated", "tup_deleted": "tuplesDeleted",
}
WAL_COUNTERS = {
    "wal_records": "records", "wal_fpi": "fullPageImages", "wal_bytes": "bytes",
    "wal_buffers_full": "buffersFull", "wal_write": "writes", "wal_sync": "syncs",
    "wal_write_time": "writeMillis", "wal_sync_time": "syncMillis",
}
BGWRITER_COUNTERS = {
    "checkpoints_timed": "checkpointsTimed", "checkpoints_req": "checkpointsRequested",
    "checkpoint_write_time": "checkpointWriteMillis",
    "checkpoint_sync_time": "checkpointSyncMillis", "buffers_checkpoint": "buffersCheckpoint",
    "buffers_clean": "buffersClean", "maxwritten_clean": "maxwrittenClean",
    "buffers_backend": "buffersBackend", "buffers_backend_fsync": "backendFsyncs",
    "buffers_alloc": "buffersAllocated",
}
IO_COUNTERS = ["reads", "writes", "writebacks", "extends", "hits", "evictions", "reuses", "fsyncs"]
TABLE_COUNTERS = {
    "n_live_tup": "liveTuples", "n_dead_tup": "deadTuples",
    "n_ins_since_vacuum": "insertsSinceVacuum", "vacuum_count": "vacuums",
    "autovacuum_count": "autovacuums", "analyze_count": "analyzes",
    "autoanalyze_count": "autoanalyzes",
}
# Everything a snapshot reads, in the order its errors are told.
READ_GROUPS = ["database", "wal", "bgwriter", "io", "tables", "vacuum", "replicationSlots"]
SNAPSHOT_GROUPS = {
    "database": DATABASE_COUNTERS, "wal": WAL_COUNTERS, "bgwriter": BGWRITER_COUNTERS,
    "vacuum": {"in_progress": "inProgress"},
}
PHASES = ["before", "after", "after_teardown"]

# Metrics kept for a run, in order, each with its statistic.
METRIC_SPECS = [
    ("CPUUtilization", "Average"),
    ("FreeableMemory", "Minimum"),
    ("DatabaseConnections", "Maximum"),
    ("DiskQueueDepth", "Maximum"),
    ("ReadIOPS", "Average"),
    ("WriteIOPS", "Average"),
    ("ReadLatency", "Average"),
    ("WriteLatency", "Average"),
    ("ReadThroughput", "Average"),
    ("WriteThroughput", "Average"),
    ("NetworkReceiveThroughput", "Average"),
    ("NetworkTransmitThroughput", "Average"),
    ("FreeStorageSpace", "Minimum"),
    ("OldestReplicationSlotLag", "Maximum"),
    ("TransactionLogsDiskUsage", "Maximum"),
]
PADDING_SECONDS = 60
LOG_LEVELS = r'"level":"(ERROR|FATAL)"'
LOG_TAIL = 3_500
# ------------------------------------------------------------ end fixed values


# --- resource usage ---------------------------------------------------------------------------

def container_states(samples: DataFrame, within: Sequence[Column] = ()) -> DataFrame:
    """One running state per container and set of labels. Works on a batch or a stream; there it is one
    for each value of ``within`` too, such as a stretch of time.

    A sample counts if its container runs and its CPU counter is not zero. Every part of the state
    is a number, so samples are hash-combined before the shuffle and a container with most of the
    samples sends one row per task.
    """
    def total(field: str) -> Column:
        zero = F.lit(0).cast("bigint")
        networks = F.coalesce(F.col("networks"), F.array())
        return F.aggregate(networks, zero, lambda acc, n: acc + F.coalesce(n[field], zero))

    valid = (F.col("state") == "running") & (F.col("cpu_ns") != 0)
    at = F.when(valid, F.col("seq"))
    read = samples.select(
        "container_id", "role", "image", "image_id", "seq", at.alias("at"), "initial_pass",
        F.col("cpu_ns").alias("cpu"), "mem", total("rx").alias("rx"), total("tx").alias("tx"), *within)
    readings = ["cpu", "rx", "tx"]
    extra = read.columns[11:]
    return read.groupBy("container_id", "role", "image", "image_id", *extra).agg(
        F.min("seq").alias("listed_at"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.min_by("initial_pass", "at").alias("initial"),
        *[F.min_by(c, "at").alias(f"first_{c}") for c in readings],
        *[F.max_by(c, "at").alias(f"last_{c}") for c in readings],
        F.max(F.when(F.col("at").isNotNull(), F.col("mem"))).alias("peak_mem"),
        F.count("at").alias("samples"),
    )


def usage_from_states(states: DataFrame) -> DataFrame:
    """Usage per container; its labels are those it was first listed with."""
    merged = states.groupBy("container_id").agg(
        *[F.min_by(c, "listed_at").alias(c) for c in ("role", "image", "image_id")],
        F.min_by("initial", "first_at").alias("initial"),
        *[F.min_by(f"first_{c}", "first_at").alias(f"first_{c}") for c in ("cpu", "rx", "tx")],
        *[F.max_by(f"last_{c}", "last_at").alias(f"last_{c}") for c in ("cpu", "rx", "tx")],
        F.max("peak_mem").alias("peak_mem"), F.sum("samples").alias("samples"),
    )

    def used(counter: str) -> Column:
        last = F.coalesce(F.col(f"last_{counter}"), F.lit(0))
        base = F.when(F.col("initial"), F.col(f"first_{counter}")).otherwise(F.lit(0))
        return F.when(last >= base, last - base).otherwise(F.lit(0)).cast("bigint")

    return merged.select(
        "container_id", "role", "image", "image_id",
        (used("cpu").cast("double") / F.lit(1e9)).alias("cpu_seconds"),
        F.coalesce("peak_mem", F.lit(0).cast("bigint")).alias("peak_mem_bytes"),
        used("rx").alias("net_rx_bytes"), used("tx").alias("net_tx_bytes"),
        F.col("samples").cast("int").alias("samples"),
    )


def usage_rollup(samples: DataFrame) -> DataFrame:
    """Usage per container from cumulative counters.

    The first reading is the baseline only if it comes from the initial pass: a container seen
    later was born later and is counted from zero. A counter that went backwards counts as no
    usage. A container without any valid sample still has a line, with zeros.
    """
    return usage_from_states(container_states(samples))


# --- counters ---------------------------------------------------------------------------------

def _lookup(name: Column, names: dict[str, str]) -> Column:
    out = F
    for key, label in names.items():
        out = out.when(name == key, F.lit(label))
    return out


def status_counters(status: DataFrame, keys: list[str]) -> DataFrame:
    """(name, value text) status lists to (counter, value); unwanted names fall out at the scan."""
    kept = status.filter(F.col("name").isin(*STATUS_NAMES))
    label = F.concat(F.lit(STATUS_PREFIX + "."), _lookup(F.col("name"), STATUS_NAMES))
    return kept.select(*keys, label.alias("counter"), parse_number(F.col("value")).alias("value")) \
        .filter(F.col("value").isNotNull())


def status_errors(status: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Values of wanted names that are no number, as text, the last one per snapshot.

    A value that cannot be read is recorded and never fails the run.
    """
    bad = status.filter(F.col("name").isin(*STATUS_NAMES) & parse_number(F.col("value")).isNull())
    text = F.concat(F.col("name"), F.lit(": not a number: "), F.coalesce("value", F.lit("NULL")))
    return bad.groupBy(*keys).agg(F.max_by(text, order).alias("error"))


def _unpivot(df: DataFrame, keys: list[str], values: list[tuple[Column, Column]]) -> DataFrame:
    """One row per (counter name, value) pair, in a single pass without a shuffle."""
    pairs = F.array(*[
        F.struct(name.alias("counter"), value.cast("double").alias("value"))
        for name, value in values
    ])
    return df.select(*keys, F.explode(pairs).alias("pair")).select(*keys, "pair.*")


def wide_counters(snapshots: DataFrame, keys: list[str], groups: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Wide snapshots to (``group.name``, value). A group is one struct column.

    A group that could not be read is NULL and gives no counters.
    """
    groups = SNAPSHOT_GROUPS if groups is None else groups
    values = [
        (F.lit(f"{group}.{label}"), F.col(group)[column])
        for group, columns in groups.items() for column, label in columns.items()
    ]
    return _unpivot(snapshots, keys, values).filter(F.col("value").isNotNull())


def wide_errors(keys: list[str], snapshots: DataFrame, groups: list[str]) -> DataFrame:
    """Names of the groups that could not be read, joined in group order; '' when all were.

    A group is a column, NULL when it could not be read: a struct of counters, or the rows of a group
    that has several (I/O by backend, tables, replication slots).
    """
    failed = [F.when(F.col(g).isNull(), F.lit(f"{g}: unreadable")) for g in groups]
    return snapshots.select(*keys, F.concat_ws("; ", *failed).alias("error"))


def io_totals(backends: DataFrame, keys: list[str]) -> DataFrame:
    """I/O counters summed over all backends, nothing counted as zero, as ``io.<name>``."""
    sums = backends.groupBy(*keys).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in IO_COUNTERS])
    return _unpivot(sums, keys, [(F.lit(f"io.{c}"), F.col(c)) for c in IO_COUNTERS])


def table_counters(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Per-table vacuum and analyze counters as ``table.<relation>.<name>``."""
    values = [
        (F.concat_ws(".", F.lit("table"), F.col("relname"), F.lit(label)), F.col(column))
        for column, label in TABLE_COUNTERS.items()
    ]
    return _unpivot(tables, keys, values)


def counter_delta(counters: DataFrame, keys: list[str]) -> DataFrame:
    """Long (keys, counter, phase, value) to one line per counter with its deltas.

    A missing side gives no delta.
    """
    phases = [F.max(F.when(F.col("phase") == p, F.col("value"))).alias(p) for p in PHASES]
    return counters.groupBy(*keys, "counter").agg(*phases).select(
        *keys, "counter", *PHASES,
        (F.col("after") - F.col("before")).alias("delta"),
        (F.col("after_teardown") - F.col("after")).alias("teardown_delta"),
    )


def map_delta(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """The same from two counter maps side by side, without a shuffle."""
    return snapshots.select(*keys, "before", F.explode("after").alias("counter", "after_value")).select(
        *keys, "counter", F.try_element_at("before", F.col("counter")).alias("before"),
        F.col("after_value").alias("after"),
        (F.col("after_value") - F.try_element_at("before", F.col("counter"))).alias("delta"),
    )


def slot_leak(before: DataFrame, after_teardown: DataFrame, keys: list[str]) -> DataFrame:
    """Replication slots still there after teardown that were not there before."""
    known = before.select(*keys, "name").distinct()
    return after_teardown.join(known, [*keys, "name"], "left_anti").select(
        *keys, "name", "active",
        F.coalesce("retained_bytes", F.lit(0).cast("bigint")).alias("retained_bytes"),
        F.coalesce("wal_status", F.lit("")).alias("wal_status"),
    )


# --- metric series ----------------------------------------------------------------------------

def metric_minutes(points: DataFrame, started: dt.datetime, ended: dt.datetime,
                   specs: list[tuple[str, str]] | None = None) -> DataFrame:
    """One value per metric and minute around a run; every metric of the specs appears.

    ``points`` has (metric, ts, value) with zoneless times. The window is padded and whole boundary
    minutes are kept, so it is the minutes that are filtered; the equal bound on the raw time and
    the list of metrics are what reaches the file reader.
    """
    specs = METRIC_SPECS if specs is None else specs
    padding = dt.timedelta(seconds=PADDING_SECONDS)
    first = (started - padding).replace(second=0, microsecond=0)
    stop = (ended + padding).replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    inside = points.filter(
        F.col("metric").isin(*[name for name, _ in specs])
        & (F.col("ts") >= zoneless(first))
        & (F.col("ts") < zoneless(stop)))
    statistic = F
    for name, stat in specs:
        statistic = statistic.when(F.col("metric") == name, F.lit(stat))
    minutes = inside.groupBy(
        "metric", minute_of(F.col("ts")).alias("at")
    ).agg(F.avg("value").alias("Average"), F.min("value").alias("Minimum"),
          F.max("value").alias("Maximum")).withColumn("stat", statistic)
    value = F
    for stat in ("Average", "Minimum", "Maximum"):
        value = value.when(F.col("stat") == stat, F.col(stat))
    series = minutes.select("metric", "stat", "at", value.alias("value"))
    wanted = pa.table({"metric": [m for m, _ in specs], "stat": [s for _, s in specs]})
    return points.sparkSession.createDataFrame(wanted).join(series, ["metric", "stat"], "left")


def metric_series(minutes: DataFrame) -> DataFrame:
    """The points of each metric as one ascending array, as a result document holds them.

    A series is as long as its run has minutes, whatever the number of raw points.
    """
    point = F.when(F.col("at").isNotNull(), F.struct("at", "value"))
    return minutes.groupBy("metric", "stat").agg(
        F.sort_array(F.collect_list(point)).alias("points"))


# --- logs -------------------------------------------------------------------------------------

def last_error(lines: DataFrame, order: str = "line_no", text: str = "line") -> DataFrame:
    """The last error record of a log, or the end of the log when there is none.

    Both are cut to 3,500 bytes. No more than 3,500 lines can make up that many bytes (each ends in
    a newline), and of each only its own end can matter. Which lines these are is found first, from
    positions alone; they are sent to the tasks, and only these lines are gathered.
    """
    errors = lines.filter(F.col(text).rlike(LOG_LEVELS)).agg(
        F.max_by(_bytes_left(F.col(text)), order).alias("record"))
    suffix = F.substring(F.concat(F.col(text), F.lit("\n")).cast("binary"), -LOG_TAIL, LOG_TAIL)
    last = lines.select(F.col(order).alias("position")).orderBy(F.desc("position")).limit(LOG_TAIL)
    end = (
        lines.join(F.broadcast(last), F.col(order) == F.col("position"), "left_semi")
        .select(F.col(order).alias("position"), suffix.alias("suffix"))
        .agg(F.sort_array(F.collect_list(F.struct("position", "suffix"))).alias("tail"))
    )
    whole = F.aggregate(
        F.transform("tail", lambda t: t["suffix"]), F.lit(b""),
        lambda acc, s: F.substring(F.concat(acc, s), -LOG_TAIL, LOG_TAIL))
    tail = end.select(F.lit("tail").alias("kind"), _valid_text(whole).alias("text"))
    record = errors.select(F.lit("record").alias("kind"), F.col("record").alias("text"))
    both = record.unionAll(tail)
    return both.agg(F.coalesce(
        F.max(F.when(F.col("kind") == "record", F.col("text"))),
        F.max(F.when(F.col("kind") == "tail", F.col("text"))),
    ).alias("text"))


def _valid_text(raw: Column) -> Column:
    """Bytes back to text; a character cut in half becomes the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def _bytes_left(col: Column) -> Column:
    return _valid_text(F.substring(col.cast("binary"), 1, LOG_TAIL))
