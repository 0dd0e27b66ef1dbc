"""Repetitions and result documents into rates, statistics, tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.operators.ordering import exact_median, null_safe_join, rank_within
from drayage.schemas import ALL_PARTS, result_document

# Result identity that must agree before two results are compared; phase fields of
# a repetition and their names; the words a report uses.
ENDPOINT_FIELDS = ["engine", "provider", "label"]
COHORT_KEYS = ["cohort", "topology", "machine", "git_commit", "dataset", "route",
               *[f"{end}_{field}" for end in ("source", "sink") for field in ENDPOINT_FIELDS]]
PHASE_FIELDS = {
    "provision": "provision_seconds", "seed": "seed_seconds", "setup": "setup_seconds",
    "wall": "wall_seconds", "teardown": "teardown_seconds", "validation": "validation_seconds",
    "reboot": "reboot_seconds", "settle": "settle_seconds",
}
PARITY_WORDS = ("pass", "FAIL")


def rep_rate(table_rows: DataFrame, reps: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per second of each repetition: all its table rows over its wall time.

    The table rows are summed before they meet the repetitions, so a repetition with very many
    table lines is no hot join key. A repetition without table lines moved 0 rows; one that took no
    time has no rate.
    """
    totals = table_rows.groupBy(*keys).agg(F.sum("rows").alias("rows"))
    moved = F.coalesce("rows", F.lit(0).cast("bigint"))
    return null_safe_join(reps.select(*keys, "wall_seconds"), totals, keys, "left").select(
        *keys, moved.alias("rows"), "wall_seconds",
        F.try_divide(moved.cast("double"), F.col("wall_seconds")).alias("rows_per_sec"))


def result_stats(reps: DataFrame, keys: list[str]) -> DataFrame:
    """Exact medians of wall time and rate, wall spread, and whether all repetitions passed.

    The two medians are independent: the rate median is not the reciprocal of the wall median.
    A result without repetitions has no line. A repetition whose parity is unknown did not pass.
    """
    spread = reps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reps"),
        F.min("wall_seconds").alias("min_wall_seconds"),
        F.max("wall_seconds").alias("max_wall_seconds"),
        F.bool_and(F.coalesce("parity_pass", F.lit(False))).alias("parity_pass"),
    )
    long = reps.select(*keys, F.explode(F.array(
        F.struct(F.lit("wall").alias("measure"), F.col("wall_seconds").alias("x")),
        F.struct(F.lit("rate").alias("measure"), F.col("rows_per_sec").alias("x")),
    )).alias("m")).select(*keys, "m.*")
    medians = exact_median(long, [*keys, "measure"], "x", "median").groupBy(*keys).agg(
        F.max(F.when(F.col("measure") == "wall", F.col("median"))).alias("median_wall_seconds"),
        F.max(F.when(F.col("measure") == "rate", F.col("median"))).alias("median_rows_per_sec"),
    )
    return null_safe_join(spread, medians, keys, "left").select(
        *keys, "reps", "median_wall_seconds", "min_wall_seconds", "max_wall_seconds",
        "median_rows_per_sec", "parity_pass")


def report(reps: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """One line per repetition, then a ``median`` line; ``line`` gives the printing order."""
    def word(passed: str) -> Column:
        return F.when(F.col(passed), F.lit(PARITY_WORDS[0])).otherwise(F.lit(PARITY_WORDS[1]))

    rep_lines = reps.select(
        *keys, F.col("rep").cast("bigint").alias("line"), F.col("rep").cast("string").alias("rep"),
        "wall_seconds", "rows_per_sec", "setup_seconds", word("parity_pass").alias("parity"))
    median_line = stats.select(
        *keys, F.lit((1 << 63) - 1).alias("line"), F.lit("median").alias("rep"),
        F.col("median_wall_seconds").alias("wall_seconds"),
        F.col("median_rows_per_sec").alias("rows_per_sec"),
        F.lit(None).cast("double").alias("setup_seconds"), word("parity_pass").alias("parity"))
    return rep_lines.unionByName(median_line)


def phase_breakdown(reps: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds per phase of each repetition; phases that were not run have no line."""
    present = [(phase, field) for phase, field in PHASE_FIELDS.items() if field in reps.columns]
    pairs = F.array(*[
        F.struct(F.lit(phase).alias("phase"), F.col(field).cast("double").alias("seconds"))
        for phase, field in present
    ])
    return reps.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*") \
        .filter(F.col("seconds").isNotNull())


def cohort_compare(results: DataFrame, within: list[str] | None = None,
                   measure: str = "median_wall_seconds") -> DataFrame:
    """Place of each result inside its own comparison group, fastest first.

    Results of different machines, topologies, endpoints, commits or cohorts never meet.
    """
    return rank_within(results, within or COHORT_KEYS, measure, "place")


# --- result documents -------------------------------------------------------------------------

def read_documents(spark: SparkSession, path: str, parts: tuple[str, ...] = ALL_PARTS,
                   per_line: bool = False) -> DataFrame:
    """Stored result documents with the wanted nested parts.

    A file is one document, however it is indented, or one document per line. A document that does
    not parse fails the read.
    """
    return spark.read.schema(result_document(parts)).option("multiLine", not per_line) \
        .option("mode", "FAILFAST").json(path)


def result_table(docs: DataFrame) -> DataFrame:
    """One row per result document, its endpoints and its settings beside its identity."""
    ends = [F.col(end)[field].alias(f"{end}_{field}") for end in ("source", "sink") for field in ENDPOINT_FIELDS]
    return docs.select(
        "sut", "scenario", "route", "dataset", "rows", "cohort", "topology", *ends, "image", "native", "config",
        F.col("startedAt").alias("started_at"), F.size(F.coalesce("reps", F.array())).alias("reps"),
        F.col("medianWallSeconds").alias("median_wall_seconds"),
        F.col("minWallSeconds").alias("min_wall_seconds"),
        F.col("maxWallSeconds").alias("max_wall_seconds"),
        F.col("medianRowsPerSec").alias("median_rows_per_sec"), F.col("parityPass").alias("parity_pass"),
        "os", "arch", "cpus", F.col("cpuModel").alias("cpu_model"), F.col("memoryBytes").alias("memory_bytes"),
        F.col("goVersion").alias("go_version"), "machine", F.col("gitCommit").alias("git_commit"),
        F.col("gitDirty").alias("git_dirty"), "verification")


def flatten_reps(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per repetition, numbered from 1, with the nested parts still in ``r``.

    The outer form, filtered afterwards: for the plain form the planner would add a test of the
    array below, and so parse every document once more.
    """
    return docs.select(*keys, F.posexplode_outer("reps").alias("pos", "r")).filter(
        F.col("pos").isNotNull()).select(*keys, (F.col("pos") + 1).alias("rep"), "r")


def rep_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    return flatten_reps(docs, keys).select(
        *keys, "rep",
        F.col("r.startedAt").alias("started_at"), F.col("r.endedAt").alias("ended_at"),
        F.col("r.wallSeconds").alias("wall_seconds"),
        F.col("r.rowsPerSec").alias("rows_per_sec"),
        F.col("r.setupSeconds").alias("setup_seconds"),
        F.col("r.provisionSeconds").alias("provision_seconds"),
        F.col("r.seedSeconds").alias("seed_seconds"),
        F.col("r.teardownSeconds").alias("teardown_seconds"),
        F.col("r.validationSeconds").alias("validation_seconds"),
        F.col("r.coldStart.rebootSeconds").alias("reboot_seconds"),
        F.col("r.coldStart.settleSeconds").alias("settle_seconds"),
        F.col("r.parityPass").alias("parity_pass"))


def resource_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    return flatten_reps(docs, keys).select(*keys, "rep", F.explode("r.resources").alias("u")).select(
        *keys, "rep", F.col("u.role").alias("role"), F.col("u.image").alias("image"),
        F.col("u.imageId").alias("image_id"), F.col("u.cpuSeconds").alias("cpu_seconds"),
        F.col("u.peakMemBytes").alias("peak_mem_bytes"),
        F.col("u.netRxBytes").alias("net_rx_bytes"), F.col("u.netTxBytes").alias("net_tx_bytes"),
        F.col("u.samples").alias("samples"))


def parity_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    return flatten_reps(docs, keys).select(*keys, "rep", F.explode("r.parity").alias("p")).select(
        *keys, "rep", F.col("p.table").alias("table"), F.col("p.source").alias("source"),
        F.col("p.sink").alias("sink"), F.col("p.countMatch").alias("count_match"),
        F.col("p.match").alias("match"))


def database_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per repetition and database endpoint, what was recorded there still nested in ``d``."""
    return flatten_reps(docs, keys).select(*keys, "rep", F.explode("r.databases").alias("d")).select(
        *keys, "rep", F.col("d.role").alias("role"), F.col("d.engine").alias("engine"), "d")


def snapshot_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per snapshot of every endpoint: when it was taken and what could not be read."""
    phases = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"d.{f}").alias("snapshot"))
                       for f, p in SNAPSHOT_FIELDS.items()])
    return database_table(docs, keys).select(
        *keys, "rep", "role", "engine", F.col("d.metricsError").alias("metrics_error"),
        F.explode(phases).alias("s")).filter(F.col("s.snapshot").isNotNull()).select(
        *keys, "rep", "role", "engine", F.col("s.phase").alias("phase"),
        F.col("s.snapshot.capturedAt").alias("captured_at"), F.col("s.snapshot.error").alias("error"),
        "metrics_error")


# Snapshot fields of an endpoint and the phases they stand for.
SNAPSHOT_FIELDS = {"before": "before", "after": "after", "afterTeardown": "after_teardown"}


def counter_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Long (keys, rep, role, phase, counter, value) over the snapshots of every endpoint."""
    phases = F.array(*[
        F.struct(F.lit(p).alias("phase"), F.col(f"d.{f}.counters").alias("counters"))
        for f, p in SNAPSHOT_FIELDS.items()
    ])
    return database_table(docs, keys).select(
        *keys, "rep", "role", F.explode(phases).alias("s")
    ).select(*keys, "rep", "role", F.col("s.phase").alias("phase"),
             F.explode("s.counters").alias("counter", "value"))


def slot_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Replication slots of every snapshot of every endpoint."""
    phases = F.array(*[
        F.struct(F.lit(p).alias("phase"), F.col(f"d.{f}.replicationSlots").alias("slots"))
        for f, p in SNAPSHOT_FIELDS.items()
    ])
    return database_table(docs, keys).select(
        *keys, "rep", "role", F.explode(phases).alias("s")
    ).select(*keys, "rep", "role", F.col("s.phase").alias("phase"),
             F.explode("s.slots").alias("slot")).select(
        *keys, "rep", "role", "phase", F.col("slot.name").alias("name"),
        F.col("slot.active").alias("active"),
        F.col("slot.retainedBytes").alias("retained_bytes"),
        F.col("slot.walStatus").alias("wal_status"))


def point_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per metric point; a series without points keeps one row with no time."""
    return database_table(docs, keys).select(
        *keys, "rep", "role", F.explode("d.cloudWatch").alias("s")
    ).select(*keys, "rep", "role", F.col("s.name").alias("metric"), F.col("s.stat").alias("stat"),
             F.explode_outer("s.points").alias("p")).select(
        *keys, "rep", "role", "metric", "stat", F.col("p.at").alias("at"),
        F.col("p.value").alias("value"))
