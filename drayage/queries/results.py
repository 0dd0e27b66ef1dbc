"""Queries over repetitions and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.operators import results as r
from drayage.operators.ordering import exact_median
from drayage.queries import query
from drayage.queries.inputs import SQL_REPS, stored_documents, reps, table


@query("rep_rate", """
WITH t AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1),
w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 7 THEN 0 ELSE o_totalprice / 1000 END AS wall FROM orders)
SELECT o_orderkey AS rep, coalesce(n, 0) AS rows, wall AS wall_seconds,
  CASE WHEN wall <> 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / wall END AS rows_per_sec
FROM w LEFT JOIN t ON l_orderkey = o_orderkey""")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are the tables of a repetition, their quantities the table rows; some took no time."""
    table_rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS rep", "cast(l_quantity as bigint) AS rows")
    walls = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS rep", "if(o_orderkey % 100 = 7, 0D, o_totalprice / 1000) AS wall_seconds")
    return r.rep_rate(table_rows, walls, ["rep"])


def _stats_sql(key: str) -> str:
    return f"""
WITH r AS ({SQL_REPS}),
w AS (SELECT {key}, wall_seconds AS x, row_number() OVER (PARTITION BY {key} ORDER BY wall_seconds) AS i,
  count(*) OVER (PARTITION BY {key}) AS n FROM r),
q AS (SELECT {key}, rows_per_sec AS x, row_number() OVER (PARTITION BY {key} ORDER BY rows_per_sec) AS i,
  count(*) OVER (PARTITION BY {key}) AS n FROM r),
mw AS (SELECT {key}, (max(x) FILTER (i = (n + 1) // 2) + max(x) FILTER (i = n // 2 + 1)) / 2 AS m FROM w GROUP BY {key}),
mq AS (SELECT {key}, (max(x) FILTER (i = (n + 1) // 2) + max(x) FILTER (i = n // 2 + 1)) / 2 AS m FROM q GROUP BY {key}),
g AS (SELECT {key}, count(*) AS reps, min(wall_seconds) AS min_wall_seconds,
  max(wall_seconds) AS max_wall_seconds, bool_and(parity_pass) AS parity_pass FROM r GROUP BY {key})
SELECT g.{key}, reps, mw.m AS median_wall_seconds, min_wall_seconds, max_wall_seconds,
  mq.m AS median_rows_per_sec, parity_pass
FROM g JOIN mw USING ({key}) JOIN mq USING ({key})"""


@query("result_stats", _stats_sql("result"))
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.result_stats(reps(spark, sf_dir), ["result"])


@query("report", f"""
SELECT result, rep AS line, CAST(rep AS VARCHAR) AS rep, wall_seconds, rows_per_sec, setup_seconds,
  CASE WHEN parity_pass THEN 'pass' ELSE 'FAIL' END AS parity FROM ({SQL_REPS})
UNION ALL
SELECT result, 9223372036854775807, 'median', median_wall_seconds, median_rows_per_sec, NULL,
  CASE WHEN parity_pass THEN 'pass' ELSE 'FAIL' END FROM ({_stats_sql("result")})""")
def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_reps = reps(spark, sf_dir)
    return r.report(all_reps, r.result_stats(all_reps, ["result"]), ["result"])


_PHASES = {p: f for p, f in r.PHASE_FIELDS.items() if p not in ("reboot", "settle")}


@query("phase_breakdown", " UNION ALL ".join(
    f"SELECT rep, '{phase}' AS phase, {field} AS seconds FROM ({SQL_REPS}) WHERE {field} IS NOT NULL"
    for phase, field in _PHASES.items()))
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.phase_breakdown(reps(spark, sf_dir), ["rep"])


@query("cohort_compare", f"""
WITH r AS ({SQL_REPS}),
w AS (SELECT customer, wall_seconds AS x, row_number() OVER (PARTITION BY customer ORDER BY wall_seconds) AS i,
  count(*) OVER (PARTITION BY customer) AS n FROM r),
m AS (SELECT customer, (max(x) FILTER (i = (n + 1) // 2) + max(x) FILTER (i = n // 2 + 1)) / 2 AS median_wall_seconds
  FROM w GROUP BY customer)
SELECT c_mktsegment AS cohort, customer, median_wall_seconds,
  rank() OVER (PARTITION BY c_mktsegment ORDER BY median_wall_seconds) AS place
FROM m JOIN customer ON customer = c_custkey""")
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders are a result, its market segment the cohort."""
    medians = exact_median(reps(spark, sf_dir), ["customer"], "wall_seconds", "median_wall_seconds")
    cohorts = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS customer", "c_mktsegment AS cohort")
    return r.cohort_compare(medians.join(cohorts, "customer"), ["cohort"]).select(
        "cohort", "customer", "median_wall_seconds", "place")


def utc(column: str) -> Column:
    """An instant as the zoneless time it has in UTC."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(column).cast("timestamp_ntz")).alias(column)


# --- nested documents --------------------------------------------------------------------------

_REP = "(VALUES (1), (2)) v(n)"


@query("flatten_reps", f"""
SELECT event_id, CAST(n AS INTEGER) AS rep, ts AS started_at,
  CAST(ts + to_seconds(n) AS TIMESTAMP) AS ended_at, value + n AS wall_seconds,
  CAST(event_id AS DOUBLE) / (value + n) AS rows_per_sec, value / 4 AS setup_seconds,
  CAST(NULL AS DOUBLE) AS provision_seconds, value * n AS seed_seconds,
  CAST(NULL AS DOUBLE) AS teardown_seconds, CAST(NULL AS DOUBLE) AS validation_seconds,
  CAST(n AS DOUBLE) AS reboot_seconds, value AS settle_seconds, event_id % 11 <> n AS parity_pass
FROM events, {_REP}""")
def doc_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps_of_all = r.rep_table(stored_documents(spark, sf_dir), ["event_id"])
    return reps_of_all.withColumns({c: utc(c) for c in ("started_at", "ended_at")})


@query("flatten_resources", f"""
SELECT event_id, CAST(n AS INTEGER) AS rep, 'source' AS role, 'pg:17' AS image,
  'sha-' || event_id AS image_id, value * n AS cpu_seconds,
  event_id * n AS peak_mem_bytes, event_id AS net_rx_bytes, user_id AS net_tx_bytes,
  CAST(n AS INTEGER) AS samples FROM events, {_REP}
UNION ALL SELECT event_id, n, event_type, 'tool', NULL, value, event_id, user_id, event_id, n + 1 FROM events, {_REP}""")
def doc_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.resource_table(stored_documents(spark, sf_dir, "resources"), ["event_id"])


@query("flatten_parity", f"""
SELECT event_id, CAST(n AS INTEGER) AS rep, event_type AS "table", event_id AS source,
  event_id - CASE WHEN event_id % 11 = n THEN 1 ELSE 0 END AS sink,
  event_id % 11 <> n AS count_match, event_id % 11 <> n AS "match" FROM events, {_REP}""")
def doc_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.parity_table(stored_documents(spark, sf_dir, "parity"), ["event_id"])


_COUNTERS = """(VALUES ('before', 0), ('after', 10)) p(phase, step)"""


@query("flatten_counters", f"""
SELECT event_id, CAST(n AS INTEGER) AS rep, 'source' AS role, phase, 'database.blocksRead' AS counter,
  CAST(event_id + n * step AS DOUBLE) AS value FROM events, {_REP}, {_COUNTERS}
UNION ALL SELECT event_id, n, 'source', phase, 'table.' || event_type || '.vacuums',
  CAST(user_id AS DOUBLE) FROM events, {_REP}, {_COUNTERS}""")
def doc_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.counter_table(stored_documents(spark, sf_dir, "snapshots"), ["event_id"])


@query("flatten_slots", f"""
SELECT event_id, CAST(n AS INTEGER) AS rep, 'source' AS role, phase, 's' || user_id AS name,
  user_id % 2 = 0 AS active, event_id * 8 AS retained_bytes, 'reserved' AS wal_status
FROM events, {_REP}, {_COUNTERS}""")
def doc_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.slot_table(stored_documents(spark, sf_dir, "snapshots"), ["event_id"])


@query("flatten_points", f"""
SELECT event_id, CAST(n AS INTEGER) AS rep, 'source' AS role, 'CPUUtilization' AS metric,
  'Average' AS stat, ts AS "at", value * n AS value FROM events, {_REP}
UNION ALL SELECT event_id, n, 'source', 'ReadIOPS', 'Average', NULL, NULL FROM events, {_REP}""")
def doc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = r.point_table(stored_documents(spark, sf_dir, "series"), ["event_id"])
    return points.withColumn("at", utc("at"))


@query("flatten_snapshots", f"""
SELECT event_id, CAST(n AS INTEGER) AS rep, 'source' AS role, 'pg' AS engine, phase, ts AS captured_at,
  CASE WHEN event_type = 'error' THEN 'wal: unreadable' END AS error,
  CASE WHEN event_id % 3 = 0 THEN 'denied' END AS metrics_error FROM events, {_REP}, {_COUNTERS}""")
def doc_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored_documents(spark, sf_dir, "snapshots", "series")
    return r.snapshot_table(docs, ["event_id"]).withColumn("captured_at", utc("captured_at"))


_RESULTS = """
SELECT event_id, 'tool' || (user_id % 3) AS sut, event_type AS dataset, 'c1' AS cohort, 'remote' AS topology,
  'pg-pg' AS route, 'm' || (user_id % 2) AS machine, 'abc' AS git_commit, 'pg' AS source_engine, 'own' AS source_provider,
  'end-' || (user_id % 4) AS source_label, 'pg' AS sink_engine, 'own' AS sink_provider, 'warehouse' AS sink_label,
  CAST(user_id % 8 AS VARCHAR) AS workers, ts AS started_at, CAST(2 AS INTEGER) AS reps,
  value AS median_wall_seconds, event_type <> 'error' AS parity_pass FROM events"""


@query("flatten_results", _RESULTS)
def doc_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.result_table(stored_documents(spark, sf_dir)).select(
        F.col("rows").alias("event_id"), "sut", "dataset", *r.COHORT_KEYS[:4], "route",
        *r.COHORT_KEYS[6:], F.col("config")["workers"].alias("workers"), utc("started_at").alias("started_at"),
        "reps", "median_wall_seconds", "parity_pass")


@query("cohort_results", f"""
SELECT event_id, dataset, machine, source_label, median_wall_seconds, rank() OVER (
  PARTITION BY cohort, topology, machine, git_commit, dataset, route, source_engine, source_provider, source_label,
    sink_engine, sink_provider, sink_label ORDER BY median_wall_seconds) AS place
FROM ({_RESULTS})""")
def places_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results meet under the whole default key only: one endpoint more or less is another race."""
    results = r.result_table(stored_documents(spark, sf_dir))
    return r.cohort_compare(results).select(
        F.col("rows").alias("event_id"), "dataset", "machine", "source_label", "median_wall_seconds", "place")
