"""Queries over counters, metric points and logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.operators import telemetry as t
from drayage.queries import query
from drayage.queries.inputs import SQL_USAGE, samples, table


@query("usage_rollup", SQL_USAGE)
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.usage_rollup(samples(table(spark, sf_dir, "events")))


# Twelve status lines per snapshot: ten wanted names and two others; some values are words.
_STATUS_NAMES = [*t.STATUS_NAMES, "Uptime", "Ssl_accepts"]
_STATUS_LABELS = {n: f"mysql.{t.STATUS_NAMES[n]}" for n in t.STATUS_NAMES}
_SQL_NAMES = "[" + ", ".join(f"'{n}'" for n in _STATUS_NAMES) + "]"
_SQL_LABELS = " ".join(f"WHEN '{n}' THEN '{label}'" for n, label in _STATUS_LABELS.items())
_SQL_STATUS = f"""
SELECT event_id // 12 AS snapshot, event_id AS line_no, {_SQL_NAMES}[event_id % 12 + 1] AS name,
  CASE event_type WHEN 'error' THEN 'ON' WHEN 'view' THEN '1.5d' ELSE CAST(value AS VARCHAR) END AS raw,
  CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS number
FROM events"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ", ".join(f"'{n}'" for n in _STATUS_NAMES)
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 12 AS snapshot", "event_id AS line_no",
        f"element_at(array({names}), cast(event_id % 12 + 1 as int)) AS name",
        "case event_type when 'error' then 'ON' when 'view' then '1.5d' else cast(value as string) end AS value")


@query("counters_long", f"""
SELECT snapshot, CASE name {_SQL_LABELS} END AS counter, number AS value FROM ({_SQL_STATUS})
WHERE name NOT IN ('Uptime', 'Ssl_accepts') AND number IS NOT NULL""")
def status_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.status_counters(_status(spark, sf_dir), ["snapshot"])


@query("counter_errors", f"""
SELECT snapshot, arg_max(name || ': not a number: ' || raw, line_no) AS error FROM ({_SQL_STATUS})
WHERE name NOT IN ('Uptime', 'Ssl_accepts') AND number IS NULL GROUP BY snapshot""")
def status_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.status_errors(_status(spark, sf_dir), ["snapshot"], "line_no")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide snapshot per event; column i of a group holds event_id + i."""
    def group(columns: dict[str, str], present: str) -> str:
        fields = ", ".join(f"'{c}', double(event_id + {i})" for i, c in enumerate(columns))
        return f"if({present}, named_struct({fields}), null)"

    conditions = {"database": "true", "wal": "event_type <> 'error'",
                  "bgwriter": "user_id % 2 = 0", "vacuum": "event_type <> 'view'"}
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS snapshot",
        *[f"{group(t.SNAPSHOT_GROUPS[g], c)} AS {g}" for g, c in conditions.items()])


_SQL_CONDITIONS = {"database": "true", "wal": "event_type <> 'error'",
                   "bgwriter": "user_id % 2 = 0", "vacuum": "event_type <> 'view'"}
_SQL_WIDE = " UNION ALL ".join(
    f"SELECT event_id AS snapshot, '{g}.' || label AS counter, CAST(event_id + i AS DOUBLE) AS value "
    f"FROM events, (VALUES {', '.join(f'({i}, {chr(39)}{label}{chr(39)})' for i, label in enumerate(columns.values()))}) v(i, label) "
    f"WHERE {_SQL_CONDITIONS[g]}"
    for g, columns in t.SNAPSHOT_GROUPS.items())


@query("wide_counters", _SQL_WIDE)
def wide_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.wide_counters(_wide(spark, sf_dir), ["snapshot"])


@query("wide_errors", """
SELECT event_id AS snapshot, concat_ws('; ',
  CASE WHEN event_type = 'error' THEN 'wal: unreadable' END,
  CASE WHEN user_id % 2 <> 0 THEN 'bgwriter: unreadable' END,
  CASE WHEN event_id % 5 = 0 THEN 'io: unreadable' END,
  CASE WHEN event_id % 7 = 0 THEN 'tables: unreadable' END,
  CASE WHEN event_type = 'view' THEN 'vacuum: unreadable' END,
  CASE WHEN event_type = 'click' THEN 'replicationSlots: unreadable' END) AS error FROM events""")
def wide_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of several rows come as arrays; one that is empty was read, one that is NULL was not."""
    several = {"io": "snapshot % 5 <> 0", "tables": "snapshot % 7 <> 0", "replicationSlots": "event_type <> 'click'"}
    wide = _wide(spark, sf_dir).join(
        table(spark, sf_dir, "events").selectExpr("event_id AS snapshot", "event_type"), "snapshot")
    rows = wide.withColumns({g: F.expr(f"if({c}, array(snapshot), null)") for g, c in several.items()})
    return t.wide_errors(["snapshot"], rows, t.READ_GROUPS)


_SQL_IO = " UNION ALL ".join(
    f"SELECT day, 'io.{c}' AS counter, COALESCE(sum(CASE WHEN event_type = 'error' THEN NULL "
    f"ELSE CAST(event_id % {i + 2} AS DOUBLE) END), 0) AS value FROM d GROUP BY day"
    for i, c in enumerate(t.IO_COUNTERS))


@query("table_io", f"""
WITH d AS (SELECT CAST(ts AS DATE) AS day, * FROM events) {_SQL_IO}""")
def io_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [
        f"if(event_type = 'error', null, double(event_id % {i + 2})) AS {c}"
        for i, c in enumerate(t.IO_COUNTERS)
    ]
    backends = table(spark, sf_dir, "events").selectExpr("cast(ts as date) AS day", *columns)
    return t.io_totals(backends, ["day"])


_SQL_VACUUM = " UNION ALL ".join(
    f"SELECT event_id AS snapshot, 'table.' || event_type || '.{label}' AS counter, "
    f"CAST(event_id * {i + 1} AS DOUBLE) AS value FROM events"
    for i, label in enumerate(t.TABLE_COUNTERS.values()))


@query("table_counters", _SQL_VACUUM)
def vacuum_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"double(event_id * {i + 1}) AS {c}" for i, c in enumerate(t.TABLE_COUNTERS)]
    stats = table(spark, sf_dir, "events").selectExpr(
        "event_id AS snapshot", "event_type AS relname", *columns)
    return t.table_counters(stats, ["snapshot"])


_SQL_PHASED = """
SELECT user_id AS endpoint, event_type AS counter,
  max(event_id) FILTER (ts < TIMESTAMP '2024-01-11') AS b,
  max(event_id) FILTER (ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21') AS a,
  max(event_id) FILTER (ts >= TIMESTAMP '2024-01-21') AS t
FROM events GROUP BY 1, 2"""


@query("counter_delta", f"""
SELECT endpoint, counter, CAST(b AS DOUBLE) AS "before", CAST(a AS DOUBLE) AS "after",
  CAST(t AS DOUBLE) AS after_teardown, CAST(a - b AS DOUBLE) AS delta,
  CAST(t - a AS DOUBLE) AS teardown_delta FROM ({_SQL_PHASED})""")
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters: the highest reading of each phase is that phase's snapshot."""
    readings = table(spark, sf_dir, "events").selectExpr(
        "user_id AS endpoint", "event_type AS counter", "double(event_id) AS value",
        "case when ts < timestamp_ntz'2024-01-11' then 'before' "
        "when ts < timestamp_ntz'2024-01-21' then 'after' else 'after_teardown' end AS phase")
    return t.counter_delta(readings, ["endpoint"])


@query("map_delta", """
SELECT event_id, event_type AS counter,
  CASE WHEN user_id % 2 = 0 THEN CAST(event_id AS DOUBLE) END AS "before",
  event_id + value AS "after",
  CASE WHEN user_id % 2 = 0 THEN event_id + value - CAST(event_id AS DOUBLE) END AS delta
FROM events
UNION ALL SELECT event_id, 'shared', CAST(user_id AS DOUBLE), CAST(user_id * 2 AS DOUBLE),
  CAST(user_id AS DOUBLE) FROM events""")
def map_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "if(user_id % 2 = 0, map('shared', double(user_id), event_type, double(event_id)), "
        "map('shared', double(user_id))) AS before",
        "map('shared', double(user_id * 2), event_type, event_id + value) AS after")
    return t.map_delta(snapshots, ["event_id"])


@query("slot_leak", """
WITH b AS (SELECT DISTINCT 's' || (event_id % 2000) AS name FROM events
  WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-11'),
a AS (SELECT 's' || (event_id % 2000) AS name, bool_or(user_id % 2 = 0) AS active,
    max(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 1024 END) AS retained,
    max(CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'reserved' END) AS status
  FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-21' GROUP BY 1)
SELECT 'source' AS role, name, active, COALESCE(retained, 0) AS retained_bytes,
  COALESCE(status, '') AS wal_status FROM a WHERE name NOT IN (SELECT name FROM b)""")
def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    name = "concat('s', event_id % 2000) AS name"
    before = events.filter("event_type = 'view' and ts < timestamp_ntz'2024-01-11'").selectExpr(
        "'source' AS role", name)
    after = events.filter("event_type = 'click' and ts >= timestamp_ntz'2024-01-21'").selectExpr(
        "'source' AS role", name, "user_id % 2 = 0 AS active",
        "if(event_id % 3 = 0, null, event_id * 1024) AS retained_bytes",
        "if(event_id % 5 = 0, null, 'reserved') AS wal_status",
    ).groupBy("role", "name").agg(
        F.bool_or("active").alias("active"), F.max("retained_bytes").alias("retained_bytes"),
        F.max("wal_status").alias("wal_status"))
    return t.slot_leak(before, after, ["role"])


_SPECS = [("view", "Average"), ("click", "Maximum"), ("purchase", "Minimum"),
          ("error", "Average"), ("idle", "Maximum")]
_SQL_SPECS = ", ".join(f"('{m}', '{s}')" for m, s in _SPECS)
_STARTED, _ENDED = dt.datetime(2024, 1, 5, 17, 32, 47), dt.datetime(2024, 1, 25, 6, 10, 5)


@query("metric_minutes", f"""
WITH spec(metric, stat) AS (VALUES {_SQL_SPECS}),
m AS (SELECT event_type AS metric, date_trunc('minute', ts) AS "at", avg(value) AS av,
    min(value) AS mn, max(value) AS mx FROM events GROUP BY 1, 2),
w AS (SELECT * FROM m WHERE "at" >= date_trunc('minute', TIMESTAMP '{_STARTED}' - INTERVAL 60 SECOND)
    AND "at" <= TIMESTAMP '{_ENDED}' + INTERVAL 60 SECOND)
SELECT metric, stat, CAST("at" AS TIMESTAMP) AS "at", round(CASE stat WHEN 'Average' THEN av
  WHEN 'Minimum' THEN mn ELSE mx END, 6) AS value
FROM spec LEFT JOIN w USING (metric)""")
def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").selectExpr("event_type AS metric", "ts", "value")
    series = t.metric_minutes(points, _STARTED, _ENDED, _SPECS)
    return series.withColumn("value", F.round("value", 6))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = "case event_type when 'error' then 'ERROR' when 'view' then 'WARN' else 'INFO' end"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS line_no", "event_type",
        f"""concat('{{"level":"', {level}, '","event":', event_id, ',"detail":"',
            repeat(event_type, if(event_type = 'error', 900, 3)), '"}}') AS line""")


_SQL_LOG = """
SELECT event_id AS line_no, event_type, '{"level":"' || CASE event_type WHEN 'error' THEN 'ERROR'
  WHEN 'view' THEN 'WARN' ELSE 'INFO' END || '","event":' || event_id || ',"detail":"'
  || repeat(event_type, CASE WHEN event_type = 'error' THEN 900 ELSE 3 END) || '"}' AS line
FROM events"""


@query("last_error", f"""
WITH l AS ({_SQL_LOG})
SELECT 'with_errors' AS log, left(arg_max(line, line_no), {t.LOG_TAIL}) AS text FROM l
WHERE event_type = 'error'
UNION ALL SELECT 'clean', right(string_agg(line || chr(10), '' ORDER BY line_no), {t.LOG_TAIL})
FROM l WHERE event_type <> 'error'""")
def log_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs: one whose last error is longer than the cut, one without any error."""
    lines = _log(spark, sf_dir)
    clean = lines.filter("event_type <> 'error'")
    return t.last_error(lines).select(F.lit("with_errors").alias("log"), "text").unionAll(
        t.last_error(clean).select(F.lit("clean").alias("log"), "text"))
