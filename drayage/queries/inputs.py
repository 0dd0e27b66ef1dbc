"""Inputs the given tables do not hold, derived from them: raw taxi layouts, samples, documents.

Every derivation exists twice, as Spark and as SQL text for the oracle, side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.functions.months import Month
from drayage.operators.harmonise import Era, fhv, fhvhv, yellow_2009, yellow_2010, yellow_modern
from drayage.operators.results import read_documents
from drayage.session import scratch_dir
from drayage.sources.monthly import with_position
from drayage.sources.tables import parquet_table

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
MOVED = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]

# Windows over the dates the tables really have; the last month is cut short of their end.
TRIPS_ERAS = [
    Era("a", yellow_2009, Month(1995, 1), Month(1996, 12)),
    Era("b", yellow_2010, Month(1997, 1), Month(1998, 12)),
    Era("c", yellow_modern, Month(1999, 1), Month(2001, 9)),
]
FHV_ERAS = [
    Era("d", fhv, Month(2024, 1), Month(2024, 1)),
    Era("e", fhvhv, Month(2024, 1), Month(2024, 1)),
]
TRIPS_LAST = Month(2001, 9)
TRIPS_MONTHS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet_table(spark, sf_dir, name)


def positioned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_position(parquet_table(spark, sf_dir, name))


# --- raw taxi layouts from lineitem and events -------------------------------------------------

_PICKUP = "l_shipdate + make_dt_interval(0, 0, 0, l_partkey % 86400)"
_DROPOFF = "l_shipdate + make_dt_interval(0, 0, 0, l_partkey % 86400 + l_linenumber * 3600)"
_POSITION = ["file_path", "row_index"]

_LEGACY = [
    ("vendor", "element_at(array('CMT', 'vts', 'DDS', 'XYZ'), cast(l_suppkey % 4 + 1 as int))"),
    ("pickup", f"cast({_PICKUP} as string)"),
    ("dropoff", f"cast({_DROPOFF} as string)"),
    ("passengers", "if(l_linenumber = 7, null, cast(l_linenumber as bigint))"),
    ("distance", "l_quantity / 8"),
    ("rate", "case l_linenumber % 4 when 0 then '1' when 1 then 'x' when 2 then '2.5' end"),
    ("stored", "if(l_returnflag = 'N', null, l_returnflag)"),
    ("payment", "case l_returnflag when 'A' then 'Credit' when 'N' then 'CASH' else 'No Charge' end"),
    ("fare", "l_extendedprice"),
    ("surcharge", "if(l_linenumber = 3, null, l_discount)"),
    ("mta_tax", "if(l_linenumber = 7, null, l_tax)"),
    ("tip", "l_discount"),
    ("tolls", "l_tax"),
    ("total", "l_extendedprice + l_tax"),
]

_NAMES_2009 = {
    "vendor": "vendor_name", "pickup": "Trip_Pickup_DateTime", "dropoff": "Trip_Dropoff_DateTime",
    "passengers": "Passenger_Count", "distance": "Trip_Distance", "rate": "Rate_Code",
    "stored": "store_and_forward", "payment": "Payment_Type", "fare": "Fare_Amt",
    "surcharge": "surcharge", "mta_tax": "mta_tax", "tip": "Tip_Amt", "tolls": "Tolls_Amt",
    "total": "Total_Amt",
}
_NAMES_2010 = {
    "vendor": "vendor_id", "pickup": "pickup_datetime", "dropoff": "dropoff_datetime",
    "passengers": "passenger_count", "distance": "trip_distance", "rate": "rate_code",
    "stored": "store_and_fwd_flag", "payment": "payment_type", "fare": "fare_amount",
    "surcharge": "surcharge", "mta_tax": "mta_tax", "tip": "tip_amount", "tolls": "tolls_amount",
    "total": "total_amount",
}


def _legacy(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.selectExpr(*_POSITION, *[f"{expr} AS {names[key]}" for key, expr in _LEGACY])


def yellow_2009_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy(positioned(spark, sf_dir, "lineitem"), _NAMES_2009)


def yellow_2010_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy(positioned(spark, sf_dir, "lineitem"), _NAMES_2010)


def yellow_modern_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(spark, sf_dir, "lineitem").selectExpr(
        *_POSITION,
        "l_linenumber + element_at(array(0.0D, 0.5D, 0.7D, null), cast(l_suppkey % 4 + 1 as int)) AS VendorID",
        f"{_PICKUP} AS tpep_pickup_datetime", f"{_DROPOFF} AS tpep_dropoff_datetime",
        "cast(l_quantity as double) AS passenger_count", "l_quantity / 8 AS trip_distance",
        "l_tax * 100 AS RatecodeID", "if(l_returnflag = 'N', null, l_linestatus) AS store_and_fwd_flag",
        "l_partkey AS PULocationID", "if(l_suppkey % 3 = 0, null, l_suppkey) AS DOLocationID",
        "cast(l_linenumber as bigint) AS payment_type", "l_extendedprice AS fare_amount",
        "l_discount AS extra", "l_tax AS mta_tax", "if(l_linenumber = 5, null, l_discount) AS tip_amount",
        "l_tax AS tolls_amount", "0.3D AS improvement_surcharge",
        "l_extendedprice + l_tax AS total_amount", "2.5D AS congestion_surcharge",
        "if(l_linenumber = 1, 1.25D, null) AS Airport_fee",
    )


def fhv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(spark, sf_dir, "events").selectExpr(
        *_POSITION,
        "if(event_type = 'view', null, concat('B', lpad(cast(user_id as string), 5, '0'))) AS dispatching_base_num",
        "ts AS pickup_datetime",
        "if(event_type = 'error', null, ts + make_dt_interval(0, 0, 0, user_id * 60)) AS dropOff_datetime",
        "cast(user_id as double) AS PUlocationID",
        "if(event_id % 5 = 0, null, event_id % 263) AS DOlocationID",
        "case event_id % 3 when 0 then '1' when 1 then 'n/a' end AS SR_Flag",
        "if(event_id % 2 = 0, null, concat('B', lpad(cast(event_id % 900 as string), 5, '0'))) AS Affiliated_base_number",
    )


def fhvhv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(spark, sf_dir, "events").selectExpr(
        *_POSITION,
        "concat('HV', lpad(cast(user_id as string), 4, '0')) AS dispatching_base_num",
        "ts AS pickup_datetime",
        "if(event_type = 'error', null, ts + make_dt_interval(0, 0, 0, user_id * 60)) AS dropoff_datetime",
        "cast(user_id as int) AS PULocationID",
        "if(event_id % 5 = 0, null, cast(event_id % 263 as int)) AS DOLocationID",
        "case event_id % 3 when 0 then 'Y' when 1 then 'N' end AS shared_request_flag",
        "if(event_id % 2 = 0, null, concat('B', lpad(cast(event_id % 900 as string), 5, '0'))) AS originating_base_num",
    )


# The same inputs and their harmonised form as SQL. ``rn`` is the row position in the file.

def _money(expr: str) -> str:
    return f"CAST(CAST(COALESCE({expr}, 0) AS VARCHAR) AS DECIMAL(15,2))"


def _int(expr: str) -> str:
    return f"CAST(COALESCE(TRY_CAST({expr} AS INTEGER), 0) AS INTEGER)"


_SQL_PICKUP = "l_shipdate + to_seconds(l_partkey % 86400)"
_SQL_DROPOFF = "l_shipdate + to_seconds(l_partkey % 86400 + l_linenumber * 3600)"

_SQL_LINES = "(SELECT *, row_number() OVER () - 1 AS rn FROM lineitem)"
_SQL_EVENTS = "(SELECT *, row_number() OVER () - 1 AS rn FROM events)"

SQL_LEGACY_ROWS = f"""
SELECT rn,
  CAST(CASE l_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS INTEGER) AS vendor_id,
  {_SQL_PICKUP} AS pickup_at, {_SQL_DROPOFF} AS dropoff_at,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END AS INTEGER) AS passenger_count,
  {_money("l_quantity / 8")} AS trip_distance,
  {_int("CASE l_linenumber % 4 WHEN 0 THEN '1' WHEN 1 THEN 'x' WHEN 2 THEN '2.5' END")} AS ratecode_id,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS store_and_fwd_flag,
  CAST(0 AS INTEGER) AS pu_location_id, CAST(0 AS INTEGER) AS do_location_id,
  CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS INTEGER) AS payment_type,
  {_money("l_extendedprice")} AS fare_amount,
  {_money("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END")} AS extra,
  {_money("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END")} AS mta_tax,
  {_money("l_discount")} AS tip_amount, {_money("l_tax")} AS tolls_amount,
  {_money("NULL")} AS improvement_surcharge,
  {_money("l_extendedprice + l_tax")} AS total_amount,
  {_money("NULL")} AS congestion_surcharge, {_money("NULL")} AS airport_fee
FROM {_SQL_LINES}
"""

SQL_MODERN_ROWS = f"""
SELECT rn,
  {_int("l_linenumber + CASE l_suppkey % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 END")} AS vendor_id,
  {_SQL_PICKUP} AS pickup_at, {_SQL_DROPOFF} AS dropoff_at,
  {_int("l_quantity")} AS passenger_count, {_money("l_quantity / 8")} AS trip_distance,
  {_int("l_tax * 100")} AS ratecode_id,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE l_linestatus END AS store_and_fwd_flag,
  {_int("l_partkey")} AS pu_location_id,
  {_int("CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey END")} AS do_location_id,
  {_int("l_linenumber")} AS payment_type,
  {_money("l_extendedprice")} AS fare_amount, {_money("l_discount")} AS extra,
  {_money("l_tax")} AS mta_tax,
  {_money("CASE WHEN l_linenumber = 5 THEN NULL ELSE l_discount END")} AS tip_amount,
  {_money("l_tax")} AS tolls_amount, {_money("CAST(0.3 AS DOUBLE)")} AS improvement_surcharge,
  {_money("l_extendedprice + l_tax")} AS total_amount,
  {_money("CAST(2.5 AS DOUBLE)")} AS congestion_surcharge,
  {_money("CASE WHEN l_linenumber = 1 THEN CAST(1.25 AS DOUBLE) END")} AS airport_fee
FROM {_SQL_LINES}
"""

_SQL_BASE = "CASE WHEN event_id % 2 = 0 THEN '' ELSE 'B' || lpad(CAST(event_id % 900 AS VARCHAR), 5, '0') END"

SQL_FHV_ROWS = f"""
SELECT rn,
  CASE WHEN event_type = 'view' THEN '' ELSE 'B' || lpad(CAST(user_id AS VARCHAR), 5, '0') END AS dispatching_base_num,
  ts AS pickup_at,
  CASE WHEN event_type = 'error' THEN ts ELSE ts + to_seconds(user_id * 60) END AS dropoff_at,
  CAST(user_id AS INTEGER) AS pu_location_id,
  CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 263 END AS INTEGER) AS do_location_id,
  CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS sr_flag,
  {_SQL_BASE} AS affiliated_base_number
FROM {_SQL_EVENTS}
"""

SQL_FHVHV_ROWS = f"""
SELECT rn,
  'HV' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS dispatching_base_num,
  ts AS pickup_at,
  CASE WHEN event_type = 'error' THEN NULL ELSE ts + to_seconds(user_id * 60) END AS dropoff_at,
  CAST(user_id AS INTEGER) AS pu_location_id,
  CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 263 END AS INTEGER) AS do_location_id,
  CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS sr_flag,
  {_SQL_BASE} AS affiliated_base_number
FROM {_SQL_EVENTS}
"""


def sql_window(rows: str, ordinal: int, lo: Month, hi: Month) -> str:
    """Harmonised rows with their id, inside a window."""
    return f"""
SELECT CAST({ordinal} AS BIGINT) * 4294967296 + rn AS id, * EXCLUDE (rn) FROM ({rows})
WHERE pickup_at >= TIMESTAMP '{lo.start}' AND pickup_at < TIMESTAMP '{hi.plus(1).start}'
  AND dropoff_at < TIMESTAMP '{hi.plus(2).start}'
"""


# --- repetitions from orders -------------------------------------------------------------------

def reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is one repetition: its priority names the result, its price gives the times."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority AS result", "o_custkey AS customer", "o_orderkey AS rep",
        "o_totalprice / 1000 AS wall_seconds",
        "(o_custkey + 1) / (o_totalprice / 1000) AS rows_per_sec",
        "o_totalprice / 50000 AS setup_seconds",
        "if(o_orderkey % 3 = 0, null, o_totalprice / 2000) AS provision_seconds",
        "o_totalprice / 4000 AS seed_seconds", "o_totalprice / 8000 AS teardown_seconds",
        "if(o_orderkey % 5 = 0, null, o_totalprice / 16000) AS validation_seconds",
        "not (o_orderpriority = '1-URGENT' and o_orderkey % 1000 = 3) AS parity_pass",
        "1000 + o_custkey + if(o_orderkey % 50 = 0, 1, 0) AS rows",
    )


SQL_REPS = """
SELECT o_orderpriority AS result, o_custkey AS customer, o_orderkey AS rep,
  o_totalprice / 1000 AS wall_seconds,
  (o_custkey + 1) / (o_totalprice / 1000) AS rows_per_sec,
  o_totalprice / 50000 AS setup_seconds,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 2000 END AS provision_seconds,
  o_totalprice / 4000 AS seed_seconds, o_totalprice / 8000 AS teardown_seconds,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 16000 END AS validation_seconds,
  NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 1000 = 3) AS parity_pass,
  1000 + o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS rows
FROM orders
"""


# --- resource samples from events --------------------------------------------------------------

_NETWORKS = ("array(named_struct('rx', event_id * 3, 'tx', event_id * 2), "
             "named_struct('rx', event_id * 7, 'tx', event_id))")


def samples(events: DataFrame) -> DataFrame:
    """Five containers: plain, idle at times, counter going back, born late, never valid."""
    return events.selectExpr(
        "user_id % 5 AS container", "event_id", "event_type", "value", "user_id", "ts AS sampled_at"
    ).selectExpr(
        "concat('c', cast(container as string)) AS container_id",
        "if(container = 0, 'source', 'tool') AS role",
        "concat('image-', cast(container % 2 as string)) AS image",
        "concat('sha-', cast(container as string)) AS image_id",
        "event_id AS seq",
        "event_id < 60 and container <> 3 AS initial_pass",
        "if(container = 4, 'exited', 'running') AS state",
        "case when event_type = 'error' then 0 when container = 2 then 9000000000000 - event_id "
        "else event_id * 1000003 + 5 end AS cpu_ns",
        "cast(round(value * 100) as bigint) AS mem",
        f"{_NETWORKS} AS networks", "sampled_at",
    )


SQL_USAGE = """
WITH s AS (
  SELECT user_id % 5 AS c, event_id AS seq, event_id < 60 AND user_id % 5 <> 3 AS initial,
    CASE WHEN event_type = 'error' THEN 0 WHEN user_id % 5 = 2 THEN 9000000000000 - event_id
      ELSE event_id * 1000003 + 5 END AS cpu,
    CAST(round(value * 100) AS BIGINT) AS mem, event_id * 10 AS rx, event_id * 3 AS tx
  FROM events),
v AS (SELECT *, c <> 4 AND cpu <> 0 AS valid FROM s),
g AS (
  SELECT c, count(*) FILTER (valid) AS samples, max(mem) FILTER (valid) AS mem,
    arg_min(initial, seq) FILTER (valid) AS initial,
    arg_min(cpu, seq) FILTER (valid) AS cpu0, arg_max(cpu, seq) FILTER (valid) AS cpu1,
    arg_min(rx, seq) FILTER (valid) AS rx0, arg_max(rx, seq) FILTER (valid) AS rx1,
    arg_min(tx, seq) FILTER (valid) AS tx0, arg_max(tx, seq) FILTER (valid) AS tx1
  FROM v GROUP BY c),
b AS (SELECT *, CASE WHEN initial THEN cpu0 ELSE 0 END AS cpub,
    CASE WHEN initial THEN rx0 ELSE 0 END AS rxb, CASE WHEN initial THEN tx0 ELSE 0 END AS txb FROM g)
SELECT 'c' || CAST(c AS VARCHAR) AS container_id,
  CASE WHEN c = 0 THEN 'source' ELSE 'tool' END AS role,
  'image-' || CAST(c % 2 AS VARCHAR) AS image, 'sha-' || CAST(c AS VARCHAR) AS image_id,
  CAST(CASE WHEN cpu1 >= cpub THEN cpu1 - cpub ELSE 0 END AS DOUBLE) / 1e9 AS cpu_seconds,
  COALESCE(mem, 0) AS peak_mem_bytes,
  CASE WHEN rx1 >= rxb THEN rx1 - rxb ELSE 0 END AS net_rx_bytes,
  CASE WHEN tx1 >= txb THEN tx1 - txb ELSE 0 END AS net_tx_bytes,
  CAST(samples AS INTEGER) AS samples
FROM b
"""


# --- repetitions again, as nested documents ----------------------------------------------------

# Fixed values of stored documents: a compressed file is read by one task, so it must not hold many.
DOCUMENT_FILE_ROWS = 10_000
DOCUMENT_OPTIONS = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def documents_json(events: DataFrame) -> DataFrame:
    """One JSON result document per event, three levels deep, built without grouping."""
    def snapshot(offset: str) -> str:
        return (f"named_struct('capturedAt', ts_utc, 'error', if(event_type = 'error', 'wal: unreadable', null), 'counters', map('database.blocksRead', "
                f"double(event_id + {offset}), concat('table.', event_type, '.vacuums'), "
                f"double(user_id)), 'replicationSlots', array(named_struct('name', "
                f"concat('s', cast(user_id as string)), 'active', user_id % 2 = 0, "
                f"'retainedBytes', event_id * 8, 'walStatus', 'reserved')))")

    def rep(n: int) -> str:
        return f"""named_struct(
            'startedAt', ts_utc, 'endedAt', ts_utc + make_dt_interval(0, 0, 0, {n}),
            'wallSeconds', value + {n}, 'rowsPerSec', double(event_id) / (value + {n}),
            'setupSeconds', value / 4, 'seedSeconds', {f"value * {n}"},
            'coldStart', named_struct('rebootSeconds', double({n}), 'settleSeconds', value),
            'parityPass', event_id % 11 <> {n},
            'resources', array(
                named_struct('role', 'source', 'image', 'pg:17', 'imageId', concat('sha-', event_id),
                    'cpuSeconds', value * {n}, 'peakMemBytes', event_id * {n},
                    'netRxBytes', event_id, 'netTxBytes', user_id, 'samples', {n}),
                named_struct('role', event_type, 'image', 'tool', 'imageId', cast(null as string), 'cpuSeconds', value, 'peakMemBytes', event_id,
                    'netRxBytes', user_id, 'netTxBytes', event_id, 'samples', {n + 1})),
            'parity', array(named_struct('table', event_type, 'source', event_id, 'sink',
                event_id - if(event_id % 11 = {n}, 1, 0), 'countMatch', event_id % 11 <> {n},
                'match', event_id % 11 <> {n})),
            'databases', array(named_struct('role', 'source', 'engine', 'pg', 'metricsError', if(event_id % 3 = 0, 'denied', null),
                'before', {snapshot('0')}, 'after', {snapshot(str(n * 10))},
                'cloudWatch', array(
                    named_struct('name', 'CPUUtilization', 'stat', 'Average', 'points',
                        array(named_struct('at', ts_utc, 'value', value * {n}))),
                    named_struct('name', 'ReadIOPS', 'stat', 'Average', 'points',
                        cast(null as array<struct<at: timestamp, value: double>>))))))"""

    doc = f"""to_json(named_struct('sut', concat('tool', cast(user_id % 3 as string)),
        'scenario', 'full-load', 'route', 'pg-pg', 'dataset', event_type, 'rows', event_id,
        'cohort', 'c1', 'topology', 'remote', 'machine', concat('m', cast(user_id % 2 as string)),
        'gitCommit', 'abc', 'source', named_struct('engine', 'pg', 'provider', 'own', 'label',
            concat('end-', cast(user_id % 4 as string))),
        'sink', named_struct('engine', 'pg', 'provider', 'own', 'label', 'warehouse'),
        'config', map('workers', cast(user_id % 8 as string), 'mode', 'copy'), 'startedAt', ts_utc,
        'medianWallSeconds', value, 'parityPass', event_type <> 'error',
        'reps', array({rep(1)}, {rep(2)})), map('timestampFormat', "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))"""
    return events.withColumn("ts_utc", F.col("ts").cast("timestamp")).selectExpr("event_id", f"{doc} AS json")


def stored_documents(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """The documents written to compressed files, one per line, and read back from there."""
    path = scratch_dir(spark, "documents")
    documents_json(table(spark, sf_dir, "events")).select("json").write.options(**DOCUMENT_OPTIONS) \
        .option("maxRecordsPerFile", DOCUMENT_FILE_ROWS).text(path)
    return read_documents(spark, path, parts, per_line=True).withColumn("event_id", F.col("rows"))
