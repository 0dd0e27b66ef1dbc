"""Declared layouts of the tables, files and documents the library moves and analyses."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Column names, order and types of the eight TPC-H tables, in load order.
TPCH_DDL: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING, r_comment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT, n_comment STRING",
    "supplier": """s_suppkey INT, s_name STRING, s_address STRING, s_nationkey INT, s_phone STRING,
        s_acctbal DECIMAL(15,2), s_comment STRING""",
    "customer": """c_custkey INT, c_name STRING, c_address STRING, c_nationkey INT, c_phone STRING,
        c_acctbal DECIMAL(15,2), c_mktsegment STRING, c_comment STRING""",
    "part": """p_partkey INT, p_name STRING, p_mfgr STRING, p_brand STRING, p_type STRING, p_size INT,
        p_container STRING, p_retailprice DECIMAL(15,2), p_comment STRING""",
    "partsupp": """ps_partkey INT, ps_suppkey INT, ps_availqty INT, ps_supplycost DECIMAL(15,2),
        ps_comment STRING""",
    "orders": """o_orderkey INT, o_custkey INT, o_orderstatus STRING, o_totalprice DECIMAL(15,2),
        o_orderdate DATE, o_orderpriority STRING, o_clerk STRING, o_shippriority INT, o_comment STRING""",
    "lineitem": """l_orderkey INT, l_partkey INT, l_suppkey INT, l_linenumber INT,
        l_quantity DECIMAL(15,2), l_extendedprice DECIMAL(15,2), l_discount DECIMAL(15,2),
        l_tax DECIMAL(15,2), l_returnflag STRING, l_linestatus STRING, l_shipdate DATE,
        l_commitdate DATE, l_receiptdate DATE, l_shipinstruct STRING, l_shipmode STRING,
        l_comment STRING""",
}

# Column names, order and types of the two taxi tables.
TAXI_DDL: dict[str, str] = {
    "trips": """id BIGINT, vendor_id INT, pickup_at TIMESTAMP_NTZ, dropoff_at TIMESTAMP_NTZ,
        passenger_count INT, trip_distance DECIMAL(15,2), ratecode_id INT, store_and_fwd_flag STRING,
        pu_location_id INT, do_location_id INT, payment_type INT, fare_amount DECIMAL(15,2),
        extra DECIMAL(15,2), mta_tax DECIMAL(15,2), tip_amount DECIMAL(15,2),
        tolls_amount DECIMAL(15,2), improvement_surcharge DECIMAL(15,2), total_amount DECIMAL(15,2),
        congestion_surcharge DECIMAL(15,2), airport_fee DECIMAL(15,2)""",
    "fhv_trips": """id BIGINT, dispatching_base_num STRING, pickup_at TIMESTAMP_NTZ,
        dropoff_at TIMESTAMP_NTZ, pu_location_id INT, do_location_id INT, sr_flag INT,
        affiliated_base_number STRING""",
}

# Leading key column of each table, by which a database extraction is split.
SPLIT_KEYS: dict[str, str] = {
    "region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey",
    "customer": "c_custkey", "part": "p_partkey", "partsupp": "ps_partkey",
    "orders": "o_orderkey", "lineitem": "l_orderkey", "trips": "id", "fhv_trips": "id",
}

# Field names of a published result document (JSON), and of the nested parts of a repetition.
_SNAPSHOT = """STRUCT<capturedAt: TIMESTAMP, counters: MAP<STRING, DOUBLE>,
    replicationSlots: ARRAY<STRUCT<name: STRING, active: BOOLEAN, retainedBytes: BIGINT,
        walStatus: STRING>>, error: STRING>"""
ENDPOINT_PARTS = {
    "snapshots": f"before: {_SNAPSHOT}, after: {_SNAPSHOT}, afterTeardown: {_SNAPSHOT}",
    "series": """cloudWatch: ARRAY<STRUCT<name: STRING, stat: STRING,
        points: ARRAY<STRUCT<at: TIMESTAMP, value: DOUBLE>>>>, metricsError: STRING""",
}
REP_PARTS = {
    "resources": """resources: ARRAY<STRUCT<role: STRING, image: STRING, imageId: STRING,
        cpuSeconds: DOUBLE, peakMemBytes: BIGINT, netRxBytes: BIGINT, netTxBytes: BIGINT,
        samples: INT>>""",
    "parity": """parity: ARRAY<STRUCT<`table`: STRING, source: BIGINT, sink: BIGINT,
        countMatch: BOOLEAN, `match`: BOOLEAN>>""",
    "databases": "databases: ARRAY<STRUCT<role: STRING, engine: STRING, rdsIdentifier: STRING{endpoint}>>",
}
RESULT_DDL = """
    sut STRING, scenario STRING, route STRING, dataset STRING, rows BIGINT, cohort STRING,
    topology STRING,
    source STRUCT<engine: STRING, provider: STRING, label: STRING>,
    sink STRUCT<engine: STRING, provider: STRING, label: STRING>,
    image STRING, native BOOLEAN, config MAP<STRING, STRING>, startedAt TIMESTAMP,
    reps ARRAY<STRUCT<
        startedAt: TIMESTAMP, endedAt: TIMESTAMP,
        coldStart: STRUCT<rebootSeconds: DOUBLE, settleSeconds: DOUBLE>,
        provisionSeconds: DOUBLE, seedSeconds: DOUBLE, setupSeconds: DOUBLE, wallSeconds: DOUBLE,
        teardownSeconds: DOUBLE, validationSeconds: DOUBLE, rowsPerSec: DOUBLE,
        parityPass: BOOLEAN{parts}>>,
    medianWallSeconds DOUBLE, minWallSeconds DOUBLE, maxWallSeconds DOUBLE,
    medianRowsPerSec DOUBLE, parityPass BOOLEAN, os STRING, arch STRING, cpus INT,
    cpuModel STRING, memoryBytes BIGINT, goVersion STRING, machine STRING, gitCommit STRING,
    gitDirty BOOLEAN, verification STRING
"""
# ------------------------------------------------------------ end fixed values


# Reading a DDL text takes a running session, so layouts are made when asked for.
MANIFEST = "`table` STRING, rows BIGINT"
OUTCOME = "`table` STRING, status STRING, rows BIGINT, seconds DOUBLE, error STRING"


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(ddl.split()))


def tpch_schema(table: str) -> T.StructType:
    return _struct(TPCH_DDL[table])


def taxi_schema(table: str) -> T.StructType:
    return _struct(TAXI_DDL[table])


ALL_PARTS = ("resources", "parity", "snapshots", "series")


def result_document(parts: tuple[str, ...] = ALL_PARTS) -> T.StructType:
    """Layout of a result document with the wanted nested parts only.

    A reader skips what the layout leaves out, which is most of a document when only the
    repetitions are wanted.
    """
    endpoint = [ENDPOINT_PARTS[p] for p in parts if p in ENDPOINT_PARTS]
    wanted = [REP_PARTS[p] for p in parts if p in REP_PARTS]
    if endpoint:
        wanted.append(REP_PARTS["databases"].format(endpoint="".join(f", {e}" for e in endpoint)))
    return _struct(RESULT_DDL.format(parts="".join(f", {w}" for w in wanted)))


def wide_keys(schema: T.StructType) -> T.StructType:
    """The same layout with 64-bit keys.

    Declared keys are 32-bit. A strict cast of larger keys fails the load, and an order key
    passes 2^31 at a few hundred scale factors, so large moves declare wide keys.
    """
    return T.StructType([
        T.StructField(f.name, T.LongType(), f.nullable)
        if f.name.endswith("key") and isinstance(f.dataType, T.IntegerType) else f
        for f in schema.fields
    ])


def narrowed(schema: T.StructType, columns: list[str]) -> T.StructType:
    """The declared layout restricted to the columns a source really has, in declared order."""
    present = set(columns)
    return T.StructType([f for f in schema.fields if f.name in present])
