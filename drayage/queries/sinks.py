"""Queries over the writers. Each returns the sink, read back whole."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.functions.names import result_path, utc_day
from drayage.operators.verify import manifest
from drayage.queries import query
from drayage.queries.inputs import table
from drayage.session import scratch_dir
from drayage.sinks.files import (
    BATCHING, csv_export, csv_import, read_evolved, write_bounded, write_insert, write_once, write_replace,
)
from drayage.sinks.tables import check_writable, lake_write, reset_namespace, save_table


def new_namespace(spark: SparkSession) -> tuple[str, str]:
    """A namespace no other run uses, stored in the shared scratch folder."""
    name = f"drayage_{uuid.uuid4().hex}"
    return name, scratch_dir(spark, name)


@query("write_replace", "SELECT * FROM orders")
def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "replace")
    write_replace(table(spark, sf_dir, "customer"), path)
    write_replace(table(spark, sf_dir, "orders"), path)
    return spark.read.parquet(path)


@query("write_insert", """
SELECT o_orderkey, o_custkey, o_totalprice,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inserts, the second with one column more."""
    path = scratch_dir(spark, "insert")
    orders = table(spark, sf_dir, "orders")
    base = ["o_orderkey", "o_custkey", "o_totalprice"]
    write_insert(orders.filter("o_orderstatus = 'F'").select(*base), path)
    write_insert(orders.filter("o_orderstatus <> 'F'").select(*base, "o_orderpriority"), path)
    return read_evolved(spark, path)


@query("write_batching", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, true AS within_bound FROM lineitem""")
def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem in files of bounded size, each row with whether its file keeps the bound."""
    path = scratch_dir(spark, "batching")
    batching = replace(BATCHING["small"], file_rows=BATCHING["small"].write_rows)
    bound = batching.file_rows
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    write_replace(lines, path, **batching.files())
    return spark.read.parquet(path).withColumn(
        "within_bound", F.col("_metadata.row_index") < F.lit(bound))


@query("write_bounded", """
SELECT doc_id, text, lang, source, n_chars, true AS within_bound FROM documents""")
def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of very uneven length in files of at most 60,000 bytes and 500 rows (one row more than
    that alone), each row with whether its file keeps the bounds."""
    path = scratch_dir(spark, "bounded")
    documents = table(spark, sf_dir, "documents")
    batching = replace(BATCHING["small"], file_rows=500, file_bytes=60_000)
    write_bounded(documents, path, batching, ranges=4)
    back = spark.read.schema(documents.schema).json(path)
    file = F.col("_metadata.file_path")
    rows = back.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    placed = back.select("*", file.alias("file"), F.col("_metadata.file_size").alias("size"))
    within = ((F.col("size") <= batching.file_bytes) & (F.col("rows") <= batching.file_rows)) | (F.col("rows") == 1)
    return placed.join(rows, "file").select(*documents.columns, within.alias("within_bound"))


@query("csv_export", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    documents = table(spark, sf_dir, "documents")
    csv_export(documents, path, file_rows=10_000)
    return csv_import(spark, path, documents.schema)


@query("csv_times", r"""
SELECT event_id, ts, ts AS "at", CASE event_id % 5 WHEN 0 THEN '\N' WHEN 1 THEN event_type || chr(13) || chr(10) || 'x'
  WHEN 2 THEN '\' || event_type WHEN 3 THEN NULL ELSE props END AS note FROM events""")
def times_through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to the microsecond, and texts that look like markers or hold foreign line ends."""
    path = scratch_dir(spark, "csv")
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "cast(ts as timestamp) AS `at`",
        r"""case event_id % 5 when 0 then '\\N' when 1 then concat(event_type, char(13), char(10), 'x')
            when 2 then concat('\\', event_type) when 3 then null else props end AS note""")
    csv_export(events, path, file_rows=10_000)
    return csv_import(spark, path, events.schema).withColumn("at", F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.col("at").cast("timestamp_ntz")))


@query("lake_write", "SELECT * FROM customer")
def lake_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice through the catalog API; the second write replaces the first."""
    namespace, location = new_namespace(spark)
    reset_namespace(spark, namespace, location)
    check_writable(spark, namespace, "parquet")
    lake_write(table(spark, sf_dir, "supplier"), namespace, "customer", "parquet")
    lake_write(table(spark, sf_dir, "customer"), namespace, "customer", "parquet")
    return spark.table(f"{namespace}.customer")


def _safe(expr: str) -> str:
    cleaned = f"regexp_replace({expr}, '[^A-Za-z0-9_-]', '-', 'g')"
    return f"CASE WHEN {expr} = '' THEN 'unlabeled' ELSE {cleaned} END"


@query("write_once", f"""
SELECT o_orderkey, o_totalprice, CAST(o_orderdate + to_microseconds(o_orderkey) AS TIMESTAMP) AS ended_at,
  strftime(o_orderdate, '%Y') AS day, {_safe("o_orderpriority")} AS cohort,
  {_safe("'tool ' || o_orderstatus")} AS tool, 'full-load-pg-pg-order-' || o_orderkey || '-remote' AS name
FROM orders""")
def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of results into one folder tree; each order is one result."""
    root = scratch_dir(spark, "once")
    results = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_totalprice",
        "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey / 1000000BD) AS ended_at", "date_format(o_orderdate, 'yyyy') AS day",
        "o_orderpriority AS cohort", "concat('tool ', o_orderstatus) AS tool",
        "'full-load' AS scenario", "'pg-pg' AS route", "concat('order ', o_orderkey) AS dataset",
        "'remote' AS topology", "o_orderstatus = 'F' AS early")
    for part in ("early", "not early"):
        write_once(results.filter(part).drop("early"), root)
    ddl = "o_orderkey BIGINT, o_totalprice DOUBLE, ended_at TIMESTAMP_NTZ, day STRING, cohort STRING, tool STRING, name STRING"
    return spark.read.schema(ddl).json(root)


@query("result_path", f"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '/' || {_safe("o_orderpriority")} || '/'
  || {_safe("CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'tool.' || o_orderstatus END")} || '/'
  || 'full-load-' || {_safe("'pg>' || o_orderstatus")} || '-'
  || {_safe("'tpch sf' || CAST(o_custkey AS VARCHAR)")} || '-remote.json' AS path
FROM orders""")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    tool = F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("tool."), status))
    dataset = F.concat(F.lit("tpch sf"), F.col("o_custkey").cast("string"))
    path = result_path(
        utc_day(F.col("o_orderdate")), F.col("o_orderpriority"), tool, F.lit("full-load"),
        F.concat(F.lit("pg>"), status), dataset, F.lit("remote"))
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))


@query("reset_namespace", "SELECT 'orders' AS \"table\", count(*) AS rows FROM orders")
def emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A namespace with two tables, emptied, then loaded with one: only that one is left."""
    namespace, location = new_namespace(spark)
    reset_namespace(spark, namespace, location)
    save_table(table(spark, sf_dir, "customer"), namespace, "customer")
    save_table(table(spark, sf_dir, "orders"), namespace, "orders")
    reset_namespace(spark, namespace, location)
    save_table(table(spark, sf_dir, "orders"), namespace, "orders")
    left = [t.name for t in spark.catalog.listTables(namespace)]
    return manifest(spark, {name: spark.table(f"{namespace}.{name}") for name in left})
