"""Queries over the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drayage.operators.verify import (
    count_parity, file_manifest, manifest, manifest_total, parity_pass, publish_gate, rep_consistency,
    save_manifest, saved_manifest,
)
from drayage.queries import query
from drayage.queries.inputs import SQL_REPS, TABLES, reps
from drayage.session import scratch_dir
from drayage.sources.tables import parquet_tables

_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES)


@query("manifest", _COUNTS_SQL)
def all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_manifest(spark, {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TABLES})


@query("manifest_total", f"""
SELECT count(*) AS tables, CAST(sum(rows) AS BIGINT) AS rows FROM ({_COUNTS_SQL})""")
def total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_total(all_tables(spark, sf_dir))


@query("saved_manifest", """
SELECT 'orders' AS "table", count(*) AS rows FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts saved for two sources, one of them twice: the last ones count, the others stay out."""
    root = scratch_dir(spark, "manifests")
    tables = parquet_tables(spark, sf_dir, ["orders", "lineitem", "events"])
    save_manifest(manifest(spark, {"orders": tables["events"]}), root, "pg", "tpch-given")
    save_manifest(manifest(spark, {"orders": tables["events"]}), root, "mysql", "tpch-given")
    kept = manifest(spark, {n: tables[n] for n in ("orders", "lineitem")})
    save_manifest(kept, root, "pg", "tpch-given")
    return saved_manifest(spark, root, "pg", "tpch-given")


_CHECKED = ["region", "nation", "customer", "orders", "lineitem", "events"]
_PARITY_SQL = """
WITH p AS (
  SELECT 'region' AS "table", (SELECT count(*) FROM region) AS source, CAST(-1 AS BIGINT) AS sink
  UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation)
  UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 2 * (SELECT count(*) FROM customer)
  UNION ALL SELECT 'orders', (SELECT count(*) FROM orders),
    (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F')
  UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem)
  UNION ALL SELECT 'events', (SELECT count(*) FROM events), (SELECT count(*) FROM events))
SELECT "table", source, sink, source = sink AS count_match, source = sink AS "match" FROM p"""


@query("count_parity", _PARITY_SQL)
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that lost a table, doubled one and lost part of a third."""
    source = parquet_tables(spark, sf_dir, _CHECKED)
    sink = {
        "nation": source["nation"],
        "customer": source["customer"].unionAll(source["customer"]),
        "orders": source["orders"].filter("o_orderstatus <> 'F'"),
        "lineitem": source["lineitem"],
        "events": source["events"],
    }
    return count_parity(manifest(spark, source), manifest(spark, sink))


@query("parity_pass", f"""
SELECT count(*) AS tables, count(*) FILTER (NOT "match") AS mismatches,
  bool_and("match") AS parity_pass FROM ({_PARITY_SQL})""")
def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_pass(parity(spark, sf_dir))


@query("rep_consistency", f"""
WITH r AS ({SQL_REPS}), f AS (SELECT customer, arg_min(rows, rep) AS first_rows FROM r GROUP BY 1)
SELECT customer, min(first_rows) AS first_rows,
  min(rep) FILTER (rows <> first_rows) AS first_offender,
  count(*) FILTER (rows <> first_rows) = 0 AS consistent
FROM r JOIN f USING (customer) GROUP BY customer""")
def consistent_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rep_consistency(reps(spark, sf_dir), ["customer"])


@query("publish_gate", f"""
WITH r AS ({SQL_REPS})
SELECT customer, rep, wall_seconds, parity_pass FROM r
WHERE customer NOT IN (SELECT customer FROM r WHERE NOT parity_pass)""")
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = publish_gate(reps(spark, sf_dir), ["customer"])
    return gate.select("customer", "rep", "wall_seconds", "parity_pass")
