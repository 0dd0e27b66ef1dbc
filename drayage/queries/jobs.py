"""Queries over whole jobs: full loads, reuse of a loaded dataset, generations, convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.operators.conform import conform
from drayage.operators.verify import convergence, count_parity, manifest, sink_counts
from drayage.plans.load import (
    LoadFailed, current_generation, full_load, outcome_manifest, replace_tables, reuse_seed,
)
from drayage.queries import query
from drayage.queries.inputs import MOVED, table
from drayage.queries.sinks import new_namespace
from drayage.schemas import narrowed, tpch_schema, wide_keys
from drayage.session import scratch_dir
from drayage.sinks.files import table_path, write_replace
from drayage.sinks.tables import reset_namespace


def declared(name: str, df: DataFrame) -> DataFrame:
    """A given table in its declared layout, as far as the given columns go."""
    return conform(df, narrowed(wide_keys(tpch_schema(name)), df.columns))


def load_and_check(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Move tables into their declared layout and compare what was read with what arrived."""
    sink = scratch_dir(spark, "load")
    layout = {}

    def shape(name: str, df: DataFrame) -> DataFrame:
        out = declared(name, df)
        layout[name] = out.schema
        return out

    outcomes = full_load(
        spark, names, lambda n: table(spark, sf_dir, n),
        lambda n, df: write_replace(df, table_path(sink, n)), shape)
    delivered = sink_counts(
        spark, names, lambda n: spark.read.schema(layout[n]).parquet(table_path(sink, n)))
    return count_parity(outcome_manifest(outcomes), delivered, tables=names)


def _counts(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in names)


@query("full_load", f"""
SELECT "table", rows AS source, rows AS sink, true AS count_match, true AS "match" FROM ({_counts(MOVED)})""")
def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_and_check(spark, sf_dir, MOVED)


@query("reuse_seed", f'SELECT "table", rows, true AS reused FROM ({_counts(MOVED)})')
def second_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first call loads the namespace, the second finds it loaded and only counts."""
    namespace, location = new_namespace(spark)

    def seed() -> DataFrame:
        return reuse_seed(spark, namespace, "tpch-given", MOVED,
                          lambda n: declared(n, table(spark, sf_dir, n)), location)

    seed()
    return seed()


@query("replace_tables", f"""
SELECT "table", rows, false AS kept FROM ({_counts(["orders", "customer"])})
UNION ALL SELECT 'supplier', count(*), true FROM supplier""")
def replaced_as_a_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that succeeds takes its tables' places; one that fails leaves what was there."""
    namespace, location = new_namespace(spark)
    reset_namespace(spark, namespace, location)
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "supplier")}
    replace_tables(spark, namespace, list(tables), tables.get)
    replace_tables(spark, namespace, ["orders", "customer"], tables.get)
    broken = tables["supplier"].withColumn("s_nationkey", F.raise_error(F.lit("broken source")))
    try:
        replace_tables(spark, namespace, ["supplier"], lambda n: broken)
        failed = False
    except LoadFailed:
        failed = True
    left = [row.name for row in spark.catalog.listTables(namespace)]
    return manifest(spark, {n: spark.table(f"{namespace}.{n}") for n in left}).withColumn(
        "kept", (F.col("table") == "supplier") & F.lit(failed))


@query("generation_overwrite", """
SELECT event_id, event_type, value, CAST(CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1
  WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS INTEGER) AS generation_id
FROM events WHERE ts >= TIMESTAMP '2024-01-11'""")
def second_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = scratch_dir(spark, "generation")
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type", "value",
        "case when ts < timestamp_ntz'2024-01-11' then 1 when ts < timestamp_ntz'2024-01-21' then 2 "
        "else 3 end AS generation_id")
    write_replace(rows, sink)
    kept = scratch_dir(spark, "generation-kept")
    write_replace(current_generation(spark.read.parquet(sink), 2), kept)
    return spark.read.parquet(kept)


@query("convergence", """
WITH e AS (SELECT l_returnflag AS run, 't' || l_linenumber AS "table", l_linenumber AS seed_pos,
    count(*) AS expected FROM lineitem GROUP BY ALL),
d AS (SELECT l_returnflag AS run, 't' || l_linenumber AS "table",
    count(*) FILTER (NOT (l_returnflag = 'A' AND l_linenumber = 3 AND l_orderkey % 2 = 0))
    + count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 5 AND l_orderkey % 2 = 0) AS n
  FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linenumber = 6) GROUP BY ALL),
s AS (SELECT e.run, e."table", seed_pos, expected, COALESCE(n, -1) AS delivered,
    CASE WHEN COALESCE(n, -1) < expected THEN 'pending' WHEN n = expected THEN 'converged'
      ELSE 'overshoot' END AS state
  FROM e LEFT JOIN d ON e.run = d.run AND e."table" = d."table")
SELECT *, NOT EXISTS (SELECT 1 FROM s p WHERE p.run = s.run AND p.seed_pos < s.seed_pos
  AND p.state <> 'converged') AS checked FROM s""")
def converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads of seven tables: one short, one with too much, one with a table missing."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS run", "l_linenumber AS seed_pos", "concat('t', l_linenumber) AS `table`",
        "l_orderkey % 2 = 0 AS even")
    expected = rows.groupBy("run", "table", "seed_pos").agg(F.count(F.lit(1)).alias("rows"))
    copies = ("case when run = 'A' and seed_pos = 3 and even then 0 "
              "when run = 'R' and seed_pos = 5 and even then 2 else 1 end")
    delivered = rows.filter("not (run = 'N' and seed_pos = 6)").groupBy("run", "table").agg(
        F.sum(F.expr(copies)).cast("bigint").alias("rows"))
    return convergence(expected, delivered, run=["run"])
