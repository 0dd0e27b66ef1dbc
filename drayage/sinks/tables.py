"""Catalog, lake and database tables, and the namespace that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from drayage.functions.names import check_identifier

# Fixed value: the table that says which dataset a namespace holds. It is never moved as data.
MARKER_TABLE = "_seed"


def reset_namespace(spark: SparkSession, namespace: str, location: str | None = None) -> None:
    """Empty the target namespace before a run."""
    check_identifier(namespace.rsplit(".", 1)[-1])
    spark.sql(f"DROP SCHEMA IF EXISTS {namespace} CASCADE")
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA {namespace}{where}")


def save_table(df: DataFrame, namespace: str, name: str, fmt: str = "parquet",
               append: bool = False) -> None:
    mode = "append" if append else "overwrite"
    df.write.format(fmt).mode(mode).saveAsTable(f"{namespace}.{check_identifier(name)}")


def analyze_table(spark: SparkSession, namespace: str, name: str) -> None:
    """Table statistics after a load, for the planner of later reads."""
    spark.sql(f"ANALYZE TABLE {namespace}.{check_identifier(name)} COMPUTE STATISTICS")


def lake_write(df: DataFrame, namespace: str, name: str, fmt: str = "iceberg") -> None:
    """Create or replace a table through the catalog API.

    A lake catalog swaps the whole table atomically. The built-in session catalog cannot, so there
    the old table is dropped first.
    """
    spark = df.sparkSession
    table = f"{namespace}.{check_identifier(name)}"
    if fmt == "iceberg":
        df.writeTo(table).using(fmt).createOrReplace()
        return
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    df.writeTo(table).using(fmt).create()


def check_writable(spark: SparkSession, namespace: str, fmt: str = "iceberg") -> None:
    """One row in, read back and dropped: a bad target fails before the load, not after."""
    probe = "write_probe"
    lake_write(spark.range(1).withColumnRenamed("id", "ok"), namespace, probe, fmt)
    rows = spark.table(f"{namespace}.{probe}").count()
    spark.sql(f"DROP TABLE {namespace}.{probe}")
    if rows != 1:
        raise RuntimeError(f"{namespace}: wrote one row, read back {rows}")


def jdbc_write_options(url: str, schema: T.StructType, batch_rows: int, writers: int,
                       text_length: int | None = None) -> dict[str, str]:
    """Writer options for a database table.

    ``truncate`` keeps the declared column types when a table is replaced. Text has no length
    unless one is given, for a database whose unbounded text cannot be compared in a filter.
    """
    text = text_length and ", ".join(
        f"{f.name} VARCHAR({text_length})" for f in schema.fields
        if isinstance(f.dataType, T.StringType))
    options = {"url": url, "batchsize": str(batch_rows), "numPartitions": str(writers),
               "truncate": "true"}
    return options | ({"createTableColumnTypes": text} if text else {})


def jdbc_replace(df: DataFrame, options: dict[str, str], namespace: str, name: str) -> None:
    df.write.format("jdbc").options(**options) \
        .option("dbtable", f"{namespace}.{check_identifier(name)}").mode("overwrite").save()


def jdbc_insert(df: DataFrame, options: dict[str, str], namespace: str, name: str) -> None:
    df.write.format("jdbc").options(**options) \
        .option("dbtable", f"{namespace}.{check_identifier(name)}").mode("append").save()
