"""Whole-table reads: no predicate, no cursor, read once."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from drayage.functions.names import check_identifier

# Rows per round trip when reading from a database.
FETCH_SIZE = 10_240


def parquet_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{check_identifier(name)}.parquet")


def parquet_tables(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Several tables; their footers are read side by side."""
    names = list(names)
    with ThreadPoolExecutor(max_workers=8) as pool:
        return dict(zip(names, pool.map(
            inheritable_thread_target(spark)(lambda n: parquet_table(spark, root, n)), names),
            strict=True))


def catalog_table(spark: SparkSession, namespace: str, name: str) -> DataFrame:
    return spark.table(f"{namespace}.{check_identifier(name)}")


def jdbc_options(url: str, **extra: str) -> dict[str, str]:
    """Reader options for a database endpoint; zoneless timestamps stay zoneless."""
    return {"url": url, "fetchsize": str(FETCH_SIZE), "preferTimestampNTZ": "true", **extra}


def jdbc_table(spark: SparkSession, options: dict[str, str], namespace: str, name: str,
               predicates: list[str] | None = None) -> DataFrame:
    """One database table, as one partition or as one partition per predicate."""
    table = f"{namespace}.{check_identifier(name)}"
    if predicates:
        rest = {k: v for k, v in options.items() if k != "url"}
        return spark.read.jdbc(options["url"], table, predicates=predicates, properties=rest)
    return spark.read.format("jdbc").options(**options).option("dbtable", table).load()


def jdbc_count(spark: SparkSession, options: dict[str, str], namespace: str, name: str) -> DataFrame:
    """The count runs inside the database: Spark would otherwise fetch every row to count it."""
    query = f"SELECT count(*) AS n FROM {namespace}.{check_identifier(name)}"
    return spark.read.format("jdbc").options(**options).option("query", query).load()


def jdbc_bounds(spark: SparkSession, options: dict[str, str], namespace: str, name: str,
                key: str) -> DataFrame:
    """Smallest and largest key, found by the database."""
    query = (f"SELECT min({check_identifier(key)}) AS lo, max({key}) AS hi "
             f"FROM {namespace}.{check_identifier(name)}")
    return spark.read.format("jdbc").options(**options).option("query", query).load()


def jdbc_ranges(key: str, lo: int, hi: int, splits: int) -> dict[str, str]:
    """Reader options for equal key ranges; rows outside the bounds go to the edge ranges."""
    return {"partitionColumn": check_identifier(key), "lowerBound": str(lo),
            "upperBound": str(hi + 1), "numPartitions": str(splits)}
