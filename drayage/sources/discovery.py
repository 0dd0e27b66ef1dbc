"""Narrowing a discovered catalog to the wanted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.sinks.tables import MARKER_TABLE


class MissingTables(ValueError):
    """A wanted table that the catalog does not offer."""


def catalog_streams(spark: SparkSession, namespace: str) -> DataFrame:
    """Tables a namespace holds, its marker left out."""
    tables = spark.sql(f"SHOW TABLES IN {namespace}")
    return tables.select("namespace", F.col("tableName").alias("stream_name")).filter(
        F.col("stream_name") != MARKER_TABLE)


def select_tables(catalog: DataFrame, wanted: DataFrame, name: str = "stream_name") -> DataFrame:
    """Catalog rows of the wanted tables; whatever else the source holds is left out.

    Wanted names are made unique first, so a name asked for many times is no hot join key.
    """
    return catalog.join(wanted.select(name).distinct(), name, "left_semi")


def missing_tables(catalog: DataFrame, wanted: DataFrame, name: str = "stream_name") -> DataFrame:
    """Wanted names the catalog never offered."""
    return wanted.select(name).distinct().join(
        catalog.select(name).distinct(), name, "left_anti")


def require_all(catalog: DataFrame, wanted: DataFrame, name: str = "stream_name") -> None:
    """Moving less than was asked for is an error, not a silent success."""
    first = missing_tables(catalog, wanted, name).limit(1).collect()
    if first:
        raise MissingTables(f"{first[0][name]!r} was asked for and is not offered")


def narrow_catalog(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Narrow catalog documents in both places they list a table, and name what is missing.

    ``selected_streams`` maps a namespace to its streams; ``streams`` carries the schemas.
    """
    names = F.array(*[F.lit(n) for n in wanted])

    def kept(streams: Column, field: str) -> Column:
        return F.filter(streams, lambda s: F.array_contains(names, s[field]))

    selected = F.transform_values("selected_streams", lambda _, v: kept(v, "stream_name"))
    streams = F.filter("streams", lambda s: F.array_contains(names, s["stream"]["name"]))
    found = F.array_union(
        F.flatten(F.transform(F.map_values("selected_streams"),
                              lambda v: F.transform(v, lambda s: s["stream_name"]))),
        F.transform("streams", lambda s: s["stream"]["name"]),
    )
    return (
        docs.withColumn("missing", F.array_except(names, found))
        .withColumn("selected_streams", selected)
        .withColumn("streams", streams)
    )
