"""Queries over the taxi harmonisation and the declared layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.functions.casts import zoneless
from drayage.functions.months import Month
from drayage.operators.conform import conform, duplicate_keys, null_defaults
from drayage.operators.harmonise import (
    Era, era_rows, fhv, fhvhv, harmonise, project, union_eras, window_filter, yellow_2009,
    yellow_2010, yellow_modern,
)
from drayage.queries import inputs, query
from drayage.queries.inputs import sql_window, table
from drayage.schemas import narrowed, tpch_schema, wide_keys
from drayage.session import scratch_dir
from drayage.sources.monthly import listed_files, numbered, window_start, with_file_ordinal

_RAW = {
    yellow_2009: inputs.yellow_2009_raw, yellow_2010: inputs.yellow_2010_raw,
    yellow_modern: inputs.yellow_modern_raw, fhv: inputs.fhv_raw, fhvhv: inputs.fhvhv_raw,
}
_SQL = {
    yellow_2009: inputs.SQL_LEGACY_ROWS, yellow_2010: inputs.SQL_LEGACY_ROWS,
    yellow_modern: inputs.SQL_MODERN_ROWS, fhv: inputs.SQL_FHV_ROWS, fhvhv: inputs.SQL_FHVHV_ROWS,
}


def _projected(layout, table_name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = _RAW[layout](spark, sf_dir)
        return project(raw, layout, table_name, keep=("row_index",))

    return run


def _projection_sql(layout) -> str:
    return f"SELECT rn AS row_index, * EXCLUDE (rn) FROM ({_SQL[layout]})"


for _name, _layout, _table in (
    ("era_yellow_2009", yellow_2009, "trips"), ("era_yellow_2010", yellow_2010, "trips"),
    ("era_yellow_modern", yellow_modern, "trips"), ("era_fhv", fhv, "fhv_trips"),
    ("era_fhvhv", fhvhv, "fhv_trips"),
):
    query(_name, _projection_sql(_layout))(_projected(_layout, _table))


_LO, _HI = Month(1997, 3), Month(1997, 5)


@query("window_filter", f"""
SELECT rn AS row_index, pickup_at, dropoff_at, total_amount FROM ({inputs.SQL_MODERN_ROWS})
WHERE pickup_at >= TIMESTAMP '{_LO.start}' AND pickup_at < TIMESTAMP '{_HI.plus(1).start}'
  AND dropoff_at < TIMESTAMP '{_HI.plus(2).start}'""")
def three_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project(inputs.yellow_modern_raw(spark, sf_dir), yellow_modern, "trips", ("row_index",))
    return window_filter(rows, _LO, _HI).select("row_index", "pickup_at", "dropoff_at", "total_amount")


def _harmonised(spark: SparkSession, sf_dir: str, name: str, eras: list[Era], begin: Month) -> DataFrame:
    """Every era reads the one file there is, as a file of its own layout."""
    parts, ordinal = [], 0
    for era in eras:
        window = era.clipped(begin)
        if window is None:
            continue
        raw = _RAW[era.layout](spark, sf_dir)
        ordinals = numbered(listed_files(raw), ordinal)
        raw = with_file_ordinal(spark, raw, ordinals)
        ordinal += len(ordinals)
        parts.append(era_rows(raw, era, name, *window))
    return union_eras(parts, name)


def _harmonised_sql(eras: list[Era], begin: Month) -> str:
    parts, ordinal = [], 0
    for era in eras:
        window = era.clipped(begin)
        if window is not None:
            parts.append(sql_window(_SQL[era.layout], ordinal, *window))
            ordinal += 1
    return "\nUNION ALL\n".join(parts)


_BEGIN = window_start(inputs.TRIPS_MONTHS, inputs.TRIPS_LAST)
_JANUARY = Month(2024, 1)
_TRIPS_SQL = _harmonised_sql(inputs.TRIPS_ERAS, _BEGIN)
_FHV_SQL = _harmonised_sql(inputs.FHV_ERAS, _JANUARY)


@query("union_eras", _TRIPS_SQL)
def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harmonised(spark, sf_dir, "trips", inputs.TRIPS_ERAS, _BEGIN)


_PICKUP = {yellow_2009: "Trip_Pickup_DateTime", yellow_2010: "pickup_datetime",
           yellow_modern: "tpep_pickup_datetime"}


@query("harmonise_trips", f"SELECT * EXCLUDE (id) FROM ({_TRIPS_SQL})")
def from_month_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by way of real month files, one tree of them per era; ids depend on how the
    files were written and are left out."""
    root = scratch_dir(spark, "taxi")
    for era in inputs.TRIPS_ERAS:
        raw = _RAW[era.layout](spark, sf_dir).drop("file_path", "row_index")
        pickup = F.col(_PICKUP[era.layout]).cast("timestamp_ntz")
        lo, stop = zoneless(era.first.start), zoneless(era.last.plus(1).start)
        raw.filter((pickup >= lo) & (pickup < stop)) \
            .withColumn("month", F.substring(pickup.cast("string"), 1, 7)).hint("rebalance", "month") \
            .write.partitionBy("month").parquet(f"{root}/{era.prefix}")
    template = root + "/{prefix}/month={month}"
    return harmonise(spark, "trips", template, inputs.TRIPS_MONTHS, inputs.TRIPS_ERAS,
                     inputs.TRIPS_LAST).drop("id")


@query("harmonise_fhv", _FHV_SQL)
def fhv_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harmonised(spark, sf_dir, "fhv_trips", inputs.FHV_ERAS, _JANUARY)


@query("stable_id", f"""
SELECT id, id // 4294967296 AS file_ordinal, id % 4294967296 AS row_index, pickup_at FROM ({_TRIPS_SQL})""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).select(
        "id", F.shiftright("id", 32).alias("file_ordinal"),
        F.col("id").bitwiseAND((1 << 32) - 1).alias("row_index"), "pickup_at")


def _decimal(c: str) -> str:
    return f"CAST(CAST({c} AS VARCHAR) AS DECIMAL(15,2)) AS {c}"


@query("conform", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_decimal("l_quantity")},
  {_decimal("l_extendedprice")}, {_decimal("l_discount")}, {_decimal("l_tax")},
  l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate
FROM lineitem""")
def conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return conform(lines, narrowed(wide_keys(tpch_schema("lineitem")), lines.columns))


@query("null_defaults", """
SELECT rn AS row_index,
  CASE WHEN event_type = 'view' THEN '' ELSE 'B' || lpad(CAST(user_id AS VARCHAR), 5, '0') END AS dispatching_base_num,
  ts AS pickup_datetime,
  CASE WHEN event_type = 'error' THEN NULL ELSE ts + to_seconds(user_id * 60) END AS "dropOff_datetime",
  CAST(user_id AS DOUBLE) AS "PUlocationID",
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 263 END AS "DOlocationID",
  CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN 'n/a' ELSE '' END AS "SR_Flag",
  CASE WHEN event_id % 2 = 0 THEN '' ELSE 'B' || lpad(CAST(event_id % 900 AS VARCHAR), 5, '0') END AS "Affiliated_base_number"
FROM (SELECT *, row_number() OVER () - 1 AS rn FROM events)""")
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_defaults(inputs.fhv_raw(spark, sf_dir).drop("file_path"))


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
