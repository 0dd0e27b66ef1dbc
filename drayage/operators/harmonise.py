"""Taxi files of five layouts onto two tables.

A layout is a list of (output column, expression over that layout's raw columns). Expressions use
raw columns only, so an era costs one projection over its scan: unused columns are never read and
a window filter on an already typed pickup column reaches the file reader.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.functions.casts import coded, lenient_int, zero_if_null, zoneless
from drayage.functions.months import Month
from drayage.operators.conform import conform
from drayage.schemas import taxi_schema
from drayage.sources.monthly import (
    LAST_MONTH, listed_files, month_scans, numbered, stable_id, window_start, with_file_ordinal,
)

# Legacy text codes and their numbers.
VENDOR_CODES = {"CMT": 1, "VTS": 2, "DDS": 3}
PAYMENT_PREFIXES = {"CRE": 1, "CAS": 2}
SHARED_YES = "Y"


def _zero() -> Column:
    return F.lit(0)


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _time(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz")


def _code(df: DataFrame, name: str) -> Column:
    """Lenient code of a raw column, with the rounding its raw type calls for."""
    return zero_if_null(lenient_int(F.col(name), dict(df.dtypes)[_match(df, name)] == "string"))


def _match(df: DataFrame, name: str) -> str:
    return next(c for c in df.columns if c.lower() == name.lower())


def _number(name: str) -> Column:
    return zero_if_null(F.col(name))


def _coordinates_era(df: DataFrame, vendor: str, pickup: str, dropoff: str, passengers: str,
                     distance: str, rate: str, stored: str, payment: str, fare: str, tip: str,
                     tolls: str, total: str) -> dict[str, Column]:
    """Both layouts that located trips by coordinates: text codes, no location ids."""
    return {
        "vendor_id": coded(F.col(vendor), VENDOR_CODES),
        "pickup_at": _time(pickup), "dropoff_at": _time(dropoff),
        "passenger_count": _number(passengers), "trip_distance": _number(distance),
        "ratecode_id": _code(df, rate), "store_and_fwd_flag": _text(F.col(stored)),
        "pu_location_id": _zero(), "do_location_id": _zero(),
        "payment_type": coded(F.col(payment), PAYMENT_PREFIXES, prefix=True),
        "fare_amount": _number(fare), "extra": _number("surcharge"),
        "mta_tax": _number("mta_tax"), "tip_amount": _number(tip),
        "tolls_amount": _number(tolls), "improvement_surcharge": _zero(),
        "total_amount": _number(total), "congestion_surcharge": _zero(), "airport_fee": _zero(),
    }


def yellow_2009(df: DataFrame) -> dict[str, Column]:
    return _coordinates_era(
        df, "vendor_name", "Trip_Pickup_DateTime", "Trip_Dropoff_DateTime", "Passenger_Count",
        "Trip_Distance", "Rate_Code", "store_and_forward", "Payment_Type", "Fare_Amt", "Tip_Amt",
        "Tolls_Amt", "Total_Amt")


def yellow_2010(df: DataFrame) -> dict[str, Column]:
    return _coordinates_era(
        df, "vendor_id", "pickup_datetime", "dropoff_datetime", "passenger_count",
        "trip_distance", "rate_code", "store_and_fwd_flag", "payment_type", "fare_amount",
        "tip_amount", "tolls_amount", "total_amount")


def yellow_modern(df: DataFrame) -> dict[str, Column]:
    amounts = {name: _number(name) for name in (
        "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge",
        "total_amount", "congestion_surcharge")}
    return {
        "vendor_id": _code(df, "VendorID"),
        "pickup_at": _time("tpep_pickup_datetime"), "dropoff_at": _time("tpep_dropoff_datetime"),
        "passenger_count": _code(df, "passenger_count"), "trip_distance": _number("trip_distance"),
        "ratecode_id": _code(df, "RatecodeID"),
        "store_and_fwd_flag": _text(F.col("store_and_fwd_flag")),
        "pu_location_id": _code(df, "PULocationID"), "do_location_id": _code(df, "DOLocationID"),
        "payment_type": _code(df, "payment_type"), **amounts,
        "airport_fee": _number("Airport_fee"),
    }


def fhv(df: DataFrame) -> dict[str, Column]:
    pickup = _time("pickup_datetime")
    return {
        "dispatching_base_num": _text(F.col("dispatching_base_num")),
        "pickup_at": pickup, "dropoff_at": F.coalesce(_time("dropOff_datetime"), pickup),
        "pu_location_id": _code(df, "PUlocationID"), "do_location_id": _code(df, "DOlocationID"),
        "sr_flag": _code(df, "SR_Flag"),
        "affiliated_base_number": _text(F.col("Affiliated_base_number")),
    }


def fhvhv(df: DataFrame) -> dict[str, Column]:
    shared = F.col("shared_request_flag") == SHARED_YES
    return {
        "dispatching_base_num": _text(F.col("dispatching_base_num")),
        "pickup_at": _time("pickup_datetime"), "dropoff_at": _time("dropoff_datetime"),
        "pu_location_id": _number("PULocationID"), "do_location_id": _number("DOLocationID"),
        "sr_flag": F.when(shared, F.lit(1)).otherwise(F.lit(0)),
        "affiliated_base_number": _text(F.col("originating_base_num")),
    }


@dataclass(frozen=True)
class Era:
    """One layout of a table: file prefix, first and last month, and the projection."""

    prefix: str
    layout: Callable[[DataFrame], dict[str, Column]]
    first: Month
    last: Month
    #: The raw column that has the pickup time as text.
    pickup_text: str | None = None

    def clipped(self, begin: Month) -> tuple[Month, Month] | None:
        """The era's part of a window that starts at ``begin``; None if they do not meet."""
        lo = max(self.first, begin)
        return None if lo > self.last else (lo, self.last)


# Which layout each month range uses.
TRIPS_ERAS = [
    Era("yellow_tripdata", yellow_2009, Month(2009, 1), Month(2009, 12), "Trip_Pickup_DateTime"),
    Era("yellow_tripdata", yellow_2010, Month(2010, 1), Month(2010, 12), "pickup_datetime"),
    Era("yellow_tripdata", yellow_modern, Month(2011, 1), LAST_MONTH),
]
FHV_ERAS = [
    Era("fhv_tripdata", fhv, Month(2015, 1), LAST_MONTH),
    Era("fhvhv_tripdata", fhvhv, Month(2019, 2), LAST_MONTH),
]
TAXI_ERAS = {"trips": TRIPS_ERAS, "fhv_trips": FHV_ERAS}


def project(df: DataFrame, layout: Callable[[DataFrame], dict[str, Column]], table: str,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw rows onto the declared columns of ``table``, typed, without the id."""
    columns = layout(df)
    types = {f.name: f.dataType for f in taxi_schema(table).fields}
    return df.select(*keep, *[expr.cast(types[n]).alias(n) for n, expr in columns.items()])


def window_filter(df: DataFrame, lo: Month, hi: Month) -> DataFrame:
    """Drop stray rows outside the era's whole window; a NULL time drops the row.

    A row filed under the wrong month inside the window stays. A trip may end in the month after
    the window, not later.
    """
    return df.filter(
        (F.col("pickup_at") >= zoneless(lo.start))
        & (F.col("pickup_at") < zoneless(hi.plus(1).start))
        & (F.col("dropoff_at") < zoneless(hi.plus(2).start))
    )


def text_window(text: Column, lo: Month, hi: Month) -> Column:
    """What the text of a time in a window of months must look like; weaker than the window itself, but a
    plain comparison of the raw column, which lets the Parquet reader skip row groups.

    A time begins with its year. Texts that begin otherwise (spaces, signs, zeros, no time at all) pass, so
    that the exact filter sees them, with what it does about texts that are no times.
    """
    years = (text >= F.lit(str(lo.start.year))) & (text < F.lit(str(hi.start.year + 1)))
    return years | (text < F.lit("1")) | (text >= F.lit("3"))


def era_rows(raw: DataFrame, era: Era, table: str, lo: Month, hi: Month) -> DataFrame:
    """One era, numbered, projected and filtered. ``raw`` carries file_ordinal and row_index."""
    if era.pickup_text and dict(raw.dtypes)[_match(raw, era.pickup_text)] == "string":
        raw = raw.filter(text_window(F.col(era.pickup_text), lo, hi))
    numbered = raw.withColumn("id", stable_id())
    return window_filter(project(numbered, era.layout, table, keep=("id",)), lo, hi)


def union_eras(parts: list[DataFrame], table: str) -> DataFrame:
    """All eras under the declared layout, duplicates kept."""
    if not parts:
        raise ValueError(f"{table}: the window holds no month")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return conform(out, taxi_schema(table))


def harmonise(spark: SparkSession, table: str, template: str, months: int,
              eras: list[Era] | None = None, last: Month = LAST_MONTH) -> DataFrame:
    """One taxi table for the last ``months`` months: scan, number, project, filter, union.

    A single map-only plan. Nothing is shuffled and nothing is written in between.
    """
    begin = window_start(months, last)
    parts, ordinal = [], 0
    for era in TAXI_ERAS[table] if eras is None else eras:
        window = era.clipped(begin)
        if window is None:
            continue
        scans = [(scan, listed_files(scan)) for scan in
                 month_scans(spark, template, era.prefix, *window)]
        ordinals = numbered([f for _, files in scans for f in files], ordinal)
        ordinal += len(ordinals)
        for scan, files in scans:
            raw = with_file_ordinal(spark, scan, {f: ordinals[f] for f in files})
            parts.append(era_rows(raw, era, table, *window))
    return union_eras(parts, table)
