"""Lenient and exact casts, all JVM-side expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"

# What counts as a decimal number in text. Spark's own cast would also take '1.0d' or '0x1p2'.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def lenient_int(col: Column, from_text: bool) -> Column:
    """Round to the nearest INT; NULL when the value is no number or out of range.

    Text rounds halves away from zero, doubles round halves to even, as the SQL dialect the
    declared projections were written for does. Spark's own cast would truncate.
    """
    if from_text:
        number = F.round(F.when(col.rlike(_NUMBER), col.try_cast("double")))
    else:
        number = F.rint(col.cast("double"))
    return number.try_cast("int")


def money(col: Column) -> Column:
    """Two-decimal money; the cast goes through the shortest decimal text, so 1.005 gives 1.01."""
    return col.cast(MONEY)


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def coded(col: Column, codes: dict[str, int], prefix: bool = False) -> Column:
    """Map upper-cased text to a code, by equality or by prefix; anything else, NULL too, is 0."""
    text = F.upper(col.cast("string"))
    out = F
    for key, code in codes.items():
        out = out.when(text.startswith(key) if prefix else text == key, F.lit(code))
    return out.otherwise(F.lit(0))


def parse_number(col: Column) -> Column:
    """Text to double, NULL where it is no finite decimal number (no padding allowed)."""
    plain = col.rlike(_NUMBER) & (F.trim(col) == col)
    value = F.when(plain, col.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def zoneless(moment: dt.datetime) -> Column:
    """A zoneless timestamp literal, the same in every session and driver time zone."""
    return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")


def minute_of(ts: Column) -> Column:
    """Start of the minute of a zoneless timestamp, without a detour over the session zone."""
    return ts - F.make_dt_interval(secs=F.date_part(F.lit("SECOND"), ts))
