"""Loading into a declared layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns, in declared order, with declared types.

    Casts are strict: a value that does not fit fails the load rather than changing silently.
    A declared column the source lacks is an analysis error.
    """
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def null_defaults(df: DataFrame) -> DataFrame:
    """No NULL number (0 instead) and no NULL text ('' instead); other types stay as they are.

    Some sinks turn an empty field into zero and others into NULL, so neither is left to them.
    """
    def default(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.NumericType):
            return F.coalesce(column, F.lit(0).cast(field.dataType)).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(column, F.lit("")).alias(field.name)
        return column

    return df.select(*[default(f) for f in df.schema.fields])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row: Spark declares no primary key, so it is a check."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
