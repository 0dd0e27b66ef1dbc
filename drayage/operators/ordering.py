"""Exact per-group ranks and medians, the same way for a group of any size.

Both need to know how many rows of a group hold a smaller value. Values are cut into buckets at
quantiles of all groups together, so that no group can have more than one bucket's share in one
place, and a value that is itself a cut has a bucket of its own: its rows tie, and nothing has to
be sorted there. Bucket totals are small, their running sums are cheap, and a running sum inside a
bucket does the rest. The quantiles are approximate and decide how even the buckets are, nothing
else: the counts are exact for any cuts. They are a scalar subquery of the same plan, so nothing
runs before the result is asked for, and what they are taken from is shuffled once for both. The
number of buckets is a parameter, as many as there are shuffle partitions unless given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_cuts(df: DataFrame, value: str, buckets: int) -> Column:
    """At most ``buckets - 1`` cut points with about the same number of rows between them, in order.

    A struct of all cuts and of the first one of every block of them, evaluated once a query.
    """
    points = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.array_sort(F.array_distinct(F.percentile_approx(value, points, 10 * buckets))).alias("cuts"))
    starts = F.filter("cuts", lambda _, i: i % _block_width(buckets) == 0)
    return cuts.select(F.struct("cuts", starts.alias("starts"))).scalar()


def _block_width(buckets: int) -> int:
    return math.isqrt(buckets) + 1


def _with_bucket(rows: DataFrame, value: str, of: DataFrame, buckets: int | None) -> DataFrame:
    """Number of the bucket of each value among those of ``of``, rising with the value; odd ones hold a
    single value, a cut. A row without a value has none.

    Looked up in two steps, first the block of cuts and then the place in it.
    """
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(value)
    if buckets < 2:
        return rows.withColumn("_bucket", F.when(x.isNotNull(), F.lit(0)))
    width = _block_width(buckets)

    def number(cuts: Column) -> Column:
        block = F.greatest(F.lit(1), F.size(F.filter(cuts["starts"], lambda c: c <= x)))
        inside = F.slice(cuts["cuts"], (block - 1) * F.lit(width) + 1, F.lit(width))
        reached = (block - 1) * F.lit(width) + F.size(F.filter(inside, lambda c: c <= x))
        return reached * 2 - F.array_contains(inside, x).cast("int")

    # Named once only, the cuts stay a constant of the expression and are not written into every row.
    found = F.transform(F.array("_cuts"), number)[0]
    return rows.withColumn("_cuts", value_cuts(of, value, buckets)).withColumn(
        "_bucket", F.when(x.isNotNull(), found)).drop("_cuts")


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe key equality: a NULL group is a group."""
    out = F.lit(True)
    for key in keys:
        out = out & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return out


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same names in which NULL equals NULL; the keys come once."""
    joined = left.alias("l").join(right.alias("r"), _same("l", "r", keys), how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def _before(counted: DataFrame, keys: list[str], rows: Column) -> DataFrame:
    """Per group and bucket: its rows, the rows of the buckets before it and all rows."""
    whole = Window.partitionBy(*keys)
    earlier = F.sum("_in").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    return counted.groupBy(*keys, "_bucket").agg(rows.alias("_in")).select(
        *keys, "_bucket", "_in", F.sum("_in").over(whole).alias("_total"),
        F.coalesce(earlier, F.lit(0)).alias("_before"))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str,
                 buckets: int | None = None) -> DataFrame:
    """Median per group: the middle value, or the mean of the two middle values.

    Rows collapse to distinct values, combined map-side; the totals read the same shuffled values.
    Only the one or two buckets of a group that hold its middle rows are looked into.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    # The condition holds for all; reading the counts here too leaves both with the same shuffle.
    values = _with_bucket(values, "_v", values.filter("_n > 0"), buckets)
    # Positions of the two middle rows, the same one twice for an odd number of rows.
    first, second = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    totals = _before(values, keys, F.sum("_n")).filter(
        (F.col("_before") < second) & (F.col("_before") + F.col("_in") >= first))
    placed = null_safe_join(values, totals, [*keys, "_bucket"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    upto = placed.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    lower = F.min(F.when(F.col("_upto") >= first, F.col("_v")))
    upper = F.min(F.when(F.col("_upto") >= second, F.col("_v")))
    return upto.groupBy(*keys).agg(((lower + upper) / 2).alias(name))


def rank_within(df: DataFrame, keys: list[str], value: str, name: str,
                buckets: int | None = None) -> DataFrame:
    """Competition rank (ties share a rank) of ``value`` inside each group, smallest first.

    A row without a value has no rank. Rows are ranked where they are, inside their bucket; those of
    a bucket with a single value all rank first there, so they are dealt out anyhow.
    """
    rows = _with_bucket(df, value, df, buckets)
    totals = _before(rows.filter(F.col("_bucket").isNotNull()), keys, F.count(F.lit(1)))
    placed = null_safe_join(rows, totals.select(*keys, "_bucket", "_before"), [*keys, "_bucket"], "left")
    tied = F.col("_bucket").isNull() | (F.col("_bucket") % 2 == 1)
    dealt = F.when(tied, F.monotonically_increasing_id()).otherwise(F.lit(0))
    inside = Window.partitionBy(*keys, "_bucket", "_deal").orderBy(F.col(value))
    rank = F.when(F.col("_bucket").isNotNull(), F.col("_before") + F.rank().over(inside))
    return placed.withColumn("_deal", dealt).withColumn(name, rank.cast("bigint")).select(
        *[F.col(f"`{c}`") for c in df.columns], name)
