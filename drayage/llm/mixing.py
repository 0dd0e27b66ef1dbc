"""Mixing sources to target weights.

Words are counted per source; the weights then share out the total, no source above ``most`` times
its own size; target over size is the source's repetition rate. Each document comes
``floor(rate)`` times, and once more when a number between 0 and 1 drawn from a hash of its id and
a seed falls below the fraction. Draws of single documents are independent of the run and of how
rows are dealt out, so reruns agree.

A source of few or very uneven documents would stray from its target under an arbitrary seed. The
draws of ``seeds`` candidate seeds are therefore summed per source, in the same pass, and each
source uses the seed that brings it nearest to its target (the smallest such seed on ties).

Defined cases: null and empty texts have size 0; a null source is a source of its own, after all
others; rows repeating an id share its draw; a source of size 0 has rate 0 and gives no document;
an empty table gives an empty mix. Columns of any name are carried by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drayage.llm.common import WORD, private, stage, text_or_empty

WEIGHTS = (5, 2, 1)
MOST = 3
SEEDS = 32


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(id_col: Column, seed: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of id and seed."""
    text = F.concat_ws("#", F.coalesce(id_col.cast("string"), F.lit("")), seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def with_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Numbers the sources by code point, null last, and deals the weights out in turn.

    The numbering is by range: each range counts its sources, and a source's number is its place
    in its range after the sources of the ranges before.
    """
    ranged = stage(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id()), "source-ranges")
    before = (
        ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(
            W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = (F.col("place") + F.col("before")) % len(weights)
    dealt = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int"))
    return (
        ranged.withColumn("place", place).join(before, "part")
        .select("source", "source_size", dealt.alias("weight")))


def with_targets(sources: DataFrame, most: int) -> DataFrame:
    """Shares the total by weight; a source at ``most`` times its size stops, the rest is reshared.

    Every round is one sum over the sources; two numbers reach the driver.
    """
    cap = F.col("source_size") * most
    sums = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, left, weight = sums[0] or 0, sums[0] or 0, sums[1] or 1
    level = None
    while weight and (level is None or left / weight > level):
        level = left / weight
        full = F.col("weight") * F.lit(level) >= cap
        got = sources.agg(
            F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        left, weight = total - (got[0] or 0), got[1] or 0
    return sources.withColumn(
        "target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level or 0.0))))


def source_rates(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST,
                 seeds: int = SEEDS) -> DataFrame:
    """From rows of (id, source, size): size, target, rate and chosen seed of every source."""
    totals = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    weighted = stage(with_weights(totals, weights), "source-weights")
    rates = stage(
        with_targets(weighted, most).withColumn("rate", F.when(
            F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)),
        "source-rates")
    fraction = F.col("rate") - F.floor("rate")
    drawn = (
        sizes.join(rates.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .groupBy("source").agg(*[
            F.sum(F.when(draw(F.col("id"), F.lit(k)) < fraction, F.col("size")).otherwise(0)).alias(f"s{k}")
            for k in range(seeds)]))
    away = [F.struct(F.abs(F.col(f"s{k}") - (F.col("target") - F.floor("rate") * F.col("source_size"))).alias("d"),
                     F.lit(k).alias("seed")) for k in range(seeds)]
    return stage(
        rates.join(drawn.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select("source", "source_size", "weight", "target", "rate", F.array_min(F.array(*away))["seed"].alias("seed")),
        "source-seeds")


def copies(rate: Column, id_col: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(id_col, seed) < rate - whole, 1).otherwise(0)).cast("int")


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[int] = WEIGHTS, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """For every document: its size, what its source is to give, and what the mix takes of it."""
    sizes = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                              n_words(text_or_empty(text_col)).alias("size")), "mix-sizes")
    rates = source_rates(sizes, weights, most, seeds).withColumnRenamed("source", "of")
    return sizes.join(rates, F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "source", "size", "source_size", "target",
        (F.col("size") * copies(F.col("rate"), F.col("id"), F.col("seed"))).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """The documents of the mix, repeated ones as often as they are taken, columns unchanged."""
    sizes = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                              n_words(text_or_empty(text_col)).alias("size")), "mix-sizes")
    of, rate, seed, time = (private(docs, n) for n in ("of_", "rate_", "seed_", "time_"))
    rates = source_rates(sizes, weights, most, seeds).select(
        F.col("source").alias(of), F.col("rate").alias(rate), F.col("seed").alias(seed))
    times = copies(F.col(rate), F.col(f"`{id_col}`"), F.col(seed))
    return (
        docs.join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col(of)))
        .withColumn(time, F.explode(F.array_repeat(F.lit(True), times)))
        .select(*[F.col(f"`{c}`") for c in docs.columns]))
