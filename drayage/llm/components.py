"""Connected components of a table of links, by alternating star steps.

Links are rewritten until every vertex points at the smallest of its component: a large-star step
points the larger neighbours of a vertex at its smallest neighbour, a small-star step the smaller
ones. Each step is a grouped minimum and a join; the table is staged after every round. Rounds grow
with the logarithm of the longest path, and rows stay as many as the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm.common import stage


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """From links whose ``v`` is the smaller end."""
    small = _smallest(links)
    moved = links.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (u, v): a row (u, root) for every vertex that is not its component's smallest."""
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .filter("u <> v").distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return links.select("u", F.col("v").alias("root"))
        before = now
        links = stage(_small_star(_large_star(links).distinct()), "links")
