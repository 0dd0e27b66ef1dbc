"""How many splits a table gets, and where they are cut.

Files need none of this: Spark cuts them by byte range. A database table has to be cut by its
leading key, which is what these functions plan.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Workers shared by all tables of a load, rows per split, workers per table.
WORKER_BUDGET = 32
ROWS_PER_SPLIT = 750_000
MAX_WORKERS_PER_TABLE = 32


def partition_plan(manifest: DataFrame, n_tables: int, budget: int = WORKER_BUDGET,
                   rows_per_split: int = ROWS_PER_SPLIT,
                   max_workers: int = MAX_WORKERS_PER_TABLE) -> DataFrame:
    """Manifest plus the splits of each table under the two sizing rules.

    ``by_budget`` shares a worker budget over the tables; ``splits`` cuts a table every
    ``rows_per_split`` rows and ``by_rows`` is how many of those run at the same time.
    """
    splits = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(rows_per_split))).cast("bigint")
    return manifest.select(
        "table", "rows",
        F.lit(max(1, budget // n_tables)).alias("by_budget"),
        splits.alias("splits"),
        F.least(splits, F.lit(max_workers)).cast("int").alias("by_rows"),
    )


def key_bounds(df: DataFrame, key: str) -> tuple[int, int] | None:
    """Smallest and largest key in one pass; None when there is no key at all."""
    row = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    return None if row["lo"] is None else (row["lo"], row["hi"])


def equal_width_split(key: Column, lo: int, hi: int, n: int) -> Column:
    """Number of the equal-width range a key falls in; NULL keys and keys below go to split 0."""
    width = -(-(hi - lo + 1) // n)
    position = F.floor((key - F.lit(lo)) / F.lit(width)).cast("int")
    inside = F.greatest(F.lit(0), F.least(F.lit(n - 1), position))
    return F.when(key.isNotNull(), inside).otherwise(F.lit(0))


def quantile_cuts(df: DataFrame, key: str, n: int) -> list:
    """``n - 1`` cut points with about the same number of rows between them."""
    if n < 2:
        return []
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted(cuts or [])


def sql_literal(value: object) -> str:
    """A cut as SQL text: numbers as they are, everything else typed and quoted."""
    if isinstance(value, bool) or not isinstance(value, int | float | Decimal):
        text = str(value).replace("'", "''")
        kind = "TIMESTAMP " if isinstance(value, dt.datetime) else "DATE " if isinstance(value, dt.date) else ""
        return f"{kind}'{text}'"
    return repr(value) if isinstance(value, float) else str(value)


def split_predicates(cuts: list, key: str, second: str | None = None,
                     second_cuts: dict | None = None) -> list[str]:
    """SQL predicates that cover every row exactly once, NULL keys included.

    A cut that repeats is a hot key: that key alone fills several splits. With the second key
    column and its cut points for that key, the key gets splits of its own.
    """
    points = sorted(set(cuts))
    if not points:
        return ["1 = 1"]
    out = [f"{key} < {sql_literal(points[0])} OR {key} IS NULL"]
    for point, following in pairwise([*points, None]):
        at = sql_literal(point)
        above = f" AND {key} < {sql_literal(following)}" if following is not None else ""
        inner = sorted(set((second_cuts or {}).get(point, [])))
        if not inner or not second:
            out.append(f"{key} >= {at}{above}")
            continue
        out += [f"{key} = {at} AND ({p})" for p in split_predicates(inner, second)]
        out.append(f"{key} > {at}{above}")
    return out


def balanced_predicates(df: DataFrame, key: str, n: int, second: str | None = None) -> list[str]:
    """Predicates with balanced row counts, hot keys cut again by the second key column.

    For data that Spark can scan: one pass finds the cuts of the key, a second those of all its hot
    values. A database is asked for its bounds instead (``jdbc_bounds``) and cut by ``range_cuts``.
    """
    cuts = quantile_cuts(df, key, n)
    repeats = {c: m for c, m in Counter(cuts).items() if m > 1}
    inner = {}
    if second and repeats:
        most = max(repeats.values()) + 1
        hot = df.filter(F.col(key).isin(*repeats)).groupBy(F.col(key).alias("hot")).agg(
            F.percentile_approx(second, [i / most for i in range(1, most)], 10 * most).alias("cuts"))
        for row in hot.collect():  # as many rows as a plan has splits, at most
            step = most / (repeats[row["hot"]] + 1)
            inner[row["hot"]] = [
                row["cuts"][min(most - 2, round(i * step) - 1)] for i in range(1, repeats[row["hot"]] + 1)]
    return split_predicates(cuts, key, second, inner)


def range_cuts(lo: int, hi: int, n: int) -> list[int]:
    """Cut points of ``n`` key ranges of equal width, from the bounds alone."""
    width = -(-(hi - lo + 1) // n)
    return list(range(lo + width, hi + 1, width))


def split_read(pieces: Callable[[str], DataFrame], predicates: list[str]) -> DataFrame:
    """A whole table as the union of its pieces, each read by its own predicate."""
    return reduce(DataFrame.unionAll, [pieces(p) for p in predicates])


def split_sizes(df: DataFrame, key: str, lo: int, hi: int, n: int) -> DataFrame:
    """Rows and key range of each split that holds any row."""
    split = equal_width_split(F.col(key), lo, hi, n)
    return df.groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key"),
    )
