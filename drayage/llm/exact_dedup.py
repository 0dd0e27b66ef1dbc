"""Exact duplicates: a tree merge of sorted digest runs.

Every partition of the documents becomes one run of digests. Runs meet in rounds, as in a
binomial tree: in each round the runs of ``fan_in`` neighbouring slots are merged into one, sorted
by digest, and of each text the smallest identifier survives. After ``log(partitions)`` rounds one
slot is left. A run is dealt out by its digests, so the last slot is not one task, and a text with
a third of all copies is one row per run from the first round on. The outcome then goes back the
same way: to the first runs by digest, and from a run to its documents by (run, digest), so copies
of one text never meet in one task.

Two texts count as equal when SHA-256, length and a second 64-bit hash agree. All three are keys
at every level, so a digest clash stays two groups.

Defined cases: a null text counts as empty. Null ids come after all others. Rows that repeat an id
and its text are ordinary copies of it; exactly one row of each group is kept. Other columns are
carried by ``drop_copies`` as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.llm.common import keep_listed, normalised, stage, text_or_empty

FAN_IN = 16
_TEXT = ["digest", "n_bytes", "second"]


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digest_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document, sorted by digest within the run of its partition."""
    text = normalised(text_or_empty(text_col))
    rows = docs.select(
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"), text.alias("text"))
    return rows.select(
        "run", "row", "id", digest(F.col("text")).alias("digest"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("second"),
    ).sortWithinPartitions("digest", "id")


def merge_runs(runs: DataFrame, last_run: int, fan_in: int = FAN_IN) -> DataFrame:
    """Rounds of multiway merges until one slot is left: a row per text with its best row."""
    width = 1
    while width <= last_run:
        width *= fan_in
        runs = (
            runs.groupBy((F.col("run") / F.lit(fan_in)).cast("long").alias("run"), *_TEXT)
            .agg(F.min("best").alias("best"), F.sum("copies").alias("copies")))
    return runs.drop("run")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     fan_in: int = FAN_IN) -> DataFrame:
    """For every row: ``id``, ``keep_id``, ``group_size``, ``kept`` and ``digest``."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    rows = stage(digest_runs(docs, id_col, text_col), "digest-runs")
    last_run = rows.agg(F.max("run")).first()[0] or 0
    best = F.struct(F.col("id").isNull().alias("late"), "id", "row")
    first = rows.groupBy(F.col("run").cast("long").alias("run"), *_TEXT).agg(
        F.min(best).alias("best"), F.count(F.lit(1)).alias("copies"))
    merged = merge_runs(first, last_run, fan_in)
    by_run = first.select("run", *_TEXT).join(merged, _TEXT)
    return (
        rows.withColumn("run", F.col("run").cast("long")).join(by_run, ["run", *_TEXT])
        .select("id", F.col("best.id").alias("keep_id"), F.col("copies").alias("group_size"),
                (F.col("row") == F.col("best.row")).alias("kept"), "digest"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fan_in: int = FAN_IN) -> DataFrame:
    """The documents without copies, with all their columns."""
    found = stage(exact_duplicates(docs, id_col, text_col, fan_in), "exact-duplicates")
    listed = (
        found.filter(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("id", F.col("digest").alias("fingerprint"))
        .agg(F.count(F.lit(1)).alias("rows")))
    return keep_listed(docs, listed, digest(normalised(text_or_empty(text_col))), id_col)
