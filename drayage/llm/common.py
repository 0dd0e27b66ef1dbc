"""What several operators share: staged tables, words and row identity."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayage.session import scratch_dir

# A word is a run of bytes that are not ASCII white space; bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
# Matches only what changes when every run of white space becomes one space.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

# Shuffle files go as soon as the table that they were made for is written, not when the driver happens
# to collect its garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Rows of whole texts or sets that go to a Python worker together: 10,000 would be several times 30 MB outside
# of the heap, for every task.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the running stage, not the steps before it, and
    values that depend on how the rows were dealt out (partition numbers, generated row numbers)
    are the same for every later reader.
    """
    path = scratch_dir(df.sparkSession, purpose)
    with settings(df.sparkSession, SHUFFLES_GO):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what was made from them is staged itself."""
    for df in staged:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for as long as a block runs."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, UNEVEN_SPACE, " ")


def private(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_listed(docs: DataFrame, listed: DataFrame, fingerprint: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose (id, fingerprint) is listed, one row for each listed pair.

    ``listed`` has the columns ``id``, ``fingerprint`` and ``rows`` (how many rows of ``docs``
    carry the pair). Where several do, the smallest by its other columns stays.
    """
    mark = private(docs, "fingerprint_")
    marked = docs.withColumn(mark, fingerprint)
    names = {c: f"{c}_{uuid.uuid4().hex[:8]}" for c in ("id", "fingerprint", "rows")}
    right = listed.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = marked.join(
        right, marked[id_col].eqNullSafe(right[names["id"]]) & (marked[mark] == right[names["fingerprint"]]))
    single = joined.filter(F.col(names["rows"]) == 1).select(*[docs[c] for c in docs.columns])
    if listed.filter("rows > 1").isEmpty():
        return single
    several = (
        joined.filter(F.col(names["rows"]) > 1)
        .groupBy(F.col(names["id"]), F.col(names["fingerprint"]))
        .agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
        .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
    return single.unionByName(several)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file, the same on every host."""
    import public_tokenizers

    return public_tokenizers.path(name)
