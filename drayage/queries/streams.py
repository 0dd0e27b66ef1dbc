"""Queries run as streams; each must agree with the batch result."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.operators.verify import file_manifest
from drayage.queries import query
from drayage.queries.inputs import SQL_USAGE, samples, table
from drayage.session import scratch_dir
from drayage.sources.messages import envelope_read, final_rows, records
from drayage.streaming.offsets import committed_offsets, source_files
from drayage.streaming.snapshot import (
    batch_writer, finish, read_batches, snapshot_to_batches, snapshot_to_files, stream_table,
)
from drayage.streaming.usage import require_no_late, stream_usage, usage_now
from drayage.streaming.waiting import stream_until_converged


def _given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return stream_table(spark, sf_dir, schema, glob=f"{name}.parquet")


def _pieces(spark: SparkSession, sf_dir: str, name: str, pieces: int) -> DataFrame:
    """A given table as a stream of several files, one micro-batch each."""
    path = scratch_dir(spark, "pieces")
    whole = table(spark, sf_dir, name)
    whole.repartition(pieces).write.parquet(path)
    return stream_table(spark, path, whole.schema, max_files=1)


@query("stream_snapshot", "SELECT * FROM orders")
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink, checkpoint = scratch_dir(spark, "stream"), scratch_dir(spark, "stream-checkpoint")
    finish(snapshot_to_files(_pieces(spark, sf_dir, "orders", 3), sink, checkpoint))
    return spark.read.parquet(sink)


_STREAMED = ["customer", "orders", "part"]


@query("snapshot_stream", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", CAST({i} AS INTEGER) AS seed_pos, count(*) AS expected, count(*) AS delivered, "
    f"'converged' AS state, true AS checked FROM {t}" for i, t in enumerate(_STREAMED)))
def streamed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables that go on arriving while they are streamed: half of the orders come only after the first
    look at the sinks. The streams never end; they are stopped once every table has converged."""
    source = scratch_dir(spark, "arriving")
    orders = table(spark, sf_dir, "orders")
    orders.filter("o_orderkey % 2 = 0").write.parquet(f"{source}/orders")
    late = [orders.filter("o_orderkey % 2 <> 0")]
    streams = {name: _given(spark, sf_dir, name) for name in _STREAMED}
    streams["orders"] = stream_table(spark, f"{source}/orders", orders.schema)
    position = F.expr(" ".join(
        ["case `table`", *[f"when '{t}' then {i}" for i, t in enumerate(_STREAMED)], "end"]))
    expected = file_manifest(spark, {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in _STREAMED}).withColumn(
        "seed_pos", position)

    def arrive(states: DataFrame) -> None:
        if late:
            late.pop().write.mode("append").parquet(f"{source}/orders")

    return stream_until_converged(
        spark, streams, expected, scratch_dir(spark, "tables"), scratch_dir(spark, "tables-checkpoint"),
        poll_seconds=0.1, timeout_seconds=600, looked=arrive)


@query("stream_usage", SQL_USAGE)
def streamed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in four parts, in the order of their times; after each the stream goes on from its
    checkpoint. The states of hours gone by have left the state store by then."""
    source, sink = scratch_dir(spark, "events"), scratch_dir(spark, "usage")
    checkpoint, events = scratch_dir(spark, "usage-checkpoint"), table(spark, sf_dir, "events")
    cuts = [None, *events.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75])).first()[0], None]
    for low, high in pairwise(cuts):
        part = events if low is None else events.filter(F.col("ts") >= F.lit(low))
        (part if high is None else part.filter(F.col("ts") < F.lit(high))).write.mode("append").parquet(source)
        require_no_late(finish(stream_usage(samples(stream_table(spark, source, events.schema)), sink, checkpoint)))
    return usage_now(spark, sink)


_POSITIONS = {"customer": 2, "orders": 3, "part": 1}


@query("stream_positions", " UNION ALL ".join(
    f"SELECT '{t}' AS stream, CAST({n - 1} AS BIGINT) AS batch_id, CAST({n - 1} AS BIGINT) AS log_offset, "
    f"CAST({n} AS BIGINT) AS files, count(*) AS rows FROM {t}" for t, n in _POSITIONS.items()))
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three streams stand, by their checkpoints: last committed batch, its offset, and the files and
    rows taken in up to there."""
    sink, checkpoints = scratch_dir(spark, "positions"), scratch_dir(spark, "positions-checkpoint")
    for name, pieces in _POSITIONS.items():
        finish(snapshot_to_files(_pieces(spark, sf_dir, name, pieces), f"{sink}/{name}", f"{checkpoints}/{name}"))
    files = source_files(spark, checkpoints).groupBy("stream").agg(F.count(F.lit(1)).alias("files"))
    rows = file_manifest(spark, {name: f"{sink}/{name}" for name in _POSITIONS}).withColumnRenamed("table", "stream")
    return committed_offsets(spark, checkpoints).join(files, "stream").join(rows, "stream")


_VERSIONS = """
  SELECT o_orderkey % 1000 AS id, o_orderkey AS seq, o_totalprice AS price, o_orderstatus AS status,
    o_orderkey % 7 = 0 AS gone FROM orders
  UNION ALL SELECT o_orderkey % 1000, o_orderkey - 1000000, -1.0, 'late', false FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 42, o_orderkey - 5000000, 0.0, 'hot', false FROM orders"""
_FINAL_SQL = f"""
SELECT id, seq, price, status, gone FROM ({_VERSIONS})
QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a thousand records: repeated, late and deleted ones, and a record with a third of all."""
    orders = table(spark, sf_dir, "orders")
    return (
        orders.selectExpr("o_orderkey % 1000 AS id", "o_orderkey AS seq", "o_totalprice AS price", "o_orderstatus AS status",
                          "o_orderkey % 7 = 0 AS gone")
        .unionByName(orders.filter("o_orderkey % 3 = 0").selectExpr(
            "o_orderkey % 1000 AS id", "o_orderkey - 1000000 AS seq", "-1.0D AS price", "'late' AS status", "false AS gone"))
        .unionByName(orders.selectExpr(
            "42L AS id", "o_orderkey - 5000000 AS seq", "0.0D AS price", "'hot' AS status", "false AS gone")))


@query("final_records", f"SELECT id, seq, price, status FROM ({_FINAL_SQL}) WHERE NOT gone")
def final_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_rows(_versions(spark, sf_dir), ["id"], ["seq"], deleted="gone").drop("gone")


@query("stream_final", f"SELECT id, seq, price, status FROM ({_FINAL_SQL}) WHERE NOT gone")
def streamed_final_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from message lines as a stream of several batches, each written with what it has changed."""
    path, sink = scratch_dir(spark, "versions"), scratch_dir(spark, "final")
    versions = _versions(spark, sf_dir)
    message = F.struct(F.lit("RECORD").alias("type"), F.struct(
        F.lit("versions").alias("stream"), F.struct("*").alias("data")).alias("record"))
    versions.repartition(3).select(F.to_json(message).alias("value")).write.text(path)
    lines = stream_table(spark, path, T.StructType([T.StructField("value", T.StringType())]), fmt="text", max_files=1)
    rows = records(envelope_read(lines, versions.schema, T.StringType()), "versions").drop("stream")
    stream = final_rows(rows, ["id"], ["seq"]).writeStream.outputMode("update").foreachBatch(batch_writer(sink))
    finish(stream.option("checkpointLocation", scratch_dir(spark, "final-checkpoint")).trigger(availableNow=True).start())
    # What several batches have written of a record is combined the same way.
    return final_rows(read_batches(spark, sink), ["id"], ["seq"], deleted="gone").drop("gone")


@query("stream_replay", "SELECT * FROM customer")
def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch is written a second time, as after a lost commit: each row is there once."""
    sink, checkpoint = scratch_dir(spark, "replay"), scratch_dir(spark, "replay-checkpoint")
    write = batch_writer(sink)

    def twice(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        write(batch, batch_id)

    finish(snapshot_to_batches(_pieces(spark, sf_dir, "customer", 4), sink, checkpoint, twice))
    return read_batches(spark, sink)


@query("stream_offsets", "SELECT * FROM orders")
def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped and started again on the same checkpoint: new files are read, old ones are not."""
    source, sink = scratch_dir(spark, "source"), scratch_dir(spark, "resumed")
    checkpoint = scratch_dir(spark, "resumed-checkpoint")
    orders = table(spark, sf_dir, "orders")
    for part in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        orders.filter(part).write.mode("append").parquet(source)
        finish(snapshot_to_files(stream_table(spark, source, orders.schema), sink, checkpoint))
    return spark.read.parquet(sink)
