"""Typed message envelopes: one JSON object per line, only records and states go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Message types that are forwarded; all others are dropped.
FORWARDED = ("RECORD", "STATE")


# The text of a message that does not fit its layout.
CORRUPT = "corrupt"


def envelope_schema(record: T.DataType, state: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField(CORRUPT, T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("record", T.StructType([
            T.StructField("stream", T.StringType()), T.StructField("data", record),
        ])),
        T.StructField("state", state),
    ])


def envelope_read(lines: DataFrame, record: T.DataType, state: T.DataType,
                  text: str = "value") -> DataFrame:
    """Parse message lines and keep records and states. Works on a batch or a stream.

    Lines that are no messages have no type and fall out with the other message types. Records and
    states with a field that does not parse are never passed on with a NULL in its place: they are
    what ``envelope_rejects`` gives.
    """
    return _parsed(lines, record, state, text).filter(
        F.col("message.type").isin(*FORWARDED) & F.col(f"message.{CORRUPT}").isNull())


def envelope_rejects(lines: DataFrame, record: T.DataType, state: T.DataType,
                     text: str = "value") -> DataFrame:
    """The records and states that do not fit their layout, and lines cut off inside a message."""
    message = F.col("message")
    return _parsed(lines, record, state, text).filter(
        message[CORRUPT].isNotNull() & (message["type"].isNull() | message["type"].isin(*FORWARDED))
    ).drop("message")


def _parsed(lines: DataFrame, record: T.DataType, state: T.DataType, text: str) -> DataFrame:
    message = F.from_json(
        F.col(text), envelope_schema(record, state), {"columnNameOfCorruptRecord": CORRUPT})
    return lines.withColumn("message", message)


def records(messages: DataFrame, stream: str | None = None) -> DataFrame:
    """Typed rows of the record messages, of one stream or of all."""
    rows = messages.filter(F.col("message.type") == "RECORD")
    if stream is not None:
        rows = rows.filter(F.col("message.record.stream") == stream)
    return rows.select(F.col("message.record.stream").alias("stream"), "message.record.data.*")


def final_rows(rows: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The last row of every key by the columns of ``order``, which no two rows of a key may share.

    Rows are combined before the shuffle, so a key with very many versions sends one row per task. A NULL
    key is a key, a NULL in the order comes first. Where ``deleted`` is true in the last row, the key has
    no row. Works on a batch; a stream of rows needs the output mode ``update`` and keeps the last row of
    every key as its state.
    """
    last = rows.groupBy(*keys).agg(F.max_by(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in keys]), F.struct(*order)).alias("_last"))
    out = last.select(*[F.col(f"_last.`{c}`").alias(c) if c not in keys else F.col(f"`{c}`") for c in rows.columns])
    return out.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def latest_state(messages: DataFrame, order: str) -> DataFrame:
    """The last state message by its position."""
    states = messages.filter(F.col("message.type") == "STATE")
    return states.agg(F.max_by("message.state", order).alias("state")).select("state.*")


# --- catalogs in messages ----------------------------------------------------------------------

# How every selected stream is configured for a full load.
CONFIGURED = {
    "sync_mode": "full_refresh", "destination_sync_mode": "overwrite", "generation_id": 1,
    "minimum_generation_id": 1, "sync_id": 1,
}
_CATALOG = "type STRING, catalog STRUCT<streams: ARRAY<STRUCT<name: STRING, namespace: STRING>>>"


def discovered_streams(lines: DataFrame, order: str, text: str = "value") -> DataFrame:
    """Streams offered by the CATALOG messages; a later message about a stream wins."""
    message = F.from_json(F.col(text), _CATALOG)
    offered = (
        lines.select(F.col(order).alias("at"), message.alias("m")).filter(F.col("m.type") == "CATALOG")
        .select("at", F.explode("m.catalog.streams").alias("s"))
    )
    return offered.groupBy(F.col("s.name").alias("stream_name")).agg(
        F.max_by("s.namespace", "at").alias("namespace"))


def configured(streams: DataFrame) -> DataFrame:
    """Selected streams with the settings of a full load."""
    return streams.select("*", *[F.lit(v).alias(k) for k, v in CONFIGURED.items()])
