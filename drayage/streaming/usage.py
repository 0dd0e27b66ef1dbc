"""Resource usage while samples arrive.

The state of a container is kept for a stretch of time each, so it leaves the state store once the
watermark has passed its stretch, and only the states that a batch has changed are written. States
of one container merge without loss, whatever stretches or batches they come from, so the usage read
from the sink is that of all samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drayage.operators.telemetry import container_states, usage_from_states
from drayage.streaming.snapshot import BATCH_COLUMN, batch_writer

STRETCH, LATEST = "1 hour", "1 hour"
LABELS = ["container_id", "role", "image", "image_id"]


class LateSamples(RuntimeError):
    """Samples came so late that their state had gone: they are not in the usage."""


def stream_usage(samples: DataFrame, sink: str, checkpoint: str, at: str = "sampled_at", stretch: str = STRETCH,
                 latest: str = LATEST, once: bool = True) -> StreamingQuery:
    """Usage states as a stream. A sample may be ``latest`` behind the newest one. Each batch owns a folder
    of the sink, with the states that it has changed, and replaces it when it is run again."""
    stretches: Column = F.window(at, stretch)
    # Watermarks need a point in time; a zoneless one is read in the session's zone.
    timed = samples.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, latest)
    states = container_states(timed, [stretches.alias("stretch")])
    flat = states.withColumn("stretch", F.col("stretch.start"))
    writer = flat.writeStream.outputMode("update").foreachBatch(batch_writer(sink)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="0 seconds")).start()


def late_samples(query: StreamingQuery) -> int:
    """Rows that came after their state had gone, over the progress that the query still remembers."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def require_no_late(query: StreamingQuery) -> None:
    late = late_samples(query)
    if late:
        raise LateSamples(f"{late} samples came later than the watermark allows")


def usage_now(spark: SparkSession, sink: str) -> DataFrame:
    """Usage per container from the latest state of every container and stretch."""
    states = spark.read.option("basePath", sink).parquet(f"{sink}/{BATCH_COLUMN}=*")
    keys = [*LABELS, "stretch"]
    fields = [c for c in states.columns if c not in (*keys, BATCH_COLUMN)]
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*fields), BATCH_COLUMN).alias("last"))
    return usage_from_states(last.select(*keys, "last.*"))
