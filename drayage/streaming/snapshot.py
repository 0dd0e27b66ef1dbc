"""An initial snapshot delivered as a stream of row events.

Progress is kept in the checkpoint, which belongs in a folder every executor can reach: a query
that lost its executors or its driver goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# How much one micro-batch may take in.
MAX_BATCH_BYTES = 1 << 30
BATCH_COLUMN = "batch_id"
# How long to wait for news of any stream before looking at all of them.
POLL_SECONDS = 1


def stream_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Files of a table as a stream, in bounded micro-batches. Streams need a declared schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", MAX_BATCH_BYTES)
    return reader.load(path)


def snapshot_to_files(rows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now and stop. The file sink's log makes a replayed batch harmless."""
    return (
        rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(sink)
    )


def batch_writer(sink: str):
    """Micro-batch writer that may run twice for the same batch without duplicating a row.

    Each batch owns one folder, named after its id, and replaces it as a whole. Sinks without such
    a unit (a plain database insert) cannot be replayed safely this way.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/{BATCH_COLUMN}={batch_id}")

    return write


def snapshot_to_batches(rows: DataFrame, sink: str, checkpoint: str,
                        write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(write or batch_writer(sink))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_batches(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.option("basePath", sink).parquet(f"{sink}/{BATCH_COLUMN}=*").drop(BATCH_COLUMN)


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for the end of an available-now run; its failure is raised here."""
    query.awaitTermination()
    return query


def failure(running: dict[str, StreamingQuery]) -> None:
    """Raises the error of a stream that has failed."""
    for query in running.values():
        if not query.isActive and query.exception() is not None:
            raise query.exception()


def snapshot_tables(spark: SparkSession, tables: dict[str, DataFrame], sink: str,
                    checkpoints: str, parallel: int = 8) -> dict[str, DataFrame]:
    """Stream several tables, at most ``parallel`` at the same time, and return the sink tables.

    The first failure, of whichever stream, stops those that run, and no further one is started.
    """
    waiting, running = list(tables), {}
    try:
        while waiting or running:
            while waiting and len(running) < parallel:
                name = waiting.pop(0)
                running[name] = snapshot_to_files(tables[name], f"{sink}/{name}", f"{checkpoints}/{name}")
            if all(query.isActive for query in running.values()):
                spark.streams.awaitAnyTermination(POLL_SECONDS)
                spark.streams.resetTerminated()
            failure(running)
            running = {name: query for name, query in running.items() if query.isActive}
    except BaseException:
        for query in running.values():
            query.stop()
        raise
    return {name: spark.read.parquet(f"{sink}/{name}") for name in tables}
