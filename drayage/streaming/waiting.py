"""Tables that keep arriving, until each of them is complete.

The streams never end by themselves: they look for new files for as long as they run. Their progress
says when it is worth looking at a sink; the sink, whose count reads row-group sizes only, decides.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from drayage.operators.verify import convergence, require_convergence, sink_counts
from drayage.streaming.snapshot import POLL_SECONDS, failure


class StillArriving(TimeoutError):
    """Tables were not complete when the time was over."""


def endless_to_files(rows: DataFrame, sink: str, checkpoint: str, every: str = "0 seconds") -> StreamingQuery:
    """Append what arrives, batch after batch, until somebody stops it."""
    return (
        rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(processingTime=every).start(sink))


def _batches(query: StreamingQuery) -> int:
    return query.lastProgress["batchId"] if query.lastProgress else -1


def stream_until_converged(spark: SparkSession, tables: dict[str, DataFrame], expected: DataFrame, sink: str,
                           checkpoints: str, parallel: int = 8, poll_seconds: float = POLL_SECONDS,
                           timeout_seconds: float | None = None,
                           looked: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Streams tables in seed order, at most ``parallel`` at a time, until the counts of all sinks are those
    of ``expected`` (table, rows, seed_pos); returns their states.

    A table that has converged gives its place to the next one, and all sinks are counted once more at
    the end. A table with more rows than expected, seen once the ones before it are complete, stops all
    streams and is an error, and so is a stream that fails, and time running out. ``looked`` is told the
    states after every look. Every stream goes on from its checkpoint if it is started again.
    """
    until = None if timeout_seconds is None else time.monotonic() + timeout_seconds
    order = [r["table"] for r in expected.orderBy("seed_pos", "table").collect()]  # table names
    waiting, running, seen, counts = list(order), {}, {}, {}

    def look(names: list[str]) -> DataFrame:
        found = sink_counts(spark, names, lambda n: spark.read.schema(tables[n].schema).parquet(f"{sink}/{n}"))
        counts.update({r["table"]: r["rows"] for r in found.collect()})
        return convergence(expected, spark.createDataFrame(list(counts.items()), "table STRING, rows BIGINT"))

    try:
        while True:
            while waiting and len(running) < parallel:
                name = waiting.pop(0)
                running[name] = endless_to_files(tables[name], f"{sink}/{name}", f"{checkpoints}/{name}")
            failure(running)
            news = [n for n, q in running.items() if _batches(q) > seen.get(n, -1)]
            if news:
                seen |= {n: _batches(running[n]) for n in news}
                states = look(news)
                if looked:
                    looked(states)
                lines = states.collect()  # a line for each table
                if any(r["state"] == "overshoot" and r["checked"] for r in lines):
                    require_convergence(states)
                for r in lines:
                    if r["state"] == "converged" and r["table"] in running and waiting:
                        running.pop(r["table"]).stop()
                if not waiting and all(r["state"] == "converged" for r in lines):
                    break
            elif until is not None and time.monotonic() > until:
                raise StillArriving(", ".join(n for n in order if n not in counts or n in running))
            else:
                time.sleep(poll_seconds)
    finally:
        for query in running.values():
            query.stop()
    return require_convergence(look(order))
