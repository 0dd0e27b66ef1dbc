import pytest
from pyspark.sql import functions as F

from drayage.operators.telemetry import usage_rollup
from drayage.operators.verify import Overshoot
from drayage.session import scratch_dir
from drayage.sinks.claims import SharedFolder
from drayage.sources import messages as m
from drayage.streaming import offsets, usage
from drayage.streaming import snapshot as s
from drayage.streaming.waiting import StillArriving, stream_until_converged

from .conftest import rows
from .test_sources import LINES, RECORD, STATE


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_snapshot_in_batches_equals_the_table(spark, sf, folder):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.repartition(4).write.parquet(folder + "/in")
    stream = s.stream_table(spark, folder + "/in", orders.schema, max_files=1)
    query = s.finish(s.snapshot_to_batches(stream, folder + "/out", folder + "/cp"))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    assert same(orders, s.read_batches(spark, folder + "/out"))


def test_a_replayed_batch_replaces_itself(spark, folder):
    write = s.batch_writer(folder)
    write(spark.range(0, 10), 0)
    write(spark.range(10, 20), 1)
    write(spark.range(10, 20), 1)
    assert s.read_batches(spark, folder).count() == 20


def test_a_failing_stream_stops_the_others(spark, folder):
    spark.range(5).write.parquet(folder + "/in")
    good = lambda: s.stream_table(spark, folder + "/in", spark.range(1).schema)
    got = s.snapshot_tables(spark, {n: good() for n in "abc"}, folder + "/out", folder + "/cp", parallel=2)
    assert [df.count() for df in got.values()] == [5, 5, 5]
    bad = good().selectExpr("raise_error('broken') AS id")
    with pytest.raises(Exception, match="broken"):
        s.snapshot_tables(spark, {"x": bad, "y": good(), "z": good()}, folder + "/o2", folder + "/c2", parallel=2)
    assert spark.streams.active == []


def test_restart_reads_only_what_is_new(spark, folder):
    def run():
        stream = s.stream_table(spark, folder + "/in", spark.range(1).schema)
        s.finish(s.snapshot_to_files(stream, folder + "/out", folder + "/cp"))
        return spark.read.parquet(folder + "/out").count()

    spark.range(5).write.mode("append").parquet(folder + "/in")
    assert run() == 5
    assert run() == 5
    spark.range(3).write.mode("append").parquet(folder + "/in")
    assert run() == 8


def in_files(spark, df, folder, column, cuts):
    for low, high in zip(cuts, cuts[1:], strict=False):
        df.filter((F.col(column) >= low) & (F.col(column) < high)).coalesce(1).write.mode("append").parquet(folder)


def timed(spark, n, gap="0"):
    """Samples of three containers a minute, ``n`` minutes long."""
    return spark.range(n * 3).selectExpr(
        "concat('c', id % 3) AS container_id", "'tool' AS role", "'i' AS image", "'s' AS image_id", "id AS seq", "true AS initial_pass",
        "'running' AS state", "id * 7 + 1 AS cpu_ns", "id % 50 AS mem",
        "array(named_struct('rx', id, 'tx', id * 2)) AS networks",
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id / 3)) AS sampled_at", "int(id / 3) AS minute")


def test_usage_stream_equals_batch_and_forgets_what_is_over(spark, folder):
    samples_ = timed(spark, 1200)
    in_files(spark, samples_, folder + "/in", "minute", list(range(0, 1201, 120)))
    stream = s.stream_table(spark, folder + "/in", samples_.schema, max_files=1)
    query = s.finish(usage.stream_usage(stream, folder + "/out", folder + "/cp"))
    usage.require_no_late(query)
    assert same(usage_rollup(samples_), usage.usage_now(spark, folder + "/out"))
    kept = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    written = spark.read.parquet(folder + "/out")
    # Twenty hours of three containers; at any time only those of the last few are in the state.
    assert max(kept) <= 12 and written.select("container_id", "stretch").distinct().count() == 60
    assert written.groupBy("batch_id").count().agg(F.max("count")).first()[0] <= 9


def test_usage_of_a_replayed_batch_and_of_silent_containers(spark, folder):
    samples_ = timed(spark, 300).filter("container_id <> 'c2' OR minute NOT BETWEEN 60 AND 240")
    in_files(spark, samples_, folder + "/in", "minute", [0, 100, 200, 301])
    stream = s.stream_table(spark, folder + "/in", samples_.schema, max_files=1)
    s.finish(usage.stream_usage(stream, folder + "/out", folder + "/cp"))
    out = spark.read.parquet(folder + "/out")
    again = out.filter("batch_id = 1").drop("batch_id")
    s.batch_writer(folder + "/out")(spark.createDataFrame(again.collect(), again.schema), 1)
    assert same(usage_rollup(samples_), usage.usage_now(spark, folder + "/out"))
    assert same(usage_rollup(samples_), usage.usage_now(spark, folder + "/out"))


def test_samples_that_come_too_late_are_an_error(spark, folder):
    samples_ = timed(spark, 600)
    for part in ("minute >= 500", "minute < 100", "minute BETWEEN 100 AND 499"):
        samples_.filter(part).coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = s.stream_table(spark, folder + "/in", samples_.schema, max_files=1)
    query = s.finish(usage.stream_usage(stream, folder + "/out", folder + "/cp"))
    with pytest.raises(usage.LateSamples):
        usage.require_no_late(query)


EXPECTED = "table STRING, rows BIGINT, seed_pos INT"


def endless(spark, folder, names):
    for n in names:
        spark.range(5).write.mode("append").parquet(f"{folder}/in/{n}")
    return {n: s.stream_table(spark, f"{folder}/in/{n}", spark.range(1).schema) for n in names}


def waited(spark, folder, tables, expected, **options):
    return stream_until_converged(
        spark, tables, spark.createDataFrame(expected, EXPECTED), f"{folder}/out", f"{folder}/cp", poll_seconds=0.05, **options)


def test_endless_streams_stop_when_all_tables_have_converged(spark, folder):
    tables, looks = endless(spark, folder, "abc"), []

    def arrive(states):
        looks.append({r["table"]: r["state"] for r in states.collect()})
        if len(looks) == 1:
            spark.range(3).write.mode("append").parquet(f"{folder}/in/a")

    states = waited(spark, folder, tables, [("a", 8, 0), ("b", 5, 1), ("c", 5, 2)], parallel=2, looked=arrive, timeout_seconds=120)
    assert rows(states, "table", "delivered", "state") == [("a", 8, "converged"), ("b", 5, "converged"), ("c", 5, "converged")]
    assert looks[0]["a"] == "pending" and spark.streams.active == []


def test_too_many_rows_and_time_running_out_stop_all_streams(spark, folder):
    tables = endless(spark, folder, "ab")
    with pytest.raises(Overshoot, match="b: 5 of 4"):
        waited(spark, folder, tables, [("a", 5, 0), ("b", 4, 1)], timeout_seconds=120)
    assert spark.streams.active == []
    with pytest.raises(StillArriving, match="a"):
        waited(spark, folder + "/2", endless(spark, folder + "/2", "a"), [("a", 6, 0)], timeout_seconds=3)
    bad = endless(spark, folder + "/3", "ab")
    bad["b"] = bad["b"].selectExpr("raise_error('broken') AS id")
    with pytest.raises(Exception, match="broken"):
        waited(spark, folder + "/3", bad, [("a", 6, 0), ("b", 5, 1)], timeout_seconds=120)
    assert spark.streams.active == []


def test_the_youngest_stream_fails_first(spark, folder):
    spark.range(5).write.parquet(folder + "/in")
    slow = s.stream_table(spark, folder + "/in", spark.range(1).schema).selectExpr("id + int(reflect('java.lang.Thread', 'activeCount')) * 0 AS id")
    bad = s.stream_table(spark, folder + "/in", spark.range(1).schema).selectExpr("raise_error('broken') AS id")
    with pytest.raises(Exception, match="broken"):
        s.snapshot_tables(spark, {"x": slow, "y": bad, "z": slow}, folder + "/o", folder + "/c", parallel=2)
    assert spark.streams.active == []


def test_offsets_of_checkpoints(spark, folder):
    def run(name):
        stream = s.stream_table(spark, f"{folder}/in/{name}", spark.range(1).schema, max_files=1)
        s.finish(s.snapshot_to_files(stream, f"{folder}/out/{name}", f"{folder}/cp/{name}"))

    for name, files_ in (("a", 3), ("b", 1)):
        spark.range(9).repartition(files_).write.parquet(f"{folder}/in/{name}")
        run(name)
    assert rows(offsets.committed_offsets(spark, folder + "/cp")) == [("a", 2, 2), ("b", 0, 0)]
    spark.range(2).coalesce(1).write.mode("append").parquet(f"{folder}/in/b")
    run("b")
    assert rows(offsets.committed_offsets(spark, folder + "/cp")) == [("a", 2, 2), ("b", 1, 1)]
    # A batch that was planned and never committed does not count.
    shared = SharedFolder(spark, folder)
    shared.remove(shared.path("cp/a/commits/2"))
    assert rows(offsets.committed_offsets(spark, folder + "/cp")) == [("a", 1, 1), ("b", 1, 1)]
    assert rows(offsets.source_files(spark, folder + "/cp").groupBy("stream").count()) == [("a", 3), ("b", 2)]


def test_last_rows_win(spark):
    given = spark.createDataFrame(
        [(1, 1, "a", False), (1, 3, None, False), (1, 2, "c", False), (None, 1, "n", False), (2, 5, "x", True), (2, 4, "y", False)],
        "id long, seq long, v string, gone boolean")
    assert rows(m.final_rows(given, ["id"], ["seq"], deleted="gone"), "id", "seq", "v") == [(1, 3, None), (None, 1, "n")]
    assert rows(m.final_rows(given, ["id"], ["seq"]), "id", "v") == [(1, None), (2, "x"), (None, "n")]


def test_envelopes_as_a_stream(spark, folder):
    spark.createDataFrame([(x,) for x in LINES], "value STRING").write.text(folder + "/in")
    lines = spark.readStream.text(folder + "/in")
    typed = m.records(m.envelope_read(lines, RECORD, STATE))
    s.finish(s.snapshot_to_files(typed, folder + "/out", folder + "/cp"))
    assert rows(spark.read.parquet(folder + "/out")) == [("t", 1), ("u", None)]


def test_scratch_folders_lie_in_the_shared_folder(spark):
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or a.startswith(base)
    assert spark.range(1).select(F.lit(1)).count() == 1
