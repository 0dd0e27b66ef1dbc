import pytest

from drayage.operators import telemetry as t

from .conftest import at, plan, rows

SAMPLE = ("container_id STRING, role STRING, image STRING, image_id STRING, seq BIGINT, initial_pass BOOLEAN, "
          "state STRING, cpu_ns BIGINT, mem BIGINT, networks ARRAY<STRUCT<rx: BIGINT, tx: BIGINT>>")


def sample(c, seq, cpu, initial=False, state="running", mem=1, nets=((0, 0),), role="tool", image_id="i"):
    return (c, role, "img", image_id, seq, initial, state, cpu, mem, None if nets is None else list(nets))


def usage(spark, *samples):
    got = t.usage_rollup(spark.createDataFrame(list(samples), SAMPLE))
    return {r["container_id"]: r.asDict() for r in got.collect()}


def test_baseline_comes_from_the_initial_pass_only(spark):
    got = usage(
        spark,
        sample("old", 0, 5_000_000_000, True, nets=((10, 1), (20, 2))),
        sample("old", 1, 7_000_000_000, nets=((15, 4), (40, 2))),
        sample("new", 1, 3_000_000_000, nets=((9, 9),)),
        # listed in the initial pass, but its first valid sample comes later
        sample("slow", 0, 0, True), sample("slow", 1, 2_000_000_000, nets=((7, 7),)))
    assert (got["old"]["cpu_seconds"], got["old"]["net_rx_bytes"], got["old"]["net_tx_bytes"]) == (2.0, 25, 3)
    assert (got["new"]["cpu_seconds"], got["new"]["net_rx_bytes"]) == (3.0, 9)
    assert (got["slow"]["cpu_seconds"], got["slow"]["net_rx_bytes"], got["slow"]["samples"]) == (2.0, 7, 1)


def test_zero_and_stopped_samples_do_not_count(spark):
    got = usage(
        spark, sample("a", 0, 1_000_000_000, True, mem=5), sample("a", 1, 4_000_000_000, mem=9),
        sample("a", 2, 0, mem=99), sample("a", 3, 9_000_000_000, state="exited", mem=99))
    assert (got["a"]["cpu_seconds"], got["a"]["peak_mem_bytes"], got["a"]["samples"]) == (3.0, 9, 2)


def test_counter_going_back_counts_as_nothing(spark):
    got = usage(spark, sample("a", 0, 8_000_000_000, True, nets=((100, 5),)),
                sample("a", 1, 2_000_000_000, nets=((50, 6),)))
    assert (got["a"]["cpu_seconds"], got["a"]["net_rx_bytes"], got["a"]["net_tx_bytes"]) == (0.0, 0, 1)


def test_container_without_valid_samples_still_has_a_line(spark):
    got = usage(spark, sample("dead", 0, 5, True, state="created"), sample("dead", 1, 0, nets=None))
    assert got["dead"] == {
        "container_id": "dead", "role": "tool", "image": "img", "image_id": "i", "cpu_seconds": 0.0,
        "peak_mem_bytes": 0, "net_rx_bytes": 0, "net_tx_bytes": 0, "samples": 0}


def test_labels_are_those_of_the_first_listing(spark):
    got = usage(spark, sample("a", 0, 1_000_000_000, True, role="x"),
                sample("a", 1, 3_000_000_000, role="y"), sample("a", 2, 5_000_000_000, role="x"))
    assert (got["a"]["role"], got["a"]["cpu_seconds"], got["a"]["samples"]) == ("x", 4.0, 3)


def test_samples_are_hash_combined_before_the_shuffle(spark):
    text = plan(t.container_states(spark.createDataFrame([sample("a", 0, 1)], SAMPLE)))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_status_lists(spark):
    df = spark.createDataFrame([
        (1, 1, "Bytes_sent", "12"), (1, 2, "Uptime", "99"), (1, 3, "Threads_running", "ON"),
        (1, 4, "Bytes_received", "x"), (1, 5, "Innodb_data_reads", None)],
        "snap INT, n INT, name STRING, value STRING")
    assert rows(t.status_counters(df, ["snap"])) == [(1, "mysql.bytesSent", 12.0)]
    assert rows(t.status_errors(df, ["snap"], "n")) == [(1, "Innodb_data_reads: not a number: NULL")]


def test_unreadable_groups(spark):
    groups = {"database": {"blks_read": "blocksRead"}, "wal": {"wal_records": "records"}}
    df = spark.sql("SELECT 1 AS snap, named_struct('blks_read', 4D) AS database, "
                   "cast(null as struct<wal_records: double>) AS wal")
    assert rows(t.wide_counters(df, ["snap"], groups)) == [(1, "database.blocksRead", 4.0)]
    assert rows(t.wide_errors(["snap"], df, list(groups))) == [(1, "wal: unreadable")]


def test_io_and_table_counters(spark):
    columns = ", ".join(f"cast(if(id = 0, null, id) as double) AS {c}" for c in t.IO_COUNTERS)
    df = spark.sql(f"SELECT 1 AS snap, {columns} FROM range(3)")
    assert set(rows(t.io_totals(df, ["snap"]))) == {(1, f"io.{c}", 3.0) for c in t.IO_COUNTERS}
    columns = ", ".join(f"{i}D AS {c}" for i, c in enumerate(t.TABLE_COUNTERS))
    got = rows(t.table_counters(spark.sql(f"SELECT 1 AS snap, 'orders' AS relname, {columns}"), ["snap"]))
    assert (1, "table.orders.liveTuples", 0.0) in got and len(got) == 7


def test_deltas(spark):
    df = spark.createDataFrame([
        ("s", "a", "before", 1.0), ("s", "a", "after", 4.0), ("s", "a", "after_teardown", 9.0),
        ("s", "b", "after", 2.0)], "role STRING, counter STRING, phase STRING, value DOUBLE")
    assert rows(t.counter_delta(df, ["role"])) == [
        ("s", "a", 1.0, 4.0, 9.0, 3.0, 5.0), ("s", "b", None, 2.0, None, None, None)]
    maps = spark.sql("SELECT 1 AS k, map('a', 1D) AS before, map('a', 4D, 'b', 2D) AS after")
    assert rows(t.map_delta(maps, ["k"])) == [(1, "a", 1.0, 4.0, 3.0), (1, "b", None, 2.0, None)]


def test_slot_leak(spark):
    before = spark.createDataFrame([("source", "kept"), ("source", "kept")], "role STRING, name STRING")
    after = spark.createDataFrame(
        [("source", "kept", True, 5, "reserved"), ("source", "left", False, None, None),
         ("sink", "kept", True, 7, "lost")],
        "role STRING, name STRING, active BOOLEAN, retained_bytes BIGINT, wal_status STRING")
    assert rows(t.slot_leak(before, after, ["role"])) == [
        ("sink", "kept", True, 7, "lost"), ("source", "left", False, 0, "")]


def test_boundary_minutes_are_whole(spark):
    points = spark.createDataFrame([
        ("cpu", at("2024-01-01 17:30:59"), 1.0), ("cpu", at("2024-01-01 17:31:01"), 2.0),
        ("cpu", at("2024-01-01 17:31:50"), 4.0), ("cpu", at("2024-01-01 17:34:59"), 6.0),
        ("cpu", at("2024-01-01 17:35:00"), 9.0), ("mem", at("2024-01-01 17:32:00"), 3.0),
        ("mem", at("2024-01-01 17:32:30"), 1.0), ("other", at("2024-01-01 17:32:30"), 1.0)],
        "metric STRING, ts TIMESTAMP_NTZ, value DOUBLE")
    specs = [("cpu", "Average"), ("mem", "Minimum"), ("idle", "Maximum")]
    got = t.metric_minutes(points, at("2024-01-01 17:32:47"), at("2024-01-01 17:33:10"), specs)
    assert rows(got) == [
        ("cpu", "Average", at("2024-01-01 17:31:00"), 3.0),
        ("cpu", "Average", at("2024-01-01 17:34:00"), 6.0),
        ("idle", "Maximum", None, None), ("mem", "Minimum", at("2024-01-01 17:32:00"), 1.0)]
    series = {r["metric"]: [p["value"] for p in r["points"]] for r in t.metric_series(got).collect()}
    assert series == {"cpu": [3.0, 6.0], "mem": [1.0], "idle": []}


def test_metric_filter_reaches_the_reader(spark, sf):
    points = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type AS metric", "ts", "value")
    text = plan(t.metric_minutes(points, at("2024-01-02"), at("2024-01-03"), [("view", "Average")]))
    assert "EqualTo(event_type,view)" in text and "GreaterThanOrEqual(ts" in text
    assert "user_id" not in text and "props" not in text


def test_metric_specs():
    stats = [s for _, s in t.METRIC_SPECS]
    assert (stats.count("Average"), stats.count("Minimum"), stats.count("Maximum")) == (9, 2, 4)


def log(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no INT, line STRING").repartition(3)


def test_last_error_record(spark):
    got = t.last_error(log(
        spark, '{"level":"ERROR","m":1}', '{"level":"FATAL","m":"' + "x" * 4000 + '"}',
        '{"level":"INFO"}')).first()[0]
    assert got.startswith('{"level":"FATAL","m":"xxx') and len(got) == 3500


@pytest.mark.parametrize("lines, want", [
    (["a", "b"], "a\nb\n"),
    (["x" * 9000, "end"], "x" * 3495 + "\nend\n"),
    ([str(i % 10) for i in range(5000)], "".join(f"{i % 10}\n" for i in range(3250, 5000))),
    (["é" * 2000], "�" + "é" * 1749 + "\n"),
    ([], None),
])
def test_end_of_a_log_without_errors(spark, lines, want):
    got = t.last_error(log(spark, *lines)).first()[0]
    assert (got or None) == want
