import json
import os

import pytest
from pyspark.sql import functions as F

from drayage.operators import results as r
from drayage.queries import inputs
from drayage.schemas import result_document

from .conftest import rows

# Published figures of one result: wall seconds and rows per second of three repetitions.
WALLS = [23.684487625, 24.191162605, 23.93064619]
RATES = [365692.73260772094, 358033.4331765367, 361931.09585228463]
ROWS = 8_661_245
REPS = "result STRING, rep INT, wall_seconds DOUBLE, rows_per_sec DOUBLE, setup_seconds DOUBLE, parity_pass BOOLEAN"


def published(spark, n=3):
    return spark.createDataFrame(
        [("a", i + 1, WALLS[i], RATES[i], 0.4, True) for i in range(n)], REPS)


def test_published_medians(spark):
    assert rows(r.result_stats(published(spark), ["result"])) == [
        ("a", 3, 23.93064619, 23.684487625, 24.191162605, 361931.09585228463, True)]


def test_even_number_of_repetitions(spark):
    got = r.result_stats(published(spark, 2), ["result"]).first()
    assert got["median_wall_seconds"] == (WALLS[0] + WALLS[1]) / 2
    assert got["median_rows_per_sec"] == (RATES[0] + RATES[1]) / 2
    assert r.result_stats(published(spark).filter("false"), ["result"]).isEmpty()


def test_published_rates(spark):
    tables = spark.createDataFrame(
        [(i, n) for i in range(3) for n in (5, 25, ROWS - 30)], "rep INT, rows BIGINT")
    reps = spark.createDataFrame(list(enumerate(WALLS)), "rep INT, wall_seconds DOUBLE")
    got = r.rep_rate(tables, reps, ["rep"]).orderBy("rep").collect()
    assert [g["rows"] for g in got] == [ROWS] * 3
    assert [g["rows_per_sec"] for g in got] == pytest.approx(RATES, rel=1e-12)
    odd = spark.createDataFrame([(0, 0.0), (7, 2.0), (None, 1.0)], "rep INT, wall_seconds DOUBLE")
    assert rows(r.rep_rate(tables, odd, ["rep"])) == [
        (0, ROWS, 0.0, None), (7, 0, 2.0, 0.0), (None, 0, 1.0, 0.0)]


def test_a_group_without_a_name_keeps_its_medians(spark):
    reps = spark.createDataFrame([(None, 1, 2.0, 5.0, 0.1, None), (None, 2, 4.0, 7.0, 0.1, True)], REPS)
    assert rows(r.result_stats(reps, ["result"])) == [(None, 2, 3.0, 2.0, 4.0, 6.0, False)]


def test_report(spark):
    reps = published(spark)
    lines = r.report(reps, r.result_stats(reps, ["result"]), ["result"]).orderBy("line").collect()
    assert [x["rep"] for x in lines] == ["1", "2", "3", "median"]
    assert lines[-1]["wall_seconds"] == WALLS[2] and lines[-1]["setup_seconds"] is None
    assert {x["parity"] for x in lines} == {"pass"}
    failed = reps.withColumn("parity_pass", F.col("rep") != 2)
    words = r.report(failed, r.result_stats(failed, ["result"]), ["result"]).orderBy("line")
    assert [x["parity"] for x in words.collect()] == ["pass", "FAIL", "pass", "FAIL"]


def test_phases(spark):
    reps = spark.sql("SELECT 1 AS rep, 2D AS setup_seconds, 3D AS wall_seconds, cast(null as double) AS seed_seconds")
    assert rows(r.phase_breakdown(reps, ["rep"])) == [(1, "setup", 2.0), (1, "wall", 3.0)]


def test_results_meet_only_inside_their_group(spark):
    results = spark.createDataFrame(
        [("t1", "m1", 5.0), ("t2", "m1", 3.0), ("t3", "m1", 5.0), ("t4", "m2", 9.0), ("t5", None, 1.0)],
        "tool STRING, machine STRING, median_wall_seconds DOUBLE")
    for name in r.COHORT_KEYS:
        if name != "machine":
            results = results.withColumn(name, F.lit("same"))
    two = results.filter("tool IN ('t1', 't2')").withColumn("source_label", F.col("tool"))
    assert rows(r.cohort_compare(two), "tool", "place") == [("t1", 1), ("t2", 1)]
    assert rows(r.cohort_compare(results), "tool", "place") == [
        ("t1", 2), ("t2", 1), ("t3", 2), ("t4", 1), ("t5", 1)]


DOC = {
    "sut": "tool", "scenario": "full-load", "route": "a-b", "dataset": "d", "rows": 30,
    "cohort": "c", "unknown": {"x": 1},
    "reps": [
        {"wallSeconds": 2.0, "rowsPerSec": 15.0, "setupSeconds": 0.5, "parityPass": True,
         "startedAt": "2026-08-31T17:32:47.123456789Z",
         "resources": [{"role": "source", "cpuSeconds": 1.5, "peakMemBytes": 9, "netRxBytes": 1,
                        "netTxBytes": 2, "samples": 3}],
         "parity": [{"table": "t", "source": 30, "sink": 30, "countMatch": True, "match": True}],
         "databases": [{"role": "source", "engine": "db",
                        "before": {"capturedAt": "2026-08-31T17:32:00Z", "counters": {"a.b": 1, "c.d": 2}},
                        "after": {"counters": {"a.b": 5}, "replicationSlots": [
                            {"name": "s", "active": True, "retainedBytes": 7}]},
                        "cloudWatch": [
                            {"name": "CPU", "stat": "Average", "points": [
                                {"at": "2026-08-31T17:31:00Z", "value": 1.25}]},
                            {"name": "Idle", "stat": "Maximum"}]}]},
        {"wallSeconds": 4.0, "rowsPerSec": 7.5, "setupSeconds": 0.25, "parityPass": False, "parity": []},
    ],
}


@pytest.fixture
def docs(spark, folder):
    spark.createDataFrame([(json.dumps(DOC),)], "value STRING").write.text(folder)
    return lambda *parts: spark.read.schema(result_document(parts)).json(folder)


def test_indented_documents_and_broken_ones(spark, folder):
    whole = json.dumps(DOC | {"config": {"workers": 4, "mode": "copy"}, "source": {"engine": "pg", "label": "x"}}, indent=2)
    spark.createDataFrame([(whole,)], "value STRING").coalesce(1).write.text(folder + "/good")
    docs = r.read_documents(spark, folder + "/good")
    assert r.rep_table(docs, ["sut"]).count() == 2
    line = r.result_table(docs).first()
    assert (line["sut"], line["reps"], line["config"], line["source_label"], line["sink_label"]) == (
        "tool", 2, {"workers": "4", "mode": "copy"}, "x", None)
    with pytest.raises(Exception, match="[Mm]alformed|MALFORMED"):
        r.read_documents(spark, folder + "/good", per_line=True).collect()


def test_flattening_a_document(docs):
    key = ["sut"]
    assert rows(r.rep_table(docs(), key), "rep", "wall_seconds", "parity_pass", "seed_seconds") == [
        (1, 2.0, True, None), (2, 4.0, False, None)]
    assert rows(r.resource_table(docs("resources"), key), "rep", "role", "cpu_seconds", "samples") == [
        (1, "source", 1.5, 3)]
    assert rows(r.parity_table(docs("parity"), key)) == [("tool", 1, "t", 30, 30, True, True)]
    snapshots = docs("snapshots")
    assert rows(r.counter_table(snapshots, key), "phase", "counter", "value") == [
        ("after", "a.b", 5.0), ("before", "a.b", 1.0), ("before", "c.d", 2.0)]
    assert rows(r.slot_table(snapshots, key), "phase", "name", "retained_bytes", "wal_status") == [
        ("after", "s", 7, None)]
    points = rows(r.point_table(docs("series"), key), "metric", "stat", F.col("at").cast("string"), "value")
    assert points == [("CPU", "Average", "2026-08-31 17:31:00", 1.25), ("Idle", "Maximum", None, None)]


def test_whole_layout_reads_every_part(docs):
    whole = docs("resources", "parity", "snapshots", "series")
    assert r.counter_table(whole, ["sut"]).count() == 3 and r.parity_table(whole, ["sut"]).count() == 1


def test_document_statistics_agree_with_its_repetitions(docs):
    stats = r.result_stats(r.rep_table(docs(), ["sut"]), ["sut"]).first()
    assert (stats["median_wall_seconds"], stats["median_rows_per_sec"], stats["parity_pass"]) == (
        3.0, 11.25, False)


def test_stored_documents_are_small_and_in_many_files(spark, folder, monkeypatch):
    events = spark.range(1_000, numPartitions=1).selectExpr(
        "if(id % 100 = 7, null, id) AS event_id", "timestamp_ntz'2024-01-02 03:04:05.123456' AS ts", "id % 13 AS user_id",
        "if(id % 4 = 0, 'error', 'view') AS event_type", "id / 8 AS value", "cast(null as string) AS props")
    events.write.parquet(folder + "/events.parquet")
    monkeypatch.setattr(inputs, "DOCUMENT_FILE_ROWS", 300, raising=False)
    docs = inputs.stored_documents(spark, folder)
    files = [f.removeprefix("file://") for f in docs.inputFiles()]
    whole = inputs.documents_json(events).selectExpr("sum(length(json) + 1)").first()[0]
    assert len(files) == 4 and sum(os.path.getsize(f) for f in files) < whole / 4
    assert rows(r.rep_table(docs, ["event_id"]), "event_id", "rep", "settle_seconds") == rows(
        events.selectExpr("event_id", "explode(array(1, 2)) AS rep", "value"))
