"""No registered query may plan a cross join, a Python worker, or a whole-table single task."""

import datetime as dt
from itertools import pairwise

import pytest

from drayage import queries as registry
from drayage.operators.ordering import exact_median
from drayage.operators.results import cohort_compare, result_stats
from drayage.operators.telemetry import metric_minutes
from drayage.queries.inputs import reps

from .conftest import SF, plan

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow", "PythonMapInArrow", "FlatMapGroupsInArrow",
             "FlatMapCoGroupsInPandas", "FlatMapCoGroupsInArrow", "AggregateInPandas", "ArrowAggregatePython",
             "WindowInPandas", "TransformWithStateInPySpark", "FlatMapGroupsInPandasWithState", "PythonUDTF"]


registry.load_all()
# Queries whose result is one line, or lines of tables rather than of rows: one task may make it.
SMALL_RESULT = {
    "convergence", "count_parity", "envelope_state", "full_load", "last_error", "manifest", "manifest_total",
    "metric_minutes", "parity_pass", "partition_plan", "replace_tables", "reset_namespace", "reuse_seed",
    "saved_manifest", "snapshot_stream", "stream_positions",
}


@pytest.mark.parametrize("name", registry.QUERIES)
def test_plan(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert [f for f in FORBIDDEN if f in text] == []
    # Whatever goes to a single task is a result of a few lines, combined before, or the digests, one a
    # task, that cuts between buckets are taken from.
    gathered = [below for line, below in pairwise(text.splitlines()) if "Exchange SinglePartition" in line]
    assert name in SMALL_RESULT or [g for g in gathered if "partial_percentile_approx" not in g] == []


def scans(df):
    return plan(df).count("FileScan")


def test_inputs_are_read_once_a_pass(spark):
    some = reps(spark, SF)
    assert scans_of_run(exact_median(some, ["result"], "wall_seconds", "m")) <= 2
    assert scans_of_run(result_stats(some, ["result"])) <= 3
    # For the cuts, for the totals of the buckets, and for the rows themselves. (The cuts used to be found by a
    # job of their own, which counting the scans of the plan left out.)
    assert scans_of_run(cohort_compare(some.withColumnRenamed("result", "cohort"), ["cohort"], "wall_seconds")) <= 3
    points = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_type AS metric", "ts", "value")
    assert scans(metric_minutes(points, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3), [("view", "Average")])) == 1


def scans_of_run(df):
    """Scans that ran: those of the final plans, its subqueries' included."""
    df.collect()
    found, skipped = 0, None
    for line in plan(df).splitlines():
        place = len(line) - len(line.lstrip(" :+-"))
        if skipped is not None and place >= skipped:
            continue
        skipped = place if "== Initial Plan ==" in line else None
        found += skipped is None and "FileScan" in line
    return found


def test_order_statistics_are_one_plan(spark):
    some = reps(spark, SF)
    spark.sparkContext.setJobGroup("building", "no job may start here")
    try:
        median = exact_median(some, ["result"], "wall_seconds", "m")
        stats = result_stats(some, ["result"])
        placed = cohort_compare(stats.withColumnRenamed("result", "cohort"), ["cohort"])
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # The cuts are taken from the shuffle that the medians are made of.
    assert scans_of_run(median) == 1
    assert scans_of_run(stats) == 2
    assert placed.count() == stats.count()
