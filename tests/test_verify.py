import random
import statistics

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from drayage.operators import verify as v
from drayage.operators.ordering import exact_median, rank_within, value_cuts

from .conftest import plan, rows

COUNTS = "`table` STRING, rows BIGINT"


def test_parity(spark):
    expected = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 0)], COUNTS)
    sink = spark.createDataFrame([("a", 1), ("b", 5), ("d", 0), ("_seed", 1)], COUNTS)
    parity = v.count_parity(expected, sink)
    assert rows(parity) == [("a", 1, 1, True, True), ("b", 2, 5, False, False),
                            ("c", 3, -1, False, False), ("d", 0, 0, True, True)]
    assert rows(v.parity_pass(parity)) == [(4, 2, False)]
    assert rows(v.parity_pass(parity.filter("match"))) == [(2, 0, True)]
    assert rows(v.parity_pass(parity.filter("false"))) == [(0, 0, True)]


def test_manifest(spark):
    tables = {"a": spark.range(3), "b": spark.range(0)}
    assert rows(v.manifest(spark, tables)) == [("a", 3), ("b", 0)]
    assert rows(v.manifest_total(v.manifest(spark, tables))) == [(2, 3)]
    assert v.manifest(spark, {}).isEmpty()
    v.require_expected(["a"], v.manifest(spark, tables))
    with pytest.raises(v.MissingFromManifest, match="z: how many rows"):
        v.require_expected(["a", "z"], v.manifest(spark, tables))


def test_saved_manifests_are_kept_apart(spark, folder):
    first = spark.createDataFrame([("a", 1), ("b", 2)], COUNTS)
    v.save_manifest(first, folder, "pg", "x")
    v.save_manifest(first.filter("rows = 1"), folder, "pg", "y")
    v.save_manifest(first.filter("rows = 2"), folder, "mysql", "x")
    v.save_manifest(spark.createDataFrame([("a", 9)], COUNTS), folder, "pg", "x")
    assert rows(v.saved_manifest(spark, folder, "pg", "x")) == [("a", 9)]
    assert rows(v.saved_manifest(spark, folder, "pg", "y")) == [("a", 1)]
    assert rows(v.saved_manifest(spark, folder, "mysql", "x")) == [("b", 2)]
    assert v.saved_manifest(spark, folder, "mysql", "z").isEmpty()


def test_convergence_stops_at_the_first_incomplete_table(spark):
    expected = spark.createDataFrame(
        [("a", 0, 2), ("b", 1, 2), ("c", 2, 2), ("d", 3, 2)], "`table` STRING, seed_pos INT, rows BIGINT")

    def states(**sink):
        got = v.convergence(expected, spark.createDataFrame(list(sink.items()), COUNTS))
        return [(r["state"], r["checked"]) for r in got.orderBy("seed_pos").collect()]

    assert states(a=2, b=2, c=2, d=2) == [("converged", True)] * 4
    assert states(a=2, b=1, c=3, d=2) == [
        ("converged", True), ("pending", True), ("overshoot", False), ("converged", False)]
    assert states(a=3, b=2) == [
        ("overshoot", True), ("converged", False), ("pending", False), ("pending", False)]


def test_rep_consistency(spark):
    reps = spark.createDataFrame(
        [("x", 1, 10), ("x", 2, 10), ("x", 3, 10), ("y", 1, 10), ("y", 2, 11), ("y", 3, 10),
         ("y", 4, 12), ("z", 5, 7)], "result STRING, rep INT, rows BIGINT")
    assert rows(v.rep_consistency(reps, ["result"])) == [
        ("x", 10, None, True), ("y", 10, 2, False), ("z", 7, None, True)]


def test_publish_gate(spark):
    reps = spark.createDataFrame(
        [("x", 1, True), ("x", 2, True), ("y", 1, True), ("y", 2, False)],
        "result STRING, rep INT, parity_pass BOOLEAN")
    assert rows(v.publish_gate(reps, ["result"])) == [("x", 1, True), ("x", 2, True)]


# --- exact medians and ranks, with and without value buckets ---

def sample(seed):
    rng = random.Random(seed)
    out = []
    for group, size in (("hot", 700), ("even", 40), ("odd", 41), ("one", 1), (None, 6)):
        for _ in range(size):
            # many ties, one value heavier than all others
            value = 5.0 if rng.random() < 0.3 else round(rng.uniform(-20, 20), 1)
            out.append((group, value))
    return out


@pytest.mark.parametrize("buckets", [1, 4, 9, 200])
@pytest.mark.parametrize("seed", [1, 2])
def test_median_is_exact(spark, buckets, seed):
    data = sample(seed)
    df = spark.createDataFrame([*data, ("hot", None), ("empty", None)], "g STRING, x DOUBLE")
    got = {r["g"]: r["m"] for r in exact_median(df, ["g"], "x", "m", buckets).collect()}
    want = {g: statistics.median([x for k, x in data if k == g]) for g, _ in data}
    assert got == want


@pytest.mark.parametrize("buckets", [1, 16, 120])
def test_rank_is_exact(spark, buckets):
    data = sample(3)
    df = spark.createDataFrame(data, "g STRING, x DOUBLE")
    got = rows(rank_within(df, ["g"], "x", "place", buckets))
    want = sorted(((g, x, 1 + sum(1 for h, y in data if h == g and y < x)) for g, x in data), key=repr)
    assert got == want


def test_cuts(spark):
    def cuts(df, buckets):
        return tuple(spark.range(1).select(value_cuts(df, "x", buckets).alias("c")).first()["c"])

    df = spark.range(1000).selectExpr("double(id) AS x")
    every, starts = cuts(df, 10)
    assert len(every) == 9 and every == sorted(every) and starts == every[::4]
    assert cuts(df.selectExpr("1D AS x"), 100) == ([1.0], [1.0])
    assert cuts(df.filter("false"), 9) == (None, None)


@pytest.mark.parametrize("buckets", [1, 4, 50])
def test_order_statistics_of_nothing_and_of_ties(spark, buckets):
    df = spark.createDataFrame([("a", 7.0)] * 40 + [("b", 7.0), ("b", 9.0)], "g STRING, x DOUBLE")
    assert rows(exact_median(df, ["g"], "x", "m", buckets)) == [("a", 7.0), ("b", 8.0)]
    assert rows(rank_within(df, ["g"], "x", "place", buckets).distinct()) == [
        ("a", 7.0, 1), ("b", 7.0, 1), ("b", 9.0, 2)]
    assert rows(exact_median(df.filter("false"), ["g"], "x", "m", buckets)) == []
    assert rows(rank_within(df.filter("false"), ["g"], "x", "place", buckets)) == []
    strange = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", float("inf"))], "g STRING, x DOUBLE")
    assert [r["place"] for r in rank_within(strange, ["g"], "x", "place", buckets).orderBy("x").collect()] == [1, 2, 3]


def test_rows_without_a_value_have_no_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, None), ("b", 2.0)], "g STRING, x DOUBLE")
    assert rows(rank_within(df, ["g"], "x", "place")) == [
        ("a", 1.0, 1), ("a", None, None), ("b", 2.0, 1), (None, None, None)]


# --- what cannot be known does not pass ---

def test_unknown_parity_does_not_pass(spark):
    parity = spark.createDataFrame([("a", True), ("b", None)], "`table` STRING, match BOOLEAN")
    assert rows(v.parity_pass(parity)) == [(2, 1, False)]
    reps = spark.createDataFrame(
        [("x", 1, True), ("x", 2, None), (None, 1, True), (None, 2, True), ("y", 1, True)],
        "result STRING, rep INT, parity_pass BOOLEAN")
    assert rows(v.publish_gate(reps, ["result"])) == [("y", 1, True), (None, 1, True), (None, 2, True)]


def test_a_sink_that_cannot_be_counted_has_no_count(spark, folder):
    spark.range(3).write.parquet(folder + "/good")
    spark.createDataFrame([("no parquet",)], "v STRING").write.text(folder + "/broken")
    counts = v.sink_counts(spark, ["good", "broken", "absent"],
                           lambda n: spark.read.schema("id BIGINT").parquet(f"{folder}/{n}"))
    assert rows(counts) == [("good", 3)]
    expected = spark.createDataFrame([("good", 3), ("broken", 1), ("absent", 1)], COUNTS)
    assert rows(v.count_parity(expected, counts, tables=["good"]), "table", "sink") == [
        ("absent", -1), ("broken", -1), ("good", 3)]
    with pytest.raises(v.MissingFromManifest, match="other"):
        v.count_parity(expected, counts, tables=["good", "other"])


def test_a_load_that_has_not_converged_is_an_error(spark):
    expected = spark.createDataFrame([("a", 0, 2), ("b", 1, 2)], "`table` STRING, seed_pos INT, rows BIGINT")

    def states(**sink):
        return v.convergence(expected, spark.createDataFrame(list(sink.items()), COUNTS))

    assert v.require_convergence(states(a=2, b=2)).count() == 2
    with pytest.raises(v.Overshoot, match="b: 3 of 2"):
        v.require_convergence(states(a=2, b=3))
    with pytest.raises(v.NotConverged, match="a: 1 of 2"):
        v.require_convergence(states(a=1, b=3))


def test_file_manifest_of_many_tables_is_one_plan(spark, folder):
    for k in range(3):
        spark.range(k * 4).repartition(2).write.parquet(f"{folder}/a b/t{k}")
    spark.range(9).withColumn("p", F.col("id") % 3).write.partitionBy("p").parquet(f"{folder}/a b/t3")
    spark.createDataFrame([("x",)], "s STRING").write.parquet(f"{folder}/a b/t33")
    places = {f"t{k}": f"{folder}/a b/t{k}" for k in (0, 1, 2, 3, 33)}
    found = v.file_manifest(spark, places)
    assert rows(found, "table", "rows") == [("t0", 0), ("t1", 4), ("t2", 8), ("t3", 9), ("t33", 1)]
    assert plan(found).count("FileScan") == 1 and v.file_manifest(spark, {}).collect() == []
    assert plan(found).count("Union") == 0 and "ReadSchema: struct<>" in plan(found)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        v.file_manifest(spark, {"gone": folder + "/gone"}).collect()


def test_a_thousand_tables_in_one_scan(spark, folder):
    spark.range(1000).withColumn("t", F.col("id")).repartition(1).write.partitionBy("t").parquet(folder)
    found = v.file_manifest(spark, {f"t{k}": f"{folder}/t={k}" for k in range(1000)})
    assert plan(found).count("FileScan") == 1
    assert found.agg(F.count(F.lit(1)), F.sum("rows")).first() == (1000, 1000)
