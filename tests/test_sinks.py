from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.operators.verify import count_parity, manifest, sink_counts
from drayage.plans import load
from drayage.queries.sinks import new_namespace
from drayage.schemas import tpch_schema
from drayage.sinks import claims, files, tables
from drayage.sinks.claims import SharedFolder

from .conftest import rows


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


NASTY = [None, "", " edge ", 'say "x"', "a,b", "line\nbreak", "back\\slash", r"\N?", r"\N", r"\\N", "\\", "\\x", "a\r\nb", "c\rd", "\n", '"', "\t", "é😀"]


def test_csv_round_trip(spark, folder):
    df = spark.createDataFrame(list(enumerate(NASTY)), "n INT, s STRING")
    files.csv_export(df, folder, file_rows=3)
    assert same(df, files.csv_import(spark, folder, df.schema))


def test_csv_keeps_times(spark, folder):
    df = spark.sql("""SELECT timestamp_ntz'2024-01-02 03:04:05.123456' AS a, timestamp'2024-07-02 03:04:05.000001Z' AS b,
        date'1999-12-31' AS c UNION ALL SELECT null, null, null""")
    files.csv_export(df, folder)
    assert same(df, files.csv_import(spark, folder, df.schema))


def test_csv_files_are_bounded_and_headerless(spark, folder):
    files.csv_export(spark.range(10).coalesce(1), folder, file_rows=4)
    lines = spark.read.text(folder).selectExpr("_metadata.file_name AS f", "value")
    assert sorted(r["count"] for r in lines.groupBy("f").count().collect()) == [2, 4, 4]
    assert lines.filter("value = 'id'").isEmpty()


def test_csv_import_rejects_bad_rows(spark, folder):
    spark.sql("SELECT 'x' AS v").write.csv(folder)
    with pytest.raises(Exception):
        files.csv_import(spark, folder, T.StructType.fromDDL("v INT")).collect()


def test_replace_and_insert(spark, folder):
    files.write_replace(spark.range(5), folder)
    files.write_replace(spark.range(3), folder)
    files.write_insert(spark.range(3).selectExpr("id", "'x' AS more"), folder)
    assert rows(files.read_evolved(spark, folder)) == [
        (0, "x"), (0, None), (1, "x"), (1, None), (2, "x"), (2, None)]


RESULT = ("'d' AS day, 'c 1' AS cohort, 't' AS tool, 'full-load' AS scenario, 'pg-pg' AS route, "
          "concat('ds', id) AS dataset, 'remote' AS topology, id AS v")


def test_results_are_written_once(spark, folder):
    files.write_once(spark.sql(f"SELECT {RESULT} FROM range(2)"), folder)
    files.write_once(spark.sql(f"SELECT {RESULT} FROM range(2, 4)"), folder)
    with pytest.raises(FileExistsError, match="d/c-1/t/full-load-pg-pg-ds1-remote"):
        files.write_once(spark.sql(f"SELECT {RESULT} FROM range(1, 6)"), folder)
    with pytest.raises(FileExistsError):
        files.write_once(spark.sql(f"SELECT {RESULT} FROM range(9, 10) UNION ALL SELECT {RESULT} FROM range(9, 10)"), folder)
    assert rows(spark.read.json(folder), "v") == [(0,), (1,), (2,), (3,)]


def test_of_two_writers_of_one_name_one_succeeds(spark, folder):
    def write(k):
        try:
            files.write_once(spark.sql(f"SELECT {RESULT}, {k} AS writer FROM range(3)"), folder)
            return True
        except FileExistsError:
            return False

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(write, range(4))) == [False, False, False, True]
    assert spark.read.json(folder).select("writer").distinct().count() == 1
    assert rows(spark.read.json(folder), "v") == [(0,), (1,), (2,)]
    left = SharedFolder(spark, folder)
    assert left.files(left.path("_claims")) == left.files(left.path("_staged")) == left.files(left.path("_published")) == []


def test_a_write_that_fails_or_dies_leaves_nothing(spark, folder, monkeypatch):
    one = spark.sql(f"SELECT {RESULT} FROM range(2)")
    shared = SharedFolder(spark, folder)
    monkeypatch.setattr(files, "SharedFolder", lambda *a: shared)
    move = shared.move

    def broken(source, target):
        assert "/_staged/" not in source.toString() or not move(source, target), "no space left"
        return True

    monkeypatch.setattr(shared, "move", broken)
    with pytest.raises(AssertionError, match="no space"):
        files.write_once(one, folder)
    monkeypatch.undo()
    assert [f for f in shared.files(shared.path()) if not f.startswith("_")] == []
    # A writer that died while it published: its claim, its files and what it had staged are still there.
    assert shared.create(shared.path("_claims", "day=d"), "dead")
    for name in ("day=d/cohort=c-1/tool=t/dead-part.json", "_staged/dead/day=d/cohort=c-1/tool=t/part.json"):
        assert shared.create(shared.path(name), '{"name": "half", "v": 99}')
    with pytest.raises(claims.Busy):
        files.write_once(one, folder, wait_seconds=0.2)
    files.write_once(one, folder, lease_seconds=0.0)
    assert rows(spark.read.json(folder), "v") == [(0,), (1,)]


def test_a_name_is_claimed_once(spark, folder):
    shared = SharedFolder(spark, folder)
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda k: shared.create(shared.path("_claims", "x"), str(k)), range(16))) == 1
    assert not shared.move(shared.path("none"), shared.path("other")) and shared.age(shared.path("none")) is None


@pytest.mark.parametrize("ranges", [1, 3])
def test_files_keep_their_bounds(spark, folder, ranges):
    sizes = [1, 10_000, 5, 400, 1, 1, 30_000, 2, 90, 4_000, 4_900, 5_100] + [60] * 500 + [3_000] * 9
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "i long, t string").repartition(4)
    batching = replace(files.BATCHING["small"], file_rows=70, file_bytes=10_000)
    files.write_bounded(df, folder, batching, ranges)
    back = spark.read.schema("i long, t string").json(folder)
    held = back.groupBy("_metadata.file_path").agg(
        F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("bytes")).collect()
    assert sorted(r["i"] for r in back.collect()) == list(range(len(sizes)))
    assert all((r["bytes"] <= 10_000 and r["n"] <= 70) or r["n"] == 1 for r in held) and len(held) < 60


@pytest.mark.parametrize(("parts", "ranges"), [(1, 1), (1, 4), (3, 4)])
def test_ranges_of_files_do_not_grow_with_the_table(spark, parts, ranges):
    batching = replace(files.BATCHING["small"], file_rows=50)
    numbered = files.file_numbers(spark.range(6_000, numPartitions=parts), batching, ranges)
    held = numbered.groupBy(files.FILE_COLUMN).count().collect()
    sizes = {}
    for name, n in held:
        of = name.rpartition("-")[0]
        sizes[of] = sizes.get(of, 0) + n
    assert sum(sizes.values()) == 6_000 and max(sizes.values()) <= 50 and len(sizes) <= 6_000 / 50 + parts * ranges


def test_results_keep_microseconds_and_only_their_days_are_read(spark, folder):
    files.write_once(spark.sql(f"SELECT {RESULT}, timestamp_ntz'2024-01-02 03:04:05.123456' AS ended FROM range(1)"), folder)
    spark.createDataFrame([("{broken",)], "value STRING").write.text(folder + "/day=older/cohort=c/tool=t")
    files.write_once(spark.sql(f"SELECT {RESULT}, null AS ended FROM range(1, 2)"), folder)
    got = spark.read.schema("ended TIMESTAMP_NTZ, v BIGINT, day STRING").json(folder).filter("day = 'd' AND v = 0").first()
    assert got["ended"].microsecond == 123456


def test_namespace_tables(spark):
    namespace, location = new_namespace(spark)
    tables.reset_namespace(spark, namespace, location)
    tables.check_writable(spark, namespace, "parquet")
    tables.save_table(spark.range(4), namespace, "t")
    tables.save_table(spark.range(2), namespace, "t", append=True)
    tables.analyze_table(spark, namespace, "t")
    assert spark.table(f"{namespace}.t").count() == 6
    tables.lake_write(spark.range(3), namespace, "t", "parquet")
    assert spark.table(f"{namespace}.t").count() == 3
    tables.reset_namespace(spark, namespace, location)
    assert spark.sql(f"SHOW TABLES IN {namespace}").isEmpty()
    with pytest.raises(ValueError):
        tables.save_table(spark.range(1), namespace, "bad name")


def test_jdbc_write_options():
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType()),
                           T.StructField("c", T.StringType())])
    got = tables.jdbc_write_options("jdbc:x", schema, 8_192, 16, text_length=40)
    assert got == {"url": "jdbc:x", "batchsize": "8192", "numPartitions": "16", "truncate": "true",
                   "createTableColumnTypes": "a VARCHAR(40), c VARCHAR(40)"}
    assert "createTableColumnTypes" not in tables.jdbc_write_options("jdbc:x", schema, 1, 1)
    assert files.BATCHING["medium"].jdbc_write() == {"batchsize": "25000", "numPartitions": "32"}
    assert files.BATCHING["small"].jdbc_read() == {"fetchsize": "10240"}


# --- full loads ---

def loader(spark, folder, sources, **kwargs):
    def read(name):
        return sources[name]

    return load.full_load(spark, list(sources), read,
                          lambda n, df: files.write_replace(df, files.table_path(folder, n)), **kwargs)


@pytest.mark.parametrize("budget", [None, 32])
def test_load_moves_every_row(spark, folder, sf, budget):
    names = ["orders", "documents", "embeddings"]
    sources = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names}
    outcomes = loader(spark, folder, sources, budget=budget)
    assert rows(outcomes, "table", "status") == [(n, "done") for n in sorted(names)]
    for n in names:
        assert same(sources[n], spark.read.parquet(f"{folder}/{n}"))
    assert rows(load.outcome_manifest(outcomes)) == rows(manifest(spark, sources))


def test_one_failure_fails_the_load_after_all_had_their_chance(spark, folder):
    sources = {"good": spark.range(3), "bad": spark.range(3).selectExpr("cast('x' AS int) / id AS v"),
               "late": spark.range(4)}
    with pytest.raises(load.LoadFailed, match="failed: bad") as e:
        loader(spark, folder, sources, parallel=1)
    assert rows(e.value.outcomes, "table", "status", "rows") == [
        ("bad", "failed", None), ("good", "done", 3), ("late", "done", 4)]
    parity = count_parity(
        spark.createDataFrame([("good", 3), ("bad", 3), ("late", 4)], "`table` STRING, rows BIGINT"),
        sink_counts(spark, sources, lambda n: spark.read.parquet(files.table_path(folder, n))))
    assert ("bad", 3, -1, False, False) in rows(parity)


def test_a_failed_load_leaves_the_old_tables(spark):
    namespace, location = new_namespace(spark)
    tables.reset_namespace(spark, namespace, location)
    load.replace_tables(spark, namespace, ["a", "b"], lambda n: spark.range(3))
    with pytest.raises(load.LoadFailed) as e:
        load.replace_tables(spark, namespace, ["a", "b"], lambda n: spark.range(5).selectExpr(
            "id" if n == "a" else f"raise_error('{'x' * 5000}') AS id"))
    assert any(len(r["error"] or "") > 5000 for r in e.value.outcomes.collect())
    assert [spark.table(f"{namespace}.{n}").count() for n in "ab"] == [3, 3]
    assert sorted(t.name for t in spark.catalog.listTables(namespace)) == ["a", "b"]
    load.replace_tables(spark, namespace, ["a"], lambda n: spark.range(7))
    assert [spark.table(f"{namespace}.{n}").count() for n in "ab"] == [7, 3]


def test_load_rejects_nothing_and_bad_names(spark):
    with pytest.raises(ValueError, match="no tables"):
        load.full_load(spark, [], lambda n: None, lambda n, df: None)
    with pytest.raises(ValueError, match="invalid table name"):
        load.full_load(spark, ["a;b"], lambda n: None, lambda n, df: None)


def test_seed_is_reused_only_under_its_label(spark):
    namespace, location = new_namespace(spark)
    reads = []

    def seed(label, rows_read):
        def read(name):
            reads.append(name)
            return spark.range(rows_read)

        return load.reuse_seed(spark, namespace, label, ["a", "b"], read, location)

    assert rows(seed("tpch-sf1", 3)) == [("a", 3, False), ("b", 3, False)]
    assert rows(seed("tpch-sf1", 9)) == [("a", 3, True), ("b", 3, True)]
    assert rows(seed("taxi-2mo", 5)) == [("a", 5, False), ("b", 5, False)]
    assert sorted(reads) == ["a", "a", "b", "b"]


def test_failed_seed_leaves_no_marker(spark):
    namespace, location = new_namespace(spark)

    def read(name):
        return spark.range(2).selectExpr("cast('x' AS int) AS v")

    with pytest.raises(load.LoadFailed):
        load.reuse_seed(spark, namespace, "l", ["a"], read, location)
    assert load.loaded_label(spark, namespace) == ""


def test_labels():
    assert (load.tpch_label(1.0), load.tpch_label(0.01), load.taxi_label(2)) == (
        "tpch-sf1", "tpch-sf0.01", "taxi-2mo")
    with pytest.raises(ValueError, match="not empty"):
        load.check_label("")
    assert load.check_label("x" * 255)
    with pytest.raises(ValueError, match="256 bytes"):
        load.check_label("é" * 128)


def test_generations(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "v INT, generation_id INT")
    assert rows(load.current_generation(df, 2), "v") == [(2,), (3,)]
    assert load.current_generation(df, 1).count() == 3


def test_declared_columns_are_complete():
    assert len(tpch_schema("lineitem")) == 16
