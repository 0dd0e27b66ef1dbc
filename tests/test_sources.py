import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.functions.months import Month
from drayage.operators.conform import duplicate_keys
from drayage.queries.sinks import new_namespace
from drayage.schemas import TPCH_DDL, tpch_schema, wide_keys
from drayage.sinks.tables import reset_namespace, save_table
from drayage.plans.load import mark_loaded
from drayage.sources import messages as m
from drayage.sources.discovery import (
    MissingTables, catalog_streams, narrow_catalog, require_all, select_tables,
)
from drayage.sources.monthly import (
    listed_files, month_scan, month_scans, numbered, stable_id, with_file_ordinal, with_position,
)
from drayage.sources.splits import (
    balanced_predicates, equal_width_split, key_bounds, partition_plan, range_cuts, split_predicates, split_read,
)
from drayage.operators.telemetry import last_error
from drayage.sources.logs import read_lines
from drayage.sources.tables import FETCH_SIZE, jdbc_options, jdbc_ranges
from drayage.sources.tpch import nation_rows, part_rows, region_rows, rows_at, seed_tpch, supplier_rows

from .conftest import rows


# --- splits ---

def pieces(df, predicates):
    """Rows per predicate; every row must be taken exactly once."""
    taken = [df.filter(p) for p in predicates]
    sizes = [t.count() for t in taken]
    whole = taken[0]
    for t in taken[1:]:
        whole = whole.unionAll(t)
    assert whole.exceptAll(df).isEmpty() and df.exceptAll(whole).isEmpty()
    return sizes


def test_predicates_cover_every_row_once(spark):
    df = spark.range(1000).selectExpr("if(id % 97 = 0, null, id) AS k", "id AS v")
    sizes = pieces(df, balanced_predicates(df, "k", 8))
    assert len(sizes) == 8 and max(sizes) < 200


def test_hot_key_is_cut_by_the_second_key(spark):
    df = spark.range(3000).selectExpr("if(id < 1000, 500, id) AS k", "id AS line", "id AS v")
    plain = pieces(df, balanced_predicates(df, "k", 12))
    cut = pieces(df, balanced_predicates(df, "k", 12, second="line"))
    assert max(plain) >= 1000 and max(cut) < 500


def test_no_cut_points():
    assert split_predicates([], "k") == ["1 = 1"]
    assert split_predicates([5], "k") == ["k < 5 OR k IS NULL", "k >= 5"]


def test_predicates_of_texts_and_days(spark):
    texts = spark.range(300).selectExpr("concat('k', char(39), lpad(id, 4, '0')) AS k", "id AS v")
    assert pieces(texts, split_predicates(["k'0100", "k'0200"], "k")) == [100, 100, 100]
    days = spark.range(300).selectExpr("date_add(date'1995-01-01', cast(id as int)) AS k", "id AS v")
    assert max(pieces(days, balanced_predicates(days, "k", 5))) < 90
    times = spark.range(300).selectExpr("timestamp_ntz'1995-01-01' + make_dt_interval(0, id) AS k", "id AS v")
    assert max(pieces(times, balanced_predicates(times, "k", 5))) < 90


def test_ranges_from_bounds_alone(spark):
    df = spark.range(5, 106).selectExpr("id AS k", "id AS v")
    assert range_cuts(5, 105, 4) == [31, 57, 83] and range_cuts(5, 5, 3) == []
    assert pieces(df, split_predicates(range_cuts(5, 105, 4), "k")) == [26, 26, 26, 23]
    whole = split_read(df.filter, split_predicates(range_cuts(5, 105, 4), "k"))
    assert whole.exceptAll(df).isEmpty() and df.exceptAll(whole).isEmpty()


def test_bounds_and_equal_width(spark):
    df = spark.createDataFrame([(None,), (0,), (9,), (10,), (99,)], "k BIGINT")
    assert key_bounds(df, "k") == (0, 99)
    assert key_bounds(df.filter("k IS NULL"), "k") is None
    got = rows(df.select("k", equal_width_split(F.col("k"), 0, 99, 10).alias("s")))
    assert got == [(0, 0), (10, 1), (9, 0), (99, 9), (None, 0)]


def test_partition_plan(spark):
    manifest = spark.createDataFrame(
        [("a", 0), ("b", 750_000), ("c", 750_001), ("d", 10**9)], "`table` STRING, rows BIGINT")
    got = {r["table"]: (r["by_budget"], r["splits"], r["by_rows"])
           for r in partition_plan(manifest, 4).collect()}
    assert got == {"a": (8, 1, 1), "b": (8, 1, 1), "c": (8, 2, 2), "d": (8, 1334, 32)}
    assert partition_plan(manifest, 40).first()["by_budget"] == 1


def test_jdbc_options():
    assert jdbc_options("jdbc:x", user="u") == {
        "url": "jdbc:x", "fetchsize": str(FETCH_SIZE), "preferTimestampNTZ": "true", "user": "u"}


def test_jdbc_ranges():
    assert jdbc_ranges("id", 0, 99, 4) == {
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "4"}
    with pytest.raises(ValueError):
        jdbc_ranges("id; drop", 0, 1, 2)


# --- text lines ---

def test_lines_keep_their_order_over_many_pieces(spark, folder):
    spark.range(6000).coalesce(1).selectExpr(
        "concat('line ', id, if(id % 1000 = 500, ' \"level\":\"ERROR\"', ''))").write.text(folder)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, folder)
        assert lines.rdd.getNumPartitions() > 4
        ordered = [r["line"] for r in lines.orderBy("line_no").collect()]
        assert [int(x.split()[1]) for x in ordered] == list(range(6000))
        assert last_error(lines).first()[0] == 'line 5500 "level":"ERROR"'
        clean = lines.filter("NOT line LIKE '%ERROR%'")
        assert last_error(clean).first()[0] == "".join(x + "\n" for x in ordered if "ERROR" not in x)[-3500:]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


# --- monthly files ---

def write_months(spark, folder, months, rows_each=10, files=1):
    for i, m in enumerate(months):
        spark.range(i * 100, i * 100 + rows_each).repartition(files).write.parquet(
            f"{folder}/t_{m}.parquet")


def test_month_scan_reads_the_window_only(spark, folder):
    write_months(spark, folder, ["2023-12", "2024-01", "2024-02"])
    df = month_scan(spark, folder + "/{prefix}_{month}.parquet", "t", Month(2024, 1), Month(2024, 2))
    assert df.agg(F.min("id"), F.max("id"), F.count("id")).first()[:] == (100, 209, 20)
    assert not any("2023-12" in f for f in listed_files(df))


def test_missing_month_and_empty_window_fail(spark, folder):
    write_months(spark, folder, ["2024-01"])
    template = folder + "/{prefix}_{month}.parquet"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        month_scan(spark, template, "t", Month(2024, 1), Month(2024, 2))
    with pytest.raises(ValueError, match="no month"):
        month_scan(spark, template, "t", Month(2024, 2), Month(2024, 1))


def test_months_are_scanned_by_layout(spark, folder):
    for month, ddl in (("2024-01", "BIGINT"), ("2024-02", "DOUBLE"), ("2024-03", "BIGINT")):
        spark.range(3).selectExpr(f"cast(id AS {ddl}) AS v").write.parquet(f"{folder}/t_{month}.parquet")
    scans = month_scans(spark, folder + "/{prefix}_{month}.parquet", "t", Month(2024, 1), Month(2024, 3))
    assert sorted((dict(s.dtypes)["v"], s.count()) for s in scans) == [("bigint", 6), ("double", 3)]


@pytest.mark.parametrize("name", ["plain", "with space"])
def test_ids_are_unique_over_many_files_and_fixed_before_filters(spark, folder, name):
    write_months(spark, f"{folder}/{name}", ["2024-01", "2024-02"], rows_each=40, files=3)
    template = f"{folder}/{name}" + "/{prefix}_{month}.parquet"
    df = with_position(month_scan(spark, template, "t", Month(2024, 1), Month(2024, 2)))
    files = listed_files(df)
    assert len(files) == 6
    ids = with_file_ordinal(spark, df, numbered(files, 7)).withColumn("sid", stable_id())
    got = {r["id"]: r["sid"] for r in ids.collect()}
    assert len(got) == 80 and len(set(got.values())) == 80
    assert {s >> 32 for s in got.values()} == set(range(7, 13))
    # months keep their order, and a filter does not renumber
    assert max(s for i, s in got.items() if i < 100) < min(s for i, s in got.items() if i >= 100)
    assert {r["id"]: r["sid"] for r in ids.filter("id % 3 = 0").collect()} == {
        i: s for i, s in got.items() if i % 3 == 0}


def test_a_file_that_is_not_listed_is_an_error(spark, folder):
    for files in (1, 3):
        write_months(spark, f"{folder}/{files}", ["2024-01", "2024-02"], files=files)
        df = with_position(month_scan(
            spark, f"{folder}/{files}" + "/{prefix}_{month}.parquet", "t", Month(2024, 1), Month(2024, 2)))
        listing = numbered(listed_files(df))
        listing.popitem()
        with pytest.raises(Exception, match="not in the listing"):
            with_file_ordinal(spark, df, listing).agg(F.max(stable_id())).collect()


# --- messages ---

RECORD = T.StructType([T.StructField("a", T.IntegerType())])
STATE = T.StructType([T.StructField("cursor", T.LongType())])
LINES = [
    '{"type":"RECORD","record":{"stream":"t","data":{"a":1}}}',
    '{"type":"LOG","log":{"message":"x"}}',
    '{"type":"STATE","state":{"cursor":5}}',
    '{"type":"TRACE"}', '{"type":"RECORD","rec', "", "not json",
    '{"type":"RECORD","record":{"stream":"u","data":{"a":null}}}',
    '{"type":"STATE","state":{"cursor":3}}',
]


def test_a_field_that_does_not_parse_is_no_null(spark):
    lines = spark.createDataFrame([
        (1, '{"type":"RECORD","record":{"stream":"t","data":{"a":"x"}}}'),
        (2, '{"type":"STATE","state":{"cursor":"far"}}'), (3, '{"type":"LOG","state":{"cursor":"far"}}'),
        (4, '{"type":"RECORD","record":{"stream":"t","data":{"a":2}}}')], "n INT, value STRING")
    assert rows(m.records(m.envelope_read(lines, RECORD, STATE))) == [("t", 2)]
    assert rows(m.envelope_rejects(lines, RECORD, STATE), "n") == [(1,), (2,)]


def test_only_records_and_states_go_on(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "n INT, value STRING")
    messages = m.envelope_read(lines, RECORD, STATE)
    assert messages.count() == 4
    assert rows(m.records(messages)) == [("t", 1), ("u", None)]
    assert rows(m.records(messages, "u")) == [("u", None)]
    assert rows(m.latest_state(messages, "n")) == [(3,)]


def test_catalog_messages(spark):
    lines = spark.createDataFrame([
        (1, '{"type":"CATALOG","catalog":{"streams":[{"name":"a","namespace":"x"},{"name":"b"}]}}'),
        (2, '{"type":"CATALOG","catalog":{"streams":[{"name":"a","namespace":"y"}]}}'),
        (3, '{"type":"LOG"}')], "n INT, value STRING")
    got = m.configured(m.discovered_streams(lines, "n"))
    assert rows(got, "stream_name", "namespace", "sync_mode", "generation_id") == [
        ("a", "y", "full_refresh", 1), ("b", None, "full_refresh", 1)]


# --- discovery ---

def test_narrowing_a_namespace(spark):
    namespace, location = new_namespace(spark)
    reset_namespace(spark, namespace, location)
    for name in ("orders", "extra"):
        save_table(spark.range(1), namespace, name)
    mark_loaded(spark, namespace, "x")
    catalog = catalog_streams(spark, namespace)
    assert rows(catalog, "stream_name") == [("extra",), ("orders",)]
    wanted = spark.createDataFrame([("orders",), ("orders",)], "stream_name STRING")
    assert rows(select_tables(catalog, wanted), "stream_name") == [("orders",)]
    require_all(catalog, wanted)
    with pytest.raises(MissingTables, match="gone"):
        require_all(catalog, spark.createDataFrame([("gone",)], "stream_name STRING"))


def test_narrowing_a_document(spark):
    docs = spark.sql("""SELECT map('p', array(named_struct('stream_name', 'a'), named_struct('stream_name', '_seed')),
        'q', array(named_struct('stream_name', 'z'))) AS selected_streams,
        array(named_struct('stream', named_struct('name', 'a')), named_struct('stream', named_struct('name', 'b'))) AS streams""")
    got = narrow_catalog(docs, ["a", "b", "c"]).first()
    assert {k: [s["stream_name"] for s in v] for k, v in got["selected_streams"].items()} == {"p": ["a"], "q": []}
    assert [s["stream"]["name"] for s in got["streams"]] == ["a", "b"]
    assert got["missing"] == ["c"]


# --- generated tables ---

def test_generated_tables(spark):
    tables = seed_tpch(spark, 0.01)
    assert list(tables) == list(TPCH_DDL)
    for name, df in tables.items():
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in wide_keys(tpch_schema(name)).fields]
        assert df.filter(" OR ".join(f"{c} IS NULL" for c in df.columns)).isEmpty()
    counts = {name: df.count() for name, df in tables.items()}
    assert counts | {"lineitem": 0} == {
        "region": 5, "nation": 25, "supplier": 100, "customer": 1_500, "part": 2_000,
        "partsupp": 8_000, "orders": 15_000, "lineitem": 0}
    assert 3.8 < counts["lineitem"] / counts["orders"] < 4.2
    assert duplicate_keys(tables["partsupp"], ["ps_partkey", "ps_suppkey"]).isEmpty()
    assert duplicate_keys(tables["lineitem"], ["l_orderkey", "l_linenumber"]).isEmpty()
    supplied = tables["partsupp"].selectExpr("ps_partkey AS l_partkey", "ps_suppkey AS l_suppkey")
    assert tables["lineitem"].join(supplied, ["l_partkey", "l_suppkey"], "left_anti").isEmpty()
    assert tables["lineitem"].join(
        tables["orders"], F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate <= o_orderdate").isEmpty()


def test_generated_tables_do_not_depend_on_partitions(spark):
    first = seed_tpch(spark, 0.001)["lineitem"]
    again = seed_tpch(spark, 0.001)["lineitem"].repartition(3)
    assert first.exceptAll(again).isEmpty() and again.exceptAll(first).isEmpty()


def test_prices_of_lines_follow_from_their_parts(spark):
    tables = seed_tpch(spark, 0.001)
    lines = tables["lineitem"].join(tables["part"], F.col("l_partkey") == F.col("p_partkey"), "left")
    wrong = lines.filter("NOT coalesce(l_extendedprice = l_quantity * p_retailprice, false)")
    assert wrong.isEmpty() and not lines.isEmpty()


@pytest.mark.parametrize("sf", [0, -1, float("nan"), float("inf")])
def test_bad_scale_factor(sf):
    with pytest.raises(ValueError):
        rows_at("orders", sf)


def test_generated_nations_and_regions_have_their_names(spark):
    nations = rows(nation_rows(spark.createDataFrame([(0,), (24,), (25,)], "n_nationkey BIGINT")),
                   "n_nationkey", "n_name", "n_regionkey")
    assert nations == [(0, "ALGERIA", 0), (24, "UNITED STATES", 1), (25, None, None)]
    regions = rows(region_rows(spark.createDataFrame([(4,), (5,)], "r_regionkey BIGINT")), "r_regionkey", "r_name")
    assert regions == [(4, "MIDDLE EAST"), (5, None)]


def test_generated_rows_depend_on_their_key_only(spark):
    few = spark.createDataFrame([(7,), (7,), (2_000_000_000_000,)], "k BIGINT")
    suppliers, parts = (rows(f(few.withColumnRenamed("k", key))) for f, key in (
        (supplier_rows, "s_suppkey"), (part_rows, "p_partkey")))
    for found in (suppliers, parts):
        assert len(found) == 3 and len(set(found)) == 2
    whole = seed_tpch(spark, 0.001)
    assert rows(whole["part"].filter("p_partkey = 7").select("p_name", "p_brand")) == rows(
        part_rows(few.withColumnRenamed("k", "p_partkey")).filter("p_partkey = 7").distinct().select("p_name", "p_brand"))
