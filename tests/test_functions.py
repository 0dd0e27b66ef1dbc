import pytest
from pyspark.sql import functions as F

from drayage.functions.casts import coded, lenient_int, money, parse_number
from drayage.functions.months import Month, span
from drayage.functions.names import check_identifier, result_path, slug, utc_day
from drayage.sources.monthly import month_paths, window_start

from .conftest import at, rows


def one(spark, value, ddl, fn):
    return spark.createDataFrame([(value,)], f"x {ddl}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize("value, want", [
    ("1", 1), (" 5 ", 5), ("1.7", 2), ("2.5", 3), ("-2.5", -3), (".5", 1), ("1e3", 1000),
    ("x", None), ("", None), ("1.0d", None), ("nan", None), ("1e10", None),
    ("2147483647.4", 2147483647), ("2147483647.6", None), (None, None),
])
def test_text_to_int(spark, value, want):
    assert one(spark, value, "STRING", lambda c: lenient_int(c, True)) == want


@pytest.mark.parametrize("value, want", [
    (1.7, 2), (2.5, 2), (3.5, 4), (-2.5, -2), (-0.5, 0), (2147483647.6, None),
    (float("nan"), None), (float("inf"), None), (None, None),
])
def test_double_to_int(spark, value, want):
    assert one(spark, value, "DOUBLE", lambda c: lenient_int(c, False)) == want


@pytest.mark.parametrize("value, want", [(1.005, "1.01"), (0.125, "0.13"), (-0.125, "-0.13")])
def test_money_rounds_as_text(spark, value, want):
    assert str(one(spark, value, "DOUBLE", money)) == want


@pytest.mark.parametrize("value, want", [
    ("1", 1.0), ("-2.5e3", -2500.0), ("ON", None), ("", None), (" 1", None), ("1d", None),
    ("0x1p2", None), ("1e999", None), (None, None),
])
def test_parse_number(spark, value, want):
    assert one(spark, value, "STRING", parse_number) == want


def test_codes(spark):
    df = spark.createDataFrame([("cmt",), ("VTS",), ("x",), (None,)], "v STRING")
    assert [r[0] for r in df.select(coded(F.col("v"), {"CMT": 1, "VTS": 2})).collect()] == [1, 2, 0, 0]
    df = spark.createDataFrame([("Credit",), ("cas",), ("ca",), (None,)], "v STRING")
    got = [r[0] for r in df.select(coded(F.col("v"), {"CRE": 1, "CAS": 2}, prefix=True)).collect()]
    assert got == [1, 2, 0, 0]


def test_months():
    assert Month(2024, 12).plus(1) == Month(2025, 1)
    assert Month(2024, 1).plus(-1) == Month(2023, 12)
    assert [str(m) for m in span(Month(2023, 11), Month(2024, 2))] == [
        "2023-11", "2023-12", "2024-01", "2024-02"]
    assert span(Month(2024, 2), Month(2024, 1)) == []
    assert window_start(1) == Month(2024, 12)
    assert window_start(192) == Month(2009, 1)
    assert month_paths("/d/{prefix}_{month}.parquet", "a", Month(2024, 1), Month(2024, 1)) == [
        "/d/a_2024-01.parquet"]


@pytest.mark.parametrize("months", [0, 193, -1])
def test_window_out_of_range(months):
    with pytest.raises(ValueError, match="1 to 192"):
        window_start(months)


def test_identifiers():
    assert check_identifier("a_1") == "a_1"
    for bad in ("", "1a", "a-b", "a b", "a;drop", "a.b"):
        with pytest.raises(ValueError):
            check_identifier(bad)


def test_slug(spark):
    df = spark.createDataFrame([("a b/c",), ("",), (None,), ("A-z_0",), ("é😀",)], "s STRING")
    assert [r[0] for r in df.select(slug(F.col("s"))).collect()] == [
        "a-b-c", "unlabeled", "unlabeled", "A-z_0", "--"]


def test_result_path(spark):
    df = spark.createDataFrame([(at("2024-03-01T23:59:59"),)], "t TIMESTAMP_NTZ")
    path = result_path(utc_day(F.col("t")), F.lit(""), F.lit("x y"), F.lit("full-load"),
                       F.lit("pg-pg"), F.lit("tpch sf1"), F.lit("remote"))
    assert rows(df.select(path)) == [
        ("2024-03-01/unlabeled/x-y/full-load-pg-pg-tpch-sf1-remote.json",)]


def test_utc_day_of_an_instant(spark):
    df = spark.sql("SELECT timestamp'2024-03-01 23:30:00-05:00' AS t")
    assert df.select(utc_day(F.col("t"), instant=True)).first()[0] == "2024-03-02"
