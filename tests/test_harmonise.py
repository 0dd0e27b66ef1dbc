import pytest
from pyspark.sql import functions as F

from drayage.functions.casts import minute_of
from drayage.functions.months import Month
from drayage.operators import harmonise as h
from drayage.operators.conform import conform, null_defaults
from drayage.schemas import narrowed, taxi_schema, tpch_schema, wide_keys
from drayage.sources.monthly import (
    listed_files, month_scan, numbered, with_file_ordinal, with_position,
)

from .conftest import at, plan, rows

MODERN = ["VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count",
          "trip_distance", "RatecodeID", "store_and_fwd_flag", "PULocationID", "DOLocationID",
          "payment_type", "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount",
          "improvement_surcharge", "total_amount", "congestion_surcharge", "Airport_fee"]


def modern(spark, pickup, dropoff, n=1):
    """Modern-layout rows with every other column NULL."""
    typed = {"tpep_pickup_datetime": f"timestamp_ntz'{pickup}'" if pickup else "cast(null as timestamp_ntz)",
             "tpep_dropoff_datetime": f"timestamp_ntz'{dropoff}'" if dropoff else "cast(null as timestamp_ntz)",
             "store_and_fwd_flag": "cast(null as string)"}
    return spark.range(n).selectExpr(*[
        f"{typed.get(c, 'cast(null as double)')} AS {c}" for c in MODERN])


def legacy_2010(spark, pickup, dropoff, n=1):
    return spark.range(n).selectExpr(
        "'vts' AS vendor_id", f"'{pickup}' AS pickup_datetime", f"'{dropoff}' AS dropoff_datetime",
        "2L AS passenger_count", "1.005D AS trip_distance", "'x' AS rate_code",
        "cast(null as string) AS store_and_fwd_flag", "'Cash' AS payment_type", "2.5D AS fare_amount",
        "0.5D AS surcharge", "cast(null as double) AS mta_tax", "0D AS tip_amount",
        "0D AS tolls_amount", "3D AS total_amount")


def test_modern_nulls_become_defaults(spark):
    got = h.project(modern(spark, "2020-01-01", "2020-01-02"), h.yellow_modern, "trips").first()
    assert got["vendor_id"] == 0 and got["store_and_fwd_flag"] == "" and str(got["airport_fee"]) == "0.00"
    assert got.__fields__ == [f.name for f in taxi_schema("trips").fields if f.name != "id"]


def test_2010_row(spark):
    got = h.project(legacy_2010(spark, "2010-05-01 10:00:00", "2010-05-01 10:30:00"),
                    h.yellow_2010, "trips").first().asDict()
    assert got["vendor_id"] == 2 and got["payment_type"] == 2 and got["ratecode_id"] == 0
    assert got["pickup_at"] == at("2010-05-01 10:00:00") and str(got["trip_distance"]) == "1.01"
    assert got["pu_location_id"] == 0 and str(got["mta_tax"]) == "0.00"


def test_bad_timestamp_text_fails_the_load(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        h.project(legacy_2010(spark, "soon", "later"), h.yellow_2010, "trips").collect()


@pytest.mark.parametrize("pickup, dropoff, kept", [
    ("2020-03-01 00:00:00", "2020-03-01 00:10:00", True),
    ("2020-02-29 23:59:59", "2020-03-01 00:10:00", False),
    ("2020-04-30 23:59:59", "2020-05-01 00:10:00", True),
    ("2020-05-01 00:00:00", "2020-05-01 00:10:00", False),
    ("2020-04-30 23:59:59", "2020-05-31 23:59:59", True),
    ("2020-04-30 23:59:59", "2020-06-01 00:00:00", False),
    ("2020-04-10 00:00:00", "2019-01-01 00:00:00", True),
    ("2020-04-10 00:00:00", None, False),
    (None, "2020-04-10 00:00:00", False),
])
def test_window_edges(spark, pickup, dropoff, kept):
    df = h.project(modern(spark, pickup, dropoff), h.yellow_modern, "trips")
    assert h.window_filter(df, Month(2020, 3), Month(2020, 4)).count() == int(kept)


def test_fhv_dropoff_falls_back_and_fhvhv_does_not(spark):
    columns = ("'B1' AS dispatching_base_num, timestamp_ntz'2020-03-05 00:00:00' AS pickup_datetime, "
               "cast(null as timestamp_ntz) AS {drop}, 1 AS {pu}, 2 AS {do}, 'Y' AS {flag}, 'B9' AS {base}")
    fhv = spark.sql("SELECT " + columns.format(drop="dropOff_datetime", pu="PUlocationID", do="DOlocationID",
                                               flag="SR_Flag", base="Affiliated_base_number"))
    hv = spark.sql("SELECT " + columns.format(drop="dropoff_datetime", pu="PULocationID", do="DOLocationID",
                                              flag="shared_request_flag", base="originating_base_num"))
    a = h.project(fhv, h.fhv, "fhv_trips")
    b = h.project(hv, h.fhvhv, "fhv_trips")
    assert a.first()["dropoff_at"] == at("2020-03-05") and a.first()["sr_flag"] == 0
    assert b.first()["dropoff_at"] is None and b.first()["sr_flag"] == 1
    assert b.first()["affiliated_base_number"] == "B9"
    window = Month(2020, 3), Month(2020, 3)
    assert h.window_filter(a, *window).count() == 1 and h.window_filter(b, *window).count() == 0


@pytest.fixture
def taxi_files(spark, folder):
    legacy_2010(spark, "2010-11-15 10:00:00", "2010-11-15 11:00:00", 3).coalesce(1).write.parquet(
        f"{folder}/yellow_tripdata_2010-11.parquet")
    legacy_2010(spark, "2010-11-20 10:00:00", "2010-11-20 11:00:00", 2).coalesce(1).write.parquet(
        f"{folder}/yellow_tripdata_2010-12.parquet")
    rest = modern(spark, "2011-01-05 10:00:00", "2011-01-05 11:00:00", 4).unionAll(
        modern(spark, "2013-01-05 10:00:00", "2013-01-05 11:00:00", 1))
    rest.coalesce(1).write.parquet(f"{folder}/yellow_tripdata_2011-01.parquet")
    return folder + "/{prefix}_{month}.parquet"


def shortened(last):
    return [h.TRIPS_ERAS[0], h.TRIPS_ERAS[1], h.Era("yellow_tripdata", h.yellow_modern, Month(2011, 1), last)]


def test_whole_table_from_month_files(spark, taxi_files):
    last = Month(2011, 1)
    got = h.harmonise(spark, "trips", taxi_files, 3, shortened(last), last)
    assert [(f.name, f.dataType) for f in got.schema] == [
        (f.name, f.dataType) for f in taxi_schema("trips")]
    by_file = rows(got.groupBy(F.shiftright("id", 32)).count())
    # November rows filed under December stay, the stray row of 2013 goes
    assert by_file == [(0, 3), (1, 2), (2, 4)]
    assert got.select("id").distinct().count() == 9
    # a shorter window skips whole eras and numbers its own files from 0
    one = h.harmonise(spark, "trips", taxi_files, 1, shortened(last), last)
    assert rows(one.groupBy(F.shiftright("id", 32)).count()) == [(0, 4)]


def test_harmonise_is_map_only_and_pushes_the_window(spark, taxi_files):
    last = Month(2011, 1)
    text = plan(h.harmonise(spark, "trips", taxi_files, 1, shortened(last), last).select("id", "total_amount"))
    assert "Exchange" not in text
    assert "GreaterThanOrEqual(tpep_pickup_datetime" in text
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "total_amount" in schema and "fare_amount" not in schema


def test_types_may_change_from_month_to_month(spark, folder):
    def month(m, expr, n):
        rows_ = modern(spark, f"2020-{m:02d}-05 10:00:00", f"2020-{m:02d}-05 11:00:00", n)
        rows_.withColumn("passenger_count", F.expr(expr)).withColumn("VendorID", F.expr("2")) \
            .coalesce(1).write.parquet(f"{folder}/yellow_tripdata_2020-{m:02d}.parquet")

    month(1, "3L", 2)
    month(2, "2.5D", 1)
    month(3, "'2.5'", 1)
    month(4, "7L", 3)
    last = Month(2020, 4)
    got = h.harmonise(spark, "trips", folder + "/{prefix}_{month}.parquet", 4, [
        h.Era("yellow_tripdata", h.yellow_modern, Month(2020, 1), last)], last)
    assert {(r["id"], r["passenger_count"]) for r in got.collect()} == {
        (0, 3), (1, 3), (1 << 32, 2), (2 << 32, 3), (3 << 32, 7), ((3 << 32) + 1, 7), ((3 << 32) + 2, 7)}


def test_many_files_are_numbered_without_a_shuffle(spark, taxi_files):
    last = Month(2011, 1)
    got = h.harmonise(spark, "trips", taxi_files, 3, shortened(last), last)
    text = plan(got)
    assert "Exchange" not in text and "Join" not in text


def test_a_listing_too_large_to_broadcast_is_joined(spark, taxi_files):
    for month in ("2010-11", "2010-12"):
        path = taxi_files.format(prefix="yellow_tripdata", month=month)
        spark.read.parquet(path).coalesce(1).write.mode("append").parquet(path)
    raw = with_position(month_scan(spark, taxi_files, "yellow_tripdata", Month(2010, 11), Month(2010, 12)))
    files = listed_files(raw)
    small = with_file_ordinal(spark, raw, numbered(files))
    assert "BroadcastHashJoin" in plan(small)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = with_file_ordinal(spark, raw, numbered(files))
        assert "SortMergeJoin" in plan(large)
        assert rows(large, "file_ordinal", "row_index") == rows(small, "file_ordinal", "row_index")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_no_era_in_the_window(spark):
    with pytest.raises(ValueError, match="no month"):
        h.harmonise(spark, "fhv_trips", "/nowhere/{prefix}_{month}", 1, [
            h.Era("fhv", h.fhv, Month(2015, 1), Month(2015, 2))], Month(2016, 1))


def test_eras_cover_the_declared_range():
    assert [e.clipped(Month(2010, 6)) for e in h.TRIPS_ERAS] == [
        None, (Month(2010, 6), Month(2010, 12)), (Month(2011, 1), Month(2024, 12))]
    assert h.FHV_ERAS[1].clipped(Month(2009, 1)) == (Month(2019, 2), Month(2024, 12))


# --- declared layouts ---

def test_conform_is_strict(spark):
    narrow = narrowed(tpch_schema("orders"), ["o_orderkey", "o_totalprice"])
    df = spark.sql("SELECT 1.005D AS o_totalprice, 7L AS o_orderkey, 'x' AS more")
    assert [str(v) for v in conform(df, narrow).first()] == ["7", "1.01"]
    big = spark.sql("SELECT 1D AS o_totalprice, 3000000000L AS o_orderkey")
    with pytest.raises(Exception, match="OVERFLOW"):
        conform(big, narrow).collect()
    assert conform(big, wide_keys(narrow)).first()["o_orderkey"] == 3_000_000_000
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        conform(df.drop("o_totalprice"), narrow).collect()


def test_null_defaults(spark):
    df = spark.sql("SELECT cast(null as int) i, cast(null as decimal(15,2)) d, cast(null as string) s, "
                   "cast(null as date) t")
    got = null_defaults(df)
    assert [str(v) for v in got.first()] == ["0", "0.00", "", "None"]
    assert [f.dataType for f in got.schema] == [f.dataType for f in df.schema]


def test_session_zone_does_not_move_the_window(spark):
    """The hour skipped by the zone's clock change stays where it is."""
    df = h.project(modern(spark, "2020-03-29 02:30:00", "2020-03-29 02:45:00"), h.yellow_modern, "trips")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = h.window_filter(df, Month(2020, 3), Month(2020, 3))
        assert got.select(F.col("pickup_at").cast("string")).first()[0] == "2020-03-29 02:30:00"
        assert got.select(minute_of(F.col("dropoff_at") + F.expr("interval 7 seconds")).cast("string")
                          ).first()[0] == "2020-03-29 02:45:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


TEXTS = ["2010-05-01 10:00:00", "2009-12-31 23:59:59", "2010-01-01", "2010-12-31 23:59:59", "2011-01-01 00:00:00", "2010-1-5 1:02:03",
         "  2010-06-01 00:00:00", "\t2010-06-02", "2010", "2010-07", "2008-01-01", "1999-01-01", "+2010-03-03", "002010-03-04 00:00:00", "2010-08-08T08:08:08"]


def test_a_window_over_text_skips_row_groups_and_loses_nothing(spark, folder):
    era = h.TRIPS_ERAS[1]
    months = (Month(2010, 1), Month(2010, 12))
    for k, text in enumerate(TEXTS):
        legacy_2010(spark, text, "2010-12-31 23:59:59").withColumns(
            {"file_ordinal": F.lit(k), "row_index": F.lit(0).cast("bigint")}).coalesce(1).write.mode("append").parquet(folder)
    raw = spark.read.parquet(folder)
    got = h.era_rows(raw, era, "trips", *months)
    exact = h.window_filter(h.project(raw.withColumn("id", h.stable_id()), era.layout, "trips", keep=("id",)), *months)
    assert rows(got) == rows(exact) and len(rows(got)) == 11
    pushed = plan(got).split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(pickup_datetime,2010)" in pushed and "LessThan(pickup_datetime,2011)" in pushed


@pytest.mark.parametrize("text", ["soon", "", "\x7f2010-13-01"])
def test_texts_that_are_no_times_still_fail_the_load(spark, folder, text):
    legacy_2010(spark, text, "2010-12-31 23:59:59").withColumns(
        {"file_ordinal": F.lit(1), "row_index": F.lit(0).cast("bigint")}).write.parquet(folder)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        h.era_rows(spark.read.parquet(folder), h.TRIPS_ERAS[1], "trips", Month(2010, 1), Month(2010, 12)).collect()
