import datetime as dt

import pytest

from drayage.session import local_session, scratch_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "8", shuffle_partitions=4)


@pytest.fixture
def folder(spark):
    return scratch_dir(spark, "test")


@pytest.fixture
def sf():
    return SF


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def plan(df) -> str:
    """Physical plan with whole filter and column lists."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return df._jdf.queryExecution().executedPlan().toString()
