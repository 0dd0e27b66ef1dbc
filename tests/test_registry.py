"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from drayage import queries as registry
from drayage.queries.inputs import TABLES

from .conftest import SF

registry.load_all()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
    "decimal(15,2)": "DECIMAL(15,2)",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    described = {r[0]: r[1] for r in duck.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert columns == sorted(described)
    types = dict(got.dtypes)
    assert {c: TYPES.get(types[c], types[c]) for c in columns} == described
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    have = [tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_all_are_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    parity = __spark_entry__.entry(spark)
    assert {r["table"]: r["match"] for r in parity.collect()} == {"orders": True, "lineitem": True}
