"""Every registered query against its SQL twin on whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from triflux.plans.oracles import ORACLES
from triflux.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
TABLES = ("lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).first()["triangles"] > 0


def _key(row):
    return tuple((value is None, value) for value in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    spark_types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    assert {c: spark_types[t] for c, t in got.dtypes} == types
    got_rows = [tuple(row) for row in got.select(columns).collect()]
    want_rows = want.select(*columns).fetchall()
    assert sorted(got_rows, key=_key) == sorted(want_rows, key=_key)
