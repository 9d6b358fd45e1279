"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"
from pagewell.plans.oracles import ORACLES  # noqa: E402
from pagewell.plans.queries import REGISTRY as QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{file}'")
    return con


def rows(table, columns):
    return sorted(repr(row) for row in zip(*[table[c].to_pylist() for c in columns]))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, database, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    want = database.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert sorted(want.column_names) == columns
    assert {c: str(got.schema.field(c).type) for c in columns} == {
        c: str(want.schema.field(c).type) for c in columns
    }
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
