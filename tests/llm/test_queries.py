"""Every query of the operators that SQL can express against its SQL, over whole tables."""

import os

import duckdb
import pytest

from pagewell.llm.oracles import ORACLES
from pagewell.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return con


def rows(table, columns):
    return sorted(repr(row) for row in zip(*[table[c].to_pylist() for c in columns]))


def test_all_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in REGISTRY) == list(range(1, 14))
    assert set(ORACLES) <= set(REGISTRY)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, database, name):
    got, want = REGISTRY[name](spark, SMALL).toArrow(), database.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert sorted(want.column_names) == columns
    assert {c: str(got.schema.field(c).type) for c in columns} == {
        c: str(want.schema.field(c).type) for c in columns
    }
    assert rows(got, columns) == rows(want, columns)
