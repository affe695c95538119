"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from larkspur import queries as library

SF = "/root/testdata/sf0.001"
QUERIES, SQL = library.queries(), library.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([shown(r[c]) for c in columns] for r in df.collect())
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted([shown(r[names.index(c)]) for c in columns] for r in cursor.fetchall())
    assert got == want
