"""Joins by place and number, and the first rows of a key, against DuckDB on rows that the given tables don't have."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspur import queries as library
from larkspur.operators import places

QUERIES, SQL = library.queries(), library.oracle_sql()
TYPES = {"custkey": pa.int64(), "suppkey": pa.int64(), "orderkey": pa.int64(), "nationkey": pa.int32(), "acctbal": pa.float64(), "totalprice": pa.float64()}


def stored(path, **tables):
    """Writes a table (columns, rows) each; returns their folder."""
    for name, (columns, rows) in tables.items():
        pq.write_table(pa.table({c: pa.array([r[i] for r in rows], TYPES[c[2:]]) for i, c in enumerate(columns)}), f"{path}/{name}.parquet")
    return str(path)


def same(spark, path, query, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    shown = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert shown(QUERIES[query](spark, path).collect()) == shown(con.execute(SQL[query]).fetchall())


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Nulls, NaN, infinities, repeated keys, zeros, numbers that rounding makes equally far."""
    draw = random.Random(5)
    numbers = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.3, 0.1 + 0.2, 1e300, -1e18, 1e17, 5e-324, 150.0, 150.00000000000003, -64.0, 64.0]
    rows = lambda n: [(draw.choice([None, *range(n)]), draw.choice([None, 0, 0, 0, 1, 2]), draw.choice([*numbers, round(draw.uniform(-500, 500), 1)])) for _ in range(n)]
    customers, suppliers = rows(200), [r for r in rows(120) if r[1] != 2]
    return stored(tmp_path_factory.mktemp("odd"), customer=(["c_custkey", "c_nationkey", "c_acctbal"], customers), supplier=(["s_suppkey", "s_nationkey", "s_acctbal"], suppliers))


@pytest.mark.parametrize("chunk", [7, places.CHUNK])
def test_nearest_of_odd_rows(spark, odd, monkeypatch, chunk):
    monkeypatch.setattr(places, "CHUNK", chunk)
    same(spark, odd, "spatial_nearest", "customer", "supplier")


def test_lateral_top_keeps_its_order(spark, tmp_path):
    """Of 3000 orders a customer the two dearest, ties by key; nulls last."""
    draw = random.Random(6)
    orders = [(k, k % 8, float(draw.randint(0, 400))) for k in range(24000)] + [(None, 8, 9.0), (1, 8, 9.0), (2, 8, 9.0), (3, 8, None), (4, 9, None), (5, 9, float("nan")), (6, None, 1.0)]
    draw.shuffle(orders)
    path = stored(tmp_path, customer=(["c_custkey"], [(k,) for k in [*range(10), 3, None]]), orders=(["o_orderkey", "o_custkey", "o_totalprice"], orders))
    same(spark, path, "lateral_topk", "customer", "orders")


@pytest.mark.parametrize("block", [3, places.BLOCK])
def test_within_of_odd_rows(spark, odd, monkeypatch, block):
    monkeypatch.setattr(places, "BLOCK", block)
    same(spark, odd, "spatial_join_within", "customer", "supplier")


def test_within_is_dealt_by_cells_and_blocks(spark, tmp_path, monkeypatch):
    """Rows of one nation, and of one number, are compared in many tasks."""
    monkeypatch.setattr(places, "BLOCK", 50)
    monkeypatch.setattr(places, "PAIRS", 5000)
    customers, suppliers = [(k, 7, 10.0 if k % 2 else k * 3.0) for k in range(600)], [(k, 7, 10.0 if k % 2 else k * 9.0) for k in range(200)]
    path = stored(tmp_path, customer=(["c_custkey", "c_nationkey", "c_acctbal"], customers), supplier=(["s_suppkey", "s_nationkey", "s_acctbal"], suppliers))
    same(spark, path, "spatial_join_within", "customer", "supplier")
    rows = QUERIES["spatial_join_within"](spark, path).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 5
    assert max(r["count"] for r in rows) < sum(r["count"] for r in rows) / 3
