"""Proofs are sound: a pruned scan returns what the plain one does."""

import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import exprs as E
from larkspur.plans import pruning
from larkspur.plans.scan import ScanRequest, Selection
from larkspur.sources import files

col = E.col
FILTERS = {
    "eq": (col("a") == 37, True),
    "gt": (col("a") > 90, True),
    "between": (E.between(col("a"), 20, 25), True),
    "and": ((col("a") < 30) & (col("b") > 0.0), True),
    "or": ((col("a") < 5) | (col("a") > 95), True),
    "not": (~(col("a") < 90), True),
    "null": (E.is_null(col("n")), True),
    "not null": (E.is_not_null(col("n")), True),
    "prefix": (E.like(col("s"), "k09%"), True),
    "exact": (E.like(col("s"), "k0042"), True),
    "in": (E.list_contains([3, 4, 77], col("a")), True),
    "nan": (col("f") > 1e9, False),
    "ilike": (E.like(col("s"), "K09%", ignore_case=True), False),
    "arithmetic": (col("a") + 1 == 5, False),
    "dynamic": (E.dynamic("ge", lambda: 88, col("a")), True),
}


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zones") / "t")
    rows = [(k, float(k % 7), None if k < 40 else k, f"k{k:04d}", math.nan if k % 10 == 3 else float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, "a int, b double, n int, s string, f double")
    df.coalesce(1).sortWithinPartitions("a").write.parquet(path)
    return path


@pytest.mark.parametrize("name", FILTERS)
def test_pruned_scan_equals_plain_scan(spark, path, name):
    e, prunes = FILTERS[name]
    df = spark.read.parquet(path)
    zones = pruning.zone_map(df, df.columns, 10)
    got = sorted(map(str, pruning.pruned(df, zones, e, 10).collect()))
    assert got == sorted(map(str, df.where(e.bind(df)).collect()))
    assert (pruning.keep(zones, e).count() < zones.count()) == prunes
    sure = pruning.all_true(zones, e)
    for r in sure.collect():
        inside = df.where((F.col("a") >= r.a__min) & (F.col("a") <= r.a__max))
        assert inside.where(~F.coalesce(e.bind(inside), F.lit(False))).count() == 0


def test_requests(spark, path):
    r = ScanRequest(filter=col("a") > 10, limit=5, ordered=True, projection=["a"])
    assert [x.a for x in r.run(spark, path).collect()] == [11, 12, 13, 14, 15]
    assert ScanRequest(selection=Selection((5, 6), exclude=True)).run(spark, path).count() == 98
    assert ScanRequest(row_range=(10, 20)).count(spark, path) == 10
    pushed = ScanRequest(filter=col("a") > 90, projection=["s"]).run(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,90)" in pushed and "ReadSchema: struct<a:int,s:string>" in pushed


def test_write_and_handles(spark, path, tmp_path):
    df = spark.read.parquet(path).withColumn("t", F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    out = str(tmp_path / "out")
    summary = files.write(df, out, ["months(t)", "bucket(4, a)"], zone_columns=["a"])
    assert summary.rows == 100 and spark.read.parquet(out + "_zones").count() >= 1
    assert {str(r[0])[:7] for r in spark.read.parquet(out).select("t_month").distinct().collect()} == {"2024-05"}
    data = files.Dataset(spark, path)
    assert data.count_rows() == 100 and data.filter(col("a") < 3).to_table(["a"]).num_rows == 3
    assert data.take([7, 7, 0]).column("a").to_pylist() == [7, 7, 0]
    assert len(data.get_fragments()) == 1 and sum(b.num_rows for b in data.to_batches(30)) == 100
    more = str(tmp_path / "evolved")
    spark.range(3).write.parquet(more)
    spark.range(2).withColumn("x", F.lit("y")).write.mode("append").parquet(more)
    assert files.read(spark, more, evolve=True).where("x is null").count() == 3
    found = files.with_provenance(spark.read.parquet(more))
    assert found.select("file_index", "file_row_number").distinct().count() == 5
