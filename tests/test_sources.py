"""Data sets, scans with zone maps, push-down into the scan, the command line, and what a user may register."""

import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur import cli
from larkspur.functions import exprs as E
from larkspur.functions import registry
from larkspur.plans import pruning
from larkspur.plans.scan import RepeatedScan, ScanRequest
from larkspur.sources import files

SF = "/root/testdata/sf0.001"
col = E.col


@pytest.fixture(scope="module")
def sorted_lines(spark, tmp_path_factory):
    """lineitem in eight files by ranges of the order key, with a zone map."""
    path = f"{tmp_path_factory.mktemp('set')}/lines"
    df = spark.read.parquet(f"{SF}/lineitem.parquet").repartitionByRange(8, "l_orderkey").sortWithinPartitions("l_orderkey")
    summary = files.write(df, path, zone_columns=["l_orderkey", "l_quantity"])
    assert (summary.rows, summary.files) == (df.count(), 8)
    return path


def test_zone_maps_leave_files_out(spark, sorted_lines):
    wanted = E.between(col("l_orderkey"), 100, 180) & (col("l_quantity") >= 10.0)
    plain = ScanRequest(filter=wanted)
    with_zones = plain.with_(zones=f"{sorted_lines}_zones")
    rows = lambda r: sorted(tuple(x) for x in r.run(spark, sorted_lines).collect())
    assert rows(plain) == rows(with_zones) != []
    assert len(with_zones.run(spark, sorted_lines).inputFiles()) < len(plain.run(spark, sorted_lines).inputFiles()) == 8
    assert plain.with_(filter=col("l_orderkey") > 10**9, zones=f"{sorted_lines}_zones").run(spark, sorted_lines).count() == 0
    # row numbers count all files
    ranged = with_zones.with_(row_range=(0, 500))
    assert rows(ranged) == rows(plain.with_(row_range=(0, 500)))
    data = files.Dataset(spark, sorted_lines)
    assert data.can_prune(col("l_orderkey") > 10**9, f"{sorted_lines}_zones") and not data.can_prune(wanted, f"{sorted_lines}_zones")


def test_splits_and_ranges_of_files_give_all_rows(spark, sorted_lines):
    request = ScanRequest(projection=["l_orderkey", "l_linenumber"], filter=col("l_quantity") > 25.0)
    every = sorted(map(tuple, request.run(spark, sorted_lines).collect()))
    parts = request.splits(spark, sorted_lines)
    assert len(parts) == 8
    assert sorted(tuple(r) for p in parts for r in p.run(spark, sorted_lines).collect()) == every
    halves = [request.with_(partition_range=r) for r in ((0, 3), (3, 8))]
    assert sorted(tuple(r) for h in halves for r in h.run(spark, sorted_lines).collect()) == every
    assert request.with_(partition_range=(8, 9)).run(spark, sorted_lines).count() == 0
    with pytest.raises(ValueError):
        request.with_(row_range=(0, 3)).splits(spark, sorted_lines)


def test_repeated_scans(spark):
    scan = RepeatedScan(ScanRequest(projection=["n_name"], filter=col("n_nationkey") > 3, row_range=(2, 20)), spark, (f"{SF}/nation.parquet",))
    assert scan.execute((0, 6)).count() == 2 and scan.execute().count() == 16
    assert scan.scalar_at(3) is None and scan.scalar_at(4).n_name


def test_limit_before_the_filter(spark):
    request = ScanRequest(projection=["n_nationkey"], filter=col("n_nationkey") >= 0, limit_first=7)
    assert request.run(spark, f"{SF}/nation.parquet").count() == 7
    assert request.with_(filter=col("n_nationkey") < 0).run(spark, f"{SF}/nation.parquet").count() == 0


def test_taking_rows_keeps_the_filter(spark):
    data = files.Dataset(spark, f"{SF}/nation.parquet", filter=col("n_nationkey") > 10)
    assert data.take([0, 12, 11, 1]).column("n_nationkey").to_pylist() == [12, 11]
    assert files.Dataset(spark, f"{SF}/nation.parquet").take([3, 3]).num_rows == 2


def test_batches_have_the_schema_even_where_all_is_null(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") > 90, "x").alias("s"), F.lit(None).cast("double").alias("d"))
    summary = files.write(df.repartition(3), f"{tmp_path}/d")
    assert summary.rows == 100
    batches = list(files.Dataset(spark, f"{tmp_path}/d").to_batches(7))
    assert len({b.schema for b in batches}) == 1 and all(b.num_rows <= 7 for b in batches)
    assert pa.types.is_floating(batches[0].schema.field("d").type)
    assert sorted(x for b in batches for x in b.column("id").to_pylist()) == list(range(100))


def test_writes_in_parts_append_and_truncate(spark, tmp_path):
    df = spark.createDataFrame([(k, datetime.datetime(2024, 1 + k % 3, 5)) for k in range(30)], "k long, t timestamp_ntz")
    first = files.write(df, f"{tmp_path}/p", partition_by=["months(t)", "bucket(2, k)"])
    assert first.rows == 30
    again = files.write(df.limit(4), f"{tmp_path}/p", partition_by=["months(t)", "bucket(2, k)"], mode="append")
    assert again.rows == 4 and spark.read.parquet(f"{tmp_path}/p").count() == 34
    assert spark.read.parquet(f"{tmp_path}/p").where("t_month = '2024-02'").where("month(t) <> 2").isEmpty()
    files.truncate(spark, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 0


@pytest.mark.parametrize(
    "wanted,pushed",
    [
        (E.list_contains(["F", "P"], col("o_orderstatus")), "In(o_orderstatus"),
        (E.between(col("o_orderkey"), 5, 9), "GreaterThanOrEqual(o_orderkey,5), LessThanOrEqual(o_orderkey,9)"),
        (E.like(col("o_orderpriority"), "1-%"), "StringStartsWith(o_orderpriority,1-)"),
        (~(col("o_orderkey") == 5), "Not(EqualTo(o_orderkey,5))"),
        ((col("o_orderkey") == 5) | (col("o_custkey") == 7), "Or(EqualTo(o_orderkey,5),EqualTo(o_custkey,7))"),
        (E.is_null(col("o_orderkey")), "IsNull(o_orderkey)"),
    ],
)
def test_filters_reach_the_scan(spark, wanted, pushed):
    df = ScanRequest(projection=["o_custkey"], filter=wanted).run(spark, f"{SF}/orders.parquet")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    line = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert pushed in line or all(p in line for p in pushed.split(", ")), line
    read = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "o_totalprice" not in read


def test_fields_of_structs_are_pruned_and_pushed(spark, tmp_path):
    spark.range(50).select(F.struct(F.col("id").alias("a"), F.col("id").cast("string").alias("b")).alias("s")).write.parquet(f"{tmp_path}/s")
    df = ScanRequest(projection={"a": col("s")["a"]}, filter=col("s")["a"] > 40).run(spark, f"{tmp_path}/s")
    plan = df._jdf.queryExecution().toString()
    assert df.count() == 9 and "GreaterThan(s.a,40)" in plan and "b:string" not in plan.split("ReadSchema")[-1]


def test_no_proof_for_floats_without_a_count_of_nan(spark):
    stats = spark.createDataFrame([(10, 1.0, 3.0, 0)], "row_count long, x__min double, x__max double, x__nulls long")
    assert pruning.keep(stats, col("x") > 5.0).count() == 1
    assert pruning.keep(stats.withColumn("x__nans", F.lit(0)), col("x") > 5.0).count() == 0
    assert pruning.keep(stats.withColumn("x__nans", F.lit(1)), col("x") > 5.0).count() == 1


def test_bounds_of_long_strings_are_short_and_right(spark, tmp_path):
    spark.createDataFrame([("a" * 100,), ("b" * 100,)], "s string").coalesce(1).write.parquet(f"{tmp_path}/s")
    stats = pruning.file_stats(spark.read.parquet(f"{tmp_path}/s"), ["s"]).cache()
    row = stats.first()
    assert len(row["s__max"]) <= 64 and row["s__max"] > "b" * 100 and row["s__min"] == "a" * 64
    assert pruning.keep(stats, col("s") == "b" * 100).count() == 1 and pruning.keep(stats, col("s") > "c").count() == 0


def test_registered_functions_check_types_and_rules_prune(spark):
    def numbers(kinds):
        if any(k.typeName() == "string" for k in kinds):
            raise TypeError("numbers only")

    registry.register_scalar("over", lambda x, y: x > y, numbers)
    df = spark.createDataFrame([(1, "a"), (9, "b")], "x long, s string")
    assert df.where(E.call("over", col("x"), 5).bind(df)).count() == 1
    with pytest.raises(TypeError):
        E.call("over", col("s"), 5).bind(df)
    with pytest.raises(KeyError):
        E.call("unknown", col("x")).bind(df)
    stats = spark.createDataFrame([(0, 4, 5), (3, 9, 5)], "x__min long, x__max long, row_count long")
    assert pruning.keep(stats, E.call("over", col("x"), 5)).count() == 2
    registry.register_rule("over", lambda e, stat: stat(e.args[0], "max") <= stat(e.args[1], "min"))
    assert pruning.keep(stats, E.call("over", col("x"), 5)).count() == 1


def test_command_line(spark, tmp_path, capsys):
    cli.main(["query", f"{SF}/nation.parquet", "SELECT count(*) AS n FROM data"])
    assert "25" in capsys.readouterr().out
    cli.main(["tree", f"{SF}/nation.parquet"])
    cli.main(["inspect", f"{SF}/nation.parquet"])
    cli.main(["segments", f"{SF}/nation.parquet"])
    spark.range(5).write.option("header", True).csv(f"{tmp_path}/x.csv")
    cli.main(["convert", f"{tmp_path}/x.csv", f"{tmp_path}/x"])
    assert spark.read.parquet(f"{tmp_path}/x").count() == 5
