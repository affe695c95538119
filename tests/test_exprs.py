"""Semantics that differ from Spark's own operators."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import aggs, geo
from larkspur.functions import exprs as E
from larkspur.operators import positional

col = E.col


def values(df, e, coerce=False):
    return [r[0] for r in df.select(e.bind(df, coerce).alias("x")).collect()]


def test_integer_division_stays_integer_and_fails_on_zero(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (None, 3)], "a int, b int")
    assert values(df, col("a") / col("b")) == [3, -3, None]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        values(spark.createDataFrame([(1, 0)], "a int, b int"), col("a") / col("b"))


def test_overflow_is_an_error(spark):
    df = spark.createDataFrame([(2**63 - 1,)], "a long")
    with pytest.raises(Exception, match="OVERFLOW"):
        values(df, col("a") + 1)


def test_float_division_never_fails(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (3.0, 2.0)], "a double, b double")
    got = values(df, col("a") / col("b"))
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] is None and got[4] == 1.5


def test_operands_of_two_types_are_refused_unless_coerced(spark):
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    with pytest.raises(TypeError):
        values(df, col("a") + col("b"))
    assert values(df, col("a") + col("b"), coerce=True) == [3.5]
    assert E.least_supertype(T.IntegerType(), T.FloatType()) == T.DoubleType()


def test_list_contains_is_never_null_for_a_null_element(spark):
    df = spark.createDataFrame([([1, None],), ([],), (None,), ([2],)], "v array<int>")
    assert values(df, E.list_contains(col("v"), 2)) == [False, False, None, True]
    assert values(df, E.list_contains(col("v"), E.lit(None, "int"))) == [None] * 4
    needles = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert values(needles, E.list_contains([1, None], col("x"))) == [True, False, False]


def test_conditionals(spark):
    df = spark.createDataFrame([(None,), (True,), (False,)], "c boolean")
    assert values(df, E.case_when([(col("c"), 1)])) == [None, 1, None]
    assert values(df, E.zip_(col("c"), 1, 2)) == [2, 1, 2]
    assert values(df, E.mask(E.lit(5), col("c"))) == [None, 5, None]
    with pytest.raises(TypeError):
        E.fill_null(col("c"), col("c"))


def test_merge_takes_the_rightmost_or_refuses(spark):
    df = spark.range(1)
    a, b = E.pack(["x", "y"], [1, 2]), E.pack(["y", "z"], [3, 4])
    assert values(df, E.merge([a, b]))[0].asDict() == {"x": 1, "y": 3, "z": 4}
    with pytest.raises(ValueError):
        E.merge([a, b], "error").bind(df)


def test_variants(spark):
    df = spark.createDataFrame([('{"a":[1,2]}',), ('{"a":"x"}',), ("null",), (None,)], "j string")
    assert values(df, E.variant_get(E.json_to_variant(col("j")), "$.a[1]", "int")) == [2, None, None, None]
    with pytest.raises(Exception, match="MALFORMED"):
        values(spark.createDataFrame([("{",)], "j string"), E.variant_get(E.json_to_variant(col("j")), "a", "int"))


def test_strings(spark):
    df = spark.createDataFrame([("é%",), ("ab_c",), ("",)], "s string")
    assert values(df, E.byte_length(col("s"))) == [3, 4, 0]
    assert values(df, E.contains(col("s"), "%")) == [True, False, False]
    assert values(df, E.suffix(col("s"), "_c")) == [False, True, False]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert values(df, E.cosine_similarity(col("a"), col("b"))) == [0.0, 1.0]
    assert values(df, E.l2_norm(col("a"))) == [5.0, 1.0]
    with pytest.raises(Exception, match="different lengths"):
        values(df, E.inner_product(col("a"), E.lit([1.0])))


def test_row_keys_sort_as_tuples(spark):
    rows = [(1, "b", 1.5), (1, "a", -2.0), (None, "a", 0.0), (-5, "", math.inf), (1, "a\x00", -math.inf), (1, None, math.nan), (2**31 - 1, "é", -0.5), (1, "a", 2.0), (0, "zz", 1e-310), (0, "zz", 5e300)]
    df = spark.createDataFrame(rows, "i int, s string, d double")
    key = E.row_encode([col("i"), col("s"), col("d")]).bind(df)
    want = df.orderBy(F.asc_nulls_first("i"), F.asc_nulls_first("s"), F.asc_nulls_first("d")).collect()
    assert str(df.orderBy(key).collect()) == str(want)
    back = E.row_encode([col("i"), col("s")], [True, True], [True, True]).bind(df)
    want = [r[:2] for r in df.orderBy(F.desc_nulls_last("i"), F.desc_nulls_last("s")).select("i", "s").collect()]
    assert [r[:2] for r in df.orderBy(back).select("i", "s").collect()] == want
    sizes = df.select(E.row_size([col("i"), col("s")]).bind(df), F.octet_length(E.row_encode([col("i"), col("s")]).bind(df))).collect()
    assert all(a == b for a, b in sizes)


def test_aggregates_of_nulls_and_nan(spark):
    df = spark.createDataFrame([(math.nan, 1), (1.0, 2), (None, 3), (2.0, 4)], "x double, k int")
    x, d = F.col("x"), T.DoubleType()
    r = df.agg(aggs.sum_(x, d).alias("s"), aggs.count(x, d).alias("n"), aggs.mean(x, d).alias("m"), aggs.max_(x, d, "include").alias("p"), aggs.first(x, F.col("k")).alias("f"), aggs.nan_count(x).alias("nan"), aggs.min_max(x, d).alias("mm")).first()
    assert (r.s, r.n, r.m, r.nan, tuple(r.mm)) == (3.0, 2, 1.5, 1, (1.0, 2.0)) and math.isnan(r.p) and math.isnan(r.f)
    nulls = spark.createDataFrame([(None,)] * 3, "x double")
    r = nulls.agg(aggs.sum_(x, d).alias("s"), aggs.mean(x, d).alias("m"), aggs.is_constant(x).alias("c"), aggs.all_nan(x).alias("a")).first()
    assert r.s == 0.0 and math.isnan(r.m) and r.c and not r.a
    big = spark.createDataFrame([(2**63 - 1,), (1,)], "x long")
    assert big.agg(aggs.sum_(F.col("x"), T.LongType())).first()[0] is None


@pytest.mark.parametrize("xs,strict,want", [([1, 2, 3], True, True), ([1, 2, 2], True, False), ([1, 2, 2], False, True), ([None, None, 1], False, True), ([None, None, 1], True, False), ([1, None], False, False), ([], True, True), ([3, 1], False, False)])
def test_is_sorted(spark, xs, strict, want):
    df = spark.createDataFrame(list(enumerate(xs)), "k long, x int")
    assert aggs.is_sorted(df, "x", "k", strict, chunk=2).first()[0] is want


def test_bounded_bounds(spark):
    assert aggs.successor("abcd", 3) == "abd" and aggs.successor("ab", 3) == "ab" and aggs.successor("\U0010ffff" * 2, 4) is None
    df = spark.createDataFrame([("éé",), ("zebra",)], "x string")
    r = df.agg(aggs.bounded_min(F.col("x"), 3).alias("lo"), aggs.bounded_max(F.col("x"), 3).alias("hi")).first()
    assert r.lo == "zeb" and r.hi == "êé"[:1]


def test_positions(spark):
    df = spark.createDataFrame([(0, None), (1, 1), (2, 1), (3, 5)], "k long, x int")
    got = [r.x for r in positional.take(df, "k", [3, 0, None, 3]).orderBy("pos").collect()]
    assert got == [5, None, None, 5]
    assert tuple(positional.search_sorted(df, "x", 1, "left").first()) == (1, True)
    assert tuple(positional.search_sorted(df, "x", 1, "right").first()) == (3, True)


def test_geometry(spark):
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(square, (2.0, 2.0)), (square, (7.0, 8.0))], f"s array<array<{geo.POINT}>>, p {geo.POINT}")
    r = df.select(geo.within(F.col("p"), F.col("s")), geo.distance_to_polygon(F.col("p"), F.col("s")), geo.area(F.col("s"))).collect()
    assert [tuple(x) for x in r] == [(True, 0.0, 16.0), (False, 5.0, 16.0)]
    assert geo.hull([(0, 0), (1, 1), (2, 0), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert geo.decode_wkb(bytes.fromhex("0101000000000000000000f03f0000000000000040")) == ("point", [1.0, 2.0])
