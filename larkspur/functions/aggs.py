"""Aggregates with their own rules for nulls, NaN and overflow.

`nans="skip"` leaves NaN out, `nans="include"` lets one NaN decide the result.
All are compositions of built-in aggregates, so they have partial sums.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)


def _numbers(x: Column, kind: T.DataType, nans: str) -> tuple[Column, Column | None]:
    """x without NaN, and whether a NaN decides."""
    if not isinstance(kind, _FLOATS):
        return x, None
    return F.when(~F.isnan(x), x), (F.coalesce(F.bool_or(F.isnan(x)), F.lit(False)) if nans == "include" else None)


def _poisoned(out: Column, nan: Column | None) -> Column:
    return out if nan is None else F.when(nan, F.lit(float("nan"))).otherwise(out)


def sum_(x: Column, kind: T.DataType, nans: str = "skip") -> Column:
    """0 without values; null on overflow; whole numbers and booleans give a long."""
    x, nan = _numbers(x, kind, nans)
    if isinstance(kind, T.BooleanType):
        x = x.cast("long")
    if isinstance(kind, T.DecimalType):
        zero = F.lit(0).cast(T.DecimalType(min(38, kind.precision + 10), kind.scale))
    else:
        x = x.cast("double" if isinstance(kind, _FLOATS) else "long")
        zero = F.lit(0.0 if isinstance(kind, _FLOATS) else 0)
    return _poisoned(F.when(F.count(x) == 0, zero).otherwise(F.try_sum(x)), nan)


def count(x: Column, kind: T.DataType, nans: str = "skip") -> Column:
    """Values that aren't null; with "skip", NaN isn't counted either."""
    return F.count(_numbers(x, kind, nans)[0] if nans == "skip" else x)


def mean(x: Column, kind: T.DataType, nans: str = "skip") -> Column:
    """NaN without values; null if the sum overflows."""
    n = count(x, kind, "skip")
    x, nan = _numbers(x, kind, nans)
    total = F.try_sum(x.cast("double" if isinstance(kind, _FLOATS) else "long")).cast("double")
    return _poisoned(F.when(n == 0, F.lit(float("nan"))).otherwise(total / F.when(n == 0, 1).otherwise(n)), nan)


def min_(x: Column, kind: T.DataType, nans: str = "skip") -> Column:
    x, nan = _numbers(x, kind, nans)
    return _poisoned(F.min(x), nan)


def max_(x: Column, kind: T.DataType, nans: str = "skip") -> Column:
    x, nan = _numbers(x, kind, nans)
    return _poisoned(F.max(x), nan)


def min_max(x: Column, kind: T.DataType, nans: str = "skip") -> Column:
    """struct(min, max); null without values."""
    both = F.struct(min_(x, kind, nans).alias("min"), max_(x, kind, nans).alias("max"))
    return F.when(F.count(x) > 0, both)


def first(x: Column, order: Column) -> Column:
    """First value that isn't null, by an explicit order."""
    return F.min_by(x, F.when(x.isNotNull(), order))


def last(x: Column, order: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), order))


def null_count(x: Column) -> Column:
    return F.count_if(x.isNull())


def nan_count(x: Column) -> Column:
    return F.count_if(x.isNotNull() & F.isnan(x))


def all_null(x: Column) -> Column:
    return F.coalesce(F.bool_and(x.isNull()), F.lit(True))


def all_non_null(x: Column) -> Column:
    return F.coalesce(F.bool_and(x.isNotNull()), F.lit(True))


def all_nan(x: Column) -> Column:
    return F.coalesce(F.bool_and(x.isNotNull() & F.isnan(x)), F.lit(True))


def all_non_nan(x: Column) -> Column:
    return F.coalesce(F.bool_and(~(x.isNotNull() & F.isnan(x))), F.lit(True))


def all_non_distinct(a: Column, b: Column) -> Column:
    """Whether two columns agree everywhere, nulls included."""
    return F.coalesce(F.bool_and(a.eqNullSafe(b)), F.lit(True))


def is_constant(x: Column) -> Column:
    """Of nothing false; of nulls only true; of nulls and values false."""
    nulls, n = F.count_if(x.isNull()), F.count(F.lit(1))
    return (n > 0) & ((nulls == n) | ((nulls == 0) & F.min(x).eqNullSafe(F.max(x))))


def bounded_min(x: Column, max_bytes: int) -> Column:
    """A lower bound of at most max_bytes bytes, cut between characters."""
    least = F.min(x)
    fits = F.filter(F.sequence(F.lit(max_bytes), F.lit(0), F.lit(-1)), lambda n: F.octet_length(F.left(least, n)) <= max_bytes)
    return F.left(least, F.element_at(fits, 1))


def successor(value: str | None, max_bytes: int) -> str | None:
    """The value if it fits, else a short string above all that begin as it
    does; None if there is none."""
    if value is None or len(value.encode()) <= max_bytes:
        return value
    head = value.encode()[:max_bytes].decode("utf-8", "ignore")
    while head:
        up = ord(head[-1]) + 1
        up = 0xE000 if 0xD800 <= up <= 0xDFFF else up
        if up <= 0x10FFFF and len((head[:-1] + chr(up)).encode()) <= max_bytes:
            return head[:-1] + chr(up)
        head = head[:-1]
    return None


def bounded_max(x: Column, max_bytes: int) -> Column:
    """An upper bound of at most max_bytes bytes, or null if there is none.
    Python sees one value of each group."""

    @F.pandas_udf("string")
    def up(values: pd.Series) -> pd.Series:
        return values.map(lambda v: successor(v, max_bytes))

    return up(F.max(x))


_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


def uncompressed_size(x: Column, kind: T.DataType) -> Column:
    """Bytes of the plain buffers: values and, where there are nulls, a bitmap."""
    n = F.count(F.lit(1))
    bitmap = F.when(F.count_if(x.isNull()) > 0, F.ceil(n / 8)).otherwise(0)
    if isinstance(kind, T.BooleanType):
        return (F.ceil(n / 8) + bitmap).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):  # views of 16 bytes, and what is too long for one
        long = F.coalesce(F.sum(F.when(F.octet_length(x) > 12, F.octet_length(x))), F.lit(0))
        return (16 * n + long + bitmap).cast("long")
    width = 16 if isinstance(kind, T.DecimalType) else _WIDTH[type(kind)]
    return (n * width + bitmap).cast("long")


def is_sorted(df: DataFrame, column: str, order: str, strict: bool = False, chunk: int = 1 << 16) -> DataFrame:
    """One row, is_sorted, for a column along a whole-number order: nulls come
    first, strict allows no equal neighbours. Neighbours are compared within
    chunks of the order, then the chunks' ends, so no task sorts all rows."""
    x, o = F.col(column), F.col(order)
    rows = df.select(x.alias("x"), o.alias("o"), F.floor(o / chunk).alias("chunk"))

    def bad(before: Column, has: Column, now: Column) -> Column:
        step = (before >= now) if strict else (before > now)
        null_step = now.isNull() & (before.isNotNull() | F.lit(strict))
        return has & (F.coalesce(step, F.lit(False)) | null_step)

    w = Window.partitionBy("chunk").orderBy("o")
    inner = rows.withColumn("bad", bad(F.lag("x").over(w), F.lag("o").over(w).isNotNull(), F.col("x")))
    ends = inner.groupBy("chunk").agg(F.bool_or("bad").alias("bad"), F.min(F.struct("o", "x")).alias("first"), F.max(F.struct("o", "x")).alias("last"))
    across = Window.orderBy("chunk")  # a row for each chunk
    joined = ends.withColumn("step", bad(F.lag("last.x").over(across), F.lag("chunk").over(across).isNotNull(), F.col("first.x")))
    return joined.agg((~F.coalesce(F.bool_or(F.col("bad") | F.col("step")), F.lit(False))).alias("is_sorted"))


def list_aggregate(x: Column, name: str, whole: bool = False) -> Column:
    """sum, count, min or max of each row's list, nulls left out. whole: the sum
    is one of whole numbers, and null on overflow."""
    held = F.filter(x, lambda v: v.isNotNull())
    if name == "count":
        return F.size(held)
    if name in ("min", "max"):
        return getattr(F, f"array_{name}")(held)
    if whole:
        return F.aggregate(held, F.lit(0).cast("long"), lambda s, v: F.try_add(s, v.cast("long")))
    return F.aggregate(held, F.lit(0.0), lambda s, v: s + v)
