"""Row keys: bytes that compare as tuples of columns do.

A column begins with a byte for null or value. Numbers follow in big-endian
order with the sign bit turned (floats: all bits of negative ones, in total
order), strings and bytes escaped and ended, structs field by field. Descending
columns have the bits of their values inverted. All of it is built-in
expressions, so keys are made inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hex(c: Column, digits: int) -> Column:
    return F.right(F.lpad(F.hex(c), 16, "0"), F.lit(digits))


def _integer(c: Column, width: int) -> Column:
    long = c.cast("long")
    turned = long.bitwiseXOR(F.lit(-(2**63))) if width == 8 else long + (1 << (8 * width - 1))
    return _hex(turned, 2 * width)


def _value(c: Column, kind: T.DataType) -> Column:
    """Hex digits of a value that isn't null."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "01").otherwise("00")
    for t, width in ((T.ByteType, 1), (T.ShortType, 2), (T.IntegerType, 4), (T.LongType, 8)):
        if isinstance(kind, t):
            return _integer(c, width)
    if isinstance(kind, T.DateType):
        return _integer(F.unix_date(c), 4)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _integer(F.unix_micros(c.cast("timestamp")), 8)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        bits = _bits(c.cast("double"))
        # negative: all bits turned; else the sign bit
        return F.when(bits < 0, _hex(F.bitwise_not(bits), 16)).otherwise(_hex(bits.bitwiseOR(F.lit(-(2**63))), 16))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return _integer((c * F.lit(10**kind.scale).cast(f"decimal({kind.scale + 1},0)")).cast("decimal(38,0)").cast("long"), 8)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # 00 becomes 00ff, and 0000 ends the value: a prefix sorts before what goes on
        text = F.regexp_replace(F.regexp_replace(F.hex(c), "(..)", "$1 "), "00 ", "00FF ")
        return F.concat(F.regexp_replace(text, " ", ""), F.lit("0000"))
    if isinstance(kind, T.StructType):
        return F.concat(*(_column(c.getField(f.name), f.dataType, False, False) for f in kind))
    raise TypeError(f"no order is defined for {kind.simpleString()}")


def _bits(x: Column) -> Column:
    """The IEEE bits of a double, by arithmetic: exponent and fraction."""
    size = F.abs(x)
    exponent = F.floor(F.log2(size))
    exponent = exponent + F.when(F.pow(F.lit(2.0), exponent) > size, -1).when(F.pow(F.lit(2.0), exponent + 1) <= size, 1).otherwise(0)
    exponent = F.greatest(exponent, F.lit(-1022))
    scaled = size * F.pow(F.lit(2.0), F.floor((52 - exponent) / 2)) * F.pow(F.lit(2.0), (52 - exponent) - F.floor((52 - exponent) / 2))
    whole = scaled.cast("long")  # below 2**53
    normal = F.shiftleft((exponent + 1022).cast("long"), 52) + whole
    bits = F.when(size == 0, F.lit(0).cast("long")).when(whole < F.lit(2**52), whole).otherwise(normal)
    bits = F.when(F.isnan(x), F.lit(0x7FF8 << 48)).when(size == float("inf"), F.lit(0x7FF0 << 48)).otherwise(bits)
    negative = (x < 0) | ((x == 0) & (F.atan2(x, F.lit(-1.0)) < 0))
    return F.when(negative & ~F.isnan(x), bits.bitwiseOR(F.lit(-(2**63)))).otherwise(bits)


_FLIP = ("0123456789ABCDEF", "FEDCBA9876543210")


def _column(c: Column, kind: T.DataType, descending: bool, nulls_last: bool) -> Column:
    value = _value(c, kind)
    if descending:
        value = F.translate(value, *_FLIP)
    return F.when(c.isNull(), "02" if nulls_last else "00").otherwise(F.concat(F.lit("01"), value))


def encode(columns: list[Column], kinds: list[T.DataType], descending: list[bool], nulls_last: list[bool]) -> Column:
    parts = [_column(c, k, d, n) for c, k, d, n in zip(columns, kinds, descending, nulls_last, strict=True)]
    return F.unhex(F.concat(*parts))
