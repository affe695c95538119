"""Strictly typed expressions as an inspectable tree.

A tree is bound to a DataFrame, which gives it types, and becomes a Column; the
pruning rules read the same tree. Binary operations take operands of one type
(nullability aside); `coerce=True` at binding inserts casts to the least common
type instead.

Results differ from Spark's own operators where the typed semantics ask for it:
integer division stays integer and fails on zero, float division never fails,
list membership is never null because of a null element, a missing variant
path or failed variant cast is null, and cosine similarity with a zero vector
is 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geo, registry, rowkey, tensor


@dataclass(frozen=True, eq=False)
class Expr:
    """A node: operation, operands, options."""

    op: str
    args: tuple[Expr, ...] = ()
    opts: dict[str, Any] = field(default_factory=dict)

    def __repr__(self) -> str:
        if self.op == "col":
            return self.opts["name"]
        if self.op == "lit":
            return repr(self.opts["value"])
        return f"{self.op}({', '.join(map(repr, self.args))})"

    def bind(self, df: DataFrame, coerce: bool = False) -> Column:
        """The Column of this tree over df's columns."""
        return _Binder(df, coerce).column(self)

    def data_type(self, df: DataFrame, coerce: bool = False) -> T.DataType:
        return _Binder(df, coerce).type_of(self)

    def __add__(self, o):
        return binary("add", self, o)

    def __sub__(self, o):
        return binary("sub", self, o)

    def __mul__(self, o):
        return binary("mul", self, o)

    def __truediv__(self, o):
        return binary("div", self, o)

    def __eq__(self, o):
        return binary("eq", self, o)

    def __ne__(self, o):
        return binary("ne", self, o)

    def __lt__(self, o):
        return binary("lt", self, o)

    def __le__(self, o):
        return binary("le", self, o)

    def __gt__(self, o):
        return binary("gt", self, o)

    def __ge__(self, o):
        return binary("ge", self, o)

    def __and__(self, o):
        return binary("and", self, o)

    def __or__(self, o):
        return binary("or", self, o)

    def __invert__(self):
        return Expr("not", (self,))

    def __getitem__(self, name: str):
        return get_item(name, self)

    __hash__ = object.__hash__


def _expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else lit(x)


def root() -> Expr:
    """The whole row as a struct."""
    return Expr("root")


def lit(value: Any, dtype: T.DataType | str | None = None) -> Expr:
    return Expr("lit", (), {"value": value, "dtype": dtype})


def col(name: str) -> Expr:
    return Expr("col", (), {"name": name})


def row_idx() -> Expr:
    """Row number within its file."""
    return Expr("row_idx")


def row_count() -> Expr:
    """Rows of a zone or file; binds to a table of statistics."""
    return Expr("row_count")


def stat(name: str, which: str) -> Expr:
    """A statistic (min, max, nulls, nans) of a column in a zone or file; binds to a table of statistics."""
    return Expr("stat", (), {"name": name, "which": which})


def call(name: str, *args: Any) -> Expr:
    """A function that registry.register_scalar has made known."""
    return Expr("call", tuple(map(_expr, args)), {"name": name})


def binary(op: str, left: Any, right: Any) -> Expr:
    return Expr(op, (_expr(left), _expr(right)))


def and_collect(parts: list[Expr]) -> Expr:
    """Balanced conjunction; of nothing, true."""
    return _balanced("and", parts, True)


def or_collect(parts: list[Expr]) -> Expr:
    """Balanced disjunction; of nothing, false."""
    return _balanced("or", parts, False)


def _balanced(op: str, parts: list[Expr], empty: bool) -> Expr:
    if not parts:
        return lit(empty)
    while len(parts) > 1:
        parts = [binary(op, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def conjuncts(e: Expr) -> list[Expr]:
    """The terms of a tree of conjunctions."""
    return [x for a in e.args for x in conjuncts(a)] if e.op == "and" else [e]


def between(x: Any, low: Any, high: Any, low_strict: bool = False, high_strict: bool = False) -> Expr:
    return Expr("between", (_expr(x), _expr(low), _expr(high)), {"low_strict": low_strict, "high_strict": high_strict})


def is_null(x: Expr) -> Expr:
    return Expr("is_null", (x,))


def is_not_null(x: Expr) -> Expr:
    return Expr("is_not_null", (x,))


def get_item(name: str, x: Expr) -> Expr:
    return Expr("get_item", (x,), {"name": name})


def select(fields: list[str], x: Expr | None = None) -> Expr:
    """Some fields of a struct, in the order asked for."""
    return Expr("select", (x or root(),), {"fields": fields})


def select_exclude(fields: list[str], x: Expr | None = None) -> Expr:
    return Expr("select_exclude", (x or root(),), {"fields": fields})


def pack(names: list[str], values: list[Expr]) -> Expr:
    return Expr("pack", tuple(map(_expr, values)), {"names": names})


def merge(structs: list[Expr], duplicates: str = "rightmost") -> Expr:
    """Fields of several structs in one; duplicates: 'rightmost' or 'error'."""
    return Expr("merge", tuple(structs), {"duplicates": duplicates})


def case_when(branches: list[tuple[Expr, Any]], otherwise: Any = None) -> Expr:
    """First branch whose condition is true; a null condition isn't."""
    flat = [_expr(x) for pair in branches for x in pair]
    return Expr("case_when", (*flat, *(() if otherwise is None else (_expr(otherwise),))), {"n": len(branches)})


def fill_null(x: Expr, value: Any) -> Expr:
    if isinstance(value, Expr) and value.op != "lit":
        raise TypeError("fill_null takes a constant")
    return Expr("fill_null", (x, _expr(value)))


def mask(x: Expr, keep: Expr) -> Expr:
    """x where keep is true, else null."""
    return Expr("mask", (x, keep))


def zip_(condition: Expr, if_true: Any, if_false: Any) -> Expr:
    """Row-wise choice; a null condition takes if_false."""
    return Expr("zip", (condition, _expr(if_true), _expr(if_false)))


def cast(x: Expr, dtype: T.DataType | str) -> Expr:
    """Fails where the value can't be represented."""
    return Expr("cast", (x,), {"dtype": dtype})


def ext_storage(x: Expr) -> Expr:
    """Stored number of a date (days) or timestamp (microseconds)."""
    return Expr("ext_storage", (x,))


def like(x: Expr, pattern: Any, negated: bool = False, ignore_case: bool = False) -> Expr:
    return Expr("like", (x, _expr(pattern)), {"negated": negated, "ignore_case": ignore_case})


def _escaped(s: str) -> str:
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains(x: Expr, part: str) -> Expr:
    return like(x, f"%{_escaped(part)}%")


def prefix(x: Expr, part: str) -> Expr:
    return like(x, f"{_escaped(part)}%")


def suffix(x: Expr, part: str) -> Expr:
    return like(x, f"%{_escaped(part)}")


def byte_length(x: Expr) -> Expr:
    return Expr("byte_length", (x,))


def list_contains(values: Any, needle: Any) -> Expr:
    """Null for a null list or a null constant needle; else true or false,
    whatever nulls the list holds. A null needle in a column against a constant
    list is false."""
    return Expr("list_contains", (_expr(values), _expr(needle)))


def list_length(x: Expr) -> Expr:
    return Expr("list_length", (x,))


def list_sum(x: Expr) -> Expr:
    return Expr("list_sum", (x,))


def dynamic(op: str, value: Callable[[], Any], x: Expr, default: bool = True) -> Expr:
    """A comparison whose bound is read when the tree is bound; without a bound
    (None) it is `default`."""
    return Expr("dynamic", (x,), {"op": op, "value": value, "default": default})


def variant_get(x: Expr, path: str, dtype: str | None = None) -> Expr:
    return Expr("variant_get", (x,), {"path": path, "dtype": dtype})


def json_to_variant(x: Expr) -> Expr:
    """Fails on text that isn't JSON."""
    return Expr("json_to_variant", (x,))


def l2_norm(x: Expr) -> Expr:
    return Expr("l2_norm", (x,))


def inner_product(x: Expr, y: Any) -> Expr:
    return Expr("inner_product", (x, _expr(y)))


def cosine_similarity(x: Expr, y: Any) -> Expr:
    return Expr("cosine_similarity", (x, _expr(y)))


def l2_denorm(x: Expr, norm: Any) -> Expr:
    return Expr("l2_denorm", (x, _expr(norm)))


def geo_distance(x: Expr, y: Expr) -> Expr:
    return Expr("geo_distance", (x, y))


def row_encode(columns: list[Expr], descending: list[bool] | None = None, nulls_last: list[bool] | None = None) -> Expr:
    """Bytes that compare as the columns do."""
    n = len(columns)
    return Expr("row_encode", tuple(columns), {"descending": descending or [False] * n, "nulls_last": nulls_last or [False] * n})


def row_size(columns: list[Expr]) -> Expr:
    return Expr("row_size", tuple(columns))


COMPARE = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def least_supertype(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The least type that holds both, or None."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _INTS) and isinstance(b, _INTS):
        return max(a, b, key=lambda t: _INTS.index(type(t)))
    if isinstance(a, _FLOATS) and isinstance(b, _FLOATS):
        return T.DoubleType()
    if isinstance(a, (*_INTS, *_FLOATS)) and isinstance(b, (*_INTS, *_FLOATS)):
        whole = a if isinstance(a, _INTS) else b
        small = isinstance(whole, (T.ByteType, T.ShortType)) and T.FloatType() in (a, b)
        return T.FloatType() if small else T.DoubleType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        width = max(a.precision - a.scale, b.precision - b.scale) + scale
        return T.DecimalType(width, scale) if width <= 38 else None
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = least_supertype(a.elementType, b.elementType)
        return T.ArrayType(inner, a.containsNull or b.containsNull) if inner else None
    return None


class _Binder:
    def __init__(self, df: DataFrame, coerce: bool):
        self.df, self.coerce = df, coerce

    def type_of(self, e: Expr) -> T.DataType:
        return self._type(self.column(e))

    def _type(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema["x"].dataType

    def pair(self, e: Expr) -> tuple[Column, Column, T.DataType]:
        """Operands of one type."""
        a, b = (self.column(x) for x in e.args)
        ta, tb = self._type(a), self._type(b)
        for k, other in ((0, tb), (1, ta)):  # a bare Python constant takes the other side's type
            x = e.args[k]
            if x.op == "lit" and x.opts["dtype"] is None and _plain(x.opts["value"], other):
                a, b = (a.cast(other), b) if k == 0 else (a, b.cast(other))
                ta = tb = other
        if _bare(ta) == _bare(tb):
            return a, b, ta
        common = least_supertype(ta, tb) if self.coerce else None
        if common is None:
            raise TypeError(f"{e.op}: operands of types {ta.simpleString()} and {tb.simpleString()}")
        return a.cast(common), b.cast(common), common

    def fields(self, c: Column) -> list[str]:
        kind = self._type(c)
        if not isinstance(kind, T.StructType):
            raise TypeError(f"a struct is needed, not {kind.simpleString()}")
        return kind.names

    def column(self, e: Expr) -> Column:
        method = getattr(self, f"_{e.op}", None)
        if method:
            return method(e)
        if e.op in COMPARE:
            a, b, _ = self.pair(e)
            return getattr(a, COMPARE[e.op])(b)
        return getattr(self, f"_on_{e.op}")(e, *(self.column(a) for a in e.args))

    def _root(self, e):
        return F.struct(*(F.col(f"`{c}`") for c in self.df.columns))

    def _lit(self, e):
        c = F.lit(e.opts["value"])
        return c if e.opts["dtype"] is None else c.cast(e.opts["dtype"])

    def _col(self, e):
        return F.col(e.opts["name"])

    def _row_count(self, e):
        return F.col("row_count")

    def _stat(self, e):
        return F.col(f"{e.opts['name']}__{e.opts['which']}")

    def _call(self, e):
        made = registry.scalar(e.opts["name"])
        args = [self.column(a) for a in e.args]
        if made.accepts is not None:
            made.accepts([self._type(a) for a in args])
        return made.build(*args)

    def _row_idx(self, e):
        return F.col("_metadata.row_index")

    def _arithmetic(self, e, name):
        a, b, kind = self.pair(e)
        if isinstance(kind, T.DecimalType) or not isinstance(kind, T.NumericType):
            raise TypeError(f"{e.op} isn't defined for {kind.simpleString()}")
        return getattr(a, name)(b)

    def _add(self, e):
        return self._arithmetic(e, "__add__")

    def _sub(self, e):
        return self._arithmetic(e, "__sub__")

    def _mul(self, e):
        return self._arithmetic(e, "__mul__")

    def _div(self, e):
        a, b, kind = self.pair(e)
        if isinstance(kind, _INTS):
            # div gives a long; the least number by -1 doesn't fit and fails in the cast
            return F.call_function("div", a, b).cast(kind)
        if not isinstance(kind, _FLOATS):
            raise TypeError(f"div isn't defined for {kind.simpleString()}")
        signed = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when((a > 0) == (F.signum(F.lit(1.0) / F.when(b == 0, F.lit(1.0)).otherwise(b)) > 0), float("inf")).otherwise(float("-inf"))
        return F.when(b == 0, F.when(a.isNull(), F.lit(None)).otherwise(signed)).otherwise(F.try_divide(a, b)).cast(kind)

    def _and(self, e):
        return self.column(e.args[0]) & self.column(e.args[1])

    def _or(self, e):
        return self.column(e.args[0]) | self.column(e.args[1])

    def _between(self, e):
        x, low, high = e.args
        above = binary("gt" if e.opts["low_strict"] else "ge", x, low)
        below = binary("lt" if e.opts["high_strict"] else "le", x, high)
        return self.column(above) & self.column(below)

    def _dynamic(self, e):
        value = e.opts["value"]()
        return F.lit(e.opts["default"]) if value is None else self.column(binary(e.opts["op"], e.args[0], value))

    def _on_not(self, e, x):
        return ~x

    def _on_is_null(self, e, x):
        return x.isNull()

    def _on_is_not_null(self, e, x):
        return x.isNotNull()

    def _on_get_item(self, e, x):
        return x.getField(e.opts["name"])

    def _select(self, e):
        x = self.column(e.args[0])
        missing = set(e.opts["fields"]) - set(self.fields(x))
        if missing:
            raise KeyError(f"no such fields: {sorted(missing)}")
        return _keep_null(x, F.struct(*(x.getField(n).alias(n) for n in e.opts["fields"])))

    def _select_exclude(self, e):
        x = self.column(e.args[0])
        return _keep_null(x, F.struct(*(x.getField(n).alias(n) for n in self.fields(x) if n not in e.opts["fields"])))

    def _on_pack(self, e, *xs):
        return F.struct(*(x.alias(n) for x, n in zip(xs, e.opts["names"], strict=True)))

    def _on_merge(self, e, *xs):
        found: dict[str, Column] = {}
        for x in xs:
            for n in self.fields(x):
                if n in found and e.opts["duplicates"] == "error":
                    raise ValueError(f"merge: field {n} occurs twice")
                found[n] = x.getField(n)
        return F.struct(*(c.alias(n) for n, c in found.items()))

    def _on_case_when(self, e, *xs):
        n = e.opts["n"]
        out = reduce(lambda c, k: c.when(xs[2 * k], xs[2 * k + 1]), range(1, n), F.when(xs[0], xs[1]))
        return out.otherwise(xs[2 * n]) if len(xs) > 2 * n else out

    def _on_fill_null(self, e, x, value):
        return F.coalesce(x, value.cast(self._type(x)))

    def _on_mask(self, e, x, keep):
        return F.when(keep, x)

    def _on_zip(self, e, condition, a, b):
        return F.when(condition, a).otherwise(b)

    def _on_cast(self, e, x):
        return x.cast(e.opts["dtype"])

    def _on_ext_storage(self, e, x):
        kind = self._type(x)
        if isinstance(kind, T.DateType):
            return F.unix_date(x)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(x.cast("timestamp"))
        return x

    def _on_like(self, e, x, pattern):
        literal = e.args[1].op == "lit"
        if literal:
            name = "ilike" if e.opts["ignore_case"] else "like"
            out = getattr(x, name)(e.args[1].opts["value"])
        else:
            out = (F.ilike if e.opts["ignore_case"] else F.like)(x, pattern)
        return ~out if e.opts["negated"] else out

    def _on_byte_length(self, e, x):
        return F.octet_length(x).cast("long")

    def _on_list_contains(self, e, values, needle):
        constant_list, constant_needle = e.args[0].op == "lit", e.args[1].op == "lit"
        if constant_list:
            held = [v for v in e.args[0].opts["value"] if v is not None] if e.args[0].opts["value"] is not None else None
            if held is None or constant_needle and e.args[1].opts["value"] is None:
                return F.lit(None).cast("boolean")
            # never null, and a form that reaches the scan
            return needle.isNotNull() & needle.isin(held) if held else F.lit(False)
        element = self._type(values).elementType
        found = F.coalesce(F.array_contains(F.filter(values, lambda v: v.isNotNull()), needle.cast(element)), F.lit(False))
        return F.when(values.isNull() | needle.isNull(), F.lit(None)).otherwise(found)

    def _on_list_length(self, e, x):
        return F.array_size(x).cast("long")

    def _on_list_sum(self, e, x):
        kind = self._type(x).elementType
        zero = F.lit(0).cast("double" if isinstance(kind, _FLOATS) else "bigint")
        return F.aggregate(x, zero, lambda s, v: s + F.coalesce(v.cast(self._type(zero)), zero))

    def _on_variant_get(self, e, x):
        path = e.opts["path"]
        return F.try_variant_get(x, path if path.startswith("$") else f"$.{path}", e.opts["dtype"] or "variant")

    def _on_json_to_variant(self, e, x):
        return F.parse_json(x)

    def _on_l2_norm(self, e, x):
        return tensor.l2_norm(x, self._type(x).elementType)

    def _on_inner_product(self, e, x, y):
        return tensor.inner_product(x, y, self._type(x).elementType)

    def _on_cosine_similarity(self, e, x, y):
        return tensor.cosine_similarity(x, y, self._type(x).elementType)

    def _on_l2_denorm(self, e, x, norm):
        return tensor.l2_denorm(x, norm, self._type(x).elementType)

    def _on_geo_distance(self, e, x, y):
        return geo.distance(x, y)

    def _on_row_encode(self, e, *xs):
        return rowkey.encode(list(xs), [self._type(x) for x in xs], e.opts["descending"], e.opts["nulls_last"])

    def _on_row_size(self, e, *xs):
        n = len(xs)
        return F.octet_length(rowkey.encode(list(xs), [self._type(x) for x in xs], [False] * n, [False] * n)).cast("long")


def _keep_null(x: Column, made: Column) -> Column:
    return F.when(x.isNotNull(), made)


def _bare(t: T.DataType) -> str:
    return t.simpleString()


def _plain(value: Any, kind: T.DataType) -> bool:
    """Whether a Python constant stands for a value of a type without loss."""
    if value is None:
        return True
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, (*_INTS, *_FLOATS))
    if isinstance(value, float):
        return isinstance(kind, _FLOATS)
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and hasattr(value, "year")
