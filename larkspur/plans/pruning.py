"""Zone maps, and proofs from them that a filter keeps nothing (or all) of a zone.

A proof is a Column over the statistics of a zone: true proves, anything else,
null included, proves nothing. Statistics of a column c are c__min, c__max,
c__nulls, c__nans (floats) and row_count; string bounds may be cut short, so
they are never taken for values.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggs, registry
from ..functions.exprs import COMPARE, Expr, binary

ZONE_ROWS, STRING_BYTES = 8192, 64
_ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def _stats(df: DataFrame, columns: list[str]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("row_count")]
    for c in columns:
        kind, x = df.schema[c].dataType, F.col(c)
        out.append(aggs.null_count(x).alias(f"{c}__nulls"))
        if isinstance(kind, T.StringType):
            out += [aggs.bounded_min(x, STRING_BYTES).alias(f"{c}__min"), aggs.bounded_max(x, STRING_BYTES).alias(f"{c}__max")]
        elif isinstance(kind, _ORDERED):
            out += [aggs.min_(x, kind).alias(f"{c}__min"), aggs.max_(x, kind).alias(f"{c}__max")]
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            out.append(aggs.nan_count(x).alias(f"{c}__nans"))
    return out


def zone_map(df: DataFrame, columns: list[str], rows: int = ZONE_ROWS) -> DataFrame:
    """Statistics of each run of `rows` rows of each file. df reads files."""
    zone = F.floor(F.col("_metadata.row_index") / rows).alias("zone")
    return df.select(*columns, F.col("_metadata.file_path").alias("file"), zone).groupBy("file", "zone").agg(*_stats(df, columns))


def file_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns, F.col("_metadata.file_path").alias("file")).groupBy("file").agg(*_stats(df, columns))


class _Prover:
    """stats: the type of the statistics' table."""

    def __init__(self, stats: T.StructType):
        self.known = set(stats.names)
        self.floats = {f.name.removesuffix("__max") for f in stats if f.name.endswith("__max") and isinstance(f.dataType, (T.FloatType, T.DoubleType))}

    def stat(self, e: Expr, which: str) -> Column | None:
        if e.op == "lit":
            value = e.opts["value"]
            return {"min": F.lit(value), "max": F.lit(value), "nulls": F.lit(int(value is None)), "nans": F.lit(int(value != value))}[which]
        name = f"{e.opts['name']}__{which}" if e.op == "col" else None
        return F.col(name) if name in self.known else None

    def no_nan(self, *sides: Expr) -> Column | None:
        """NaN sorts above all numbers and is in no bound: without a count of
        NaN there is no proof for floats."""
        if any(e.op == "col" and e.opts["name"] in self.floats and self.stat(e, "nans") is None for e in sides):
            return None
        tests = [self.stat(e, "nans") for e in sides if e.op == "lit" or f"{e.opts.get('name')}__nans" in self.known]
        return reduce(lambda a, b: a & b, [t == 0 for t in tests], F.lit(True))

    def falsify(self, e: Expr) -> Column | None:
        """Proof that e is true for no row."""
        if e.op == "and":
            return _any(self.falsify(a) for a in e.args)
        if e.op == "or":
            return _all([self.falsify(a) for a in e.args])
        if e.op == "not":
            return self.satisfy(e.args[0])
        if e.op in COMPARE:
            return self._false_comparison(e)
        if e.op == "between":
            x, low, high = e.args
            above = binary("gt" if e.opts["low_strict"] else "ge", x, low)
            below = binary("lt" if e.opts["high_strict"] else "le", x, high)
            return _any([self.falsify(above), self.falsify(below)])
        if e.op == "is_null":
            nulls = self.stat(e.args[0], "nulls")
            return None if nulls is None else nulls == 0
        if e.op == "is_not_null":
            nulls = self.stat(e.args[0], "nulls")
            return None if nulls is None else nulls == F.col("row_count")
        if e.op == "like":
            return self._false_like(e)
        if e.op == "list_contains" and e.args[0].op == "lit":
            held = [v for v in e.args[0].opts["value"] or [] if v is not None]
            if not held:
                return F.lit(True)
            return _all([self.falsify(binary("eq", e.args[1], v)) for v in held])
        if e.op == "dynamic":
            value = e.opts["value"]()
            return None if value is None else self.falsify(binary(e.opts["op"], e.args[0], value))
        if e.op == "lit" and e.opts["value"] is False:
            return F.lit(True)
        if e.op == "call" and (rule := registry.rule(e.opts["name"])):
            return rule(e, self.stat)
        return None

    def _false_comparison(self, e: Expr) -> Column | None:
        left, right = e.args
        llo, lhi, rlo, rhi = (self.stat(x, w) for x in (left, right) for w in ("min", "max"))
        if any(s is None for s in (llo, lhi, rlo, rhi)):
            return None
        proof = {
            "eq": (llo > rhi) | (rlo > lhi),
            "gt": lhi <= rlo,
            "ge": lhi < rlo,
            "lt": llo >= rhi,
            "le": llo > rhi,
        }.get(e.op)
        if e.op == "ne":
            # bounds of strings may be cut: only literals and numbers are one value if their bounds agree
            proof = (llo == lhi) & (rlo == rhi) & (llo == rlo)
        no_nan = self.no_nan(left, right)
        return None if no_nan is None else proof & no_nan

    def _false_like(self, e: Expr) -> Column | None:
        pattern = e.args[1].opts.get("value") if e.args[1].op == "lit" else None
        if pattern is None or e.opts["negated"] or e.opts["ignore_case"] or "\\" in pattern:
            return None
        head = re.match(r"[^%_]*", pattern)[0]
        if head == pattern:
            return self.falsify(binary("eq", e.args[0], pattern))
        low, high = self.stat(e.args[0], "min"), self.stat(e.args[0], "max")
        if not head or low is None or high is None:
            return None
        # nothing that begins with head lies between the bounds
        return (high < F.lit(head)) | ((low > F.lit(head)) & ~F.startswith(low, F.lit(head)))

    def satisfy(self, e: Expr) -> Column | None:
        """Proof that e is true for every row."""
        if e.op == "and":
            return _all([self.satisfy(a) for a in e.args])
        if e.op == "or":
            return _any(self.satisfy(a) for a in e.args)
        if e.op == "not":
            # false for all rows, not just true for none: there may be no null
            return None if not _columns(e) else _all([self.falsify(e.args[0]), *[self._no_null(c) for c in _columns(e)]])
        if e.op in COMPARE:
            other = {"eq": "ne", "ne": "eq", "lt": "ge", "ge": "lt", "gt": "le", "le": "gt"}[e.op]
            return _all([self.falsify(binary(other, *e.args)), *[self._no_null(c) for c in _columns(e)]])
        if e.op == "is_null":
            return self.falsify(Expr("is_not_null", e.args))
        if e.op == "is_not_null":
            return self.falsify(Expr("is_null", e.args))
        if e.op == "lit" and e.opts["value"] is True:
            return F.lit(True)
        return None

    def _no_null(self, name: str) -> Column | None:
        return F.col(f"{name}__nulls") == 0 if f"{name}__nulls" in self.known else None


def _columns(e: Expr) -> set[str]:
    return {e.opts["name"]} if e.op == "col" else {c for a in e.args for c in _columns(a)}


def _any(proofs) -> Column | None:
    found = [F.coalesce(p, F.lit(False)) for p in proofs if p is not None]
    return reduce(lambda a, b: a | b, found) if found else None


def _all(proofs: list) -> Column | None:
    if not proofs or any(p is None for p in proofs):
        return None
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in proofs])


def keep(stats: DataFrame, e: Expr) -> DataFrame:
    """The zones or files that a filter may keep rows of."""
    proof = _Prover(stats.schema).falsify(e)
    return stats if proof is None else stats.where(~F.coalesce(proof, F.lit(False)))


def all_true(stats: DataFrame, e: Expr) -> DataFrame:
    """The zones or files of which a filter keeps every row."""
    proof = _Prover(stats.schema).satisfy(e)
    return stats.limit(0) if proof is None else stats.where(F.coalesce(proof, F.lit(False)))


def pruned(df: DataFrame, zones: DataFrame, e: Expr, rows: int = ZONE_ROWS) -> DataFrame:
    """df filtered by e, read only from files and zones that may hold a match.

    The files are listed on the driver, as any scan lists them; zones are joined
    by file and number, broadcast by Spark only if their table is small.
    """
    spark = df.sparkSession
    left = keep(zones, e)
    files = [r.file for r in left.select("file").distinct().collect()]
    if not files:
        return df.limit(0)
    part = spark.read.schema(df.schema).parquet(*files)
    marked = part.withColumns({"__file": F.col("_metadata.file_path"), "__zone": F.floor(F.col("_metadata.row_index") / rows)})
    inside = left.select(F.col("file").alias("__file"), F.col("zone").alias("__zone"))
    return marked.join(inside, ["__file", "__zone"], "left_semi").where(e.bind(part)).select(*df.columns)
