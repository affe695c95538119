"""Functions, aggregates and pruning rules that a user adds.

A scalar function is a way to build a Column from Columns, and, if wanted, a
check of its operands' types that raises TypeError. An aggregate is the same over
the rows of a group. A rule gives a proof, as a Column over a zone's statistics,
that a call of a function is true for no row of the zone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T


@dataclass(frozen=True)
class Scalar:
    build: Callable[..., Column]
    accepts: Callable[[list[T.DataType]], None] | None = None


_scalars: dict[str, Scalar] = {}
_aggregates: dict[str, Callable[..., Column]] = {}
_rules: dict[str, Callable] = {}


def register_scalar(name: str, build: Callable[..., Column], accepts: Callable[[list[T.DataType]], None] | None = None) -> None:
    _scalars[name] = Scalar(build, accepts)


def scalar(name: str) -> Scalar:
    if name not in _scalars:
        raise KeyError(f"no scalar function {name}; known: {sorted(_scalars)}")
    return _scalars[name]


def register_aggregate(name: str, build: Callable[..., Column]) -> None:
    _aggregates[name] = build


def aggregate(name: str, *args: Column) -> Column:
    if name not in _aggregates:
        raise KeyError(f"no aggregate {name}; known: {sorted(_aggregates)}")
    return _aggregates[name](*args)


def register_rule(name: str, falsify: Callable) -> None:
    """falsify(e, stat): e is the call, stat(operand, which) a statistic of an
    operand or None; returns a proof or None."""
    _rules[name] = falsify


def rule(name: str) -> Callable | None:
    return _rules.get(name)
