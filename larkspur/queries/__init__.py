"""All queries of the library with the SQL that each can be held to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import native, shapes, suites

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return native.queries() | suites.queries() | shapes.queries()


def oracle_sql() -> dict[str, str]:
    return native.oracle_sql() | suites.oracle_sql() | shapes.oracle_sql()
