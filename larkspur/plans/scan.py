"""Scan requests: projection, filter, row range, selection and limit over files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import Expr, and_collect, conjuncts

ROW = "__row"


@dataclass(frozen=True)
class Selection:
    """Rows by number: all, those listed, or those not listed."""

    rows: tuple[int, ...] | DataFrame | None = None
    exclude: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.rows is None:
            return df
        spark = df.sparkSession
        listed = self.rows if isinstance(self.rows, DataFrame) else spark.createDataFrame([(r,) for r in self.rows], f"{ROW} long")
        return df.join(listed.select(F.col(listed.columns[0]).alias(ROW)), ROW, "left_anti" if self.exclude else "left_semi")


def numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of the files with their number over all files in order of path.

    Offsets come from a count by file, a scan without columns; the table of
    files is as long as their list."""
    df = spark.read.parquet(*paths)
    counts = df.groupBy(F.col("_metadata.file_path").alias("f")).count().orderBy("f").collect()
    offsets, at = [], 0
    for r in counts:
        offsets.append((r["f"], at))
        at += r["count"]
    if len(offsets) <= 1:
        return df.withColumn(ROW, F.col("_metadata.row_index"))
    table = spark.createDataFrame(offsets, "__f string, __o long")
    marked = df.withColumns({"__f": F.col("_metadata.file_path"), "__i": F.col("_metadata.row_index")})
    return marked.join(F.broadcast(table), "__f").withColumn(ROW, F.col("__o") + F.col("__i")).drop("__f", "__o", "__i")


def listing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files below the paths, in order and written as _metadata.file_path
    has them, without reading them."""
    return sorted(re.sub("^file:/+", "file:/", f) for f in spark.read.parquet(*paths).inputFiles())


@dataclass(frozen=True)
class ScanRequest:
    """What to read. The limit counts rows after the filter.

    zones: the path of a zone map that was written beside the data; files of
    which it proves that the filter keeps nothing aren't read. files: some of
    the files by place in the order of paths, partition_range: a run of them.
    limit_first: a limit on rows before the filter."""

    projection: list[str] | dict[str, Expr] | None = None
    filter: Expr | None = None
    row_range: tuple[int, int] | None = None
    selection: Selection = field(default_factory=Selection)
    files: list[int] | None = None
    ordered: bool = False
    limit: int | None = None
    zones: str | None = None
    partition_range: tuple[int, int] | None = None
    limit_first: int | None = None

    def with_(self, **changes: Any) -> ScanRequest:
        return replace(self, **changes)

    def where(self, e: Expr) -> ScanRequest:
        terms = [*conjuncts(self.filter), *conjuncts(e)] if self.filter is not None else conjuncts(e)
        return replace(self, filter=and_collect(terms))

    def run(self, spark: SparkSession, *paths: str) -> DataFrame:
        """The request as a DataFrame. Row numbers are made only if asked for,
        so that a plain request is a plain scan with pushed filters."""
        source = list(paths)
        if self.files is not None or self.partition_range:
            listed = listing(spark, source)
            source = [listed[k] for k in self.files] if self.files is not None else listed[slice(*self.partition_range)]
            if not source:
                return self.with_(files=None, partition_range=None, limit=0).run(spark, *paths)
        if self.zones and self.filter is not None and not (self.row_range or self.selection.rows is not None):
            # row numbers count all files, so only a request without them leaves files out
            from . import pruning

            known = spark.read.parquet(self.zones)
            gone = {r.file for r in known.select("file").distinct().join(pruning.keep(known, self.filter).select("file").distinct(), "file", "left_anti").collect()}
            left = [f for f in listing(spark, source) if f not in gone] if gone else source
            if not left:
                return self.with_(zones=None, limit=0).run(spark, *paths)
            source = left
        positional = self.row_range or self.selection.rows is not None or self.ordered
        df = numbered(spark, source) if positional else spark.read.parquet(*source)
        if self.row_range:
            df = df.where((F.col(ROW) >= self.row_range[0]) & (F.col(ROW) < self.row_range[1]))
        df = self.selection.apply(df)
        if self.limit_first is not None:
            df = df.limit(self.limit_first)
        if self.filter is not None:
            df = df.where(self.filter.bind(df))
        if self.ordered:
            df = df.orderBy(ROW)
        if self.limit is not None:
            df = df.limit(self.limit)
        if isinstance(self.projection, dict):
            return df.select(*(e.bind(df).alias(n) for n, e in self.projection.items()))
        if self.projection is not None:
            return df.select(*self.projection)
        return df.drop(ROW)

    def count(self, spark: SparkSession, *paths: str) -> int:
        return self.with_(projection=[]).run(spark, *paths).count()

    def splits(self, spark: SparkSession, *paths: str) -> list[ScanRequest]:
        """A request for each file that this one would read: small, picklable,
        and together they give the same rows. Not for requests by row number or
        with a limit."""
        if self.row_range or self.selection.rows is not None or self.limit is not None or self.limit_first is not None:
            raise ValueError("a request by row number, or with a limit, isn't split")
        every = range(len(listing(spark, list(paths))))
        chosen = self.files if self.files is not None else list(every)[slice(*self.partition_range)] if self.partition_range else every
        return [self.with_(files=[k], partition_range=None) for k in chosen]


@dataclass(frozen=True)
class RepeatedScan:
    """A request that is run again and again over other runs of rows."""

    request: ScanRequest
    spark: SparkSession
    paths: tuple[str, ...]

    def execute(self, row_range: tuple[int, int] | None = None) -> DataFrame:
        own = self.request.row_range
        if own and row_range:
            row_range = (max(own[0], row_range[0]), min(own[1], row_range[1]))
        return self.request.with_(row_range=row_range or own).run(self.spark, *self.paths)

    def scalar_at(self, row: int) -> Any:
        """The row of this number, or None if the filter drops it."""
        return self.execute((row, row + 1)).first()
