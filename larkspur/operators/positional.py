"""Operators on row numbers. Rows have no order of their own, so each takes the
column that numbers them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(mask)


def slice_(df: DataFrame, row: str, start: int, end: int) -> DataFrame:
    return df.where((F.col(row) >= start) & (F.col(row) < end))


def scalar_at(df: DataFrame, row: str, index: int) -> DataFrame:
    return df.where(F.col(row) == index)


def take(df: DataFrame, row: str, indices: DataFrame | list[int | None]) -> DataFrame:
    """The rows at the indices, with their place `pos` in the list: unsorted,
    repeated, and null for a null index. indices: a list, or (pos, idx)."""
    if not isinstance(indices, DataFrame):
        indices = df.sparkSession.createDataFrame(list(enumerate(indices)), "pos long, idx long")
    return indices.join(df, F.col("idx") == F.col(row), "left").select("pos", *df.columns)


def search_sorted(df: DataFrame, column: str, value: Any, side: str = "left") -> DataFrame:
    """One row: the place at which value would go (index), and whether it is
    there (found). Nulls count as less."""
    x = F.col(column)
    below = x.isNull() | (x < value if side == "left" else x <= value)
    return df.agg(F.count_if(below).alias("index"), F.coalesce(F.bool_or(x == value), F.lit(False)).alias("found"))


def interleave(arrays: list[DataFrame], row: str, picks: DataFrame) -> DataFrame:
    """Rows gathered from several tables. picks: pos, array_idx, row_idx."""
    tagged = [a.withColumn("array_idx", F.lit(k)) for k, a in enumerate(arrays)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return picks.join(every.withColumnRenamed(row, "row_idx"), ["array_idx", "row_idx"]).select("pos", *[c for c in arrays[0].columns if c != row])


def concat(chunks: list[DataFrame]) -> DataFrame:
    """Chunks of one schema, one after the other."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out
