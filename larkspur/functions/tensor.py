"""Vector functions over arrays of floats, as built-in array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def inner_product(x: Column, y: Column, element: T.DataType | str = "double") -> Column:
    """Sum of products; fails if the lengths differ."""
    product = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    same = F.size(x) == F.size(y)
    return F.when(same, _sum(product)).when(x.isNotNull() & y.isNotNull(), F.raise_error(F.lit("vectors of different lengths")).cast("double")).cast(element)


def l2_norm(x: Column, element: T.DataType | str = "double") -> Column:
    return F.sqrt(_sum(F.transform(x, lambda v: v.cast("double") * v.cast("double")))).cast(element)


def cosine_similarity(x: Column, y: Column, element: T.DataType | str = "double") -> Column:
    """0 if either vector has norm zero."""
    scale = l2_norm(x) * l2_norm(y)
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.try_divide(inner_product(x, y), scale)).cast(element)


def l2_denorm(x: Column, norm: Column, element: T.DataType | str = "double") -> Column:
    """A normalised vector times its norm."""
    return F.transform(x, lambda v: (v * norm).cast(element))


def search(df: DataFrame, column: str, query: list[float], threshold: float) -> DataFrame:
    """Rows whose vectors have a cosine above the threshold with the query:
    one scan, the query a constant of the plan."""
    return df.where(cosine_similarity(F.col(column), F.array(*map(F.lit, query))) > threshold)
