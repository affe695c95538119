"""Connected components of a graph given by its edges.

Alternates the large-star and small-star steps until the edges no longer
change: each vertex then points to the least vertex of its component. Every
step is an aggregation with partial sums and a join whose large keys Spark can
split; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """vertex, component (its least vertex) for the vertices of edges (a, b)."""
    edge = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edge = scratch.save(edge, f"{name}-0")
    before, at = _state(edge), 0
    while before[0]:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join with it can split what a vertex of many edges has
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
        # large star: what is greater than u moves to the least around u
        large = edge.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}-large")
        # small star: u and all below it point to the least below
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        at += 1
        edge = scratch.save(made, f"{name}-{at}")
        scratch.drop(f"{name}-{at - 1}", f"{name}-least", f"{name}-large")
        after = _state(edge)
        if after == before:
            break
        before = after
    heads = edge.select(F.col("v").alias("vertex")).distinct()
    return edge.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(heads.select("vertex", F.col("vertex").alias("component")))


def _state(edge: DataFrame) -> tuple:
    # the sum is of 31-bit parts, so that no table can overflow it
    h = F.xxhash64("u", "v")
    return tuple(edge.select(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))), F.sum(F.shiftrightunsigned(h, 33))).first())
