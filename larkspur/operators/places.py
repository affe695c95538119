"""Joins by distance along a line within a place: points and sites have a key,
a place and a number `at`. Work is dealt in units that no place, however many
of the rows it has, makes larger than stated."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of a place that one task takes, or as many as there are sites.
CHUNK = 65536
#: Points and sites of a cell that are compared as one, and pairs that a task compares on average.
BLOCK, PAIRS = 4096, 4_000_000


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The k rows of least key of each group; most go before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("key").asc_nulls_last()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _any(n: Column) -> Column:
    """One of n parts for each row, whatever it holds."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), n).cast("int")


def nearest(points: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """(point, key) of the k sites of each point's place that are least by
    (abs(at - point's at), key), nulls last and NaN before them. Points (point,
    place, at) may repeat; sites are (key, place, at).

    Sites of one place and number differ by key only, so k of them are enough.
    The distinct numbers of a place are numbered in order; a point finds the
    number of the last that isn't above it in one sorted pass over points and
    sites, and the k numbers on either side hold its result. Rounding can make
    numbers beyond them equally far; the next one on each side shows it, and
    such points (1e300 among small numbers) are compared with all sites of the
    place. Work is otherwise n log n; sites are repeated for each chunk of
    points, points + sites rows at most."""
    points, sites = points.where("place IS NOT NULL"), sites.where("place IS NOT NULL")
    odd = "at IS NULL OR isnan(at) OR abs(at) = double('inf')"
    few = _first(sites, k, "place", "at")
    # what is equally far from all points (null, NaN, infinities), and for points like that all sites
    kind = F.expr("CASE WHEN at IS NULL THEN 4 WHEN isnan(at) THEN 3 WHEN at = double('inf') THEN 2 WHEN at = double('-inf') THEN 1 ELSE 0 END")
    rare = _first(sites.withColumn("kind", kind), k, "place", "kind").groupBy("place").agg(F.collect_list(F.struct("kind", "at", "key")).alias("rare"))
    values = few.where(f"NOT ({odd})").groupBy("place", "at").agg(F.collect_list(F.struct("at", "key")).alias("here"))
    # the first row of a place stands below all its numbers
    rows = values.withColumn("rare", F.lit(None).cast(rare.schema["rare"].dataType)).unionByName(
        rare.select("place", F.lit(float("-inf")).alias("at"), F.array().cast(values.schema["here"].dataType).alias("here"), "rare")
    )
    order = Window.partitionBy("place").orderBy("at")
    placed = rows.withColumn("pos", F.row_number().over(order) - 1)
    near = placed.select(
        "place", "pos", F.flatten(F.collect_list("here").over(order.rowsBetween(1 - k, k))).alias("sites"), F.first("rare", True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("rare"),
        F.lag("at", k).over(order).alias("below"), F.lead("at", k + 1).over(order).alias("above"),
    )
    others = F.expr("transform(filter(rare, r -> r.kind > 0), r -> named_struct('at', r.at, 'key', r.key))")
    near = near.select("place", "pos", F.when(F.size("sites") < k, F.concat("sites", others)).otherwise(F.col("sites")).alias("sites"), F.expr("CASE WHEN below > double('-inf') THEN below END").alias("below"), "above")
    near = near.unionByName(rare.select("place", F.lit(-1).alias("pos"), F.expr("transform(rare, r -> named_struct('at', r.at, 'key', r.key))").alias("sites"), F.lit(None).cast("double").alias("below"), F.lit(None).cast("double").alias("above")))

    chunks = max(1, -(-points.count() // max(CHUNK, sites.count())))
    none = F.lit(None).cast(points.schema["point"].dataType)
    marks = placed.where("pos > 0").select(none.alias("point"), "place", "at", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "pos")
    dealt = points.where(f"NOT ({odd})").select("point", "place", "at", _any(F.lit(chunks)).alias("chunk"), F.lit(None).cast("int").alias("pos"))
    passed = Window.partitionBy("place", "chunk").orderBy("at", F.col("pos").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    located = dealt.unionByName(marks).withColumn("last", F.coalesce(F.max("pos").over(passed), F.lit(0))).where("pos IS NULL").select("point", "place", "at", F.col("last").alias("pos"))
    located = located.unionByName(points.where(odd).select("point", "place", "at", F.lit(-1).alias("pos")))

    distance = "transform(sites, s -> named_struct('n', abs(s.at - at) IS NULL, 'd', abs(s.at - at), 'm', s.key IS NULL, 'key', s.key))"
    found = located.join(near, ["place", "pos"]).withColumn("best", F.slice(F.sort_array(F.expr(distance)), 1, k))
    last = f"get(best, {k - 1}).d"
    found = found.withColumn("tied", F.expr(f"coalesce(abs(below - at) <= {last}, false) OR coalesce(abs(above - at) <= {last}, false)"))
    clear = found.where("NOT tied").select("point", F.explode("best.key").alias("key"))
    pairs = found.where("tied").groupBy("point", "place", "at").agg(F.count("*").alias("n")).join(few.select("place", "key", F.col("at").alias("site")), "place").withColumn("d", F.expr("abs(site - at)"))
    rank = F.row_number().over(Window.partitionBy("point", "place", "at").orderBy(F.col("d").asc_nulls_last(), F.col("key").asc_nulls_last()))
    rest = pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("point", "key", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return clear.unionByName(rest.drop("copy"))


def within(points: DataFrame, sites: DataFrame, most: float, matches: str) -> DataFrame:
    """(point, key) of the pairs of a place for which `matches` (of p.at and
    s.at) holds; no pair does whose numbers are more than about `most` apart.

    The line is cut into cells, four to eight in `most`; a site goes to all that it
    can reach. Their width is a power of two, so that cells are exact. Cells of
    more than BLOCK points or sites are compared block by block. The result
    grows with the square of the input, and so does the number of tasks: each
    compares about PAIRS pairs."""
    width = 2.0 ** math.floor(math.log2(most / 4))
    reach = math.floor(most / width) + 1
    cell = F.expr(f"CAST(floor(greatest(least(at / {width!r}D, 1e15D), -1e15D)) AS BIGINT)")
    some = "place IS NOT NULL AND at IS NOT NULL"
    points = points.where(some).withColumn("cell", cell)
    sites = sites.where(some).withColumn("cell", cell).withColumn("cell", F.explode(F.sequence(F.col("cell") - reach, F.col("cell") + reach)))

    unit = ["place", "cell"]
    counts = points.groupBy(*unit).agg(F.count("*").alias("p")).join(sites.groupBy(*unit).agg(F.count("*").alias("s")), unit)
    blocks = counts.select(*unit, F.expr(f"CAST(ceil(p / {BLOCK}) AS INT)").alias("ps"), F.expr(f"CAST(ceil(s / {BLOCK}) AS INT)").alias("ss"))
    heavy = F.broadcast(blocks.where("ps > 1 OR ss > 1"))  # (points + sites) / BLOCK rows at most
    total = counts.agg(F.sum(F.col("p").cast("double") * F.col("s")).alias("pairs"), F.sum("p").alias("p"), F.sum("s").alias("s")).first()
    n = min(100_000, 1 + int((total["pairs"] or 0) / PAIRS + ((total["p"] or 0) + (total["s"] or 0)) / CHUNK))

    def dealt(rows: DataFrame, own: str, mine: str, theirs: str, others: str) -> DataFrame:
        """Each row in one block of its own side, against all of the other."""
        rows = rows.join(heavy, unit, "left").withColumn(mine, _any(F.coalesce(F.col(own), F.lit(1))))
        return rows.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(others), F.lit(1)) - 1))).drop("ps", "ss")

    keys = [*unit, "i", "j"]
    left, right = dealt(points, "ps", "i", "j", "ss").repartition(n, *keys).alias("p"), dealt(sites, "ss", "j", "i", "ps").repartition(n, *keys).alias("s")
    both = F.expr(" AND ".join(f"p.{k} = s.{k}" for k in keys) + f" AND ({matches})")
    return left.join(right.hint("merge"), both).select("p.point", "s.key")
