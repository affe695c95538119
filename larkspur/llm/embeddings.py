"""Operator 7: near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of equal content form one class, whose representative is compared.
Representatives are dealt into tiles by median cuts along leading principal
components; two tiles whose boxes lie further apart than the threshold allows
are not compared. For the other pairs of tiles a task accumulates products over
the leading components first; a pair goes on only while the product so far and
the product of the two suffix norms together can reach the threshold. What is
left is decided by the cosine of the given vectors in double precision.

The sample on which components and cuts are fitted (SAMPLE numbers at most) and
the tiles change the work, never the result: the search is exact. A task
holds two tiles; it returns counts of links and a spanning forest, not pairs.
Every vector is sent once for each tile that its own has to meet: where boxes
can't part tiles (vectors that spread alike in all directions), that is all.

Defined results: vectors that are null or empty, hold a null or a value that
isn't finite, or have norm zero link with nothing; vectors of different lengths
don't link, and those of each length are compared by themselves; repeated rows are vectors of their own that link with each other;
a null id keeps its row and links like any other, but names no component unless
all its members are null; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, map_arrow

#: Numbers in the sample that components and cuts are fitted on.
SAMPLE = 1_500_000
#: Numbers and vectors of a tile at most, tiles at most, rows of a block within a task, leading components of a box.
TILE_NUMBERS, TILE, MAX_TILES, BLOCK, BOX = 1 << 19, 8192, 1 << 18, 512, 12
#: Rounding of products of unit vectors, far above what double precision gives.
SLACK = 1e-9


class Cuts:
    """Principal axes and a tree of median cuts; its leaves are the tiles."""

    def __init__(self, sample: np.ndarray, tiles: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        _, axes = np.linalg.eigh(unit.T @ unit)
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, value, below, above; a leaf: -1, 0, tile, 0
        self.tiles = 0
        self._grow(unit @ self.axes[:, :BOX], tiles)

    def _grow(self, points: np.ndarray, tiles: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, self.tiles, 0))
        axis = int(np.argmax(points.std(axis=0))) if len(points) else 0
        value = float(np.median(points[:, axis])) if len(points) else 0.0
        low = points[:, axis] <= value if len(points) else np.zeros(0, bool)
        if tiles < 2 or not low.any() or low.all():
            self.tiles += 1
            return at
        below = self._grow(points[low], tiles // 2)
        above = self._grow(points[~low], tiles - tiles // 2)
        self.nodes[at] = (axis, value, below, above)
        return at

    def rotate(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.axes

    def tile(self, rotated: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rotated), np.int64)
        todo = [(0, np.arange(len(rotated)))]
        while todo:
            node, rows = todo.pop()
            axis, value, below, above = self.nodes[node]
            if axis < 0:
                out[rows] = below
                continue
            low = rotated[rows, axis] <= value
            todo += [(below, rows[low]), (above, rows[~low])]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def links(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least the threshold. rx, ry:
    the same as rotated unit vectors."""
    d = rx.shape[1]
    product, done = np.zeros((len(rx), len(ry))), 0
    for upto in sorted({min(d, k) for k in (8, 16, 32, d)}):
        product += rx[:, done:upto] @ ry[:, done:upto].T
        done = upto
        if done == d:
            alive = product >= threshold - SLACK
            break
        rest = np.sqrt(np.maximum(0, (rx[:, done:] ** 2).sum(axis=1)))[:, None] * np.sqrt(np.maximum(0, (ry[:, done:] ** 2).sum(axis=1)))
        alive = product + rest >= threshold - SLACK
        if np.count_nonzero(alive) <= alive.size // 50:
            break
    i, j = np.nonzero(alive)
    out = np.zeros(alive.shape, bool)
    for at in range(0, len(i), 20_000):
        a, b = x[i[at : at + 20_000]], y[j[at : at + 20_000]]
        cosine = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        hit = cosine >= threshold
        out[i[at : at + 20_000][hit], j[at : at + 20_000][hit]] = True
    return out


class Forest:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def join(self, hit: np.ndarray, row: int, col: int) -> None:
        """Joins what a block of links connects. Labels spread through the
        block, so that dense blocks cost a few sweeps, not a step a link."""
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        small = hit[np.ix_(rows, cols)]
        label, far = np.arange(len(rows)), len(rows)
        while True:
            of_col = np.where(small, label[:, None], far).min(axis=0)
            now = np.minimum(label, np.where(small, of_col, far).min(axis=1))
            if (now == label).all():
                break
            label = now
        for i, k in zip((rows + row).tolist(), (rows[label] + row).tolist(), strict=True):
            self.union(i, k)
        for j, k in zip((cols + col).tolist(), (rows[of_col] + row).tolist(), strict=True):
            self.union(j, k)


def _compared(classes: DataFrame, d: int, total: int, threshold: float, scratch: Scratch) -> DataFrame:
    """c, links and to, a class linked with it, from all pairs of tiles of the
    classes, which all are d long."""
    picked = classes.orderBy(F.xxhash64("k1", "k2"), "k1").limit(max(d, SAMPLE // d)).select("v").toArrow()
    most = max(16, min(TILE, TILE_NUMBERS // d), -(-total // MAX_TILES))
    cuts = Cuts(_matrix(picked.column("v")), -(-total // most))
    sent = classes.sparkSession.sparkContext.broadcast(cuts)
    width = min(BOX, d)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        r = sent.value.rotate(_matrix(batch.column("v")))
        lead = np.ascontiguousarray(r[:, :BOX])
        return pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), batch.column("v"), pa.array(sent.value.tile(r), pa.int64()), pa.array(list(lead), pa.list_(pa.float64()))], ["c", "n", "v", "tile", "lead"])

    tiled = scratch.save(map_arrow(classes.select("c", "n", "v"), deal, "c long, n long, v array<double>, tile long, lead array<double>", 8192), f"tiles-{d}")
    sides = [f(F.get("lead", F.lit(k))) for k in range(width) for f in (F.min, F.max)]
    # tiles that the sample made too large are dealt into parts of the same box; a row for each of at most about MAX_TILES tiles
    box = tiled.groupBy("tile").agg(F.array(*sides).alias("box"), F.ceil(F.count(F.lit(1)) / (1.25 * most)).cast("long").alias("parts"))
    box = scratch.save(box, f"boxes-{d}")
    parts = box.select("tile", "parts", "box", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    parts = scratch.save(parts.select((F.col("tile") * MAX_TILES + F.col("part")).alias("tile"), "box"), f"parts-{d}")
    every = parts.orderBy("tile").toArrow()
    boxes = classes.sparkSession.sparkContext.broadcast((every.column("tile").to_numpy(), _matrix(every.column("box"))))

    def meet(batch: pa.RecordBatch) -> pa.RecordBatch:
        tiles, sides = boxes.value
        low, high = sides[:, ::2], sides[:, 1::2]
        own, out = _matrix(batch.column("box")), []
        for t, lo, hi in zip(batch.column("tile").to_pylist(), own[:, ::2], own[:, 1::2], strict=True):
            gap = np.maximum(0, np.maximum(lo - high, low - hi))
            near = tiles[(gap**2).sum(axis=1) <= 2 - 2 * threshold + 1e-6]
            out.append(np.stack([np.full(len(near), t), np.minimum(near, t), np.maximum(near, t)]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], ["tile", "a", "b"])

    pairs = scratch.save(map_arrow(parts, meet, "tile long, a long, b long", 64), f"pairs-{d}")
    fine = tiled.join(box.select("tile", "parts"), "tile").select("c", "n", "v", (F.col("tile") * MAX_TILES + F.pmod(F.xxhash64("c"), "parts")).alias("tile"))
    work = fine.join(pairs, "tile")

    def compare(table: pa.Table) -> pa.Table:
        c, n, tile = (table.column(k).to_numpy() for k in ("c", "n", "tile"))
        x = _matrix(table.column("v"))
        order = np.argsort(tile, kind="stable")
        c, n, tile, x = c[order], n[order], tile[order], x[order]
        r = sent.value.rotate(x)
        cut = int((tile == tile[0]).sum())
        same = cut == len(c)
        counts, forest = np.zeros(len(c), np.int64), Forest(len(c))
        for i in range(0, cut, BLOCK):
            for j in range(i if same else cut, len(c), BLOCK):
                p, q = min(i + BLOCK, cut), min(j + BLOCK, len(c))
                hit = links(x[i:p], x[j:q], r[i:p], r[j:q], threshold)
                if same and i == j:
                    np.fill_diagonal(hit, False)
                if hit.any():
                    counts[i:p] += hit @ n[j:q]
                    if i != j:
                        counts[j:q] += hit.T @ n[i:p]
                    forest.join(hit, i, j)
        root = np.array([forest.find(i) for i in range(len(c))], np.int64)
        own = np.flatnonzero(counts)
        return pa.table({"c": pa.array(c[own], pa.int64()), "links": pa.array(counts[own], pa.int64()), "to": pa.array(c[root[own]], pa.int64())})

    return scratch.save(work.groupBy("a", "b").applyInArrow(compare, "c long, links long, to long"), f"found-{d}")


def near_duplicates(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = rows.select("vec_id", "v", good.alias("good"), F.when(good, F.xxhash64("v")).alias("k1"), F.when(good, F.xxhash64(F.lit(7), "v")).alias("k2"))
    lone = keyed.select("vec_id", "k1", "k2")
    classes = keyed.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = scratch.save(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    lengths = classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    if not lengths:
        return lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = spark.createDataFrame([], "c long, links long, to long")
    # a class that is alone of its length has nothing to be compared with
    for size in lengths:
        if size["count"] > 1:
            found = found.unionByName(_compared(classes.where(F.size("v") == size.d), size.d, size["count"], threshold, scratch))
    group = components(found.select(F.col("c").alias("a"), F.col("to").alias("b")), scratch)
    links_of = found.groupBy("c").agg(F.sum("links").alias("links"))
    of_class = classes.select("c", "k1", "k2", "rep", "n").join(links_of, "c", "left").join(group.withColumnRenamed("vertex", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(named, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = lone.join(of_class, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


ORACLE = """
    WITH RECURSIVE pairs AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b
        WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
    links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
    SELECT e.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
    FROM embeddings e LEFT JOIN links l ON l.a = e.vec_id
    JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id"""
