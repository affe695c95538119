"""Operator 6: near-duplicates by chosen-path set similarity join.

A document is its set of word shingles. Documents with the same set form a
class, of which one takes part. Each of several trees sends a class down a
path: every level of every tree has a minhash of its own, and the token found
there names the branch. Nodes of at most
SMALL members are compared exhaustively on signatures; larger ones branch on,
to DEPTH levels. What still is larger then (members that agree in all tokens
of a path, that is one large group of near copies) is tied to its least member.

This gives candidate groups, with room below the threshold, so that a true link
is missed only if no tree brings its two classes (or a chain of candidates)
together. Within a candidate group every pair that isn't connected yet is
decided on the full shingle sets: a task takes one block of BLOCK members, or
two, and returns a spanning forest, never the pairs. The blocks of a large group
share some members, by which a group of near copies becomes one in time linear
in its size; only what stays outside its largest part meets all blocks.

Chance of a link at similarity s in a node of depth d: 1 - (1 - s**d)**trees.
There are as many trees as it takes for this to be RECALL at the similarity
asked for and the last depth, however large the nodes above are: 22 for 0.85,
38 for 0.80. If that were more than MAX_TREES, paths are shorter, which costs
work and not recall. Tokens of paths are cut to 16 bits, which only adds
candidates.

Defined results: words are runs of bytes other than ASCII white space, A-Z in
lower case; a text with fewer words than a shingle is one shingle; a null or
empty text, or one of white space, has none and links with nothing; rows with
equal sets link; a null id keeps its row but names no group; repeated rows each
get their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .embeddings import Forest
from .hashing import CACHE, WordHashes, mix, shingles
from .shared import Scratch, map_arrow, maybe_in, split_in, texts_of, tidy

#: Length of a signature, first and last depth at which nodes are looked at.
WIDTH, FIRST, DEPTH = 64, 4, 8
#: Chance that a pair of just the similarity asked for meets in a node of the last depth; trees at most.
RECALL, MAX_TREES = 0.999, 64
#: Members of a node that is compared exhaustively; members of a block of a candidate group.
SMALL, BLOCK = 64, 1024
#: Members of a large candidate group, about, that all of its blocks are compared with first.
PIVOTS = 32
_random = np.random.default_rng(6)
_XOR = _random.integers(0, 2**63, MAX_TREES * DEPTH, np.uint64)
_MUL = _random.integers(0, 2**63, MAX_TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_words = WordHashes()


class _ByteHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = _ByteHashes()


def shingle_set(text: str, n: int) -> np.ndarray:
    """The ascending distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    if len(h) >= n:
        return np.unique(shingles(h, n))
    return mix(shingles(h, len(h)) + np.uint64(len(h))) if len(h) else h


def set_key(members: np.ndarray) -> str:
    return xxhash.xxh128_hexdigest(members.tobytes())


def forest_size(percent: int, recall: float = RECALL) -> tuple[int, int]:
    """Trees and their depth for the recall at percent / 100."""
    share = percent / 100
    for depth in range(DEPTH, 0, -1):
        trees = math.ceil(math.log(1 - recall) / math.log1p(-(share**depth))) if share < 1 else 1
        if trees <= MAX_TREES:
            return trees, depth
    raise ValueError(f"{percent} percent would take {trees} trees; at most {MAX_TREES} are made")


def signatures(sets: list[np.ndarray], width: int = WIDTH) -> np.ndarray:
    """Minwise signatures, one row for each set; none may be empty."""
    lens = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.cumsum(lens) - lens
    out = np.empty((len(sets), width), np.uint32)
    for k in range(width):
        out[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], starts) >> np.uint64(32)
    return out


def paths(tokens: np.ndarray, tree: int, depths: range, depth: int = DEPTH) -> dict[int, np.ndarray]:
    """The node of each row at the given depths of a tree. tokens: `depth` of each tree."""
    at = np.full(len(tokens), mix(np.array([tree + 1], np.uint64))[0])
    out = {}
    for d in range(1, depths.stop):
        at = mix(at * np.uint64(0x9E3779B97F4A7C15) + tokens[:, tree * depth + d - 1].astype(np.uint64) + np.uint64(d))
        if d in depths:
            out[d] = at.astype(np.int64)
    return out


def _signature_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, WIDTH)


def _token_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint16).reshape(batch.num_rows, -1)


def shingle_table(texts: DataFrame, n: int, tokens: int) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, set_key, sig and the tokens
    of the paths; the last three null for empty sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, n) for t in batch.column("text").to_pylist()]
        full = [s for s in sets if len(s)]
        made = signatures(full, max(WIDTH, tokens)) if full else np.zeros((0, max(WIDTH, tokens)), np.uint32)
        sig, token = (iter(made[:, :WIDTH].copy()), iter(made[:, :tokens].astype(np.uint16)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(map(len, sets), pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.string())]
            + [pa.array([next(x).tobytes() if len(s) else None for s in sets], pa.binary()) for x in (sig, token)],
            ["doc_id", "h", "n_shingles", "set_key", "sig", "tokens"],
        )

    return map_arrow(texts.withColumn("h", F.xxhash64("text")), run, "doc_id long, h long, n_shingles long, set_key string, sig binary, tokens binary", 256)


def leaves(classes: DataFrame, scratch: Scratch, trees: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(leaf, c) of the nodes of 2 to SMALL members, and of the larger ones at the last depth."""
    start = min(FIRST, depth)

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = _token_rows(batch)
        nodes = [paths(tokens, t, range(start, start + 1), depth)[start] for t in range(trees)]
        return pa.RecordBatch.from_arrays([pa.array(np.tile(batch.column("c").to_numpy(), trees)), pa.array(np.repeat(np.arange(trees, dtype=np.int32), len(tokens))), pa.array(np.concatenate(nodes))], ["c", "tree", "node"])

    nodes = scratch.save(map_arrow(classes.select("c", "tokens"), first, "c long, tree int, node long", 8192), "nodes")
    # counts are written, so that the joins with them can split what a crowded node holds
    counts = scratch.save(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    held = scratch.save(nodes.join(counts, "node"), "held")
    scratch.drop("nodes")
    small = held.where(F.col("n") <= SMALL).select(F.col("node").alias("leaf"), "c")
    large = held.where(F.col("n") > SMALL)
    deeper = range(start + 1, depth + 1)
    if not deeper:
        return small, large.select(F.col("node").alias("leaf"), "c")

    def further(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, tree = _token_rows(batch), batch.column("tree").to_numpy()
        out = {d: np.zeros(len(tokens), np.int64) for d in deeper}
        for t in np.unique(tree).tolist():
            own = tree == t
            for d, at in paths(tokens[own], t, deeper, depth).items():
                out[d][own] = at
        return pa.RecordBatch.from_arrays([batch.column("c"), *(pa.array(out[d]) for d in deeper)], ["c", *(f"d{d}" for d in deeper)])

    large = large.select("c", "tree").join(classes.select("c", "tokens"), "c")
    rows = scratch.save(map_arrow(large, further, "c long, " + ", ".join(f"d{d} long" for d in deeper), 8192), "deep")
    # each level is written, which keeps the plans that the driver holds small
    for d in deeper:
        if rows.isEmpty():
            break
        size = scratch.save(rows.groupBy(f"d{d}").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"counts-{d}")
        level = scratch.save(rows.join(size, f"d{d}"), f"level-{d}")
        small = small.unionByName(level.where(F.col("n") <= SMALL).select(F.col(f"d{d}").alias("leaf"), "c"))
        rows = level.where(F.col("n") > SMALL).drop("n")
    return small, rows.select(F.col(f"d{depth}").alias("leaf"), "c")


def compare_leaves(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of a spanning forest of each leaf's pairs whose signatures
    agree in at least `least` of their places. rows: leaf, c, sig."""

    def forest(leaf: np.ndarray, c: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        trees, out = Forest(len(c)), []
        for gap in range(1, SMALL):
            i = np.flatnonzero(leaf[:-gap] == leaf[gap:]) if gap < len(leaf) else ()
            if not len(i):
                break
            near = i[(sig[i] == sig[i + gap]).mean(axis=1) >= least]
            for a in near.tolist():
                if trees.find(a) != trees.find(a + gap):
                    trees.union(a, a + gap)
                    out.append((a, a + gap))
        a, b = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c[a]), pa.array(c[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 16_384):
                part = batch.slice(at, 16_384)
                new = (part.column("leaf").to_numpy(), part.column("c").to_numpy(), _signature_rows(part))
                now = tuple(np.concatenate(x) for x in zip(kept, new, strict=True)) if kept else new
                whole = now[0] != now[0][-1]  # the last leaf may go on in the next batch
                yield forest(*(x[whole] for x in now))
                kept = tuple(x[~whole] for x in now)
        if kept:
            yield forest(*kept)
        tidy()

    return rows.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, "a long, b long")


def linked(sets: list[np.ndarray], cut: int, percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets: among all if cut is 0,
    else only between the first `cut` and the others. Pairs that are connected
    already, to begin with those of equal numbers in `known`, aren't looked at
    again."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.cumsum(size) - size
    codes = np.unique(flat, return_inverse=True)[1].ravel()
    mark, trees, out = np.zeros(codes.max() + 1, bool), Forest(n), []
    if known:
        first_of: dict[int, int] = {}
        for k, label in enumerate(known):
            trees.union(first_of.setdefault(label, k), k)
    root = np.array([trees.find(k) for k in range(n)])
    for i in range(cut or n):
        first = cut or i + 1
        # roots of earlier rounds merge only downwards, so a stale root costs work, not links
        other = first + np.flatnonzero((root[first:] != root[i]) & (100 * np.minimum(size[first:], size[i]) >= percent * np.maximum(size[first:], size[i])))
        if not len(other):
            continue
        own = codes[starts[i] : starts[i] + size[i]]
        mark[own] = True
        if 4 * len(other) > n:
            common = np.add.reduceat(mark[codes].astype(np.int64), starts)[other]
        else:
            common = np.array([np.count_nonzero(mark[codes[starts[j] : starts[j] + size[j]]]) for j in other])
        mark[own] = False
        hit = other[100 * common >= percent * (size[i] + size[other] - common)]
        for j in hit.tolist():
            if trees.find(i) != trees.find(j):
                trees.union(i, j)
                out.append((i, j))
        if len(hit):
            root = np.array([trees.find(k) for k in range(n)])
    return out


def member_sets(texts: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """c, component, size and the set of each member. members: c, k, h,
    set_key, component, size; texts: doc_id, text. Only rows that a bitmap of
    the members lets through are shuffled, once for each id and text."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_set(t, n) for t in batch.column("text").to_pylist()]
        own = pa.array([set_key(s) == k for s, k in zip(made, batch.column("set_key").to_pylist(), strict=True)])
        out = pa.RecordBatch.from_arrays([batch.column("c"), batch.column("component"), batch.column("size"), pa.array([s.tobytes() for s in made], pa.binary())], ["c", "component", "size", "set"])
        return out.filter(own)

    h = F.xxhash64("text")
    rows = maybe_in(texts, F.xxhash64("doc_id", h), members.select("k"))
    rows = rows.select(F.xxhash64("doc_id", h).alias("k"), h.alias("h"), "text").groupBy("k", "h").agg(F.first("text").alias("text"))
    rows = rows.join(members, ["k", "h"]).select("c", "component", "size", "set_key", "text")
    return map_arrow(rows, sets, "c long, component long, size long, set binary", 256)


def _forests(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that span the links within the rows of each (component, p, q).
    rows: component, p, q, side, c, set, known; sides 0 and 1 are compared with
    each other only, side 2 with all; equal numbers in `known` are connected already."""

    def forest(side: list[int], c: list[int], blobs: list[bytes], known: list[int | None]) -> list[tuple[int, int]]:
        order = sorted(range(len(c)), key=lambda k: (side[k], c[k]))
        order = [k for at, k in enumerate(order) if not at or (side[k], c[k]) != (side[order[at - 1]], c[order[at - 1]])]
        cut = sum(side[k] == 0 for k in order)
        label = [c[k] if known[k] is None else known[k] for k in order]
        if len(set(label)) == 1:
            return []
        found = linked([np.frombuffer(blobs[k], np.uint64) for k in order], cut if cut < len(order) else 0, percent, label)
        return [(c[order[i]], c[order[j]]) for i, j in found]

    def edges_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            columns = [batch.column(k).to_pylist() for k in ("component", "p", "q", "side", "c", "set", "known")]
            found = []
            for comp, p, q, *row in zip(*columns, strict=True):
                if (comp, p, q) != key:
                    if key:
                        found += forest(*held)
                    key, held = (comp, p, q), ([], [], [], [])
                for x, y in zip(held, row, strict=True):
                    x.append(y)
            yield edges_of(found)
        if key:
            yield edges_of(forest(*held))
        tidy()

    return rows.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q").select("component", "p", "q", "side", "c", "set", "known").mapInArrow(run, "a long, b long")


def verified(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that span the links within each candidate group: all of
    them, in two rounds.

    A group of at most BLOCK members is compared by one task. A larger one is
    dealt into blocks, and the same PIVOTS members or so go to each of its blocks:
    what is near to them is connected then. Only what isn't connected with its
    group's largest part by that has to meet the other blocks.
    """
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    blocks = F.ceil(F.col("size") / BLOCK)
    block = F.pmod(F.xxhash64("c"), blocks)
    pivot = F.pmod(F.xxhash64("c", F.lit(7)), F.col("size")) < PIVOTS
    first = sets.select("component", "c", "set", F.explode(F.when((blocks > 1) & pivot, F.sequence(zero, blocks - 1)).otherwise(F.array(block))).alias("p"))
    edges = scratch.save(_forests(first.select("component", "p", zero.alias("q"), F.lit(2).alias("side"), "c", "set", none.alias("known")), percent), "edges-1")
    large = sets.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return edges
    ids = large.select("component", "size", "c")
    parts = components(edges.join(ids.select(F.col("c").alias("a")), "a", "left_semi"), scratch, "parts")
    own = ids.join(parts.select(F.col("vertex").alias("c"), F.col("component").alias("known")), "c", "left").withColumn("known", F.coalesce("known", "c"))
    own = scratch.save(own, "own")
    counted = own.groupBy("component", "known").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    top = counted.groupBy("component").agg(F.max(F.struct("n", (-F.col("known")).alias("least"))).alias("top"), F.first("size").alias("all"))
    # groups of which some members aren't in the largest part, and how many
    split = scratch.save(top.select("component", (-F.col("top.least")).alias("top"), (F.col("all") - F.col("top.n")).alias("rest")).where("rest > 0"), "split")
    if split.isEmpty():
        return edges
    rows = large.join(own.select("c", "known"), "c").join(split, "component")
    rests = F.ceil(F.col("rest") / BLOCK)
    to_rests = rows.select("component", F.explode(F.sequence(zero, rests - 1)).alias("p"), block.alias("q"), F.lit(1).alias("side"), "c", "set", "known")
    to_all = rows.where("known <> top").select("component", F.pmod(F.xxhash64("c", F.lit(1)), rests).alias("p"), F.explode(F.sequence(zero, blocks - 1)).alias("q"), F.lit(0).alias("side"), "c", "set", "known")
    return edges.unionByName(scratch.save(_forests(to_rests.unionByName(to_all), percent), "edges-2"))


def _grouped(texts: DataFrame, words: int, percent: int, recall: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, h, n_shingles and set_key of each row, and set_key, rep and
    component of each class."""
    trees, depth = forest_size(percent, recall)
    table = scratch.save(shingle_table(texts, words, trees * depth), "signatures")
    rows = scratch.save(table.select("doc_id", "h", "n_shingles", "set_key"), "thin")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("of")
    classes = table.where("set_key is not null").groupBy("set_key").agg(least, F.first("sig").alias("sig"), F.first("tokens").alias("tokens"))
    classes = classes.select("set_key", F.col("of.doc_id").alias("rep"), "of.h", "sig", "tokens")
    classes = scratch.save(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    scratch.drop("signatures")
    small, large = leaves(classes, scratch, trees, depth)
    share = percent / 100
    least = share - 4 * (share * (1 - share) / WIDTH) ** 0.5
    edges = scratch.save(compare_leaves(small.join(classes.select("c", "sig"), "c"), least), "edges")
    if not large.isEmpty():
        head = scratch.save(large.groupBy("leaf").agg(F.min("c").alias("b")), "heads")
        edges = edges.unionByName(large.join(head, "leaf").select(F.col("c").alias("a"), "b"))
    group = scratch.save(components(edges, scratch, "candidates"), "groups")
    size = scratch.save(group.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    members = group.withColumnRenamed("vertex", "c").join(size, "component").join(classes.select("c", F.xxhash64("rep", "h").alias("k"), "h", "set_key"), "c")
    members = scratch.save(members, "members")
    sets = scratch.save(member_sets(texts, members, words), "sets")
    found = components(verified(sets, percent, scratch), scratch, "links")
    of_class = classes.select("c", "set_key", "rep").join(found.withColumnRenamed("vertex", "c"), "c", "left")
    of_class = scratch.save(of_class.select("set_key", "rep", F.coalesce("component", "c").alias("component")), "of-class")
    scratch.keep("thin", "of-class")
    return rows, of_class


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document. Linked are
    documents whose sets of `words`-word shingles have a Jaccard similarity of
    at least percent / 100; recall: the chance that two of just that meet."""
    table, of_class = _grouped(texts_of(docs, id_col, text_col), words, percent, recall, Scratch(docs.sparkSession, "near-dedup"))
    named = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(named, "component").select("set_key", "component_id")
    out = table.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """The documents, all columns, one row of each group: of the least id (a
    null id only if there is no other), whatever else has that id; of rows that
    agree in id and text one stays. Rows without shingles are groups of their own."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    table, of_class = _grouped(texts_of(docs), words, percent, recall, scratch)
    rows = table.where("set_key is not null").groupBy("doc_id", "h").agg(F.first("set_key").alias("set_key"), F.count(F.lit(1)).alias("n"))
    rows = scratch.save(rows.join(of_class.select("set_key", "component"), "set_key"), "rows")
    one = scratch.save(rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("one")), "one")
    chosen = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("h") == F.col("one.h"))
    # what goes (0), and what is there several times over (how often); all else stays as it is
    fate = rows.join(one, "component").select(F.col("doc_id").alias("_id"), F.col("h").alias("_of"), F.when(chosen, F.col("n")).otherwise(0).alias("_n"))
    fate = scratch.save(fate.where("_n <> 1").withColumn("_k", F.xxhash64("_id", "_of")), "fate")
    scratch.keep("fate")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    some, others = split_in(docs, F.xxhash64("doc_id", h), fate.select("_k"))
    found = some.withColumn("_h", h).join(fate, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_of")), "left")
    out = found.where("_n is null").select(*docs.columns)
    if others is not None:
        out = others.unionByName(out)
    if fate.where("_n > 1").isEmpty():
        return out
    return out.unionByName(found.where("_n > 1").dropDuplicates(["doc_id", "_h"]).select(*docs.columns))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)


ORACLE = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
    SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
    FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id
    JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id"""
