"""Operator 9: removal of repeated byte strings with a sparse suffix array.

A byte goes if a string of 400 bytes that covers it also starts anywhere else
(BYTES). The same search runs over words (WORDS): a word, a run of bytes other
than ASCII white space, is one symbol, its 64-bit hash, and 51 words in a row
that also start anywhere else go, whatever white space lies between them.

Sorting a suffix for every symbol isn't needed: of every window of unit.length
symbols the gram of unit.gram symbols with the least hash is its anchor, which
depends on the window's content only, so equal windows have their anchors at
the same place.

1. Anchors of all texts are found, each with the windows it stands for. Anchors
   whose gram occurs once stand for windows that occur once, and go.
2. Anchors that agree in the whole stretch of their windows (a 128-bit digest)
   are covered altogether; groups of copies end here, whatever their size.
3. The rest are the borders of passages. Their suffixes are dealt to buckets by
   sampled splitters of their leading bytes, sorted within a bucket by a
   multikey sort on 8-byte numbers, and so are the reversed prefixes. The common
   lengths of neighbours then say for every window whether another one agrees.
4. A gram that very many different borders share is dealt over several buckets;
   the different windows of each are compared across buckets by digest.

Defined results: a null text counts as empty; texts shorter than a window
stay whole; matches don't cross documents; a row repeated with its id is a document
of its own, so both lose what they share; null ids stay null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import mix
from .shared import Scratch, map_arrow, maybe_in, split_in, texts_of, tidy


class Unit(NamedTuple):
    """What is compared: symbols of a window and of a gram, and whether a
    symbol is a word or a byte."""

    length: int
    gram: int
    words: bool

    @property
    def reach(self) -> int:
        return self.length - self.gram

    @property
    def span(self) -> int:
        """A span that begins at b and has n symbols, at most reach + length, is the number b * span + n."""
        return 2 * self.length

    @property
    def kind(self) -> type:
        return np.uint64 if self.words else np.uint8

    def symbols(self, raw: bytes) -> np.ndarray:
        if not self.words:
            return np.frombuffer(raw, np.uint8)
        words = raw.split()
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


#: Operator 9's strings, and passages of over 50 words.
BYTES, WORDS = Unit(400, 100, False), Unit(51, 13, True)
#: Borders of one gram in a bucket, symbols of a text worked on at a time, suffixes sorted at a time.
SPLIT, CHUNK, SORTED = 4096, 1 << 20, 16_384
_random = np.random.default_rng(9)
_OF_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests, two numbers each, of stretches of a text's symbols."""
    view = memoryview(raw.tobytes())
    one = raw.itemsize
    found = b"".join([xxhash.xxh128_digest(view[one * a : one * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, np.uint64).reshape(-1, 2)


class _Sums:
    """Hashes of all grams of a text from sums over its prefixes; they choose anchors and say nothing of equality."""

    _power: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def __init__(self, raw: np.ndarray):
        n = max(len(raw) + 1, 1 << 14)
        if len(self._power[0]) < n:
            _Sums._power = (_powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n))
        power, self.inverse = self._power
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        of_symbol = _OF_BYTE[raw] if raw.dtype == np.uint8 else mix(raw ^ _OF_BYTE[0])
        np.cumsum(of_symbol * power[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """(gram digest, two digests of the stretch, place, first and last window)
    of each anchor of a text; windows are numbered by where they start."""
    parts, length = [], unit.length
    for at in range(0, max(1, len(raw) - length + 1), CHUNK):
        piece = raw[at : at + CHUNK + length - 1]  # the windows that start in this chunk
        if len(piece) < length:
            continue
        place = np.arange(len(piece) - unit.gram + 1)
        gram = _Sums(piece).of(place, place + unit.gram)
        # least hash, leftmost among equals: the place fills the low bits
        keys = gram & ~np.uint64(0x3FFFFF) | place.astype(np.uint64)
        chosen = (_window_minima(keys, unit.reach + 1) & np.uint64(0x3FFFFF)).astype(np.int64)
        begins = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        ends = np.r_[begins[1:], len(chosen)] - 1
        p = chosen[begins]
        span = (p - begins).astype(np.uint64) << np.uint64(32) | (p - ends).astype(np.uint64)
        f = _digests(piece, begins, ends + length)
        parts.append((gram[p], f[:, 0] ^ span * np.uint64(0x9E3779B97F4A7C15), f[:, 1], p + at, begins + at, ends + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(6))


ANCHORS = "doc_id long, h long, gram long, f1 long, f2 long, place long, first long, last long"


def _find_anchors(batch: pa.RecordBatch, unit: Unit) -> pa.RecordBatch:
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    for k, text in enumerate(batch.column("text").to_pylist()):
        found = anchors(unit.symbols(text.encode("utf-8", "surrogatepass")), unit)
        if len(found[0]):
            for column, x in zip(columns, (*found, np.full(len(found[0]), k)), strict=True):
                column.append(x.astype(np.int64))
    if not columns[0]:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 8, ANCHORS.replace(" long", "").split(", "))
    *found, k = (np.concatenate(c) for c in columns)
    rows = pa.array(k)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("h").take(rows), *(pa.array(x) for x in found)], ANCHORS.replace(" long", "").split(", "))


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: by the first word, ties by the next."""
    n, width = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    head = np.r_[True, np.diff(words[order, 0]) != 0] if n else np.zeros(0, bool)
    for k in range(1, width):
        group = np.cumsum(head)
        tied = ~(head & np.r_[head[1:], True])  # rows in groups of two or more
        at = np.flatnonzero(tied)
        if not len(at):
            break
        part = order[at]
        inner = np.lexsort((words[part, k], group[at]))
        order[at] = part[inner]
        value = words[order[at], k]
        new = np.r_[True, (value[1:] != value[:-1]) | (group[at][1:] != group[at][:-1])]
        head[at] |= new
    return order


def _classes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of symbols, and the common length of each with the one before."""
    words = strings
    if strings.dtype == np.uint8:
        padded = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
        padded[:, : strings.shape[1]] = strings
        words = padded.view(">u8").astype(np.uint64)
    order = multikey_order(words)
    differ = strings[order[1:]] != strings[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return order, np.r_[-1, common]


def repeated_windows(left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and offset, whether the window that starts `offset`
    symbols before the anchor agrees with that of another one, and whether it is
    the first of those that agree. left: reversed symbols before the anchors;
    right: symbols from them; offsets from low to high are an anchor's own
    windows."""
    n = len(right)
    out, firsts = np.zeros((n, unit.reach + 1), bool), np.zeros((n, unit.reach + 1), bool)
    (r_order, r_common), (l_order, l_common) = _classes(right), _classes(left)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(unit.reach + 1):
        own = np.flatnonzero((low <= offset) & (offset <= high))
        if len(own) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < unit.length - offset)
        l_class[l_order] = np.cumsum(l_common < offset)
        code = r_class[own] * (n + 1) + l_class[own]
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        out[own[order[1:][same]], offset] = True
        out[own[order[:-1][same]], offset] = True
        firsts[own[order[:-1][same & ~np.r_[False, same[:-1]]]], offset] = True
    return out, firsts


FOUND = "doc_id long, h long, begin long, end long, w1 long, w2 long"


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the runs of a boolean matrix."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _compare(part: pa.Table, unit: Unit) -> pa.RecordBatch:
    """Stretches of repeated windows (end given), and for grams dealt over
    several buckets the digests of the different windows here (w1 given)."""
    place, first, last, parts = (part.column(c).to_numpy() for c in ("place", "first", "last", "parts"))
    low, high = place - last, place - first
    n, blobs = part.num_rows, part.column("bytes").to_pylist()
    left, right = np.zeros((n, unit.reach), unit.kind), np.zeros((n, unit.length), unit.kind)
    for k, (blob, o) in enumerate(zip(blobs, high.tolist(), strict=True)):
        raw = np.frombuffer(blob, unit.kind)
        left[k, :o] = raw[:o][::-1]
        right[k, : len(raw) - o] = raw[o:]
    hit, firsts = repeated_windows(left, right, low, high, unit)
    row, a, b = _runs(hit)
    begin, end = place[row] - b, place[row] - a + unit.length
    w1 = w2 = np.zeros(0, np.int64)
    more, start = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (parts > 1).any():
        offset = np.arange(unit.reach + 1)
        open_ = (~hit | firsts) & (low[:, None] <= offset) & (offset <= high[:, None]) & (parts > 1)[:, None]
        found = []
        for k in np.flatnonzero(open_.any(axis=1)).tolist():
            raw, o = np.frombuffer(blobs[k], unit.kind), np.flatnonzero(open_[k])
            at = high[k] - o
            w = _digests(raw, at, at + unit.length).astype(np.int64)
            found.append((np.full(len(o), k), place[k] - o, w[:, 0], w[:, 1]))
        if found:
            more, start, w1, w2 = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = pa.array(np.r_[row, more])
    empty = lambda k: pa.nulls(k, pa.int64())
    take = lambda c: part.column(c).combine_chunks().take(rows)
    return pa.RecordBatch.from_arrays(
        [take("doc_id"), take("h"), pa.array(np.r_[begin, start]), pa.concat_arrays([pa.array(end), empty(len(more))]), pa.concat_arrays([empty(len(row)), pa.array(w1)]), pa.concat_arrays([empty(len(row)), pa.array(w2)])],
        ["doc_id", "h", "begin", "end", "w1", "w2"],
    )


def _sorted_buckets(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """Compares a sorted bucket in runs of about SORTED suffixes, cut where the
    gram or its part changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SORTED):
            held.append(batch.slice(at, SORTED))
            size += held[-1].num_rows
            if size < SORTED:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("gram").to_numpy() * 64 + table.column("part").to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            if not len(change):
                continue
            cut = int(change[-1]) + 1
            yield _compare(table.slice(0, cut), unit)
            held = table.slice(cut).to_batches()
            size = table.num_rows - cut
    if held:
        yield _compare(pa.Table.from_batches(held), unit)
    tidy()


def repeats(texts: DataFrame, scratch: Scratch, unit: Unit = BYTES) -> DataFrame:
    """doc_id, h, spans (see Unit): stretches that hold every repeated symbol.
    texts: doc_id, text and h, a hash of the text that tells rows of one id apart."""
    found = scratch.save(map_arrow(texts.select("doc_id", "h", "text"), lambda batch: _find_anchors(batch, unit), ANCHORS, 64), "anchors")
    grams = scratch.save(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    found = scratch.save(found.join(grams, "gram"), "repeated")
    scratch.drop("anchors", "grams")
    key = ["gram", "f1", "f2"]
    whole = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "h", "place", "first", "last")))
    whole = scratch.save(whole, "stretches")
    stretch = ["doc_id", "h", F.col("first").alias("begin"), (F.col("last") + unit.length).alias("end")]
    # all stretches less those that occur once, taken from each other where a text's spans meet: a join of all anchors less
    covered = found.select(*stretch, F.lit(False).alias("lone")).unionByName(whole.where("n = 1").select(*stretch, F.lit(True).alias("lone")))
    group = whole.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("gram", "kinds")
    # written, so that the join with it can split what a frequent gram has
    group = scratch.save(group, "kinds")
    border = whole.join(group, "gram").withColumn("parts", F.ceil(F.col("kinds") / SPLIT))
    border = border.withColumn("part", F.pmod(F.xxhash64("f1", "f2"), "parts"))
    wanted = border.groupBy("doc_id", "h").agg(F.collect_list(F.struct("gram", "place", "first", "last", "parts", "part")).alias("at"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, hs, ats = (batch.column(c).to_pylist() for c in ("doc_id", "h", "at"))
        out: list[tuple] = []
        for doc, h, text, at in zip(docs, hs, batch.column("text").to_pylist(), ats, strict=True):
            raw = unit.symbols(text.encode("utf-8", "surrogatepass"))
            for a in at:
                out.append((doc, h, a["gram"], a["place"], a["first"], a["last"], a["parts"], a["part"], raw[a["first"] : a["last"] + unit.length].tobytes(), raw[a["place"] : a["place"] + 16 // raw.itemsize].tobytes()))
        kinds = [pa.int64()] * 8 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "h", "gram", "place", "first", "last", "parts", "part", "bytes", "head"])

    # a text repeated with its id is cut once: its stretches are the same
    wanted = scratch.save(wanted.withColumn("k", F.xxhash64("doc_id", "h")), "wanted")
    once = maybe_in(texts, F.xxhash64("doc_id", "h"), wanted.select("k"))
    once = once.join(wanted.withColumnsRenamed({"doc_id": "id2", "h": "h2"}), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")))
    cuts = map_arrow(once.select("doc_id", "h", "text", "at"), cut, "doc_id long, h long, gram long, place long, first long, last long, parts long, part long, bytes binary, head binary", 64)
    cuts = scratch.save(cuts, "suffixes")
    buckets = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["head", "gram", "part"]
    made = cuts.repartitionByRange(buckets, *order).sortWithinPartitions(*order).drop("head").mapInArrow(lambda batches: _sorted_buckets(batches, unit), FOUND)
    made = scratch.save(made, "compared")
    across = made.where("w1 is not null")
    twice = across.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    across = across.join(twice, ["w1", "w2"]).select("doc_id", "h", "begin", (F.col("begin") + unit.length).alias("end"))
    part = made.where("end is not null").select("doc_id", "h", "begin", "end").unionByName(across)
    return _spans(covered, part, unit)


def _spans(covered: DataFrame, part: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, h and the distinct spans of each text that has any. A span is
    one number, on which Spark's set operations hash; on structs they would
    compare every span with every other."""
    span = F.col("begin") * unit.span + (F.col("end") - F.col("begin"))
    every = covered.unionByName(part.withColumn("lone", F.lit(None).cast("boolean")))
    held = every.groupBy("doc_id", "h").agg(*(F.collect_set(F.when(when, span)).alias(name) for name, when in (("all", F.col("lone") == F.lit(False)), ("lone", F.col("lone")), ("part", F.col("lone").isNull()))))
    return held.select("doc_id", "h", F.array_union(F.array_except("all", "lone"), "part").alias("spans")).where(F.size("spans") > 0)


def _merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _in_bytes(raw: bytes, spans: list[int], unit: Unit) -> list[tuple[int, int]]:
    """Begin and end of the spans in the text; of words, with the white space between them."""
    found = _merge((b, b + n) for b, n in (divmod(s, unit.span) for s in spans))
    if not unit.words or not found:
        return found
    words = [m.span() for m in re.finditer(rb"\S+", raw)]
    return [(words[a][0], words[b - 1][1]) for a, b in found]


def _with_spans(texts: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """texts with `spans0` and so on: for each unit, the stretches of each row in one array (null: none)."""
    texts = texts.withColumn("h", F.xxhash64("text"))
    every = None
    for k, unit in enumerate(units):
        scratch = Scratch(texts.sparkSession, "suffixes")
        spans = scratch.save(repeats(texts, scratch, unit), "spans").withColumn("unit", F.lit(k))
        scratch.keep("spans")
        every = every.unionByName(spans) if every else spans
    of_unit = (F.first(F.when(F.col("unit") == k, F.col("spans")), ignorenulls=True).alias(f"spans{k}") for k in range(len(units)))
    every = every.groupBy(F.col("doc_id").alias("id2"), F.col("h").alias("h2")).agg(*of_unit).withColumn("k", F.xxhash64("id2", "h2"))
    every = Scratch(texts.sparkSession, "suffixes").save(every, "of-texts")
    some, others = split_in(texts, F.xxhash64("doc_id", "h"), every.select("k"))
    joined = some.join(every.drop("k"), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left").drop("id2", "h2", "h")
    if others is None:
        return joined
    none = F.lit(None).cast("array<bigint>")
    return others.drop("h").withColumns({f"spans{k}": none for k in range(len(units))}).unionByName(joined)


def _kept(text: str, *spans: tuple[Unit, list[int] | None]) -> tuple[bytes, list[tuple[int, int]]]:
    raw = text.encode("utf-8", "surrogatepass")
    gone = _merge(x for unit, of in spans for x in _in_bytes(raw, of or [], unit))
    edges = [0, *(x for s in gone for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), gone


def passage_words(spans: list[int] | None, unit: Unit) -> int:
    """Words that spans of a unit of words cover."""
    return sum(b - a for a, b in _merge((b, b + n) for b, n in (divmod(s, unit.span) for s in spans or [])))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, and
    n_passage_words: its words in passages of over 50 words that occur again."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        made = [_kept(t, (BYTES, s)) for t, s in zip(texts, batch.column("spans0").to_pylist(), strict=True)]
        gone = [sum(b - a for a, b in g) for _, g in made]
        passages = [passage_words(s, WORDS) for s in batch.column("spans1").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(k) + g for (k, _), g in zip(made, gone, strict=True)], pa.int64()), pa.array(gone, pa.int64()), pa.array([len(g) for _, g in made], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in made]), pa.array(passages, pa.int64())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"],
        )

    rows = _with_spans(texts_of(docs, id_col, text_col), (BYTES, WORDS)).select("doc_id", "text", "spans0", "spans1")
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long", 128)


def drop_repeats(docs: DataFrame, *units: Unit) -> DataFrame:
    """The documents, all columns, with repeated strings (BYTES, if no units
    are given) taken out of `text` and `n_chars` counted anew. A character cut
    by a border goes altogether."""
    units = units or (BYTES,)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = _with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("others")), units)
    spans = [f"spans{k}" for k in range(len(units))]

    @F.udf("string", useArrow=True)
    def kept(text: str, *found: list) -> str:
        return _kept(text, *zip(units, map(list, found), strict=True))[0].decode("utf-8", "ignore")

    # texts without a repeat don't go through Python
    whole = F.coalesce(*spans).isNull()
    made = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(kept("text", *(F.coalesce(c, F.array().cast("array<bigint>")) for c in spans))))
    made = made.select("doc_id", "text", *(F.col("others")[c].alias(c) for c in others))
    if "n_chars" in others:
        made = made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
