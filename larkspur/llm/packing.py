"""Operator 4: packing of tokenized documents by linear grouping.

A document's ids are followed by an end id; documents of more than a sequence
are cut, and the pieces are packed whole. The plan is made from the histogram
of piece lengths, which has at most as many rows as a sequence has tokens
whatever the corpus' size:

1. Large lengths are dealt into groups of equal cardinality, and each group is
   rounded up to its largest member.
2. Over these few sizes a linear program (column generation: a knapsack prices
   new configurations) gives how often each configuration of a sequence is to
   be used; the counts are rounded down, the rest is packed best-fit.
3. Actual lengths take the places of the rounded ones, longest first, and
4. the small lengths go best-fit into what is left, then into new sequences;
   sequences that rounding left too empty are opened and packed best-fit.

Sequences of the same content form a run, so that the whole plan is a table of
runs. A piece finds its place by its rank among the pieces of its length; ranks
are counted in salted parts, as many as a length's pieces need. Pieces that
fill a sequence need neither rank nor plan.

Defined results: a null or empty text is a piece that holds only the end id;
null ids stay null; repeated rows are separate documents; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_merge import PairTable, merge_words
from .memory import WIDTH, Memory, Runs, Table, in_places, raw_of
from .shared import Scratch, is_plain, map_arrow, texts_of

#: The word split over lower-cased texts for which is_plain() holds.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
WORDS_AND_ENDS = re.compile(WORDS.pattern + r"|\n")
#: Chunks, longer chunks (to 8 LONG - 1 bytes) and words that a worker remembers, besides as many from before.
CACHE, LONG = 250_000, 9
#: Share of a sequence from which a length counts as large, and the number of groups.
LARGE, GROUPS = 1 / 3, 24


class WordEncoder:
    """Little-endian ids of a text, as the tokenizers library gives them."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = [p.get("behavior") or p.get("use_regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: Only this scheme (lower case, white space dropped) splits as WORDS does.
        self.split = kinds == ["NFC", "Replace", "Lowercase"] and pre == ["Removed", False]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        # longer chunks, which other scripts have, by themselves: their rows are wider
        self.longer = Memory(self._chunks, CACHE, 8 * WIDTH, LONG)
        self.chunks, self.words = Memory(self.longer.each, CACHE), Memory(self._words, CACHE)
        if self.split:
            vocab, pairs = spec["model"]["vocab"], {}
            for rank, merge in enumerate(spec["model"]["merges"]):
                a, b = merge if isinstance(merge, list) else merge.split(" ")
                pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
            self.table = PairTable(pairs)
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
            other = [b for b in range(256) if b not in shown]
            sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(other)}
            end = spec["model"]["end_of_word_suffix"]
            self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int32)
            self.last = np.array([vocab[sign[b] + end] for b in range(256)], np.int32)

    @property
    def known(self) -> Table:
        return self.chunks.known

    @property
    def older(self) -> Table:
        return self.chunks.older

    def _words(self, words: pa.Array) -> Runs:
        """Ids of single words, all merged together."""
        raw, borders = raw_of(words)
        symbols, last = self.inner[raw], borders[1:] - 1
        symbols[last] = self.last[raw[last]]
        ids, n = merge_words(symbols, np.diff(borders), self.table)
        return Runs(ids.astype(np.uint32), np.cumsum(n) - n, n)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """texts: in UTF-8. Nothing of this scheme's split crosses ASCII white
        space, so a text is the sum of its chunks between that."""
        if not self.split:
            return self.whole([t.decode() for t in texts])
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        runs, which = self.chunks.runs(cut.values)
        ids, borders = runs.spread(which)
        flat, ends = ids.astype("<u4", copy=False).tobytes(), (4 * borders[cut.offsets.to_numpy()]).tolist()
        return [flat[a:b] for a, b in pairwise(ends)]

    def _chunks(self, chunks: pa.Array) -> Runs:
        """Ids of chunks, from those of their words."""
        shown = chunks.to_pylist()
        if not self._is_plain("\n".join(shown)):
            plain = np.fromiter(map(self._is_plain, shown), bool, len(shown))
            odd = [np.frombuffer(x, "<u4") for x in self.whole([c for c, p in zip(shown, plain, strict=True) if not p])]
            size = np.fromiter(map(len, odd), np.int64, len(odd))
            parts = [(np.flatnonzero(~plain), Runs(np.concatenate([np.zeros(0, np.uint32), *odd]), np.cumsum(size) - size, size))]
            if plain.any():
                parts.append((np.flatnonzero(plain), self._plain([c for c, p in zip(shown, plain, strict=True) if p])))
            return in_places(parts, len(shown))
        return self._plain(shown)

    def _is_plain(self, text: str) -> bool:
        return is_plain(text) and not any(s in text for s in self.specials)

    def _plain(self, chunks: list[str]) -> Runs:
        # all chunks at once, a line break behind each
        words = pa.array(WORDS_AND_ENDS.findall("\n".join([*chunks, ""]).lower()), pa.large_string())
        ends = pc.equal(words, "\n")
        runs, which = self.words.runs(words.filter(pc.invert(ends)))
        flat, borders = runs.spread(which)
        at = borders[np.flatnonzero(ends) - np.arange(len(chunks))]
        return Runs(flat, np.r_[0, at[:-1]], np.diff(at, prepend=0))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document, of at most `size` tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([end_id], "<u4").tobytes()
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer_path).encode(batch.column("text").cast(pa.binary()).to_pylist()), strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(texts_of(docs, id_col, text_col), run, PIECES, 256)


def _price(sizes: np.ndarray, worth: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest worth: an unbounded knapsack."""
    best = np.zeros(size + 1)
    last = np.full(size + 1, -1)
    for room in range(1, size + 1):
        best[room] = best[room - 1]
        for k, s in enumerate(sizes):
            if s <= room and best[room - s] + worth[k] > best[room] + 1e-12:
                best[room], last[room] = best[room - s] + worth[k], k
    used = np.zeros(len(sizes), np.int64)
    room = size
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            used[last[room]] += 1
            room -= sizes[last[room]]
    return best[size], used


def _simplex(columns: np.ndarray, need: np.ndarray, sizes: np.ndarray, size: int, rounds: int = 200) -> list[tuple[np.ndarray, float]]:
    """Column generation for: fewest configurations that cover need."""
    basis = columns.astype(float)  # one column for each size to begin with
    inverse = np.linalg.inv(basis)
    for _ in range(rounds):
        worth = inverse.sum(axis=0)
        value, column = _price(sizes, worth, size)
        if value <= 1 + 1e-9:
            break
        x, enter = inverse @ need, inverse @ column
        rows = np.flatnonzero(enter > 1e-9)
        if not len(rows):
            break
        out = rows[np.argmin(x[rows] / enter[rows])]
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
    x = inverse @ need
    return [(np.rint(basis[:, j]).astype(np.int64), x[j]) for j in range(len(sizes)) if x[j] > 1e-9]


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Runs (number of sequences, lengths in a sequence) that hold all pieces.

    counts: pieces of each length from 1 to size.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    runs: list[tuple[int, list[int]]] = []
    if size in left:
        runs.append((left.pop(size), [size]))
    large = sorted((n for n in left if n > size * LARGE), reverse=True)
    open_runs: list[tuple[int, tuple[int, ...]]] = []
    if large:
        groups = _groups([(n, left.pop(n)) for n in large])
        open_runs = _configure(groups, size)
    return runs + _mend(_best_fit(open_runs, left, size), size)


def _mend(runs: list[tuple[int, list[int]]], size: int) -> list[tuple[int, list[int]]]:
    """Rounding leaves room in some sequences. Those with more room than a
    bound are opened and their pieces packed best-fit; of a few bounds, the one
    that gives the fewest sequences."""
    best = runs
    for most in (0, 2, 8, 32, 128):
        kept = [r for r in runs if size - sum(r[1]) <= most]
        loose: dict[int, int] = defaultdict(int)
        for c, x in runs:
            if size - sum(x) > most:
                for n in x:
                    loose[n] += c
        other = kept + _best_fit([], loose, size)
        if sum(c for c, _ in other) < sum(c for c, _ in best):
            best = other
    return best


def _groups(large: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in at most GROUPS groups of equal cardinality:
    lists of (length, pieces)."""
    share = -(-sum(c for _, c in large) // GROUPS)
    groups: list[list[tuple[int, int]]] = [[]]
    room = share
    for n, c in large:
        while c:
            if not room:
                groups.append([])
                room = share
            take = min(c, room)
            groups[-1].append((n, take))
            c, room = c - take, room - take
    merged: dict[int, list[tuple[int, int]]] = {}
    for g in groups:  # groups that round up to the same length are one
        merged.setdefault(g[0][0], []).extend(g)
    return list(merged.values())


def _configure(groups: list[list[tuple[int, int]]], size: int) -> list[tuple[int, tuple[int, ...]]]:
    sizes = np.array([g[0][0] for g in groups])
    need = np.array([sum(c for _, c in g) for g in groups], float)
    first = np.diag([max(1, size // s) for s in sizes])
    queues = [[list(x) for x in g] for g in groups]
    runs: list[tuple[int, tuple[int, ...]]] = []
    for column, x in _simplex(first, need, sizes, size):
        slots = [k for k, c in enumerate(column) for _ in range(c)]
        todo = int(x + 1e-6)
        todo = min([todo, *(sum(c for _, c in queues[k]) // column[k] for k in set(slots))])
        while todo > 0:
            # as many sequences as take the same lengths: all slots draw from their groups' fronts
            heads: dict[int, int] = defaultdict(int)
            for k in slots:
                heads[k] += 1
            step, lengths = todo, []
            for k, times in heads.items():
                n, c = queues[k][0]
                if c >= times:
                    step = min(step, c // times)
                    lengths += [n] * times
                else:
                    step = 1
                    front = (n for n, c in queues[k] for _ in range(min(c, times)))
                    lengths += [next(front) for _ in range(times)]
            for k, times in heads.items():
                take = times * step
                while take:
                    used = min(take, queues[k][0][1])
                    queues[k][0][1] -= used
                    take -= used
                    if not queues[k][0][1]:
                        queues[k].pop(0)
                        if not queues[k]:
                            queues[k].append([0, 0])
            runs.append((step, tuple(lengths)))
            todo -= step
    rest: dict[int, int] = defaultdict(int)
    for q in queues:
        for n, c in q:
            if c:
                rest[n] += c
    return [(c, tuple(x)) for c, x in _best_fit(runs, rest, size)]


def _best_fit(runs: list[tuple[int, tuple[int, ...]]], counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over runs: each length goes where least room stays."""
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for c, x in runs:
        by_room[size - sum(x)][x] += c
    for n in sorted(counts, reverse=True):
        todo = counts[n]
        for room in sorted(r for r in by_room if r >= n):
            # the least room first; what is left of it may take the same length again, and has less room still
            while todo and room >= n and by_room[room]:
                x, c = next(iter(by_room[room].items()))
                fits = room // n
                if todo >= fits:
                    used, times = min(c, todo // fits), fits
                else:
                    used, times = 1, todo
                by_room[room][x] -= used
                if not by_room[room][x]:
                    del by_room[room][x]
                by_room[room - n * times][x + (n,) * times] += used
                todo -= used * times
        fits = size // n
        if todo >= fits:
            by_room[size - n * fits][(n,) * fits] += todo // fits
        if todo % fits:
            by_room[size - n * (todo % fits)][(n,) * (todo % fits)] += 1
    return [(c, list(x)) for room in by_room.values() for x, c in room.items() if c]


def places(runs: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), by rank."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for c, lengths in runs:
        at = 0
        for n in lengths:
            out[n].append((ranks[n], sequence, at))
            ranks[n] += c
            at += n
        sequence += c
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


#: Pieces of one length that are ranked together, at least; about how many such parts there are at most, besides one a length.
RANKED, PARTS = 1000, 100_000


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ranked: int = RANKED) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id and the offset there. Full pieces are sequences of their own,
    whose numbers are negative."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(cut_pieces(docs, tokenizer_path, size, end_id, id_col, text_col), "pieces")
    total = {r["length"]: r["count"] for r in pieces.where(F.col("length") < size).groupBy("length").count().collect()}
    ranked = max(ranked, sum(total.values()) // PARTS)
    # parts of each length, so that one has about `ranked` rows; first part of each length in a row of all parts
    parts = np.zeros(size + 1, np.int64)
    for n, count in total.items():
        parts[n] = -(-count // ranked)
    first = np.cumsum(parts) - parts
    of_length = lambda values: F.get(F.from_json(F.lit(str(values.tolist())), "array<bigint>"), F.col("length").cast("int"))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), of_length(parts))
    salted = pieces.where(F.col("length") < size).withColumn("part", of_length(first) + salt)
    # at most as many rows as lengths, and PARTS more
    count = np.zeros(int(parts.sum()), np.int64)
    for r in salted.groupBy("part").count().collect():
        count[r["part"]] = r["count"]
    base = np.cumsum(count) - count
    base -= np.repeat(base[first[parts > 0]], parts[parts > 0])
    table = places(plan(total, size))
    starts = np.zeros(size + 2, np.int64)
    for n, rows in table.items():
        starts[n + 1] = len(rows)
    starts = np.cumsum(starts)
    rows = np.concatenate([table[n] for n in sorted(table)]) if table else np.zeros((0, 3), np.int64)
    # about as many rows as runs times lengths in a sequence, which lengths bound, not pieces
    sent = spark.sparkContext.broadcast((base, starts, rows))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start")) - 1
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, starts, rows = sent.value
        n = batch.column("length").to_numpy()
        rank = base[batch.column("part").to_numpy()] + batch.column("rank").to_numpy()
        # ranks of all lengths in one ascending row: the length in the high bits
        keys = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) << 40 | rows[:, 0]
        at = np.searchsorted(keys, n << 40 | rank, "right") - 1
        put = [pa.array(rows[at, 1] + rank - rows[at, 0], pa.int64()), pa.array(rows[at, 2], pa.int64())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *put], [*names, "sequence_id", "offset"])

    placed = map_arrow(salted.withColumn("rank", rank), place, f"{PIECES}, sequence_id long, offset long", 100_000)
    full = pieces.where(F.col("length") == size).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
