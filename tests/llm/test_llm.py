"""Each operator against a library, SQL or brute force, and its edge cases."""

import hashlib
import importlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import embeddings, fingerprint, labelled, licences, memory, near_dedup, packing, quality, sentencepiece_codec, shared, suffixes, token_count, toxicity
from larkspur.llm.components import components
from larkspur.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
random.seed(11)
LETTERS = "abcdefgh é日"


def made_text(n):
    return "".join(random.choice(LETTERS) for _ in range(n))


#: null, empty, blank, very long, ties, a row repeated with its id, null ids, odd characters
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "word " * 30_000), (5, "the same text here"), (6, "the same text here"), (6, "the same text here"), (None, "no id at all"), (None, None), (7, "\x00ﬁ日本😀 a² <|endoftext|> <s>"), (8, made_text(900)), (9, "x" * 5000), (-3, "A")]


@pytest.fixture(scope="module")
def edges(spark):
    """The edge rows with columns whose names clash with those that operators make."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    clash = {c: F.lit(1) for c in ("n_tokens", "h", "c", "range", "row", "item", "label", "kept", "digest", "set_key", "spans", "length", "part", "component", "content_sha256")}
    return df.withColumns(clash | {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def as_sorted(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# 1: SentencePiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("which", ["rows", "edges"])
def test_sentencepiece_is_the_library(request, spark, docs, edges, rows, which):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    data, df = (rows, docs) if which == "rows" else (EDGES, edges)
    want = []
    for doc, text in data:
        ids = lib.encode(text or "")
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    got = as_sorted(sentencepiece_codec.digests(df, MODEL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=str)


def test_sentencepiece_random_strings():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_codec.Codec(MODEL)
    texts = ["".join(random.choice(" aabbcdein ▁\n\t\x00é日本語😀İßtherof  ﬁ　Ａ́") for _ in range(random.randrange(80))) for _ in range(400)]
    texts += ["ab" * n for n in (1, 30, 3000)] + [" " * n for n in range(1, 40)] + ["aaaa" * n for n in range(1, 30)]
    for t, ids in zip(texts, own.encode_many(texts), strict=True):
        assert ids.tolist() == lib.encode(t)
        assert own.text(ids.tolist()) == lib.decode(ids.tolist())


# 2: token counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_are_the_library_and_the_cache_is_used(spark, edges, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    want = sorted(((d, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in EDGES), key=str)
    cache = f"file://{tmp_path}/cache"
    got = token_count.count_tokens(edges, BYTES, cache, 512)
    assert as_sorted(got, "doc_id", "n_bytes", "n_tokens") == want
    assert {(r.n_tokens > 512) == r.over_limit for r in got.collect()} == {True}
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in EDGES})
    # nothing is left to encode: a second run reads the stored counts, also false ones
    stored.select("content_sha256", "tokenizer_sha256", F.lit(7).cast("long").alias("n_tokens")).write.parquet(f"{cache}2")
    again = token_count.count_tokens(edges, BYTES, f"{cache}2", 512)
    assert {r.n_tokens for r in again.collect()} == {7}


def test_token_counts_with_sentencepiece(spark, edges, tmp_path):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_count.count_tokens(edges, MODEL, f"file://{tmp_path}/cache", 10)
    assert as_sorted(got, "doc_id", "n_tokens") == sorted(((d, len(lib.encode(t or ""))) for d, t in EDGES), key=str)


# 3: fingerprints


def jaccard(a, b):
    a, b = (Counter(t.lower().split()) or Counter([""]) for t in (a, b))
    every = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in every) / sum(max(a[k], b[k]) for k in every)


def test_fingerprints_estimate_generalised_jaccard(docs, rows):
    ordered, off = sorted(rows), []
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (doc, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        off.append((r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)))
    off = np.array(off)
    assert np.abs(off.mean(axis=0)).max() < 0.02 and off.std(axis=0).max() < 0.09
    by_text = {}
    for doc, text in rows:
        assert by_text.setdefault(text, got[doc].fingerprint) == got[doc].fingerprint


def test_fingerprint_edges(spark, edges):
    got = fingerprint.fingerprints(edges).collect()
    assert len(got) == len(EDGES)
    same = [r.fingerprint for r in got if r.doc_id in (5, 6)]
    assert len(same) == 3 and len(set(same)) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    alone = fingerprint.fingerprints(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == sha("abc " + "abc")


def test_fingerprint_ranges_hold_alike_many_rows(spark):
    """An outlying id, an id that a third of the rows have, and a third without id."""
    rows = spark.range(30_000).withColumn("tie", F.xxhash64("id"))
    k = F.col("id")
    for doc_id in (F.when(k == 0, F.lit(2**62)).otherwise(k), F.when(k % 3 == 0, F.lit(77)).when(k % 3 == 1, F.lit(None)).otherwise(k), F.lit(None).cast("long")):
        df = rows.select(doc_id.alias("doc_id"), "tie")
        of_range, is_first, before = fingerprint.ranges(df, 32)
        sizes = df.groupBy(of_range.alias("range")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_first).alias("first"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("range").collect()
        assert [r.range for r in sizes] == list(range(len(sizes))) and len(sizes) > 24
        assert max(r.n for r in sizes) < 2500 and all(r.first == 1 for r in sizes)
        assert all((a.high or -(2**63)) <= (b.low or 2**63) or b.low is None for a, b in zip(sizes, sizes[1:]) if a.high is not None)


def test_fingerprint_successors_with_hot_and_null_ids(spark, monkeypatch):
    import xxhash

    dice = random.Random(3)
    rows = [(dice.choice([None, 7, 7, dice.randrange(30)]), f"{made_text(12)} {k}") for k in range(120)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42) >> 1, r[1]))
    want = []
    for k, (doc, text) in enumerate(order):
        half = len(text) // 2
        want.append((doc, sha(text[: len(text) - half] + order[(k + 1) % len(order)][1][:half])))
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def test_fingerprints_take_the_least_hash_of_all_occurrences(spark):
    import xxhash

    def h(value, seed=42):
        return xxhash.xxh64_intdigest(value, seed)

    def want(text):
        words = Counter(text.lower().split())
        every = [h(n.to_bytes(8, "little"), h(h(word.encode()).to_bytes(8, "little"))) for word, w in words.items() for n in range(1, w + 1)]
        out = ""
        for k in range(fingerprint.SAMPLES):
            hashes = (h(x.to_bytes(8, "little"), h((k // 2).to_bytes(4, "little"))) for x in every)
            least = min(x >> 32 if k % 2 else x & 0xFFFFFFFF for x in hashes)
            out += f"{h(least.to_bytes(8, 'little')) & 0xFFFF:04x}"
        return out

    rows = [(1, "one two three"), (2, "one one one two"), (3, "ONE " * 300 + "two"), (4, made_text(80))]
    df = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.fingerprint for r in df.collect()} == {doc: want(text) for doc, text in rows}


def test_fingerprints_draw_without_logarithms(docs):
    """Three of them for each sample of each term took most of the time."""
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "xxhash64(" in plan and "ln(" not in plan and "log(" not in plan


def test_fingerprints_are_native(docs):
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 4: packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_word_encoder_is_the_library():
    encoder = packing.WordEncoder(WORD)
    draw = random.Random(4)
    signs = "abcABC éÉßİıΣσςñ̃́ \u0085\u00a0\u3000\x1c\x1d\n\t\r\x0b\x0c|<>'s 12²½٣一가ᄀﬁ…—“$_.,"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    texts += [t[:9] + "<|endoftext|>" + t[9:] for t in texts[::7]] + ["x" * 300 + " a", ""]
    assert [encoder.encode([t.encode()])[0] for t in texts] == encoder.whole(texts)
    assert encoder.encode([t.encode() for t in texts]) == encoder.whole(texts)


def test_word_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    encoder, draw = packing.WordEncoder(WORD), random.Random(5)
    for _ in range(60):
        texts = [" ".join(draw.choice(["some", "Words,", "again.", "éte", made_text(5)]) for _ in range(9)) for _ in range(3)]
        assert encoder.encode([t.encode() for t in texts]) == encoder.whole(texts)
    assert len(encoder.known) <= 60 and len(encoder.older) <= 60


def test_word_encoder_merges_a_word_once(monkeypatch):
    merged = []
    real = packing.merge_words
    monkeypatch.setattr(packing, "merge_words", lambda sym, lens, table: merged.append(len(lens)) or real(sym, lens, table))
    monkeypatch.setattr(packing, "CACHE", 100)
    encoder, draw = packing.WordEncoder(WORD), random.Random(6)
    words = list(dict.fromkeys("".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(240)))
    common, fresh, ends = words[:60], iter(words[60:]), ".?)!;"
    for end in ends:  # the same words in other chunks, with so many new words that the table is full again and again
        text = " ".join(w + end for w in [*common, *(next(fresh) for _ in range(30))])
        assert encoder.encode([text.encode()]) == encoder.whole([text])
    assert sum(merged) == len(common) + 30 * len(ends) + len(ends)


def test_word_encoder_tells_chunks_apart():
    encoder = packing.WordEncoder(WORD)
    # lengths about that of what is remembered; equal beginnings; zero bytes; nothing
    chunks = [c * n + d for most in (8 * memory.WIDTH, 8 * packing.LONG) for n in range(most - 4, most + 3) for c in ("a", "\x00") for d in ("", "b", "\x00", "é")] + ["a", "a\x00", "\x00", "", " "]
    for _ in range(2):
        assert encoder.encode([c.encode() for c in chunks]) == encoder.whole(chunks)
    assert 0 < len(encoder.known) and 0 < len(encoder.longer.known) and len(encoder.known) + len(encoder.longer.known) < len(chunks)


def test_memory_finds_all_in_a_full_table(monkeypatch):
    monkeypatch.setattr(memory.Table, "_slot", lambda self, keys: np.zeros(len(keys), np.int64))  # every key collides
    learnt = []

    def learn(strings):
        learnt.extend(strings.to_pylist())
        values = [np.frombuffer(s.encode(), np.uint8).astype(np.uint32) for s in strings.to_pylist()]
        size = np.array([len(v) for v in values], np.int64)
        return memory.Runs(np.concatenate(values), np.cumsum(size) - size, size)

    store = memory.Memory(learn, 40)
    words = [f"{'x' * (k % 30)}{k}" for k in range(60)]
    for batch in (words[:20], words[:40], words[20:], words[::-1], words[::2]):
        runs, which = store.runs(pa.array(batch * 2, pa.large_string()))
        flat, borders = runs.spread(which)
        assert bytes(flat.astype(np.uint8)).decode() == "".join(batch * 2)
        assert np.diff(borders).tolist() == [len(w) for w in batch * 2]
        assert len(store.known) <= 40 and len(store.older) <= 40
    short = [w for w in learnt if len(w) < 8 * memory.WIDTH]
    assert len(short) == len(set(short))


@pytest.mark.parametrize("which,ranked", [("rows", packing.RANKED), ("edges", packing.RANKED), ("rows", 2), ("edges", 1)])
def test_packing_places_every_piece(docs, edges, rows, which, ranked):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    data, df = (rows, docs) if which == "rows" else (EDGES, edges)
    want = []
    for doc, text in data:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack(df, WORD, ranked=ranked).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(w[3] for w in want)
    assert len(sequences) <= -(-total // 2048) * 1.02 + 2


def test_packing_plan_holds_all_lengths():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = Counter(rng.integers(1, 101, rng.integers(1, 400)).tolist())
        runs = packing.plan(counts, 100)
        held = Counter()
        for n, lengths in runs:
            assert sum(lengths) <= 100
            for x in lengths:
                held[x] += n
        assert held == counts


# 5: licences


def test_licences_are_found_in_other_forms(spark):
    mit = licences.KNOWN[0][1]
    shouted = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace("\n", "\n *  ") + "\nAll rights reserved."
    texts = [(1, mit), (2, shouted), (3, mit + " And more."), (4, "Prose.\nreleased under the mit licence\nLicensed under CC BY-NC 4.0.\nProse."), (5, None)]
    got = {r.doc_id: (r.licence, r.line_licences) for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1][0] == got[2][0] == "MIT" and got[3][0] is None and got[5] == (None, None)
    assert got[4] == (None, "CC-BY-NC-4.0,MIT")


def test_whole_licence_texts_are_found(spark):
    import re
    from pathlib import Path

    folder = Path(licences.__file__).parent / "known_licences"
    texts = {k: (folder / f"{k}.txt").read_text() for k in ("Apache-2.0", "CC-BY-4.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense")}
    rows = list(texts.items()) + [(k, "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", t))) for k, t in texts.items()]
    rows += [("GPL-2.0", texts["GPL-2.0"].partition("END OF TERMS")[0]), ("Apache-2.0", texts["Apache-2.0"].partition("APPENDIX")[0])]
    got = licences.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licence for r in got} == {k: name for k, (name, _) in enumerate(rows)}


def test_licence_edges(edges):
    assert licences.scan(edges).count() == len(EDGES)


# 6: near duplicates


def brute_components(sets, linked):
    n = len(sets)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def byte_shingles(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_maybe_in_keeps_all_of_the_keys(spark):
    rows = spark.range(20_000).withColumn("k", F.xxhash64("id"))
    keys = rows.where("id % 10 = 3").select("k")
    got = [r.id for r in shared.maybe_in(rows, F.col("k"), keys).collect()]
    assert {k for k in range(20_000) if k % 10 == 3} <= set(got) and len(got) == len(set(got)) < 5000
    assert shared.maybe_in(rows, F.col("k"), keys, most=10).count() == 20_000
    assert shared.maybe_in(rows, F.col("k"), keys.where("false")).count() == 0
    some, others = shared.split_in(rows, F.col("k"), keys)
    assert sorted(got + [r.id for r in others.collect()]) == list(range(20_000)) and others.where("id % 10 = 3").isEmpty()


def test_members_of_large_groups_are_linked_across_blocks(spark, tmp_path, monkeypatch):
    """A chain (each links with the next only) besides a crowd of near copies, in one candidate group."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    sets = [np.arange(100 * 3 + k, 100 * 3 + k + 50, dtype=np.uint64) for k in range(0, 200, 8)]
    sets += [np.r_[np.arange(40, dtype=np.uint64), np.array([90 + k], np.uint64)] for k in range(40)]
    sets += [np.arange(1000 + k * 60, 1050 + k * 60, dtype=np.uint64) for k in range(3)]
    rows = [(k, 1, len(sets), s.tobytes()) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "c long, component long, size long, set binary")
    scratch = Scratch(spark, "test")
    got = components(near_dedup.verified(df, 70, scratch), scratch)
    want = brute_components([set(s.tolist()) for s in sets], lambda a, b: 100 * len(a & b) >= 70 * len(a | b))
    found = {r.vertex: r.component for r in got.collect()}
    assert [found.get(k, k) for k in range(len(sets))] == want and len(set(want)) == 5


@pytest.mark.parametrize("small,block,pivots", [(64, 1024, 32), (2, 3, 32), (2, 3, 1)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, small, block, pivots):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    base = [[made_text(4).replace(" ", "x") for _ in range(80)] for _ in range(6)]
    texts = []
    for k in range(90):
        words = list(base[k % 6])
        for _ in range(random.randrange(0, 9)):
            words[random.randrange(80)] = random.choice("pqrs") * 3
        texts.append(" ".join(words))
    texts += ["", None, "one two", "ONE  two", "one two three", texts[0].upper()]
    sets = [byte_shingles(t, 3) for t in texts]
    link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)
    want = [(k, len(s), c, k == c) for k, (s, c) in enumerate(zip(sets, brute_components(sets, link), strict=True))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(df, 3, 85).collect())
    assert got == want


def test_near_duplicate_edges(edges):
    got = near_dedup.near_duplicates(edges, 3, 85).collect()
    assert len(got) == len(EDGES)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].n_shingles == by_id[3].n_shingles == 0 and by_id[6].component_id == 5 and by_id[4].n_shingles == 1


def test_dropping_near_duplicates_leaves_one_row_of_each_group(spark, pipeline):
    dice = random.Random(6)
    made = lambda: " ".join("".join(dice.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    a, b, c, d, e, f = (made() for _ in range(6))
    near = b + " more"
    # rows repeated with their id; null-id copies; a near copy and another text under one id; only null ids; two texts of one set under one id
    rows = [(1, a), (1, a), (1, a), (2, b), (None, b), (None, b), (3, near), (3, c), (None, d), (None, d), (5, e), (5, e.upper()), (6, f), (7, f), (8, None), (8, None), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(pipeline.STAGES)
    got = [tuple(r) for r in stages["near_dedup"](spark, df, SF).collect()]
    five = [r for r in got if r[0] == 5]
    assert len(five) == 1 and five[0][1] in (e, e.upper())
    assert Counter(r for r in got if r[0] != 5) == Counter([(1, a), (2, b), (3, c), (None, d), (6, f), (8, None), (8, None), (None, ""), (None, None)])
    # no survivor is taken for a repeat of another
    after = Counter(r.text for r in stages["suffix_dedup"](spark, stages["near_dedup"](spark, df, SF), SF).collect())
    assert all(after[t] == 1 for t in (a, b, c, d, f)) and len(a) > 400


@pytest.mark.parametrize("percent", [80, 85])
def test_paths_reach_the_stated_recall_at_the_last_depth(percent):
    trees, depth = near_dedup.forest_size(percent)
    dice = np.random.default_rng(percent)
    n = 20_000
    a = dice.integers(0, 2**32, (n, trees * depth), np.uint32)
    b = np.where(dice.random(a.shape) < percent / 100, a, dice.integers(0, 2**32, a.shape, np.uint32))
    met = np.zeros(n, bool)
    for t in range(trees):
        x, y = (near_dedup.paths(s.astype(np.uint16), t, range(depth, depth + 1), depth)[depth] for s in (a, b))
        met |= x == y
    # four standard errors of a share of 0.001
    assert met.mean() >= near_dedup.RECALL - 0.0009


def test_pairs_at_the_threshold_are_found_below_crowded_nodes(spark):
    dice = random.Random(80)
    word = lambda: "".join(dice.choice("abcdefghijklmnop") for _ in range(7))
    common = [word() for _ in range(410)]  # boilerplate: unrelated texts have a similarity just below the threshold
    texts = []
    for _ in range(300):
        own, pair = [word() for _ in range(40)], [word() for _ in range(54)]
        texts += [" ".join(common + own + [word() for _ in range(54)]), " ".join(common + own + pair)]
    sets = [byte_shingles(t, 5) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(0.8 <= alike(k, k + 1) < 0.81 for k in range(0, 600, 2)) and all(alike(0, k) < 0.8 for k in range(2, 600))
    table = near_dedup.shingle_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, np.prod(near_dedup.forest_size(80))).toArrow()
    tokens = near_dedup._token_rows(table.combine_chunks().to_batches()[0])
    crowd = [max(Counter(near_dedup.paths(tokens, t, range(5, 6))[5].tolist()).values()) for t in range(near_dedup.forest_size(80)[0])]
    assert max(crowd) > near_dedup.SMALL
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()}
    found = sum(got[k + 1] == k == got[k] for k in range(0, 600, 2))
    assert found >= 298 and all(got[k] >= k - 1 for k in got)


def test_signature_agreement_is_jaccard():
    a, b = set(range(1000)), set(range(100, 1100))
    h = lambda s: np.unique(near_dedup.mix(np.array(sorted(s), np.uint64) + np.uint64(1)))
    sig = near_dedup.signatures([h(a), h(b)])
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.2


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# 7: embeddings


@pytest.mark.parametrize("tile,block", [(4096, 512), (40, 7)])
def test_embeddings_are_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 24))
    v = [(centre[k % 12] + rng.normal(size=24) * rng.choice([0.02, 0.25, 0.33])).astype(np.float32).tolist() for k in range(240)]
    v += [v[0], v[0], [0.0] * 24, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [], None, [None] * 24, (np.array(v[3]) * 7).tolist()]
    x = [np.array(a, float) if a and None not in a else None for a in v]
    ok = lambda a: a is not None and len(a) == 24 and np.isfinite(a).all() and np.linalg.norm(a) > 0
    link = lambda a, b: ok(a) and ok(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95
    comp = brute_components(x, link)
    want = [(k, sum(link(x[k], x[j]) for j in range(len(x)) if j != k), comp[k], comp[k] == k) for k in range(len(x))]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embeddings.near_duplicates(df, 0.95).collect()) == want


def test_embeddings_of_every_length_are_compared(spark):
    a, b, c = [1.0, 2.0, 3.0], [1.0, 2.0], [5.0]
    rows = [(1, a), (2, a), (3, [2.0, 4.0, 6.1]), (4, b), (5, b), (6, [2.0, 4.1]), (7, [2.0, -1.0]), (8, c), (9, c), (10, [7.0, 0.0, 0.0, 0.0]), (11, [0.0, 0.0]), (12, None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (2, 4), 5: (2, 4), 6: (2, 4), 7: (0, 7), 8: (1, 8), 9: (1, 8), 10: (0, 10), 11: (0, 11), 12: (0, 12)}


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), 0.95).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"), 0.95).first().component_id == 1


# 8, 10: classifiers


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    good, bad, rude = ["river", "stone", "light", "paper", "morning", "window"], ["$$$", "||", "click###", "buy!!!"], ["idiot", "moron"]
    docs, labels = [], []
    for k in range(600):
        quality, toxic = int(k % 4 != 0), int(k % 5 == 0)
        words = [rng.choice(good if quality or rng.random() < 0.3 else bad) for _ in range(rng.randrange(8, 40))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        docs.append((k, " ".join(words)))
        labels.append((k, quality, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_keeps_good_documents(judged):
    got = quality.resample(*judged).join(judged[1], "doc_id").collect()
    assert np.mean([r.kept for r in got if r.quality]) > 0.95 and np.mean([r.kept for r in got if not r.quality]) < 0.1
    assert quality.resample(*judged, keep=0.5).where("kept").count() == 300


def plain_hash(word):
    import xxhash

    return xxhash.xxh64_intdigest(word.encode())


def plain_pair(a, b, gap=1):
    """The hash of two words, with Python's own numbers."""
    m = 2**64 - 1
    h = (a * 0x9E3779B97F4A7C15 + b + gap) & m
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
    return h ^ h >> 31


def test_quality_is_recomputed(spark, judged):
    """Weights, noise, k and the draw in plain Python, over texts of which many are alike."""
    import math
    import re

    import xxhash

    docs = judged[0].unionByName(judged[0].where("doc_id % 50 = 0").select(F.lit(None).cast("long").alias("doc_id"), "text")).unionByName(judged[0].where("doc_id < 9"))
    got = quality.resample(docs, judged[1]).collect()
    texts = {r.doc_id: r.text for r in judged[0].collect()}
    label = {r.doc_id: r.quality for r in judged[1].collect()}

    def buckets(text):
        h = [plain_hash(w) for w in re.findall(r"\w+|[^\w\s]+", text.lower())]
        return [x >> 48 for x in h + [plain_pair(a, b) for a, b in zip(h, h[1:], strict=False)]]

    half = {r.doc_id for r in judged[0].where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(2)) == 0).collect()}
    target = Counter(b for k, t in texts.items() if label[k] == 1 and k in half for b in buckets(t))
    raw = Counter(b for r in docs.collect() for b in buckets(r.text))
    n, all_target = sum(raw.values()) + 2**16, sum(target.values())
    ratio = lambda t: sum(math.log((target[b] + (raw[b] + 1) / n * 1000) / (all_target + 1000)) - math.log((raw[b] + 1) / n) for b in buckets(t))
    held = sorted((ratio(t), label[k]) for k, t in texts.items() if k not in half)
    bad, good = sum(y == 0 for _, y in held), sum(y == 1 for _, y in held)
    gains, b, g = [], 0, 0
    for _, y in held:
        b, g = b + (y == 0), g + (y == 1)
        gains.append(b / bad - g / good)
    at = next(k for k, x in enumerate(gains) if x >= max(gains) - 0.01)
    cut = (held[at][0] + held[at + 1][0]) / 2
    k = sum(ratio(r.text) >= cut for r in docs.collect())
    noise = lambda t: -math.log(-math.log((xxhash.xxh64_intdigest(t.encode(), 8) + 0.5) / 2**64))
    want = {t: (ratio(t), ratio(t) + noise(t)) for t in {r.text for r in docs.collect()}}
    of = {r.doc_id: texts[r.doc_id] for r in got if r.doc_id is not None}
    assert all(abs(r.log_ratio - want[of[r.doc_id]][0]) < 1e-3 and abs(r.key - want[of[r.doc_id]][1]) < 1e-3 for r in got if r.doc_id is not None)
    assert sum(r.kept for r in got) == k
    assert min(r.key for r in got if r.kept) >= max(r.key for r in got if not r.kept)


@pytest.mark.parametrize("cells", [4096, 3])
def test_top_k_is_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(quality, "CELLS", cells)
    dice = np.random.default_rng(8)
    key = np.r_[dice.normal(size=60), np.full(50, 0.25), dice.normal(size=20) * 1e9]
    tie = np.r_[dice.integers(0, 2**62, 80), np.full(50, 2**61 + 1)]
    rows = [(float(a), int(b), k) for k, (a, b) in enumerate(zip(key, tie, strict=True))]
    df = spark.createDataFrame(rows, "key double, tie long, row long").cache()
    for k in (0, 1, 40, 70, 90, 129, 130, 500):
        kept = df.where(quality.top_k(df, k, ["key", "tie", "row"])).collect()
        assert sorted(map(tuple, kept), reverse=True) == sorted(rows, reverse=True)[:k]


def test_toxicity_is_recomputed(spark, judged):
    """FTRL-proximal, one coordinate at a time, in plain Python."""
    import math
    import re

    docs, labels = judged
    rows = labelled.sample(docs, labels, "toxic", 100).orderBy(F.xxhash64(F.col("doc_id") + 1), "doc_id").collect()

    def features(text):
        h = [plain_hash(w) for w in re.findall(r"\w+", text.lower())]
        return {x >> 44 for x in h + [plain_pair(a, b) for a, b in zip(h, h[1:], strict=False)] + [plain_pair(a, b, 2) for a, b in zip(h, h[2:], strict=False)]}

    z, n, bias, bias_n = Counter(), Counter(), 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= 10 else -(z[i] - math.copysign(10, z[i])) / ((1 + math.sqrt(n[i])) + 0.1)
    for _ in range(toxicity.EPOCHS):
        for r in rows:
            own = features(r.text)
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - r.label
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= g / (1 + math.sqrt(bias_n))
    scores = {r.doc_id: 1 / (1 + math.exp(-(sum(map(weight, features(r.text))) + bias))) for r in docs.collect()}
    got = toxicity.toxicity(docs, labels, per_class=100, held_out_mod=10**9).collect()
    assert len(got) == 600 and all(abs(r.score - scores[r.doc_id]) < 1e-4 for r in got)


def test_samples_take_one_text_of_an_id(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, None), (2, None), (None, "c")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    for data in (rows, rows[::-1]):
        got = labelled.sample(spark.createDataFrame(data, "doc_id long, text string").repartition(3), labels, "toxic", 10).collect()
        least = min("ab", key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
        assert sorted((r.doc_id, r.text, r.label) for r in got) == [(1, least, 1), (2, "", 0)]


def test_toxicity_held_out(judged):
    got = toxicity.toxicity(*judged).join(judged[1], "doc_id").where("held_out").collect()
    assert len(got) > 60 and np.mean([r.predicted == r.toxic for r in got]) > 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_classifier_edges(spark, edges, judged):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (judged[1], nothing):
        assert quality.resample(edges, labels).count() == len(EDGES)
        scored = toxicity.toxicity(edges, labels).collect()
        assert len(scored) == len(EDGES) and all(0 <= r.score <= 1 for r in scored)
    assert quality.keep_quality(edges, nothing).columns == edges.columns
    assert toxicity.drop_toxic(edges, nothing).count() == len(EDGES)


def test_samples_are_bounded(judged):
    assert labelled.sample(*judged, "toxic", 10).groupBy("label").count().where("count <> 10").count() == 0


# 9: suffixes


def brute_repeats(rows, length=400):
    seen = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for r in raws:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for (doc, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out.append((doc, len(r), sum(gone), spans, sha(bytes(x for x, y in zip(r, gone, strict=True) if not y))))
    return sorted(out, key=str)


@pytest.mark.parametrize("split,run,chunk", [(4096, 16_384, 1 << 20), (5, 50, 700)])
def test_repeats_are_brute_force(spark, monkeypatch, split, run, chunk):
    monkeypatch.setattr(suffixes, "SPLIT", split)
    monkeypatch.setattr(suffixes, "SORTED", run)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    passages = [made_text(n) for n in (380, 399, 400, 401, 520, 900, 1500, 300)]
    rows = []
    for k in range(150):
        text = made_text(random.randrange(400))
        for _ in range(random.randrange(4)):
            p = random.choice(passages)
            text += p[random.randrange(60) : len(p) - random.randrange(40)] + made_text(random.randrange(300))
        rows.append((k, text))
    rows += [(400, None), (401, ""), (402, "a" * 3000), (403, "ab" * 300), (404, rows[5][1]), (405, rows[6][1][:200] + "x" + rows[6][1][200:]), (7, rows[7][1]), (None, rows[8][1]), (406, "a" * 399), (407, made_text(900) * 2)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute_repeats(rows)


def test_repeat_edges(edges):
    short = [(d, t if t is None or len(t) < 10_000 else t[:3000]) for d, t in EDGES]
    df = edges.withColumn("text", F.when(F.length("text") < 10_000, F.col("text")).otherwise(F.substring("text", 1, 3000)))
    assert as_sorted(suffixes.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(short)
    kept = suffixes.drop_repeats(df)
    assert kept.columns == edges.columns and kept.count() == len(EDGES)


@pytest.mark.parametrize("split,run,chunk", [(4096, 16_384, 1 << 20), (5, 50, 70)])
def test_repeated_passages_of_over_50_words(spark, monkeypatch, split, run, chunk):
    monkeypatch.setattr(suffixes, "SPLIT", split)
    monkeypatch.setattr(suffixes, "SORTED", run)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    dice = random.Random(51)
    words = lambda n: ["".join(dice.choice("abcdé") for _ in range(dice.randrange(1, 6))) for _ in range(n)]
    passages = [words(n) for n in (49, 50, 51, 52, 60, 80, 200)]
    made = []
    for _ in range(80):
        text = words(dice.randrange(40))
        for _ in range(dice.randrange(3)):
            p = dice.choice(passages)
            text += p[dice.randrange(8) : len(p) - dice.randrange(6)] + words(dice.randrange(1, 30))
        made.append(text)
    made += [["b"] * 120, [], passages[3], passages[1]]
    rows = [(k, dice.choice(" \n\t").join(t)) for k, t in enumerate(made)]
    seen = Counter(tuple(t[i : i + 51]) for t in made for i in range(len(t) - 50))
    want = {}
    for k, t in enumerate(made):
        gone = {j for i in range(len(t) - 50) if seen[tuple(t[i : i + 51])] > 1 for j in range(i, i + 51)}
        want[k] = [w for j, w in enumerate(t) if j not in gone]
    assert any(len(want[k]) < len(t) and len(" ".join(t).encode()) < 400 for k, t in enumerate(made))
    got = suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), suffixes.WORDS)
    assert {r.doc_id: r.text.split() for r in got.collect()} == want
    counted = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_passage_words for r in counted.collect()} == {k: len(t) - len(want[k]) for k, t in enumerate(made)}


def test_pipeline_drops_short_passages_of_over_50_words_and_long_strings(spark, pipeline):
    passage, run = " ".join(f"w{k}" for k in range(54)), made_text(450).replace(" ", "x")
    assert len(passage) < 400
    rows = [(1, f"one {passage} end"), (2, f"two {passage} END"), (3, f"three {run} end"), (4, f"four {run} END"), (5, passage.rpartition(" w50")[0])]
    got = {r.doc_id: r.text.split() for r in dict(pipeline.STAGES)["suffix_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert got == {1: ["one", "end"], 2: ["two", "END"], 3: ["threeend"], 4: ["fourEND"], 5: rows[4][1].split()}


# the pipeline


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_pipeline_stages(spark, pipeline, docs):
    at, columns = docs, docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = at.count()
        at = Scratch(spark, "test").save(stage(spark, at, SF), name)
        if k < len(pipeline.STAGES) - 1:
            assert at.columns == columns and 0 < at.count() <= before
        if name == "near_dedup":
            sets = {r.doc_id: byte_shingles(r.text, 5) for r in at.collect()}
            ids = sorted(sets)
            assert not [(a, b) for a in ids for b in ids if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert labels and {"doc_id", "sequence_id", "offset"} <= set(at.columns)


def test_pipeline_over_nothing_and_edges(spark, pipeline, edges):
    empty = edges.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    at = edges
    for _, stage in pipeline.STAGES:
        at = stage(spark, at, SF)
    assert at.count() > 0


def test_empty_tables(spark, edges, tmp_path, judged):
    empty = edges.limit(0)
    for made in (
        sentencepiece_codec.digests(empty, MODEL), token_count.count_tokens(empty, BYTES, f"file://{tmp_path}/c", 512), fingerprint.fingerprints(empty), packing.pack(empty, WORD), licences.scan(empty),
        near_dedup.near_duplicates(empty), quality.resample(empty, judged[1]), suffixes.remove_repeats(empty), toxicity.toxicity(empty, judged[1]),
    ):
        assert made.count() == 0
