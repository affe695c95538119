"""Operator 1: SentencePiece BPE encoding and decoding.

Texts are cut into words (a run of word marks and what follows it up to the
next mark); no piece of the vocabulary crosses such a border, so words merge
independently. Each worker keeps a bounded table of the words it has met, and
the new words of a slice of documents are merged together by `bpe_merge`.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to the empty text; a null id stays null; repeated rows each get their
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe_merge import PairTable, merge_words
from .shared import map_arrow, texts_of

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words a worker remembers, about 40 MB.
WORD_CACHE = 150_000


class Codec:
    """Encoder and decoder of one SentencePiece BPE model file."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = proto.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        if model.trainer_spec.model_type != 2 or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with word marks as suffixes are not supported")
        norm = model.normalizer_spec
        self.identity = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.prefix = norm.add_dummy_prefix
        self.n = len(model.pieces)
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.byte_ids = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.text_of = [p.piece.replace(MARK, " ") if p.type == 1 else "" for p in model.pieces]
        self.text_of[self.unk] = model.trainer_spec.unk_surface
        self.byte_of = {j: b for b, j in enumerate(self.byte_ids or [])}
        for j in self.byte_of:
            # bytes above 127 are read together
            self.text_of[j] = chr(self.byte_of[j]) if self.byte_of[j] < 128 else None
        symbols = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        normal = dict(symbols)
        self.free_words = not any(MARK in p.lstrip(MARK) for p in normal)
        for p in normal:  # characters that occur in pieces without being one
            for c in p:
                symbols.setdefault(c, len(symbols) + self.n)
        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank[model.pieces[i].score], i)
        self.table = PairTable(pairs)
        self.first_other = len(symbols) + self.n + 1  # characters in no piece
        self.char = np.arange(0x110000, dtype=np.int32) + self.first_other
        self.char_of = {}
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
                if i >= self.n:
                    self.char_of[i] = s
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.digits = [str(i) for i in range(self.n)]

    def normalize(self, text: str) -> str:
        if not self.identity:
            return self.sp.normalize(text)
        return MARK + text.replace(" ", MARK) if text else ""

    def words(self, text: str) -> list[str]:
        """Words of a text, of which no piece spans two, each without the mark
        that begins it if texts have a dummy prefix."""
        s = self.normalize(text)
        if not s:
            return []
        if not self.free_words:
            return [s[1:] if self.prefix else s]
        if self.prefix and MARK * 2 not in s and s[-1] != MARK:
            return s[1:].split(MARK)
        return [w[self.prefix :] for w in WORDS.findall(s)]

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and ids per word."""
        if self.prefix:
            words = [MARK + w for w in words]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym, lens = merge_words(self.char[points], lens, self.table)
        other = np.flatnonzero(sym >= self.n)
        if not len(other):
            return sym, lens
        spelt = [self._spell(s) for s in sym[other].tolist()]  # characters outside the vocabulary
        more = np.ones(len(sym), np.int64)
        more[other] = [len(x) for x in spelt]
        out = np.repeat(sym, more)
        out[np.repeat(sym >= self.n, more)] = [i for x in spelt for i in x]
        return out, np.bincount(np.repeat(np.arange(len(words)), lens), more, len(words)).astype(np.int64)

    def _spell(self, s: int) -> list[int]:
        c = self.char_of.get(s) or chr(s - self.first_other)
        return [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unk]

    def decode(self, ids: list[int]) -> str:
        """Text of ids, the leading mark of the dummy prefix included."""
        parts = [self.text_of[i] for i in ids]
        if not self.byte_of or None not in parts:
            return "".join(parts)
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i is not None:
                out.append(self.text_of[i])
        return "".join(out)

    def _ids_of(self, cut: list[list[str]]) -> list[np.ndarray]:
        """Ids of each list of words. Words met before are not merged again."""
        if len(self.known) > WORD_CACHE:
            self.known.clear()
            self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        known = self.known
        new = list({w for words in cut for w in words if w not in known})
        if new:
            ids, lens = self._merge(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(lens)]
            self.flat = np.r_[self.flat, ids.astype(np.int32)]
        out = []
        for words in cut:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            start = self.ends[at]
            lens = self.ends[at + 1] - start
            shift = np.cumsum(lens) - lens
            out.append(self.flat[np.repeat(start - shift, lens) + np.arange(lens.sum())])
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        return self._ids_of([self.words(t) for t in texts])

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def text(self, ids: list[int]) -> str:
        """Text of a document's ids: decode() without the dummy prefix."""
        out = self.decode(ids)
        return out[1:] if self.prefix and out[:1] == " " else out


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:  # one sign for each byte that can't be read
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            at += n
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded text of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        use = codec(model_path)
        ids = [x.tolist() for x in use.encode_many(batch.column("text").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(use.text, ids), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(texts_of(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids array<int>, decoded string", 128)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        use = codec(model_path)
        ids = [x.tolist() for x in use.encode_many(batch.column("text").to_pylist())]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([sha(",".join([use.digits[i] for i in x])) for x in ids], pa.string()), pa.array([sha(use.text(x)) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(texts_of(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 128)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
