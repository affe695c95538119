"""Operator 2: token counts through a digest cache.

A count is stored under the digest of the normalised content and the digest of
the tokenizer file, in a Parquet table that can be kept between runs. A run
joins the documents' digests to the stored counts, encodes one text of each
digest that is missing, and appends the new counts.

Only digests and lengths are joined; the texts that cross the network are those
of misses, one per digest and task (the first step of the deduplication runs
before the shuffle, so a text that a third of all rows hold costs one row per
task). Counting a text sums the counts of its pre-tokens, of which each worker
keeps a bounded table; texts with characters outside `shared.PLAIN`, or that
spell a special token, are encoded whole by the library.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null ids
stay null; repeated rows each get their row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, is_plain, map_arrow, texts_of

#: The byte-level split over characters for which is_plain() holds.
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Pre-tokens a worker remembers.
CACHE = 300_000
CACHE_SCHEMA = "content_sha256 string, tokenizer_sha256 string, n_tokens long"


class Counter:
    """Counts as the tokenizers or the sentencepiece library gives them."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
            self.split = False
            return
        import json

        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        lib.no_padding()
        lib.no_truncation()
        self.whole = lambda texts: [len(x.ids) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        #: Only the plain byte-level scheme splits as PRETOKENS does.
        self.split = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def count(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self.whole(texts)
        out = [0] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        rest = []
        for i, t in enumerate(texts):
            if is_plain(t) and not any(s in t for s in self.specials):
                cut.append((i, PRETOKENS.findall(t)))
            else:
                rest.append(i)
        for i, n in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = n
        if len(self.known) > CACHE:
            self.known.clear()
        new = list({w for _, words in cut for w in words if w not in self.known})
        self.known.update(zip(new, self.whole(new), strict=True))
        for i, words in cut:
            out[i] = sum(map(self.known.__getitem__, words))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each document.

    cache_path: the cache's Parquet folder, made if it isn't there; new counts
    are appended to it before this returns.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    keyed = texts_of(docs, id_col, text_col).withColumn("content_sha256", F.sha2("text", 256))
    cache = _read(spark, cache_path).where(F.col("tokenizer_sha256") == version)
    missing = keyed.select("content_sha256", "text").join(cache, "content_sha256", "left_anti")
    missing = missing.groupBy("content_sha256").agg(F.first("text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = counter(tokenizer_path).count(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("content_sha256"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["content_sha256", "tokenizer_sha256", "n_tokens"])

    map_arrow(missing, run, CACHE_SCHEMA, 256).write.mode("append").parquet(cache_path)
    # two runs that append at once may store a digest twice
    counts = _read(spark, cache_path).where(F.col("tokenizer_sha256") == version).groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))
    sized = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_sha256")
    return sized.join(counts, "content_sha256", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _read(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that each run does all of its work."""
    import public_tokenizers

    cache = Scratch(spark, "token-counts").path("cache")
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), cache, 512)
