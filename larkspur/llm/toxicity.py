"""Operator 10: toxicity by FTRL-proximal logistic regression.

Features are the hashed words, word pairs and skip-grams (pairs with one word
between) that a text contains. The model is fitted online, with a learning rate
of its own for each coordinate and an L1 penalty that leaves few weights; these
are broadcast, and every whole text is scored in one pass without a shuffle.

Only text is a feature. Labels are learned from a bounded sample (`per_class`
documents of each class); with `held_out_mod` the documents whose crc32 of the
id in decimal is divisible by it are never learned from.

Defined results: a null text counts as empty, whose score is the model's bias;
a null id counts as not held out; repeated rows each get their row; without a
labelled row of both classes every score is 0; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import hash_words, pairs
from .labelled import sample
from .shared import map_arrow, texts_of, tidy

BITS = 20
#: Labelled documents learned from, of each class: the documented bound.
PER_CLASS = 4000
WORD = re.compile(r"\w+")
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
EPOCHS = 4


def features(text: str) -> np.ndarray:
    """Distinct feature numbers of a text, below 2**BITS."""
    h = hash_words(WORD.findall(text.lower()))
    every = np.concatenate([h, pairs(h, 1), pairs(h, 2)])
    return np.unique(every >> np.uint64(64 - BITS)).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and values of the weights that aren't 0, and the bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 0.0
    for _ in range(epochs):
        for at, y in rows:
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            s = (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA
            z[at] = za + g - s * w
            n[at] = na + g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_n))
    at = np.flatnonzero(np.abs(z) > L1)
    w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
    return at, w, float(bias)


class Model:
    """Weights in a table of 2**BITS numbers."""

    def __init__(self, at: np.ndarray, w: np.ndarray, bias: float, blind: bool = False):
        self.at, self.w, self.bias, self.blind = at, w.astype(np.float32), bias, blind
        self._dense: np.ndarray | None = None

    def __getstate__(self):
        return self.at, self.w, self.bias, self.blind

    def __setstate__(self, state):
        self.at, self.w, self.bias, self.blind = state
        self._dense = None

    def score(self, text: str) -> float:
        if self.blind:
            return 0.0
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.at] = self.w
        return float(1 / (1 + np.exp(-np.clip(self._dense[features(text)].sum(dtype=np.float64) + self.bias, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out_mod: int = 0) -> Model:
    """Fits on executors: features where the texts are, then one task over the
    bounded sample, in the order of the ids' hashes."""
    where = f"crc32(cast(cast(doc_id as string) as binary)) % {held_out_mod} <> 0" if held_out_mod else "true"
    rows = sample(docs, labels, "toxic", per_class, where)

    def featurize(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [features(t).astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(at, pa.binary())], ["doc_id", "label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.frombuffer(a, np.int32).astype(np.int64), y) for b in batches for a, y in zip(b.column("at").to_pylist(), b.column("label").to_pylist(), strict=True)]
        if len({y for _, y in got}) == 2:
            at, w, bias = fit(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int64()), pa.array(np.r_[bias, w], pa.float64())], ["at", "w"])

    small = map_arrow(rows, featurize, "doc_id long, label int, at binary")
    order = (F.xxhash64(F.col("doc_id") + 1), F.col("doc_id"))
    found = small.repartition(1).sortWithinPartitions(*order).mapInArrow(learn, "at long, w double").toArrow()
    if not found.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, blind=True)
    at, w = (found.column(c).to_numpy() for c in ("at", "w"))
    return Model(at[at >= 0], w[at >= 0], float(w[at < 0][0]))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of a text column; a model has at most 2**BITS weights."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        made = [sent.value.score(t) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
        tidy()
        return pa.array(made, pa.float64())

    return score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out_mod: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    texts = texts_of(docs, id_col, text_col)
    model = train(texts, labels, per_class, held_out_mod)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_mod == 0
    scored = texts.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents, all columns, that aren't predicted to be toxic. Rows alike
    in text fare alike; a null or empty text stays unless the bias alone says
    toxic; without labels of both classes all stay."""
    model = train(texts_of(docs), labels, per_class)
    return docs.where(score_column(docs.sparkSession, model, docs["text"]) < 0.5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
