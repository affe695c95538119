"""Operator 8: quality by importance resampling over hashed n-grams.

Two generative models, bags of hashed words and word pairs, are counted: one
over target text (labelled good documents, a bounded sample), one over all raw
text. The log-ratio of a document's likelihoods is its log importance weight.
Adding Gumbel noise, which the document's content seeds, and keeping the k
highest draws k documents without replacement by these weights.

k is fixed before any noise is drawn: it is the number of documents whose
log-ratio reaches the cut that best separates the sample's good from its bad
documents (Youden's index on the labelled rows that set no model), or the share
`keep` of all. Then exactly k rows are kept: a bracket around the k-th key is
narrowed by histograms of CELLS counts, so no task sorts or holds all keys.

Counts are summed over every whole document; the tables have 2**BITS numbers.

Defined results: a null or empty text has log-ratio 0; a null id gets its row;
repeated rows and copies share their noise, and where the k-th key falls among
them the hash of the id decides, then an arbitrary one of rows alike; without
a labelled document of both classes every document is kept; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import hash_words, pairs
from .labelled import sample
from .shared import Scratch, map_arrow, texts_of, tidy

BITS = 16
#: Counts of a histogram in the search for the k-th key.
CELLS = 4096
#: Labelled documents of each class that are learned from: the documented bound.
PER_CLASS = 8000
TOKEN = re.compile(r"\w+|[^\w\s]+")


def grams(text: str) -> np.ndarray:
    """Bucket of every word and word pair of a text."""
    h = hash_words(TOKEN.findall(text.lower()))
    return (np.concatenate([h, pairs(h)]) >> np.uint64(64 - BITS)).astype(np.int64)


def gumbel(text: str, seed: int) -> float:
    """Standard Gumbel noise that depends on the content."""
    u = (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) + 0.5) / 2**64
    return float(-np.log(-np.log(min(max(u, 1e-18), 1 - 1e-16))))


def corpus_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of each bucket over all whole texts: one row of sums from
    each task, added up by bucket before 2**BITS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                texts = batch.column("text").slice(at, 128).to_pylist()
                total += np.bincount(np.concatenate([grams(t) for t in texts]), minlength=1 << BITS)
        tidy()
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


class Model:
    """Log-ratio of each bucket and the cut of the log-ratios that fixes k."""

    def __init__(self, ratio: np.ndarray, cut: float, seed: int):
        self.ratio, self.cut, self.seed = ratio, cut, seed

    def weigh(self, texts: list[str]) -> tuple[list[float], list[float]]:
        """Log importance weights, and the same with noise."""
        ratio = [float(self.ratio[grams(t)].sum(dtype=np.float64)) for t in texts]
        return ratio, [r + gumbel(t, self.seed) for r, t in zip(ratio, texts, strict=True)]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 8) -> Model:
    texts = docs.select("doc_id", "text")
    rows = sample(texts, labels, "quality", per_class)
    spark = docs.sparkSession
    # target text: the good half of the sample whose ids hash to even numbers; the rest sets the cut
    fit_half = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)) == 0
    target = corpus_counts(rows.where("label = 1").where(fit_half)).astype(float)
    if not target.sum():
        return Model(np.zeros(1 << BITS, np.float32), -np.inf, seed)
    raw = corpus_counts(texts).astype(float)
    smooth = 1.0
    ratio = np.log((target + smooth * (raw + 1) / (raw.sum() + len(raw)) * 1000) / (target.sum() + smooth * 1000)) - np.log((raw + 1) / (raw.sum() + len(raw)))
    model = Model(ratio.astype(np.float32), -np.inf, seed)
    sent = spark.sparkContext.broadcast(model)

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(sent.value.weigh(batch.column("text").to_pylist())[0], pa.float64())], ["label", "log_ratio"])

    held = map_arrow(rows.where(~fit_half), weigh, "label int, log_ratio double").toArrow()
    model.cut = best_cut(held.column("log_ratio").to_numpy(), held.column("label").to_numpy())
    return model


def best_cut(keys: np.ndarray, good: np.ndarray) -> float:
    """The lowest cut whose gain (share of good kept less share of bad kept) is
    within a hundredth of the greatest; midway between the neighbouring ratios."""
    if not (good == 1).any() or not (good == 0).any():
        return -np.inf
    order = np.argsort(keys, kind="stable")
    keys, good = keys[order], good[order]
    gain = np.cumsum(good == 0) / (good == 0).sum() - np.cumsum(good == 1) / (good == 1).sum()
    if gain.max() <= 0.01:
        return -np.inf
    at = int(np.argmax(gain >= gain.max() - 0.01))
    return float(keys[at] + keys[min(at + 1, len(keys) - 1)]) / 2


def weights_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(log_ratio, key) of a text column; the model has 2**BITS numbers."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("log_ratio double, key double")
    def weigh(texts: pa.Array) -> pa.Array:
        made = [sent.value.weigh(texts.slice(at, 256).to_pylist()) for at in range(0, len(texts), 256)]
        tidy()
        return pa.StructArray.from_arrays([pa.array([x for m in made for x in m[k]], pa.float64()) for k in (0, 1)], ["log_ratio", "key"])

    return weigh(F.coalesce(text, F.lit("")))


def kth(rows: DataFrame, column: str, k: int) -> tuple[float | int, int]:
    """The k-th greatest value of a numeric column without nulls, and how many
    rows lie above it. 1 <= k <= rows."""
    x, above = F.col(column), 0
    low, high = rows.agg(F.min(x), F.max(x)).first()
    while low < high:
        cell = F.least(F.floor((x - low) * (CELLS / (high - low))).cast("int"), F.lit(CELLS - 1))
        found = rows.where((x >= low) & (x <= high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for cell, n, low, high in sorted(found.collect(), reverse=True):
            if above + n >= k:
                break
            above += n
    return low, above


def top_k(rows: DataFrame, k: int, columns: list[str]) -> Column:
    """Whether a row is among the k greatest by the columns, of which the last
    is different in each row. A column that settles it is the last one used."""
    total = rows.count()
    if k <= 0:
        return F.lit(False)
    if k >= total:
        return F.lit(True)
    value, above = kth(rows, columns[0], k)
    x, same = F.col(columns[0]), rows.where(F.col(columns[0]) == F.lit(value))
    if len(columns) == 1:
        return x >= F.lit(value)
    return (x > F.lit(value)) | ((x == F.lit(value)) & top_k(same, k - above, columns[1:]))


def _draw(docs: DataFrame, labels: DataFrame, per_class: int, seed: int, keep: float | None, id_col: str, text_col: str) -> tuple[DataFrame, Column, list[Column]]:
    """Id, log-ratio, key, tie and row of each document, whether it is drawn,
    and the expressions that make the last three from docs."""
    model = train(texts_of(docs, id_col, text_col), labels, per_class, seed)
    w = weights_column(docs.sparkSession, model, F.col(text_col))
    tie, row = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 2), F.monotonically_increasing_id()
    made = docs.select(F.col(id_col).alias("doc_id"), w.alias("w"), tie.alias("_tie"), row.alias("_row"))
    # numbers only, read several times
    made = Scratch(docs.sparkSession, "quality").save(made.select("doc_id", "w.log_ratio", F.col("w.key").alias("_key"), "_tie", "_row"), "weighed")
    k = made.where(F.col("log_ratio") >= F.lit(model.cut)).count() if keep is None else round(keep * made.count())
    return made, top_k(made, k, ["_key", "_tie", "_row"]), [w["key"].alias("_key"), tie.alias("_tie"), row.alias("_row")]


def resample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 8, keep: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_ratio, noisy key and kept of each document."""
    made, drawn, _ = _draw(docs, labels, per_class, seed, keep, id_col, text_col)
    return made.select("doc_id", "log_ratio", F.col("_key").alias("key"), drawn.alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 8) -> DataFrame:
    """The documents, all columns, that the resampling keeps (see resample):
    exactly k rows, null ids, empty texts and repeated rows among them.
    Keys are made again where the documents are, which costs less than a copy of
    all texts on disk would."""
    _, drawn, made = _draw(docs, labels, per_class, seed, None, "doc_id", "text")
    return docs.select(*docs.columns, *made).where(drawn).select(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
