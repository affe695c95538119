"""Operator 3: document fingerprints by consistent weighted sampling.

A document is a set of terms (lower-cased words) weighted by their counts. As
weights are whole numbers, it is also the set of its occurrences: a term's nth,
for n from 1 to its count. Each of SAMPLES independent samples gives every
occurrence a hash and takes the least one. That hash depends only on the term
and n, and the plain Jaccard similarity of two sets of occurrences is the
generalised one of the weights (sum of least weights by sum of greatest), so
that two documents agree in a sample with the probability of that similarity.
A fingerprint holds 16 bits of each sample.

Everything is a DataFrame expression. Documents are dealt once, by ranges of
doc_id whose borders are approximate quantiles; the first document of each range
also goes to the range before it, where it is the successor of the last. Terms, samples and comparisons then need no further
shuffle, because each step groups by the range and something more.

Defined results: a null text counts as empty, an empty text is one empty term;
null ids come first, ties of doc_id go by a hash of the text and then by text; equal texts have equal
fingerprints; of rows that agree in id and text each gets its row; a sole
document is its own successor; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import texts_of

SAMPLES = 48
#: Document ranges per shuffle partition, and at most.
RANGES, MOST_RANGES = 8, 1 << 14
_OWN = " "  # begins the entries that carry a document's own values; no term holds a space


def ranges(ids: DataFrame, n: int) -> tuple[Column, Column, Column] | None:
    """The range of a row, whether it is among the first of its range, and the
    range before that. ids: doc_id and tie. About n ranges: their borders are
    quantiles of doc_id; an id (or no id) that fills several is dealt by tie.
    The driver sees n numbers."""
    own = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    found = ids.agg(F.percentile_approx(own, F.array(*(F.lit(k / n) for k in range(1, max(2, n)))), F.lit(max(10_000, 20 * n)))).first()[0]
    if found is None:
        return None
    starts, parts = [-(2**63)], [1]
    for value in sorted(set(found)):
        times = found.count(value)
        if value > starts[-1]:
            starts.append(value)
            parts.append(1)
        if times > 1 and value < 2**63 - 1:
            parts[-1] = times
            starts.append(value + 1)
            parts.append(1)
    before = [sum(parts[:k]) for k in range(len(parts))]
    # a search by halves for the last start that isn't greater
    steps = [1 << k for k in reversed(range(len(starts).bit_length()))]
    all_starts, size = _array(starts, "bigint"), F.lit(len(starts))
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step < size) & (F.get(all_starts, at + step) <= own), at + step).otherwise(at))
    share = F.shiftrightunsigned("tie", 32) * (2.0**-32)
    cell = F.get(_array(before, "int"), place) + F.floor(share * F.get(_array(parts, "int"), place)).cast("int")
    # ranges without rows have no number
    first = ids.groupBy(cell.alias("cell")).agg(F.min(F.struct(own.alias("own"), F.shiftrightunsigned("tie", 1).alias("tie"))).alias("first")).orderBy("cell").collect()
    of_cell = [0] * sum(parts)
    for k, row in enumerate(first):
        of_cell[row["cell"]] = k
    of_range = F.get(_array(of_cell, "int"), cell)
    firsts = [_array([row["first"][c] for row in first], "bigint") for c in ("own", "tie")]
    is_first = (own == F.get(firsts[0], of_range)) & (F.shiftrightunsigned("tie", 1) == F.get(firsts[1], of_range))
    return of_range, is_first, F.pmod(of_range - 1, F.lit(len(first)))


def _array(values: list[int], kind: str) -> Column:
    return F.from_json(F.lit(str(values)), f"array<{kind}>")


def sample(occurrence: Column, k: int) -> Column:
    """What sample k minimises: half of a 64-bit hash, each of which serves two samples."""
    h = F.xxhash64(F.lit(k // 2), occurrence)
    return F.shiftrightunsigned(h, 32) if k % 2 else h.bitwiseAND(F.lit(0xFFFFFFFF))


def terms(text: Column) -> Column:
    return F.split(F.trim(F.lower(text)), r"\s+")


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two signatures agree."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(SAMPLES))


def _hex(signature: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next of each document."""
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col).withColumns({"doc_id": F.col("doc_id").cast("long"), "tie": F.xxhash64("text")})
    cut = ranges(texts.select("doc_id", "tie"), min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if cut is None:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    of_range, is_first, before = cut
    own = F.struct(of_range.alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("range"), F.lit(True).alias("guest"))
    dealt = texts.select("doc_id", "text", "tie", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("at")).select("doc_id", "text", "tie", "at.*")
    # ties are in the order of the hash's bits, as their ranges are
    order = Window.partitionBy("range").orderBy("guest", F.asc_nulls_first("doc_id"), F.shiftrightunsigned("tie", 1), "text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = dealt.select("range", "guest", "doc_id", "text", F.row_number().over(order).cast("long").alias("row"), F.lead("text").over(order).alias("next"))
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    rows = rows.select("range", "guest", "doc_id", "row", n.alias("n_chars"), "text", F.when(~F.col("guest"), edited).alias("edited"))
    sha = F.sha2(F.coalesce("edited", F.lit("")), 256)
    # entries with a document's own values travel beside its terms: id, length and four parts of the digest
    carried = [F.coalesce(F.col("doc_id"), F.lit(0)).cast("string"), F.col("n_chars").cast("string"), F.when(F.col("guest"), "2").when(F.col("doc_id").isNull(), "1").otherwise("0")]
    entries = F.array(*(F.concat(F.lit(f"{_OWN}{i}"), v) for i, v in enumerate(carried)), *(F.concat(F.lit(f"{_OWN}{i + 3}"), F.substring(sha, 16 * i + 1, 16)) for i in range(4)))
    versions = F.array(F.struct((F.col("row") * 2).alias("item"), F.concat(terms(F.col("text")), entries).alias("words")), F.struct((F.col("row") * 2 + 1).alias("item"), terms(F.col("edited")).alias("words")))
    words = rows.select("range", F.explode(versions).alias("v")).select("range", "v.item", F.explode("v.words").alias("word"))
    special = F.startswith("word", F.lit(_OWN))
    kind = F.when(special, F.substring("word", 2, 1).cast("long") + 1).otherwise(F.lit(0).cast("long"))
    value = F.when(~special, F.xxhash64("word")).when(kind <= 3, F.substring("word", 3, 20).cast("long"))
    # a part of a digest: 16 hex digits as the bits of a long
    high, low = (F.conv(F.substring("word", at, 8), 16, 10).cast("long") for at in (3, 11))
    value = value.otherwise(F.shiftleft(high, 32).bitwiseOR(low))
    counted = words.select("range", (F.col("item") * 8 + kind).alias("key"), value.alias("term")).groupBy("range", "key", "term").agg(F.count(F.lit(1)).alias("w"))
    occurrences = counted.select("range", "key", "term", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w"))).alias("nth"))
    weighted = occurrences.select("range", F.shiftright("key", 3).alias("item"), F.col("key").bitwiseAND(F.lit(7)).cast("int").alias("kind"), "term", F.xxhash64("term", "nth").alias("occurrence"))
    is_term = F.col("kind") == 0
    minima = [F.min(F.when(is_term, sample(F.col("occurrence"), k))).alias(f"s{k}") for k in range(SAMPLES)]
    values = [F.max(F.when(F.col("kind") == i + 1, F.col("term"))).alias(f"v{i}") for i in range(7)]
    sampled = weighted.groupBy("range", "item").agg(*minima, *values)
    signature = F.array(*(F.xxhash64(f"s{k}").bitwiseAND(F.lit(0xFFFF)) for k in range(SAMPLES)))
    signed = sampled.select("range", "item", *(f"v{i}" for i in range(7)), signature.alias("own"))
    follow = Window.partitionBy("range").orderBy("item")
    signed = signed.withColumns({"of_edited": F.lead("own", 1).over(follow), "of_next": F.lead("own", 2).over(follow)})
    digest = F.lower(F.concat(*(F.lpad(F.hex(f"v{i}"), 16, "0") for i in range(3, 7))))
    return signed.where((F.col("item") % 2 == 0) & (F.col("v2") < 2)).select(
        F.when(F.col("v2") == 0, F.col("v0")).alias("doc_id"),
        F.col("v1").alias("n_chars"),
        digest.alias("edited_sha256"),
        _hex(F.col("own")).alias("fingerprint"),
        _hex(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("of_edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("of_next")).alias("near_next"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
