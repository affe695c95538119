"""Bounded samples of labelled documents on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: str = "true") -> DataFrame:
    """doc_id, text, label: of each class the `per_class` documents whose ids
    hash lowest. The bound makes the broadcast below safe at any corpus size.
    Rows without id or label are left out; of several labels of an id the
    greatest counts, and of several texts the one of the least hash.

    where: a condition on doc_id that rows have to meet.
    """
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(where)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = rows.where("label = 1").orderBy(*order).limit(per_class).unionByName(rows.where("label = 0").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return one.select("doc_id", "one.text", "label")
