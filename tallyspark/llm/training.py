"""Bounded, seeded samples of labelled rows for the classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], most_chars: int) -> DataFrame:
    """(text, label, key): at most per_class[y] rows that are labelled y and not held out, the first by a hash of their id.

    The sample is bounded by rows and by characters a row (longer and null texts are left out of training, never of scoring).
    The ids are chosen from the labels alone, so the broadcast holds sum(per_class.values()) ids at most.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("id")) & F.col("id").isNotNull()).dropDuplicates(["id"])
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in per_class.items()]
    chosen = reduce(DataFrame.union, parts)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.length("text") <= most_chars)
    return texts.join(F.broadcast(chosen), "id").select("text", "label", F.xxhash64("id", "text").alias("key"))
