"""The corpus pipeline: documents that pass the quality classifier, one of each group of near-duplicates, free of benchmark
items, with personal data redacted, and with the words that each gives to the mix of sources.

Every stage works on all rows that its predecessor kept and returns the columns of documents; the last adds the mix's.
run() has one row for each document with what the mix decides; corpus() has the rows that the mix takes.

Null and empty texts are scored, grouped and kept like others. Long texts are read whole. Rows without an id are members of
groups and are kept where no row of their group has one; of rows with equal ids one stays. Empty tables give empty ones.
Further columns are carried through, whatever their names, but for those of the mix's, which win over carried ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontamination, mixing, pii, quality_fm, simhash
from tallyspark.llm.common import cut, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled ones among them, predicts to be good."""
    return quality_fm.keep_good(docs, quality_fm.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found."""
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data and secrets replaced by their kinds."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the repetitions, the part and the words that the mix takes of them."""
    return mixing.mix(docs, carry=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact", redact), ("mix", mix)]
#: No SQL can express the classifier, the fingerprints or the trees; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are cut from their lineage, as a job that writes them would do."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query `pipeline`: run(), with the rows that its mix takes."""
    return mixing.emit(run(spark, sf_dir))
