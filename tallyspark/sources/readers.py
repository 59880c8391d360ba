"""Readers: JSON results, samples, manifests, texts, ground truth, caches. Schemas are given, never inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's checkpoint folder. Where none is set, a temporary one, but in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return (base or tempfile.mkdtemp(prefix="scratch-")).rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """rows, computed once and kept in the shared folder, without their lineage; for results that several parts of a plan read."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def saved(rows: DataFrame) -> DataFrame:
    """rows, computed once and kept in the shared folder as Parquet, of which later parts read the columns that they need; far smaller than stored()."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file. The file's stem is the document's key; a document_type of the outer object is the default of clean_json's."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("document_key", F.regexp_replace(F.col("_metadata.file_name"), r"(_result)?\.json$", ""))
    if "document_type" in rows.columns and "document_type" in rows.schema["clean_json"].dataType.names:
        rows = rows.withColumn("clean_json", F.col("clean_json").withField("document_type", F.coalesce("clean_json.document_type", "document_type")))
    return rows


def samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation samples without those that say success = false; a missing flag counts as true."""
    return spark.read.schema(schema).json(path).where(F.coalesce("success", F.lit(True)))


def manifest(spark: SparkSession, path: str, schema: str, found: DataFrame, key: str) -> DataFrame:
    """Manifest lines whose result exists."""
    return spark.read.schema(schema).json(path).join(found, key)


def with_texts(rows: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """rows with the whole text of their file, '' for a missing file. texts: key, text."""
    return rows.join(texts, key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): every file whole, named without its folder and ending."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("name"), F.col("value").alias("text"))


def keyed_object(spark: SparkSession, path: str, value: str, whole: bool = False) -> DataFrame:
    """JSON objects, document key -> value, a row for each key: one object a line, or a file that is one object (whole)."""
    rows = spark.read.text(path, wholetext=whole).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v"))
    return rows.select("key", "v.*") if isinstance(rows.schema["v"].dataType, T.StructType) else rows


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """rows (key, label) with the label, notes and ambiguous flag of a person's override, where there is one; ids of overrides that no row has are left out."""
    human = overrides.select(key, F.col("label").alias("_label"), "notes", "ambiguous")
    return rows.join(human, key, "left").select(key, F.coalesce("_label", "label").alias("label"), "notes", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def cache(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """A prediction cache: the last row of each key wins."""
    rows = spark.read.schema(schema).json(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def pages_text(pages: Column) -> Column:
    """The markdown of a document's pages, joined by an empty line."""
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p["markdown"], F.lit(""))), "\n\n")
