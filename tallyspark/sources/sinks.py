"""Writers: JSON lines, append-only versions and decisions, resumable predictions, nested reports, state by method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def object_files(rows: DataFrame, path: str, size: int = 1000) -> None:
    """A JSON file for each row, all in one folder. Tasks write about `size` files each and move them into the folder themselves, not the driver one by one."""
    tasks = max(1, -(-rows.count() // size))
    rows.repartition(tasks).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)


def append_versions(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Appends the tables of one run, each row marked with the run; the run itself is published last, so that readers see all tables or none."""
    for name, rows in tables.items():
        rows.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(f"{root}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(run_id,)], "run_id string").write.mode("append").parquet(f"{root}/runs")


def published(spark, root: str, name: str) -> DataFrame:
    """The rows of published runs."""
    return spark.read.parquet(f"{root}/{name}").join(spark.read.parquet(f"{root}/runs").distinct(), "run_id", "left_semi")


def append_decisions(decisions: DataFrame, path: str, before: DataFrame | None) -> DataFrame:
    """Numbers this run of each claim after its last one and appends it; what is stored is never changed."""
    last = before.groupBy("claim_id").agg(F.max("evaluation_seq").alias("last")) if before is not None else None
    rows = decisions.join(last, "claim_id", "left") if last is not None else decisions.withColumn("last", F.lit(None).cast("int"))
    rows = rows.withColumn("evaluation_seq", (F.coalesce("last", F.lit(0)) + 1).cast("int")).drop("last")
    rows.write.mode("append").parquet(path)
    return rows


def append_predictions(rows: DataFrame, path: str) -> None:
    """Resumable: a later run takes what is not here yet under its method and fingerprint."""
    rows.write.mode("append").partitionBy("method", "fingerprint").parquet(path)


def unpredicted(rows: DataFrame, done: DataFrame, key: str, fingerprint: str) -> DataFrame:
    valid = done.where((F.col("fingerprint") == fingerprint) & F.col("error").isNull())
    return rows.join(valid.select(key), key, "left_anti")


def nested_report(documents: DataFrame, by: str, path: str, size: int = 1000) -> None:
    """JSON objects for each `by`, of about `size` documents each: the part's number, a count and the array of its documents, so that no row holds a whole group."""
    rest = [c for c in documents.columns if c != by]
    sizes = documents.groupBy(by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).alias("_parts"))
    rows = documents.join(sizes, by).withColumn("part", F.pmod(F.xxhash64(*rest), F.col("_parts")).cast("int")).drop("_parts")
    rows.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(*rest))).alias("documents")).write.mode("overwrite").json(path)


def replace_methods(rows: DataFrame, path: str) -> None:
    """Replaces the stored rows of the methods in rows, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)


def keyed_objects(rows: DataFrame, path: str, keys: int = 1000) -> None:
    """rows (key, v) as JSON objects, key -> v, of about `keys` keys each, a line for each object: no object holds a whole table."""
    parts = F.pmod(F.xxhash64("key"), F.greatest(F.ceil(F.lit(rows.count()) / keys), F.lit(1)))
    rows.groupBy(parts.alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "v")))).alias("value")).select("value").write.mode("overwrite").text(path)
