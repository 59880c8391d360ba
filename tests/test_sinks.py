"""Writers whose layout readers depend on."""

import os

from pyspark.sql import functions as F

from tallyspark.sources import readers, sinks


def test_object_files_are_one_a_row_in_one_folder(spark, tmp_path):
    rows = spark.range(25).coalesce(1).select(F.lit("other").alias("document_type"), F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "fuel_receipt").alias("document_type")).alias("clean_json"))
    sinks.object_files(rows, f"{tmp_path}/out", size=10)
    files = [f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".json")]
    assert len(files) == 25 and len({f.split("-")[1] for f in files}) == 3  # three tasks
    got = readers.results(spark, f"{tmp_path}/out", "document_type string, clean_json struct<id:string,document_type:string>").select("clean_json.*").collect()
    assert {(r.id, r.document_type) for r in got} == {(str(k), "other" if k % 2 else "fuel_receipt") for k in range(25)} and len(got) == 25
