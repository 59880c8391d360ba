"""The rows that the mix takes."""

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tallyspark.llm import mixing


def test_mix_emits_what_is_taken(spark):
    rows = [(k, f" w{k} x\ty\n" * 30, s) for k, s in enumerate("abbcccccccccc")] + [(50, None, "a"), (51, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.lit(0).cast("long"))
    mixed = mixing.mix(docs, carry=True)
    assert {r.repetitions for r in mixed.collect()} >= {0, 3}
    text, found = dict((k, t) for k, t, _ in rows), {}
    for r in mixing.emit(mixed).collect():
        found.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == len(r.text) and text[r.doc_id].startswith(r.text)
    for r in mixed.collect():
        got = found.get(r.doc_id, [])
        assert sum(len(t.split()) for t in got) == r.taken and got.count(r.text) == r.repetitions and len(got) <= 3


def test_pipeline_query_emits():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.corpus
