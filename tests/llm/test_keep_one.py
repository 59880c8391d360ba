"""One row of each group, rows without an id too."""

from tallyspark.llm import simhash


def test_keep_one_of_rows_without_id(spark):
    text, other = " ".join(f"w{k}" for k in range(80)), " ".join(f"v{k}" for k in range(80))
    rows = [(None, text), (7, text), (None, text), (3, text), (None, other), (None, other), (9, "a b c d"), (9, "a b c d")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("3", text), ("None", other), ("9", "a b c d")])
