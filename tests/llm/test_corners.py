"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest

import corpus_pipeline
from tallyspark.llm import decontamination, html_text, licenses, mixing, pii, quality_fm, quality_rules, simhash, suffix_dedup, toxicity_crf

LONG = "the word of it and one more " * 40_000
ROWS = [(1, "one two three four five", "en", "a"), (1, "one two three four five", "en", "a"), (2, None, None, None), (None, "x", "de", "b"), (3, "", "en", None), (4, " \t\n", "en", "a"), (5, LONG, "en", "a"), (6, "É 日本   #|", None, "é"), (None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["'x' AS name", "'y' AS id", "1 AS size", "'s' AS score", "2 AS label", "'m' AS row", "3 AS taken", "'t' AS target", "0 AS th", "'k' AS key", "'h' AS hits", "1 AS print", "'r' AS _turn"]


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "one two three"), (2, None), (None, "x"), (3, ""), (4, "the word of it and one more the word of it")], "item_id long, text string")
    return labels, benchmark


def operators(tables):
    labels, benchmark = tables
    return {
        "licenses": licenses.scan,
        "toxicity": lambda docs: toxicity_crf.score(docs, toxicity_crf.train(docs, labels)),
        "suffix": suffix_dedup.remove_repeats,
        "mixing": mixing.mix,
        "simhash": simhash.near_duplicates,
        "pii": pii.detect,
        "decontamination": lambda docs: decontamination.contamination(docs, benchmark),
        "quality": lambda docs: quality_fm.classify(docs, quality_fm.train(docs, labels)),
        "rules": quality_rules.quality_rules,
        "html": lambda docs: html_text.extract(docs.withColumnRenamed("text", "html").withColumnRenamed("source", "url"), id_col="doc_id"),
    }


NAMES = ["licenses", "toxicity", "suffix", "mixing", "simhash", "pii", "decontamination", "quality", "rules", "html"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(spark, tables, name):
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", *CLASH).repartition(3)
    got = [r.asDict() for r in operators(tables)[name](docs).collect()]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    same = [{k: v for k, v in r.items() if k != "x"} for r in got if r["doc_id"] == 1]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, tables, name):
    assert operators(tables)[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_defined_results(spark, tables):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    by = lambda name: {r.doc_id: r for r in operators(tables)[name](docs.where("doc_id IS NOT NULL")).collect()}
    prints = by("simhash")
    assert {prints[k].fingerprint for k in (2, 3, 4)} == {"0" * 16} and {prints[k].component_id for k in (2, 3, 4)} == {2}
    rules = by("rules")
    assert rules[2].base_failed and not rules[2].kept and rules[2].n_words == 0 and rules[6].n_symbols == 2
    assert by("mixing")[3].taken == 0 and by("suffix")[2].n_bytes == 0
    hits = by("decontamination")
    assert hits[1].items == "1" and hits[5].items == "4" and not hits[2].contaminated
    assert 0 <= by("toxicity")[3].score < 0.6 and 0 <= by("quality")[2].score <= 1


def test_pipeline_keeps_nulls_and_columns(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 3) for r in ROWS], SCHEMA + ", n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = docs
    for name, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, str(tmp_path))
        if name != "mix":
            assert stage.columns == docs.columns
            stage = spark.createDataFrame(stage.collect(), docs.schema)
    ids = sorted(str(r.doc_id) for r in stage.collect())
    assert "1" not in ids and len([x for x in ids if x in ("2", "3", "4")]) <= 1
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids


def write_tables(spark, folder, docs, labels=(), items=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_on_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, spark.createDataFrame([], SCHEMA))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == [] and corpus_pipeline.corpus(spark, str(tmp_path)).collect() == []


def test_pipeline_with_clashing_columns(spark, tmp_path):
    """Columns that have the names of inner ones, of the mix's, or a dot."""
    clash = [*CLASH, "9 AS source_size", "8 AS repetitions", "7 AS part", "6 AS _print", "5 AS component_id", "4 AS k", "'b' AS bare", "3 AS h", "2 AS times", "1 AS `a.b`", "0 AS none"]
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(70)), "en", "ab"[k % 2]) for k in range(20)], SCHEMA).selectExpr("*", *clash)
    write_tables(spark, tmp_path, docs.repartition(3), [(1, 1, 0), (2, 1, 0)], [(1, "one two three four five six seven")])
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
    for name, rows in (("run", corpus_pipeline.run(spark, str(tmp_path))), ("corpus", corpus_pipeline.corpus(spark, str(tmp_path)))):
        assert len(set(rows.columns)) == len(rows.columns) and {"size", "taken", "a.b", "_turn", "k"} <= set(rows.columns)
        rows.write.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/{name}").collect()} == set(range(20))


def test_keep_one_of_equal_ids_with_different_texts(spark):
    """Id 5 has a copy of 3's text and one of its own: the copy goes, the other stays, whatever the order of rows."""
    a, b = " ".join(f"w{k}" for k in range(80)), " ".join(f"v{k}" for k in range(80))
    for rows in ([(5, a), (5, b), (3, a), (5, b)], [(5, b), (3, a), (5, b), (5, a)]):
        assert sorted(tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(3, a), (5, b)]
