"""Queries for categorization and evaluation: nearest-label predictions on embeddings and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions import tables as T
from tallyspark.operators import audit as I
from tallyspark.operators import categorize as C
from tallyspark.operators import evaluate as E
from tallyspark.plans.proxy import VERSIONS, table, versions
from tallyspark.plans.registry import query

_TYPE = "CASE p_partkey % 7 WHEN 0 THEN 'restaurant_bill' WHEN 1 THEN 'hotel_invoice' WHEN 2 THEN 'approval_correspondence' WHEN 3 THEN 'telecom_bill' ELSE 'generic_receipt' END"
_TEXT = "concat(p_name, ' ', CASE p_partkey % 11 WHEN 0 THEN 'chocolate' WHEN 1 THEN 'PETROL pump' WHEN 2 THEN 'Visa fee and hotel' WHEN 3 THEN 'Client: Acme' WHEN 4 THEN 'Team Lunch' WHEN 5 THEN 'jio pack' WHEN 6 THEN 'wireless mouse' ELSE 'sundry' END)"


def _like(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_CASES = " ".join(f"WHEN {_like(words)} THEN '{c}'" for c, words in T.KEYWORDS)
_RULES = f"""CASE WHEN k = 'approval_correspondence' THEN NULL WHEN k = 'restaurant_bill' THEN CASE WHEN {_like(T.CLIENT_HINTS)} THEN 'client_entertainment' WHEN {_like(T.TEAM_HINTS)} THEN 'team_events' ELSE 'travel_meals' END
  WHEN k = 'hotel_invoice' THEN 'accommodation' WHEN k = 'telecom_bill' THEN 'phone_internet' {_CASES} ELSE 'other' END"""
_PARTS = f"(SELECT p_partkey, p_name, {_TYPE} AS k, lower({_TEXT}) AS t FROM part)"


@query("C1_rule_category", f"SELECT p_partkey, {_RULES} AS category FROM {_PARTS}")
def rule_category(spark, d):
    return table(spark, d, "part").select("p_partkey", C.rule_category(F.expr(_TYPE), F.expr(_TEXT))["category"].alias("category"))


@query("C2_rule_keyword", f"SELECT p_partkey, CASE WHEN k = 'generic_receipt' THEN CASE {' '.join(f'WHEN {_like([w])} THEN trim({chr(39)}{w}{chr(39)})' for _, words in T.KEYWORDS for w in words)} END END AS keyword FROM {_PARTS}")
def rule_keyword(spark, d):
    return table(spark, d, "part").select("p_partkey", C.rule_category(F.expr(_TYPE), F.expr(_TEXT))["keyword"].alias("keyword"))


@query("P37_input_text", "SELECT doc_id, md5(concat_ws(' ', source, nullif(left(text, 2000), ''))) AS digest FROM documents")
def input_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(C.input_text(F.col("source"), F.array().cast("array<string>"), F.col("text"))).alias("digest"))


_PRED = """p AS (SELECT 'a' AS method, vec_id AS id, label::VARCHAR AS gold, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN ((label + 1) % 10)::VARCHAR ELSE label::VARCHAR END AS predicted, (vec_id % 10) / 10.0 AS confidence FROM embeddings
  UNION ALL SELECT 'b', vec_id, label::VARCHAR, CASE WHEN vec_id % 5 < 2 THEN '3' ELSE label::VARCHAR END, (vec_id % 4) / 4.0 FROM embeddings),
q AS (SELECT method, id, gold, coalesce(predicted, 'none') AS predicted, confidence FROM p)"""


def predictions(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("gold"), "label")
    wrong = ((F.col("label") + 1) % 10).cast("string")
    a = rows.select(F.lit("a").alias("method"), "id", "gold", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, wrong).otherwise(F.col("gold")).alias("predicted"), (F.col("id") % 10 / 10.0).alias("confidence"))
    b = rows.select(F.lit("b").alias("method"), "id", "gold", F.when(F.col("id") % 5 < 2, "3").otherwise(F.col("gold")).alias("predicted"), (F.col("id") % 4 / 4.0).alias("confidence"))
    return a.unionByName(b)


@query("E1_accuracy", f"WITH {_PRED} SELECT method, count(*) AS n, count(*) FILTER (gold = predicted) AS correct, round(avg((gold = predicted)::INT), 9) AS accuracy FROM q GROUP BY 1")
def accuracy(spark, d):
    return E.accuracy(predictions(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


_PER = """g AS (SELECT method, gold AS label, count(*) AS support, count(*) FILTER (gold = predicted) AS hits FROM q GROUP BY 1, 2), r AS (SELECT method, predicted AS label, count(*) AS given FROM q GROUP BY 1, 2),
m AS (SELECT method, label, coalesce(hits, 0) AS hits, coalesce(support, 0) AS support, coalesce(hits / nullif(given, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM g FULL JOIN r USING (method, label)),
c AS (SELECT method, label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM m)"""


@query("E2_per_class", f"WITH {_PRED}, {_PER} SELECT method, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM c")
def per_class(spark, d):
    return E.per_class(predictions(spark, d)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("E3_macro_f1", f"WITH {_PRED}, {_PER} SELECT method, round(avg(f1), 9) AS macro_f1 FROM c GROUP BY 1")
def macro_f1(spark, d):
    return E.macro_f1(predictions(spark, d)).withColumn("macro_f1", F.round("macro_f1", 9))


@query("E4_confusion", f"WITH {_PRED} SELECT method, gold, predicted, count(*) AS n FROM q GROUP BY ALL")
def confusion(spark, d):
    return E.confusion(predictions(spark, d))


@query("E5_wilson", f"""WITH {_PRED}, a AS (SELECT method, count(*)::DOUBLE AS n, count(*) FILTER (gold = predicted) / count(*)::DOUBLE AS p FROM q GROUP BY 1)
  SELECT method, round(greatest((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0), 9) AS low, round(least((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 1), 9) AS high FROM a""")
def wilson(spark, d):
    low, high = E.wilson(F.col("correct"), F.col("n"))
    return E.accuracy(predictions(spark, d)).select("method", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("E6_paired", f"WITH {_PRED}, j AS (SELECT x.gold = x.predicted AS a, y.gold = y.predicted AS b FROM q x JOIN q y ON x.id = y.id AND x.method = 'a' AND y.method = 'b') SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM j")
def paired(spark, d):
    return E.paired(predictions(spark, d), "a", "b")


@query("E7_decision", f"WITH {_PRED}, a AS (SELECT method, avg((gold = predicted)::INT) AS x, avg((gold = predicted)::INT) FILTER (id % 2 = 0) AS y FROM q GROUP BY 1) SELECT CASE WHEN (SELECT count(*) FROM a WHERE x = (SELECT max(x) FROM a)) = 1 AND (SELECT count(*) FROM a WHERE y = (SELECT max(y) FROM a)) = 1 AND (SELECT method FROM a ORDER BY x DESC LIMIT 1) = (SELECT method FROM a ORDER BY y DESC LIMIT 1) THEN (SELECT method FROM a ORDER BY x DESC LIMIT 1) ELSE 'rules' END AS chosen")
def decision(spark, d):
    right = (F.col("gold") == F.col("predicted")).cast("int")
    metrics = E.labelled(predictions(spark, d)).groupBy("method").agg(F.avg(right).alias("accuracy_all"), F.avg(F.when(F.col("id") % 2 == 0, right)).alias("accuracy_real"))
    return E.decide(metrics)


@query("E8_error_groups", f"WITH {_PRED}, g AS (SELECT method, gold, predicted, count(*) AS n FROM q WHERE gold <> predicted GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY n DESC, gold, predicted) AS place FROM g) SELECT method, gold, predicted, n, place::INT AS place, id FROM q JOIN o USING (method, gold, predicted)")
def error_groups(spark, d):
    """Every wrong prediction with its group, the largest first."""
    return E.error_members(predictions(spark, d)).select("method", "gold", "predicted", "n", "place", "id")


@query("O5_largest_error", f"WITH {_PRED}, e AS (SELECT method, gold, predicted, count(*) AS n FROM q WHERE gold <> predicted GROUP BY ALL) SELECT method, gold, predicted, n FROM e QUALIFY row_number() OVER (PARTITION BY method ORDER BY n DESC, gold DESC, predicted DESC) = 1")
def largest_error(spark, d):
    return E.error_groups(predictions(spark, d)).groupBy("method").agg(F.max(F.struct("n", "gold", "predicted")).alias("t")).select("method", "t.gold", "t.predicted", "t.n")


@query("E9_what_if", f"WITH {_PRED}, e AS (SELECT method, gold, predicted, count(*) AS n FROM q WHERE gold <> predicted GROUP BY ALL), t AS (SELECT method, max(n) AS flipped FROM e GROUP BY 1) SELECT method, flipped, round((count(*) FILTER (gold = predicted) + flipped) / count(*), 9) AS accuracy FROM q JOIN t USING (method) GROUP BY method, flipped HAVING flipped >= 3")
def what_if(spark, d):
    return E.what_if(predictions(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@query("E10_slices", f"WITH {_PRED} SELECT s AS slice, method, count(*) AS n, count(*) FILTER (gold = predicted) AS correct FROM (SELECT *, unnest(['all', CASE WHEN id % 3 = 0 THEN 'real' ELSE 'synthetic' END]) AS s FROM q) GROUP BY ALL")
def slices(spark, d):
    rows = E.labelled(predictions(spark, d)).withColumn("slice", F.explode(F.array(F.lit("all"), F.when(F.col("id") % 3 == 0, "real").otherwise("synthetic"))))
    return rows.groupBy("slice", "method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("correct"))


@query("F6_real_slice", f"WITH {_PRED} SELECT method, id FROM q WHERE id % 3 = 0 AND gold IS NOT NULL")
def real_slice(spark, d):
    return predictions(spark, d).where("gold IS NOT NULL AND id % 3 = 0").select("method", "id")


@query("E11_field_scores", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NULL AND b IS NULL THEN 'both_absent' WHEN abs(a - b) < 1 THEN 'match' ELSE 'mismatch' END AS score FROM (SELECT *, CASE WHEN l_partkey % 5 > 0 THEN l_quantity::DECIMAL(12,2) END AS a, CASE WHEN l_partkey % 5 > 0 AND l_partkey % 3 > 0 THEN l_quantity::DECIMAL(12,2) + l_linenumber * 0.3 END AS b FROM lineitem)")
def field_scores(spark, d):
    a = F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity").cast("decimal(12,2)"))
    b = F.when((F.col("l_partkey") % 5 > 0) & (F.col("l_partkey") % 3 > 0), F.col("l_quantity").cast("decimal(12,2)") + F.col("l_linenumber").cast("decimal(10,0)") * F.lit("0.3").cast("decimal(2,1)"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", E.score_field(a, b).alias("score"))


@query("E12_match_items")
def match_items(spark, d):
    """Part names of orders against the same names with some words cut or missing."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("p_name").alias("name"))
    return E.match_items(one, one.where("pos % 3 > 0").withColumn("name", F.expr("CASE WHEN pos % 2 = 0 THEN substr(name, 3) ELSE reverse(name) END")))


@query("P40_similarity")
def similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", E.similarity(F.col("p_name"), F.concat(F.substring("p_name", 4, 30), F.lit("x"))).alias("similarity"))


_SCORED = "(SELECT event_id % 6 > 0 AS ok, user_id % 3 AS m, event_id % 2 AS s, event_id % 5 AS x, CASE WHEN event_id % 3 > 0 THEN event_id % 700 END AS tokens, (user_id % 40)::DOUBLE / 10 AS sec, event_type AS t FROM events)"


def _scored(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select((k % 6 > 0).alias("success"), (F.col("user_id") % 3).alias("matched"), (k % 2).alias("missed"), (k % 5).alias("extra"), F.when(k % 3 > 0, k % 700).alias("total_tokens"), ((F.col("user_id") % 40) / 10).alias("seconds"), F.col("event_type").alias("document_type"))


@query("E13_pooled", f"SELECT count(*) AS samples, count(*) FILTER (ok) AS succeeded, sum(m) FILTER (ok)::BIGINT AS matched, sum(s) FILTER (ok)::BIGINT AS missed, sum(x) FILTER (ok)::BIGINT AS extra, count(*) FILTER (ok AND m + x = 0) AS zero_extracted, round(avg(coalesce(tokens, 0)) FILTER (ok), 6) AS mean_tokens, round(avg(sec) FILTER (ok), 6) AS mean_seconds, round(sum(m) FILTER (ok) / (sum(m) FILTER (ok) + sum(x) FILTER (ok)), 9) AS precision, round(sum(m) FILTER (ok) / (sum(m) FILTER (ok) + sum(s) FILTER (ok)), 9) AS recall FROM {_SCORED}")
def pooled(spark, d):
    return E.pooled(_scored(spark, d)).withColumns({c: F.round(c, n) for c, n in (("precision", 9), ("recall", 9), ("mean_tokens", 6), ("mean_seconds", 6))})


@query("E13_type_counts", f"SELECT t AS document_type, count(*) AS n, t IN ('purchase', 'view') AS plausible FROM {_SCORED} WHERE ok GROUP BY 1")
def type_counts(spark, d):
    return E.type_counts(_scored(spark, d), ["purchase", "view"])


@query("E17_pairs", """WITH c AS (SELECT *, c_acctbal::DECIMAL(12,2)::VARCHAR AS bal FROM customer) SELECT c_custkey AS doc, p[1]::INT AS pos, p[2]::INT AS n, p[3] AS key, p[4] AS value FROM (SELECT *, unnest([(0, 0, 'Segment', c_mktsegment), (1, 0, 'Name', c_name), (4, 0, 'Phone', '| Balance | ' || bal || ' |'), (6, 0, 'Nation', c_nationkey::VARCHAR),
  (8, 0, 'Total', bal || '  Due Date: 1 May   Ref: R' || c_custkey), (8, 1, 'Total', bal), (8, 2, 'Due Date', '1 May'), (8, 3, 'Ref', 'R' || c_custkey), (9, 0, 'Key one', '**Key two**'), (11, 0, 'Key three', 'end: of it')]) AS p FROM c)""")
def pairs(spark, d):
    """Every form: a value in bold, keys alone whose values follow, one of them a table row, table rows, plain and inline pairs, a run of keys."""
    bal = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    lines = F.array(
        F.concat(F.lit("**Segment**: "), "c_mktsegment"), F.lit("* **Name**:"), F.lit(" "), F.col("c_name"), F.lit("**Phone**"), F.concat(F.lit("| Balance | "), bal, F.lit(" |")), F.concat(F.lit("| Nation | "), F.col("c_nationkey").cast("string"), F.lit(" |")), F.lit("|---|---|"),
        F.concat(F.lit("Total: "), bal, F.lit("  Due Date: 1 May   Ref: R"), F.col("c_custkey").cast("string")), F.lit("**Key one**"), F.lit("**Key two**"), F.lit("**Key three**:"), F.lit("end: of it"), F.lit("**last**"),
    )
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.posexplode(lines).alias("pos", "line"))
    return E.pairs_of_lines(rows)


@query("E19_corpus_summary", "SELECT count(*) AS documents, sum(t)::BIGINT AS pairs, round(sum(c) / sum(t), 9) AS accuracy, round(sum(f) / sum(t), 9) AS value_recall, count(*) FILTER (c = t) AS all_correct, round(count(*) FILTER (c = t) / count(*), 9) AS all_correct_share FROM (SELECT event_id % 4 AS t, least(user_id % 4, event_id % 4) AS c, least(user_id % 4 + 1, event_id % 4) AS f FROM events) WHERE t > 0")
def corpus_summary(spark, d):
    most = lambda c: F.least(c, F.col("event_id") % 4)
    scores = table(spark, d, "events").select(F.col("event_id").alias("doc"), most(F.col("user_id") % 4).alias("correct"), most(F.col("user_id") % 4 + 1).alias("found"), (F.col("event_id") % 4).alias("total"))
    return E.corpus_summary(scores).withColumns({c: F.round(c, 9) for c in ("accuracy", "value_recall", "all_correct_share")})


@query("E20_sanity", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 9 = 0 OR abs(l_discount::DECIMAL(4,2) - l_tax::DECIMAL(4,2)) > 0.01")
def sanity(spark, d):
    found, printed = F.when(F.col("l_partkey") % 9 > 0, F.col("l_discount").cast("decimal(4,2)")), F.col("l_tax").cast("decimal(4,2)")
    return table(spark, d, "lineitem").where(found.isNull() | (F.abs(found - printed) > 0.01)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("E21_contract", "SELECT 'missing text' AS check, count(*) FILTER (text IS NULL) AS problems FROM documents UNION ALL SELECT 'missing source', count(*) FILTER (source IS NULL) FROM documents UNION ALL SELECT 'domain lang', count(*) FILTER (lang NOT IN ('en', 'de', 'fr')) FROM documents UNION ALL SELECT 'domain source', count(*) FILTER (source NOT IN ('src0', 'src1', 'src2')) FROM documents UNION ALL SELECT 'repeated doc_id', count(*) - count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'few source', count(*) FROM (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) < 60)")
def contract(spark, d):
    """Required values, unique ids, domains, and categories with too few rows."""
    return I.contract(table(spark, d, "documents"), "doc_id", ["text", "source"], {"lang": ["en", "de", "fr"], "source": ["src0", "src1", "src2"]}, "source", 60)


@query("E22_freeze_guard", "SELECT bool_or(quality = 1) AS frozen, bool_and(quality = 1) AS complete FROM labels")
def freeze_guard(spark, d):
    return table(spark, d, "labels").agg(F.bool_or(F.col("quality") == 1).alias("frozen"), F.bool_and(F.col("quality") == 1).alias("complete"))


@query("C3_classifier")
def classifier(spark, d):
    """Fitted on four fifths of the vectors, scored on the rest."""
    rows = table(spark, d, "embeddings")
    model = C.train_classifier(rows.where("vec_id % 5 > 0"), "embedding", "label")
    return C.classify(model, rows.where("vec_id % 5 = 0"), "embedding").select("vec_id", "label", "predicted", "confidence")


@query("C5_training_run")
def training_run(spark, d):
    """Leak filter, split, weighted fit, report, refit and a stored model in one job; a fifth of the vectors is the evaluation set."""
    from tallyspark.sources import readers

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return C.training_run(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), "v", "label", f"{readers.scratch(spark)}/model", limit=0.4)[0]


@query("C4_hybrid", f"WITH {_PRED} SELECT x.id, CASE WHEN x.confidence >= 0.3 THEN x.predicted ELSE y.predicted END AS category, CASE WHEN x.confidence >= 0.3 THEN 'classifier' ELSE 'fallback' END AS method FROM p x JOIN p y ON x.id = y.id AND x.method = 'a' AND y.method = 'b'")
def hybrid(spark, d):
    p = predictions(spark, d).withColumnRenamed("predicted", "category")
    return C.hybrid(p.where("method = 'a'").select("id", "category", "confidence"), p.where("method = 'b'").select("id", "category"))


@query("C5_split", "SELECT vec_id, label, CASE WHEN percent_rank() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) < 0.8 THEN 'train' ELSE 'test' END AS part FROM embeddings")
def split(spark, d):
    return C.stratified_split(table(spark, d, "embeddings"), "label", "vec_id").select("vec_id", "label", "part")


@query("C5_class_weights", "SELECT label, round((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)), 9) AS weight FROM embeddings GROUP BY 1")
def class_weights(spark, d):
    return C.class_weights(table(spark, d, "embeddings"), "label").withColumn("weight", F.round("weight", 9))


@query("C6_threshold_sweep", f"WITH {_PRED}, s AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (confidence::DOUBLE >= threshold) AS covered, round(avg((confidence::DOUBLE >= threshold)::INT), 9) AS coverage, round(avg((gold = predicted)::INT) FILTER (confidence::DOUBLE >= threshold), 9) AS accuracy FROM q, s WHERE method = 'a' GROUP BY 1")
def threshold_sweep(spark, d):
    rows = E.labelled(predictions(spark, d)).where("method = 'a'")
    return E.threshold_sweep(rows, [k / 10 for k in range(1, 10)]).withColumns({c: F.round(c, 9) for c in ("coverage", "accuracy")})


@query("J13_leaks", "SELECT a.vec_id AS train_id, b.vec_id AS held_id FROM embeddings a JOIN embeddings b ON a.vec_id % 5 > 0 AND b.vec_id % 5 = 0 WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.25")
def leaks(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return C.cosine_leaks(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), limit=0.25).select("train_id", "held_id")


@query("C8_carried_category", f"WITH {VERSIONS} SELECT a.document_id, b.category, CASE WHEN a.category = b.category THEN a.confidence END AS confidence, CASE WHEN a.category = b.category THEN 'rules' ELSE 'employee' END AS method FROM versions a JOIN versions b ON a.document_id = b.document_id AND a.version = 1 AND b.version = 2")
def carried_category(spark, d):
    """The second version of a document carries its category on, or the employee's."""
    rows = versions(spark, d)
    a = rows.where("version = 1").select("document_id", F.col("category").alias("before"), "confidence")
    b = rows.where("version = 2").select("document_id", F.col("category").alias("after"))
    return a.join(b, "document_id").select("document_id", C.carried(F.col("before"), F.col("confidence"), F.lit("rules"), F.col("after")).alias("c")).select("document_id", "c.*")


query("J12_item_matches")(match_items)


@query("E14_menu_items", """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_name, floor(p_retailprice)::BIGINT::VARCHAR AS price FROM part)
  SELECT p_partkey, 0 AS pos, NULL::INT AS sub, p_name AS nm, price, CASE WHEN k = 0 THEN '1' END AS cnt FROM p WHERE k < 3 UNION ALL SELECT p_partkey, 1, NULL, NULL, '7', '2' FROM p WHERE k = 1
  UNION ALL SELECT p_partkey, 0, 0, 'sub ' || p_partkey, NULL, NULL FROM p WHERE k IN (2, 3) UNION ALL SELECT p_partkey, 0, 1, NULL, price, NULL FROM p WHERE k = 3""")
def menu_items(spark, d):
    """Menus of a part: an object, an array with a nameless entry, an entry with one sub-item, an empty entry with two, and no menu."""
    name, price, key = F.col("p_name"), F.floor("p_retailprice").cast("string"), F.col("p_partkey").cast("string")
    own = F.concat(F.lit('"nm":"'), name, F.lit('","price":"'), price, F.lit('"'))
    sub = F.concat(F.lit('{"nm":"sub '), key, F.lit('"}'))
    kinds = F.array(F.concat(F.lit("{"), own, F.lit(',"cnt":1}')), F.concat(F.lit("[{"), own, F.lit('},{"price":7,"cnt":"2"},{"cnt":3},"x"]')), F.concat(F.lit("[{"), own, F.lit(',"sub":'), sub, F.lit("}]")), F.concat(F.lit('{"sub":['), sub, F.lit(',{"price":'), price, F.lit("}]}")), F.lit('"none"'))
    rows = table(spark, d, "part").select("p_partkey", F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("menu"))
    return E.menu_items(rows, "p_partkey", "menu")


@query("E15_amount_like", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN l_quantity ELSE l_extendedprice END::DECIMAL(20,4) AS total FROM lineitem")
def amount_like(spark, d):
    """The named field, else the first further field whose key holds the name."""
    named = F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity").cast("decimal(20,4)"))
    entries = F.array(F.struct(F.lit("Grand Total").alias("key"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("value")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(named, S.first_amount(entries, "total")).alias("total"))


@query("E16_numbered_items", """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_name, floor(p_retailprice)::BIGINT::VARCHAR AS price FROM part)
  SELECT p_partkey, 0 AS pos, 'list' AS source, '{"any":"' || p_name || '"}' AS item FROM p WHERE k = 0 UNION ALL SELECT p_partkey, 0, 'json_text', '{"nm":"' || p_name || '"}' FROM p WHERE k = 1 UNION ALL SELECT p_partkey, 1, 'json_text', '7' FROM p WHERE k = 1
  UNION ALL SELECT p_partkey, 0, 'numbered', '{"cnt":"3","nm":"' || p_name || '","price":"' || price || '"}' FROM p WHERE k = 2 UNION ALL SELECT p_partkey, 1, 'numbered', '{"cnt":null,"nm":"ten","price":null}' FROM p WHERE k = 2""")
def numbered_items(spark, d):
    """Items as a list beside one that is none, as the text of a list, as numbered keys, as trips, and none."""
    name, price = F.col("p_name"), F.floor("p_retailprice").cast("string")
    listed = F.format_string('{"tags":["x"],"empty":[],"rows":[{"any":"%s"}],"additional_fields":{"item_1_name":"no"}}', name)
    text = F.format_string('{"additional_fields":{"note":"[not json","items":"[{\\"nm\\":\\"%s\\"},7]","item_1_name":"no"}}', name)
    numbered = F.format_string('{"additional_fields":{"item_10_desc":"ten","Item 2 Name":"%s","item2price":"","item_2_amount":"%s","item_2_qty":3,"item_x_name":"no"}}', name, price)
    trips = F.lit('{"document_type":"local_conveyance_form","travel_entries":[{"kms":"1"}],"additional_fields":{"item_1_name":"no"}}')
    rows = table(spark, d, "part").select("p_partkey", F.element_at(F.array(listed, text, numbered, trips, F.lit('{"total":1}')), (F.col("p_partkey") % 5 + 1).cast("int")).alias("j"))
    return E.recovered_items(rows, "p_partkey", "j").select("p_partkey", "pos", "source", F.to_json("item").alias("item"))


@query("E18_pair_scores")
def pair_scores(spark, d):
    """Expected pairs that some found pair of the document matches, in key and value."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), "c_name", "c_mktsegment")
    expected = rows.select("doc", F.explode(F.create_map(F.lit("Name"), F.col("c_name"), F.lit("Segment"), F.col("c_mktsegment"))).alias("k", "v"))
    found = rows.select("doc", F.explode(F.create_map(F.lit("Name:"), F.col("c_name"), F.lit("Segm."), F.lower("c_mktsegment"))).alias("fk", "fv"))
    both = expected.join(found, "doc")
    right = (E.similarity(S.match_text(F.col("k")), S.match_text(F.col("fk"))) >= 0.6) & (E.similarity(S.match_text(F.col("v")), S.match_text(F.col("fv"))) >= 0.75)
    return both.groupBy("doc", "k").agg(F.bool_or(right).alias("correct"))
