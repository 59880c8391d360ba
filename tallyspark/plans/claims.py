"""Queries on versions, totals, filters, joins and orders of documents and claims."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import audit as I
from tallyspark.operators import categorize as C
from tallyspark.operators import documents as Q
from tallyspark.operators import evaluate as E
from tallyspark.operators import versions as V
from tallyspark.operators.lifecycle import breaches
from tallyspark.plans.documents import claims as claims_of
from tallyspark.plans.evaluation import _PARTS, _RULES, _TEXT, _TYPE
from tallyspark.plans.proxy import DOCS, VERSIONS, docs, table, versions
from tallyspark.plans.registry import SQL, query

_COLUMNS = "document_id, claim_id, employee_id, version, amount, currency, doc_status, claim_status, vendor, bill_date, category"
_LIST = _COLUMNS.split(", ")


@query("W1_latest_version", f"WITH {DOCS} SELECT {_COLUMNS} FROM docs")
def latest_version(spark, d):
    return V.latest(versions(spark, d).select(_LIST), ["document_id"], "version")


@query("W2_first_ai_version", f"WITH {VERSIONS} SELECT {_COLUMNS} FROM versions WHERE currency IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version) = 1")
def first_ai_version(spark, d):
    return V.earliest(versions(spark, d).where("currency IS NOT NULL"), ["document_id"], "version").select(_LIST)


@query("W3_latest_run", f"WITH {VERSIONS} SELECT document_id, claim_id, version FROM versions QUALIFY rank() OVER (PARTITION BY claim_id ORDER BY version DESC) = 1")
def latest_run(spark, d):
    return V.latest_run(versions(spark, d), "claim_id", "version").select("document_id", "claim_id", "version")


@query("W4_latest_assessment", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_assessment(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return V.latest(rows, ["user_id"], "at").select("user_id", "event_id", "event_type")


@query("W5_active_version", "(SELECT 'active' AS how, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate::DATE DESC, o_orderkey::VARCHAR DESC LIMIT 1) UNION ALL SELECT 'label', o_orderkey FROM orders WHERE o_orderkey = 7")
def active_version(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("label"), (F.col("o_orderstatus") == "F").alias("is_active"), F.to_date("o_orderdate").alias("created_on"))
    return V.active_version(rows).select(F.lit("active").alias("how"), "o_orderkey").unionByName(V.active_version(rows, "7").select(F.lit("label").alias("how"), "o_orderkey"))


@query("W6_carry_forward", """SELECT doc_id, pos, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section
  FROM (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN left(line, 12) END AS mark FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))""")
def carry_forward(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("pos") % 3 == 0, F.left("line", F.lit(12))).alias("mark"))
    return V.carry_forward(marked, "doc_id", "pos", "mark").select("doc_id", "pos", "section")


@query("W7_next_turn", """WITH RECURSIVE l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(line) <> ''),
  w AS (SELECT doc_id, pos, length(line) % 3 > 0 AS waits, false AS taken FROM l WHERE pos = 1 UNION ALL SELECT l.doc_id, l.pos, length(line) % 3 > 0 AND NOT w.waits, w.waits FROM w JOIN l ON l.doc_id = w.doc_id AND l.pos = w.pos + 1)
  SELECT doc_id, pos, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.doc_id = w.doc_id AND l.pos = w.pos + 1) THEN pos + 1 END AS answer FROM w WHERE waits""")
def next_turn(spark, d):
    """Lines of a length not divisible by three wait for the next one that isn't blank."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("trim(line) <> ''")
    lines = lines.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")).cast("long"))
    return E.awaiting(lines, "doc_id", "pos", F.length("line") % 3 > 0).where("waits").select("doc_id", "pos", "answer")


@query("W8_best_with_ties", f"""WITH {DOCS} SELECT employee_id, document_id, count(*) OVER (PARTITION BY employee_id) > 1 AS tied FROM (SELECT *, rank() OVER (PARTITION BY employee_id ORDER BY amount DESC) AS r FROM docs) WHERE r = 1""")
def best_with_ties(spark, d):
    return V.top_with_ties(docs(spark, d), "employee_id", "amount").select("employee_id", "document_id", "tied")


@query("W9_batches", f"WITH {DOCS} SELECT document_id, (row_number() OVER (PARTITION BY employee_id ORDER BY document_id) - 1) // 8 AS batch FROM docs")
def batches(spark, d):
    return V.batches(docs(spark, d), ["employee_id", "document_id"], 8).select("document_id", "batch")


@query("A1_totals_by_currency", f"WITH {DOCS} SELECT claim_id, coalesce(currency, 'unknown') AS currency, CAST(sum(amount) AS DECIMAL(22,2)) AS total FROM docs WHERE doc_status = 'confirmed' AND amount IS NOT NULL GROUP BY ALL")
def totals_by_currency(spark, d):
    return V.totals_by_currency(docs(spark, d))


@query("A2_claim_total", f"""WITH {DOCS}, t AS (SELECT claim_id, coalesce(currency, 'unknown') AS c, sum(amount) AS total FROM docs WHERE doc_status = 'confirmed' AND amount IS NOT NULL GROUP BY ALL)
  SELECT k.claim_id, CAST(CASE count(c) WHEN 0 THEN 0 WHEN 1 THEN max(total) END AS DECIMAL(22,2)) AS total_amount, CASE count(c) WHEN 0 THEN 'INR' WHEN 1 THEN max(c) END AS currency FROM (SELECT DISTINCT claim_id FROM docs) k LEFT JOIN t USING (claim_id) GROUP BY k.claim_id""")
def claim_total(spark, d):
    return V.claim_totals(docs(spark, d))


@query("A3_document_count", f"WITH {DOCS} SELECT o_orderkey AS claim_id, count(document_id) AS n_documents FROM orders LEFT JOIN (SELECT * FROM docs WHERE doc_status <> 'confirmed') ON o_orderkey = claim_id GROUP BY 1")
def document_count(spark, d):
    shown = docs(spark, d).where("doc_status <> 'confirmed'").groupBy("claim_id").count()
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id")).join(shown, "claim_id", "left").select("claim_id", F.coalesce("count", F.lit(0)).alias("n_documents"))


_VERDICT = "CASE WHEN currency IS NULL THEN 'insufficient_information' WHEN amount > 4500 THEN 'violation' WHEN amount > 4000 THEN 'needs_approval' ELSE 'compliant' END"


@query("A4_roll_up", f"""WITH {DOCS}, v AS (SELECT claim_id, max(list_position(['compliant', 'insufficient_information', 'needs_approval', 'violation'], {_VERDICT})) AS s FROM docs GROUP BY 1)
  SELECT o_orderkey AS claim_id, coalesce(['compliant', 'insufficient_information', 'needs_approval', 'violation'][s], 'insufficient_information') AS verdict FROM orders LEFT JOIN v ON o_orderkey = claim_id""")
def roll_up(spark, d):
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"))
    return V.roll_up(claims.join(docs(spark, d).select("claim_id", F.expr(_VERDICT).alias("verdict")), "claim_id", "left"), "claim_id")


@query("A6_next_version", f"WITH {VERSIONS} SELECT document_id, max(version) + 1 AS next_seq FROM versions GROUP BY 1")
def next_version(spark, d):
    return V.next_sequence(versions(spark, d), "document_id", "version")


@query("A7_frequencies", f"""WITH {DOCS} SELECT 'status' AS field, doc_status AS value, count(*) AS n FROM docs GROUP BY 2 UNION ALL SELECT 'currency', coalesce(currency, 'unknown'), count(*) FROM docs GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM docs GROUP BY 2""")
def frequencies(spark, d):
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in (("status", F.col("doc_status")), ("currency", F.coalesce("currency", F.lit("unknown"))), ("category", F.col("category")))])
    return docs(spark, d).select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


_RUN = "(SELECT event_type AS method, CASE WHEN event_id % 7 > 0 THEN 'x' END AS gold, CASE WHEN event_id % 11 > 0 THEN user_id % 50 END AS latency, CASE WHEN event_type <> 'view' THEN event_id % 900 END AS tokens, (event_id % 13)::DECIMAL(20,8) / 1000 AS cost, event_id % 6 = 0 AS failed, CASE event_id % 4 WHEN 0 THEN 'json' WHEN 2 THEN 'schema' END AS reason FROM events)"


def _run(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("event_type").alias("method"), F.when(k % 7 > 0, "x").alias("gold"), F.when(k % 11 > 0, F.col("user_id") % 50).alias("latency_ms"), F.when(F.col("event_type") != "view", k % 900).alias("total_tokens"),
        ((k % 13).cast("decimal(20,8)") / 1000).cast("decimal(20,8)").alias("cost"), (k % 6 == 0).alias("parse_failure"), F.when(k % 4 == 0, "json").when(k % 4 == 2, "schema").alias("parse_failure_reason"),
    )


@query("A10_run_stats", f"SELECT method, count(*) AS n_scored, count(*) FILTER (failed) AS parse_failures, coalesce(array_to_string(list_sort(list(DISTINCT coalesce(reason, '?')) FILTER (failed)), ','), '') AS reasons, round(avg(coalesce(latency, 0)), 6) AS mean_latency_ms, sum(tokens)::BIGINT AS total_tokens, sum(cost)::DECIMAL(30,8) AS total_cost FROM {_RUN} WHERE gold IS NOT NULL GROUP BY 1")
def run_stats(spark, d):
    """Event types are methods; some rows have no gold label, no latency, no tokens, no reason."""
    found = E.run_stats(_run(spark, d)).drop("latency_p50_ms", "cost_per_1000")
    return found.withColumn("reasons", F.array_join("reasons", ",")).withColumn("mean_latency_ms", F.round("mean_latency_ms", 6)).withColumn("total_cost", F.col("total_cost").cast("decimal(30,8)"))


@query("A11_median_latency", f"SELECT method, median(coalesce(latency, 0))::DOUBLE AS latency_p50_ms, round(avg(cost::DOUBLE) * 1000, 6) AS cost_per_1000 FROM {_RUN} WHERE gold IS NOT NULL GROUP BY 1")
def median_latency(spark, d):
    return E.run_stats(_run(spark, d)).select("method", F.col("latency_p50_ms").cast("double").alias("latency_p50_ms"), F.round("cost_per_1000", 6).alias("cost_per_1000"))


@query("A12_agreement", "SELECT quality::VARCHAR AS label, count(*) AS n, count(*) FILTER (quality = toxic) AS agreed, count(*) FILTER (quality <> toxic) AS overridden FROM labels GROUP BY 1 UNION ALL SELECT NULL, count(*), count(*) FILTER (quality = toxic), count(*) FILTER (quality <> toxic) FROM labels")
def agreement(spark, d):
    return E.agreement(table(spark, d, "labels"), "quality", "toxic")


@query("A13_coverage", "SELECT p_type AS category, count(*) AS n, count(*) >= 8 AS enough FROM part GROUP BY 1")
def coverage(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= 8)


@query("A14_batch_tally", f"WITH {VERSIONS} SELECT CASE WHEN n > 1 THEN 'reused' ELSE 'evaluated' END AS status, count(*) AS n FROM (SELECT document_id, count(*) AS n FROM versions GROUP BY 1) GROUP BY 1")
def batch_tally(spark, d):
    per = versions(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy(F.when(F.col("k") > 1, "reused").otherwise("evaluated").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("A15_checks_passed", f"""WITH k AS (SELECT document_id, count(*) FILTER (passed) AS passed, count(*) AS n_checks FROM ({SQL['Q1_checks']}) GROUP BY 1),
  t AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS document_id, sum(l_partkey + 50)::BIGINT AS tokens, sum(round(l_partkey * 0.15 / 1000000 + 50 * 0.6 / 1000000, 8)::DECIMAL(20,8))::DECIMAL(30,8) AS cost FROM lineitem GROUP BY 1)
  SELECT document_id, coalesce(passed, 0) AS passed, coalesce(n_checks, 0) AS n_checks, tokens, cost FROM t LEFT JOIN k USING (document_id)""")
def checks_passed(spark, d):
    """Checks passed of all, and tokens and cost of each document's attempts."""
    rows = claims_of(spark, d)
    attempts = rows.select("document_id", F.col("k3").alias("prompt"), F.lit(50).cast("long").alias("completion"))
    price = lambda x: F.lit(x).cast("decimal(10,4)")
    return Q.run_summary(Q.check_rows(rows), attempts, price("0.15"), price("0.60")).withColumn("cost", F.col("cost").cast("decimal(30,8)"))


@query("F1_visible", f"WITH {DOCS} SELECT document_id FROM docs WHERE doc_status <> 'confirmed'")
def visible(spark, d):
    return docs(spark, d).where("doc_status <> 'confirmed'").select("document_id")


@query("F2_evaluable", f"WITH {DOCS} SELECT document_id, category FROM docs WHERE doc_status IN ('needs_review', 'confirmed') AND amount IS NOT NULL AND category NOT LIKE 'STANDARD%'")
def evaluable(spark, d):
    return docs(spark, d).where("doc_status IN ('needs_review', 'confirmed') AND amount IS NOT NULL AND NOT startswith(category, 'STANDARD')").select("document_id", "category")


_SKIP = "CASE WHEN doc_status = 'confirmed' AND amount > 4800 THEN 'not_evaluable' WHEN category LIKE 'STANDARD%' THEN 'supporting_document' WHEN currency IS NULL THEN 'no_category' END"


@query("F3_skip_reason", f"WITH {DOCS} SELECT document_id, {_SKIP} AS skip_reason FROM docs")
def skip_reason(spark, d):
    return docs(spark, d).select("document_id", F.expr(_SKIP).alias("skip_reason"))


@query("F5_claim_universe", f"WITH {DOCS} SELECT a.claim_id, count(*) AS n FROM docs a JOIN docs b ON a.employee_id = b.employee_id AND (b.claim_status = 'submitted' OR b.claim_id = a.claim_id) GROUP BY 1")
def claim_universe(spark, d):
    """Documents of the employee's submitted claims or of the claim itself, counted from sums, not from pairs."""
    rows = docs(spark, d)
    own = rows.groupBy("claim_id", "employee_id", "claim_status").agg(F.count(F.lit(1)).alias("own"))
    submitted = own.where("claim_status = 'submitted'").groupBy("employee_id").agg(F.sum("own").alias("all"))
    joined = own.join(submitted, "employee_id", "left")
    return joined.select("claim_id", (F.col("own") * (F.coalesce("all", F.lit(0)) + F.when(F.col("claim_status") == "submitted", 0).otherwise(F.col("own")))).alias("n"))


@query("F8_stuck_rows", f"WITH {DOCS} SELECT document_id, CASE WHEN doc_status = 'needs_review' AND currency IS NULL THEN 'failed' ELSE doc_status END AS status FROM docs")
def stuck_rows(spark, d):
    return docs(spark, d).select("document_id", F.when((F.col("doc_status") == "needs_review") & F.col("currency").isNull(), "failed").otherwise(F.col("doc_status")).alias("status"))


@query("F9_blocked_claims", f"WITH {DOCS} SELECT o_orderkey AS claim_id, count(document_id) = 0 OR count(*) FILTER (doc_status = 'needs_review') > 0 AS blocked FROM orders LEFT JOIN docs ON o_orderkey = claim_id GROUP BY 1")
def blocked_claims(spark, d):
    per = docs(spark, d).groupBy("claim_id").agg(F.count_if(F.col("doc_status") == "needs_review").alias("open"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id")).join(per, "claim_id", "left").select("claim_id", (F.col("open").isNull() | (F.col("open") > 0)).alias("blocked"))


@query("J1_claim_documents", f"WITH {DOCS} SELECT o_orderkey AS claim_id, document_id, c_name AS employee, version, amount, CASE WHEN document_id IS NULL THEN '' WHEN version = 1 THEN 'currency:' || (currency IS NOT NULL) ELSE 'amount:' || (amount < 4000) || ',currency:' || (currency IS NOT NULL) END AS checks FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN docs ON claim_id = o_orderkey")
def claim_documents(spark, d):
    """Every claim with its documents' latest versions and their checks; first versions have one check only."""
    rows = versions(spark, d)
    checks = rows.select("document_id", "version", F.explode(F.array(F.struct(F.lit("currency").alias("name"), F.col("currency").isNotNull().alias("passed")), F.struct(F.lit("amount").alias("name"), (F.col("amount") < 4000).alias("passed")))).alias("c")).select("document_id", "version", "c.*").where("version > 1 OR name = 'currency'")
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("employee_id"))
    employees = table(spark, d, "customer").select(F.col("c_custkey").alias("employee_id"), F.col("c_name").alias("name"))
    found = V.claim_documents(claims, rows.select("claim_id", "document_id", "version", "amount"), checks, employees)
    line = F.transform("checks", lambda x: F.concat_ws(":", x["name"], x["passed"].cast("string")))
    return found.select("claim_id", "document_id", "employee", "version", "amount", F.array_join(line, ",").alias("checks"))


@query("J6_stale_decisions", f"WITH {VERSIONS}, l AS (SELECT document_id, max(version) AS latest FROM versions GROUP BY 1) SELECT document_id, version, version <> latest AS stale FROM versions JOIN l USING (document_id)")
def stale_decisions(spark, d):
    rows = versions(spark, d)
    return rows.join(rows.groupBy("document_id").agg(F.max("version").alias("latest")), "document_id", "left").select("document_id", "version", (F.col("latest").isNotNull() & (F.col("version") != F.col("latest"))).alias("stale"))


_STATES = "CASE WHEN quality = 1 THEN 'f2' ELSE 'f1' END AS fingerprint, CASE WHEN toxic = 1 THEN 'timeout' END AS error"


@query("J7_to_do", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, {_STATES} FROM labels) WHERE fingerprint = 'f2' AND error IS NULL)")
def to_do(spark, d):
    """Predictions of another fingerprint, or with an error, are done again."""
    return C.to_do(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").selectExpr("doc_id", *_STATES.split(", ")), "doc_id", "f2")


def _promoted(spark, d):
    """Labels override, some without a label, some of documents that are not there."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("silver_label"), (F.col("n_chars") % 2 == 0).alias("ambiguous"), F.col("source").alias("notes"))
    labels = table(spark, d, "labels").select((F.col("doc_id") * 3).alias("id"), F.when(F.col("quality") == 1, "good").alias("label"), F.when(F.col("toxic") == 1, True).alias("ambiguous"), F.when(F.col("doc_id") % 2 == 0, "seen").otherwise("").alias("notes"))
    return E.promoted(rows, labels)


@query("J8_gold_label", "SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN lang WHEN quality = 1 THEN 'good' END AS gold_label, CASE WHEN toxic = 1 THEN true ELSE n_chars % 2 = 0 END AS ambiguous, CASE WHEN l.doc_id % 2 = 0 THEN 'seen' ELSE source END AS notes, l.doc_id IS NOT NULL AS overridden FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id * 3")
def gold_label(spark, d):
    return _promoted(spark, d)[0].drop("silver_label")


@query("J8_unmatched_overrides", "SELECT doc_id * 3 AS id FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents)")
def unmatched_overrides(spark, d):
    return _promoted(spark, d)[1]


@query("J11_duplicate_upload", "SELECT source, sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_upload(spark, d):
    return table(spark, d, "documents").groupBy("source", F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("O1_claims_of_employee", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def claims_of_employee(spark, d):
    turn = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(turn).cast("long").alias("place"))


@query("O3_top_confusions", "SELECT quality AS gold, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL ORDER BY n DESC, gold, predicted LIMIT 5")
def top_confusions(spark, d):
    return table(spark, d, "labels").groupBy(F.col("quality").alias("gold"), F.col("toxic").alias("predicted")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold", "predicted").limit(5)


@query("U1_union_sources", "SELECT 'order' AS source, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def union_sources(spark, d):
    one = lambda name, key: table(spark, d, name).select(F.lit(name.rstrip("s") if name == "orders" else name).alias("source"), F.col(key).alias("id"))
    rows = one("orders", "o_orderkey").unionByName(one("part", "p_partkey")).unionByName(one("customer", "c_custkey")).unionByName(one("supplier", "s_suppkey"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("U3_number_difference", "SELECT doc_id, len(list_filter(regexp_extract_all(text, '\\d+'), lambda x: x NOT IN ('2', '3', '0')))::BIGINT AS n FROM (SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '\\d+')), ' ') AS text FROM documents)")
def number_difference(spark, d):
    found = F.array_except(F.regexp_extract_all("text", F.lit(r"(\d+)"), 1), F.array(F.lit("2"), F.lit("3"), F.lit("0")))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"))


@query("T3_status_from_events", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def status_from_events(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))


_LOG = "['upload', 'finish', 'edit', 'confirm', 'edit', 'reopen', 'confirm', 'submit', 'remove'][(event_id * 5 // 3 % 9 + 1)::INT]"


@query("T7_illegal_transitions", f"""WITH e AS (SELECT user_id // 4 AS claim_id, user_id AS document_id, event_id AS "at", {_LOG} AS event, ['ready', 'needs_review', 'failed'][(event_id % 3 + 1)::INT] AS status FROM events),
  x AS (SELECT *, (SELECT arg_max(CASE b.event WHEN 'finish' THEN b.status WHEN 'upload' THEN 'processing' WHEN 'confirm' THEN 'confirmed' WHEN 'reopen' THEN 'needs_review' ELSE 'removed' END, b."at") FROM e b WHERE b.claim_id = e.claim_id AND b.document_id = e.document_id AND b."at" < e."at" AND b.event NOT IN ('edit', 'submit')) AS state,
    EXISTS (SELECT 1 FROM e b WHERE b.claim_id = e.claim_id AND b.event = 'submit' AND b."at" < e."at") AS late FROM e WHERE event <> 'submit'),
  y AS (SELECT *, CASE WHEN late AND event <> 'finish' THEN 'edit_after_submit' WHEN event = 'edit' AND state = 'confirmed' THEN 'edit_of_confirmed' WHEN event = 'confirm' AND coalesce(state, '') NOT IN ('ready', 'needs_review') THEN 'confirm_from_wrong_state' END AS breach FROM x)
  SELECT claim_id, document_id, "at", event, breach FROM y WHERE breach IS NOT NULL""")
def illegal_transitions(spark, d):
    """Four users are the documents of a claim."""
    at = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(c) for c in ("upload", "finish", "edit", "confirm", "edit", "reopen", "confirm", "submit", "remove")]), (F.floor(at * 5 / 3) % 9 + 1).cast("int"))
    end = F.element_at(F.array(F.lit("ready"), F.lit("needs_review"), F.lit("failed")), (at % 3 + 1).cast("int"))
    return breaches(table(spark, d, "events").select(F.floor(F.col("user_id") / 4).alias("claim_id"), F.col("user_id").alias("document_id"), at.alias("at"), name.alias("event"), end.alias("status")))


@query("I1_immutability", f"""WITH {VERSIONS}, a AS (SELECT * FROM versions WHERE version = 1), b AS (SELECT * FROM versions WHERE version = 2)
  SELECT document_id, CASE WHEN b.document_id IS NULL THEN 'gone' WHEN (a.amount, a.vendor, a.bill_date, a.category, a.price) IS DISTINCT FROM (b.amount, b.vendor, b.bill_date, b.category, b.price) OR a.currency IS DISTINCT FROM b.currency THEN 'changed' ELSE 'same' END AS finding FROM a LEFT JOIN b USING (document_id)""")
def immutability(spark, d):
    """First versions as one snapshot, second ones as the next; the status is the reviewer's."""
    rows = versions(spark, d).select("document_id", "version", "amount", "currency", "vendor", "bill_date", "category", "price", "doc_status")
    a, b = (rows.where(F.col("version") == n).drop("version") for n in (1, 2))
    return I.immutability(a, b, ["document_id"], ["doc_status"])


_UNIQUE = [("region", ["r_regionkey"]), ("nation", ["n_nationkey"]), ("customer", ["c_custkey"]), ("supplier", ["s_suppkey"]), ("part", ["p_partkey"]), ("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("events", ["event_id"]), ("documents", ["doc_id"]), ("labels", ["doc_id"]), ("conversations", ["conv_id", "turn"])]
_FOREIGN = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey")]


@query("I3_referential", " UNION ALL ".join([f"SELECT '{t}({','.join(c)}) unique' AS rule, count(*) AS violations FROM (SELECT {', '.join(c)} FROM {t} GROUP BY ALL HAVING count(*) > 1)" for t, c in _UNIQUE] + [f"SELECT '{a}.{b} -> {c}.{e}', count(*) FROM {a} WHERE {b} NOT IN (SELECT {e} FROM {c})" for a, b, c, e in _FOREIGN]))
def referential(spark, d):
    names = {n for n, _ in _UNIQUE} | {x for a, _, b, _ in _FOREIGN for x in (a, b)}
    return I.keys({n: table(spark, d, n) for n in names}, _UNIQUE, _FOREIGN)


@query("D3_direction", f"""WITH {VERSIONS} SELECT a.document_id, CASE WHEN b.amount > a.amount THEN 'increase' WHEN b.amount < a.amount THEN 'decrease' ELSE 'none' END AS direction FROM versions a JOIN versions b ON a.document_id = b.document_id AND a.version = 1 AND b.version = 2""")
def version_direction(spark, d):
    rows = versions(spark, d)
    a, b = rows.where("version = 1").select("document_id", F.col("amount").cast("string").alias("x")), rows.where("version = 2").select("document_id", F.col("amount").cast("string").alias("y"))
    return a.join(b, "document_id").select("document_id", S.direction(F.col("x"), F.col("y")).alias("direction"))


@query("F7_missing_category", f"WITH {DOCS} SELECT document_id FROM docs WHERE currency IS NULL AND category NOT LIKE 'STANDARD%'")
def missing_category(spark, d):
    return docs(spark, d).where("currency IS NULL AND NOT startswith(category, 'STANDARD')").select("document_id")


@query("C7_backfilled", f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kept' ELSE {_RULES} END AS category, CASE WHEN p_partkey % 3 > 0 AND {_RULES} IS NOT NULL THEN 'rules' END AS backfilled_by FROM {_PARTS}")
def backfilled(spark, d):
    """Missing categories take the rules' one; the others stay."""
    rows = table(spark, d, "part").withColumn("category", F.when(F.col("p_partkey") % 3 == 0, "kept"))
    return C.backfill(rows, "category", F.expr(_TYPE), F.expr(_TEXT)).select("p_partkey", "category", "backfilled_by")


@query("C9_silver_labels", """SELECT CASE doc_id % 4 WHEN 0 THEN 'synth-team_events-' ELSE 'synth-fuel-' END || doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'manual' END WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 = 0 AND n_chars % 2 = 0 THEN 'travel_meals' WHEN doc_id % 5 > 0 THEN lang END END AS silver_label,
  coalesce(toxic = 1, doc_id % 3 = 0 AND doc_id % 4 = 0 AND n_chars % 2 = 0) OR n_chars % 2 = 0 AS ambiguous, l.doc_id IS NOT NULL OR doc_id % 3 = 0 AS labelled FROM documents LEFT JOIN labels l USING (doc_id)""")
def silver_labels(spark, d):
    """Manual labels, expected categories out of notes, the ambiguous exception, and rows without any."""
    name = F.concat(F.when(F.col("doc_id") % 4 == 0, "synth-team_events-").otherwise("synth-fuel-"), F.col("doc_id").cast("string"))
    notes = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("Made; expected category: "), "lang", F.lit(", or so. More")))
    rows = table(spark, d, "documents").select(name.alias("id"), F.when(F.col("doc_id") % 3 == 0, "synthetic_image").otherwise("real").alias("source"), notes.alias("notes"), (F.col("n_chars") % 2 == 0).alias("ambiguous"))
    manual = table(spark, d, "labels").select(name.alias("id"), F.when(F.col("quality") == 1, "manual").alias("category"), (F.col("toxic") == 1).alias("ambiguous"))
    return E.silver_labels(rows, manual).select("id", "silver_label", "ambiguous", "labelled")


@query("C10_method_table", f"SELECT p_partkey, 'rules' AS method, {_RULES} AS category FROM {_PARTS} UNION ALL SELECT p_partkey, 'type', CASE k WHEN 'restaurant_bill' THEN 'travel_meals' WHEN 'hotel_invoice' THEN 'accommodation' WHEN 'telecom_bill' THEN 'phone_internet' WHEN 'generic_receipt' THEN 'other' END FROM {_PARTS}")
def method_table(spark, d):
    """One prediction table, keyed by id and method."""
    rules = lambda rows: rows.select("p_partkey", C.rule_category(F.expr(_TYPE), F.expr(_TEXT)).alias("r")).select("p_partkey", "r.category", "r.confidence")
    by_type = lambda rows: rows.select("p_partkey", S.category_of_type(F.expr(_TYPE)).alias("category"), F.lit(None).cast("double").alias("confidence"))
    return C.dispatch(table(spark, d, "part"), "p_partkey", {"rules": rules, "type": by_type}).drop("confidence")


@query("D5_category_correction", f"WITH {VERSIONS}, a AS (SELECT document_id, arg_min(category, version) AS first, arg_max(category, version) AS last FROM versions GROUP BY 1) SELECT document_id, CASE WHEN first <> last THEN last END AS correction FROM a")
def category_correction(spark, d):
    per = versions(spark, d).groupBy("document_id").agg(F.min_by("category", "version").alias("a"), F.max_by("category", "version").alias("b"))
    return per.select("document_id", F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("b")).alias("correction"))


@query("D7_reasons", f"WITH {VERSIONS}, r AS (SELECT document_id, max(vendor) AS reason FROM versions WHERE version > 1 GROUP BY 1) SELECT document_id, version, reason FROM versions LEFT JOIN r USING (document_id)")
def reasons(spark, d):
    """One reason for all rows of a document."""
    rows = versions(spark, d)
    given = rows.where("version > 1").groupBy("document_id").agg(F.max("vendor").alias("reason"))
    return rows.select("document_id", "version").join(given, "document_id", "left")


@query("O4_corrections_in_order", f"WITH {VERSIONS} SELECT document_id, version, row_number() OVER (PARTITION BY claim_id ORDER BY bill_date, document_id, version) AS place FROM versions")
def corrections_in_order(spark, d):
    turn = Window.partitionBy("claim_id").orderBy("bill_date", "document_id", "version")
    return versions(spark, d).select("document_id", "version", F.row_number().over(turn).cast("long").alias("place"))


@query("O6_claim_details", f"WITH {DOCS} SELECT claim_id, count(*) AS n_documents, string_agg(document_id::VARCHAR, ',' ORDER BY document_id) AS documents FROM docs GROUP BY 1")
def claim_details(spark, d):
    """A claim with its documents in one row; a claim's documents are few by nature."""
    listed = F.sort_array(F.collect_list(F.struct("document_id", "vendor", "amount", "currency", "doc_status")))
    per = docs(spark, d).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_documents"), listed.alias("d"))
    return per.select("claim_id", "n_documents", F.array_join(F.transform("d", lambda x: x["document_id"].cast("string")), ",").alias("documents"))
