"""Queries for the fraud rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import fraud as R
from tallyspark.plans.proxy import DOCS, docs, docs_with_first, table, tasks
from tallyspark.plans.registry import query
from tallyspark.sources.readers import stored

_VENDOR = "trim(regexp_replace(regexp_replace(lower(vendor), '[^a-z0-9 ]', ' ', 'g'), '\\b(pvt|ltd|limited|private|llp|inc|the)\\b', ' ', 'g'))"
_USABLE = f"u AS (SELECT *, {_VENDOR} AS vk FROM docs WHERE amount IS NOT NULL AND currency IS NOT NULL AND bill_date IS NOT NULL AND vendor IS NOT NULL)"


def _pairs(op: str) -> str:
    return f"SELECT a.document_id, b.document_id AS other_id, a.claim_id, b.claim_id AS other_claim_id, abs(a.bill_date - b.bill_date)::INT AS days_apart, a.claim_status AS s1, b.claim_status AS s2 FROM u a JOIN u b ON a.vk = b.vk AND a.amount = b.amount AND a.currency = b.currency AND a.document_id < b.document_id AND a.employee_id {op} b.employee_id AND abs(a.bill_date - b.bill_date) <= 14"


@query("J3_duplicate_pairs", f"WITH {DOCS}, {_USABLE} SELECT document_id, other_id, claim_id, other_claim_id, days_apart FROM ({_pairs('<>')})")
def duplicate_pairs(spark, d):
    return R.duplicate_pairs(docs(spark, d), same_employee=False, tasks=tasks(spark, d))


def _rule(rule: str, op: str) -> str:
    return f"""WITH {DOCS}, {_USABLE}, p AS ({_pairs(op)}), seen AS (SELECT claim_id, document_id, other_id FROM p WHERE s2 = 'submitted' OR claim_id = other_claim_id UNION SELECT other_claim_id, document_id, other_id FROM p WHERE s1 = 'submitted' OR claim_id = other_claim_id),
  h AS (SELECT claim_id, count(*) AS hits FROM seen GROUP BY 1), k AS (SELECT claim_id, count(*) FILTER (currency IS NOT NULL) AS usable FROM docs GROUP BY 1)
  SELECT claim_id, '{rule}' AS rule_id, CASE WHEN coalesce(hits, 0) > 0 THEN 'fired' WHEN usable = 0 THEN 'not_applicable' ELSE 'clear' END AS status, coalesce(hits, 0) AS hits FROM k LEFT JOIN h USING (claim_id)"""


@query("R1_duplicate_same_employee", _rule("duplicate_same_employee", "="))
def duplicate_same_employee(spark, d):
    return R.duplicates(docs(spark, d), same_employee=True)


@query("R2_duplicate_cross_employee", _rule("duplicate_cross_employee", "<>"))
def duplicate_cross_employee(spark, d):
    return R.duplicates(docs(spark, d), same_employee=False)


@query("R3_active_duplicate_file", "SELECT source, sha256(text) AS sha, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL HAVING count(*) > 1")
def active_duplicate_file(spark, d):
    """The same file twice in a source, which stands for a claim; every fifth document counts as removed."""
    files = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("sha"), "doc_id")
    return R.duplicate_files(files, ["source", "sha"], F.col("doc_id") % 5 == 0)


def thresholds(spark):
    """Approval and documentation thresholds, one table."""
    approval = spark.createDataFrame([("*", "INR", 5000, "C-1"), ("PROMO BURNISHED COPPER", "USD", 2000, "C-2")], "category string, currency string, amount int, clause_id string").withColumn("kind", F.lit("approval"))
    receipt = spark.createDataFrame([("*", "USD", 1000, "C-3"), ("*", "INR", 0, "C-4")], "category string, currency string, amount int, clause_id string").withColumn("kind", F.lit("documentation"))
    return approval.unionByName(receipt).withColumn("amount", F.col("amount").cast("decimal(12,2)"))


_THRESHOLDS = "t(category, currency, threshold, clause_id, kind) AS (VALUES ('*', 'INR', 5000::DECIMAL(12,2), 'C-1', 'approval'), ('PROMO BURNISHED COPPER', 'USD', 2000, 'C-2', 'approval'), ('*', 'USD', 1000, 'C-3', 'documentation'), ('*', 'INR', 0, 'C-4', 'documentation'))"
_NEAR = "SELECT document_id, claim_id, amount, threshold, kind, clause_id FROM docs JOIN t ON t.currency = docs.currency AND (t.category = '*' OR t.category = docs.category) WHERE threshold > 0 AND amount >= threshold * 0.95 AND amount < threshold"


@query("J4_threshold_hits", f"WITH {DOCS}, {_THRESHOLDS} SELECT document_id, claim_id, amount, threshold, kind, clause_id, CAST(round_even((threshold - amount) * 100 / threshold, 1) AS DECIMAL(6,1)) AS percent_below FROM ({_NEAR})")
def threshold_hits(spark, d):
    return R.threshold_hits(docs(spark, d), thresholds(spark))


@query("R4_threshold_gaming", f"""WITH {DOCS}, {_THRESHOLDS}, h AS (SELECT claim_id, count(*) AS hits FROM ({_NEAR}) GROUP BY 1), k AS (SELECT claim_id, count(currency) AS usable FROM docs GROUP BY 1)
  SELECT claim_id, 'threshold_gaming' AS rule_id, CASE WHEN coalesce(hits, 0) > 0 THEN 'fired' WHEN usable = 0 THEN 'not_applicable' ELSE 'clear' END AS status, coalesce(hits, 0) AS hits FROM k LEFT JOIN h USING (claim_id)""")
def threshold_gaming(spark, d):
    return R.threshold_gaming(docs(spark, d), thresholds(spark))


@query("R5_velocity", f"""WITH {DOCS}, w AS (SELECT *, date_trunc('week', bill_date)::DATE AS week FROM docs), k AS (SELECT DISTINCT claim_id, employee_id, week FROM w),
  per AS (SELECT k.claim_id, k.week, count(*) AS n, coalesce(sum(amount) FILTER (currency = 'INR'), 0) > 6000 AS over FROM k JOIN w ON k.employee_id = w.employee_id AND k.week = w.week AND (w.claim_status = 'submitted' OR w.claim_id = k.claim_id) GROUP BY 1, 2),
  h AS (SELECT claim_id, count(*) AS hits FROM per WHERE n > 2 OR n >= 2 AND over GROUP BY 1)
  SELECT claim_id, 'velocity' AS rule_id, CASE WHEN coalesce(hits, 0) > 0 THEN 'fired' ELSE 'clear' END AS status, coalesce(hits, 0) AS hits FROM (SELECT DISTINCT claim_id FROM docs) LEFT JOIN h USING (claim_id)""")
def velocity(spark, d):
    return R.velocity(docs(spark, d), documents=2, totals={"INR": 6000})


@query("R6_round_number", f"""WITH {DOCS} SELECT claim_id, 'round_number' AS rule_id, CASE WHEN count(*) FILTER (currency = 'INR' AND amount >= 1000 AND amount % 500 = 0) > 0 THEN 'fired' WHEN count(*) FILTER (currency = 'INR') = 0 THEN 'not_applicable' ELSE 'clear' END AS status,
  count(*) FILTER (currency = 'INR' AND amount >= 1000 AND amount % 500 = 0) AS hits FROM docs GROUP BY 1""")
def round_number(spark, d):
    return R.round_number(docs(spark, d))



@query("R7_weekend_business", f"""WITH {DOCS} SELECT claim_id, 'weekend_business' AS rule_id, CASE WHEN count(*) FILTER (category LIKE 'PROMO%' AND isodow(bill_date) >= 6) > 0 THEN 'fired' ELSE 'clear' END AS status, count(*) FILTER (category LIKE 'PROMO%' AND isodow(bill_date) >= 6) AS hits FROM docs GROUP BY 1""")
def weekend_business(spark, d):
    return R.weekend_business(_scoped(docs(spark, d)))


def _scoped(rows):
    return rows.withColumn("category", F.when(F.col("category").startswith("PROMO"), "team_events").otherwise(F.col("category")))


_DECISIONS = "SELECT claim_id, employee_id, vendor AS clause_id, CASE WHEN amount > 3500 THEN 'violation' WHEN currency IS NULL THEN 'insufficient_information' ELSE 'compliant' END AS verdict FROM docs"


@query("R8_repeat_violation", f"""WITH {DOCS}, dec AS ({_DECISIONS}), v AS (SELECT * FROM dec WHERE verdict = 'violation'), hist AS (SELECT employee_id, clause_id FROM v GROUP BY 1, 2 HAVING count(*) >= 2),
  h AS (SELECT claim_id, count(*) AS hits FROM (SELECT DISTINCT claim_id, employee_id, clause_id FROM v) JOIN hist USING (employee_id, clause_id) GROUP BY 1), k AS (SELECT claim_id, count(*) FILTER (verdict <> 'insufficient_information') AS known FROM dec GROUP BY 1)
  SELECT claim_id, 'policy_repeat_violation' AS rule_id, CASE WHEN coalesce(hits, 0) > 0 THEN 'fired' WHEN known = 0 THEN 'not_applicable' ELSE 'clear' END AS status, coalesce(hits, 0) AS hits FROM k LEFT JOIN h USING (claim_id)""")
def repeat_violation(spark, d):
    return R.repeat_violation(*_decided(docs(spark, d)))


def _decided(rows):
    verdict = F.when(F.col("amount") > 3500, "violation").when(F.col("currency").isNull(), "insufficient_information").otherwise("compliant")
    return rows, rows.select("claim_id", "employee_id", F.col("vendor").alias("clause_id"), verdict.alias("verdict"))


def _corrections(rows):
    """Latest versions that differ from the first: corrections of the amount, with a reason where the price is high. rows: docs_with_first()."""
    moved = F.when(F.col("amount") > F.col("first_amount"), "increase").when(F.col("amount") < F.col("first_amount"), "decrease").otherwise("none")
    return rows.where("version > 1").select("claim_id", "document_id", F.lit("amount").alias("field_path"), moved.alias("direction"), F.when(F.col("price") > 60000, "contradicts the bill").alias("reason"))


def _with_ai(rows):
    return rows.withColumn("has_ai", F.col("currency").isNotNull())


_CORR = "c AS (SELECT b.claim_id, CASE WHEN b.amount > a.amount THEN 'increase' END AS direction, b.price > 60000 AS reasoned FROM docs b JOIN versions a ON a.document_id = b.document_id AND a.version = 1 WHERE b.version > 1)"


def _correction_sql(rule: str, hit: str) -> str:
    return f"""WITH {DOCS}, {_CORR}, h AS (SELECT claim_id, count(*) AS hits FROM c WHERE {hit} GROUP BY 1), k AS (SELECT claim_id, count(currency) > 0 AS ai FROM docs GROUP BY 1)
  SELECT claim_id, '{rule}' AS rule_id, CASE WHEN NOT ai THEN 'not_applicable' WHEN coalesce(hits, 0) > 0 THEN 'fired' ELSE 'clear' END AS status, CASE WHEN ai THEN coalesce(hits, 0) ELSE 0 END AS hits FROM k LEFT JOIN h USING (claim_id)"""


@query("R9_correction_upward", _correction_sql("correction_upward", "direction = 'increase'"))
def correction_upward(spark, d):
    rows = docs_with_first(spark, d)
    return R.corrections_rule(_with_ai(rows), _corrections(rows), "correction_upward")


@query("R10_correction_guardrail", _correction_sql("correction_guardrail", "reasoned"))
def correction_guardrail(spark, d):
    rows = docs_with_first(spark, d)
    return R.corrections_rule(_with_ai(rows), _corrections(rows), "correction_guardrail")


def results(spark, d):
    """The nine rules over one set of current documents."""
    rows = _scoped(_with_ai(stored(R.keyed(docs_with_first(spark, d)))))
    _, decisions = _decided(rows)
    return R.assess(rows, thresholds(spark), decisions, _corrections(rows), weekly_documents=2, weekly_totals={"INR": 6000}, tasks=tasks(spark, d))


def all_sql() -> str:
    """The nine rules' SQL with their common table expressions kept apart."""
    from tallyspark.plans.registry import SQL

    names = ["R1_duplicate_same_employee", "R2_duplicate_cross_employee", "R4_threshold_gaming", "R5_velocity", "R6_round_number", "R7_weekend_business", "R8_repeat_violation", "R9_correction_upward", "R10_correction_guardrail"]
    return " UNION ALL ".join(f"SELECT claim_id, rule_id, status, hits FROM ({SQL[n]})" for n in names)


_WEIGHT = "CASE rule_id WHEN 'duplicate_same_employee' THEN 30 WHEN 'duplicate_cross_employee' THEN 25 WHEN 'threshold_gaming' THEN 20 WHEN 'velocity' THEN 15 WHEN 'round_number' THEN 8 WHEN 'weekend_business' THEN 15 WHEN 'policy_repeat_violation' THEN 15 WHEN 'correction_upward' THEN 20 ELSE 35 END"
_SCORE = f"""SELECT claim_id, least(100, sum(CASE WHEN status = 'fired' THEN {_WEIGHT} ELSE 0 END))::BIGINT AS risk_score, count(*) FILTER (status = 'fired') AS n_fired, count(*) FILTER (status <> 'not_applicable') AS assessable, count(*) AS n_rules FROM ({all_sql()}) GROUP BY 1"""
_BANDED = f"SELECT *, CASE WHEN n_fired = 0 AND assessable < 3 THEN 'unassessable' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END AS risk_band FROM ({_SCORE})"


@query("R11_score", _BANDED)
def score(spark, d):
    return R.score(results(spark, d))


@query("O2_review_queue", f"SELECT claim_id, risk_band, risk_score, row_number() OVER (PARTITION BY risk_band ORDER BY risk_score DESC, claim_id) AS place FROM ({_BANDED})")
def review_queue(spark, d):
    """Places within each band; the bands follow one another: high, medium, unassessable, low."""
    return R.review_queue(R.score(results(spark, d)))


@query("A8_rule_coverage", f"SELECT rule_id, count(*) FILTER (status = 'fired') AS fired, count(*) FILTER (status = 'clear') AS clear, count(*) FILTER (status = 'not_applicable') AS not_applicable FROM ({all_sql()}) GROUP BY 1")
def rule_coverage(spark, d):
    return results(spark, d).groupBy("rule_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("fired", "clear", "not_applicable")])


@query("R12_assessments", f"SELECT claim_id, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (status = 'fired'), '') AS fired, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (status = 'not_applicable'), '') AS not_applicable, 'v1' AS ruleset FROM ({all_sql()}) GROUP BY 1")
def assessments(spark, d):
    rows = results(spark, d)
    named = lambda s: F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("rule_id")))), ",").alias(s)
    return rows.groupBy("claim_id").agg(named("fired"), named("not_applicable")).withColumn("ruleset", F.lit("v1"))


@query("R13_missing_fields", f"WITH {DOCS} SELECT document_id, concat_ws(',', CASE WHEN vendor IS NULL THEN 'vendor' END, CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN currency IS NULL THEN 'currency' END) AS missing FROM docs")
def missing_fields(spark, d):
    lacking = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("vendor", "amount", "currency")])
    return docs(spark, d).select("document_id", lacking.alias("missing"))


@query("R14_evidence", f"""WITH {DOCS}, {_USABLE} SELECT document_id, other_id, '{{"document_id":' || document_id || ',"other_id":' || other_id || ',"days_apart":' || days_apart || '}}' AS evidence FROM ({_pairs('<>')})""")
def evidence(spark, d):
    """References to both documents of each pair, as JSON."""
    pairs = R.duplicate_pairs(docs(spark, d), same_employee=False, carry=(), tasks=tasks(spark, d))
    return pairs.select("document_id", "other_id", F.to_json(F.struct("document_id", "other_id", "days_apart")).alias("evidence"))
