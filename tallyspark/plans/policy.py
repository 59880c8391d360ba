"""Queries for the policy engine: each latest document is a unit; its clause follows from its category."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import policy as L
from tallyspark.plans.proxy import DOCS, docs
from tallyspark.plans.registry import query
from tallyspark.plans.scalars import _shown

_CLAUSES = (
    # clause, unit, kind, inclusive, prohibition, limits (amount, currency, when), conditions (id, kind, check, quantity, op, value, depends_on, within), documents (item, min, by currency), approval, categories
    ("L-NIGHT", "per_night", "amount", True, False, [(900, "INR", {"tier": ["1"]}), (600, "INR", {"tier": ["2", "3"]}), (70, "USD", {})], [("c1", "requires", "judgment", None, None, None, ["bill_date", "client_name"], None)], [("invoice", 1000, None)], {"INR": 4000, "USD": 4500}, ["PROMO BURNISHED COPPER"]),
    ("L-PERSON", "per_person", "amount", False, False, [(500, "INR", {}), (500, "USD", {})], [("c2", "requires", "numeric", "persons", ">=", 2, [], None), ("c4", "requires", None, None, None, None, [], None), ("c4a", None, "judgment", None, None, None, ["vehicle_ownership"], "c4"), ("c4b", None, "numeric", "grade_rank", ">=", 5, [], "c4")], [], {"INR": 0}, ["ECONOMY ANODIZED STEEL"]),
    ("L-MONTH", "per_month", "amount", True, False, [(6000, "INR", {})], [("c3", "excludes", "judgment", None, None, None, [], None)], [("receipt", None, None)], {}, ["SMALL PLATED BRASS", "*"]),
    ("L-KM", "per_km", "amount", True, False, [(12, "INR", {}), (1, "USD", {})], [("c5", "requires", "numeric", "days_since_expense", "<=", 30, [], None)], [("invoice", None, {"INR": 2500})], {}, ["LARGE BRUSHED STEEL"]),
    ("L-SHARE", "percent_of_amount", "amount", True, False, [(10, "INR", {}), (10, "USD", {"tier": ["1"]}), (20, "USD", {"tier": ["2"]})], [("c6", "excludes", None, None, None, None, [], None), ("c6a", None, None, None, None, None, [], "c6"), ("c6aa", None, "judgment", None, None, None, ["bill_date"], "c6a"), ("c6ab", None, "numeric", "amount", ">", 3000, [], "c6a"), ("c6b", None, "judgment", None, None, None, None, "c6")], [], {}, ["MEDIUM POLISHED TIN"]),
    ("L-NONE", "none", "amount", True, True, [], [], [], {}, ["STANDARD POLISHED TIN"]),
)
_CLAUSE_TYPE = "clause_id string, limit_unit string, limit_kind string, limit_inclusive boolean, is_prohibition boolean, limits array<struct<amount:decimal(12,2),currency:string,when:map<string,array<string>>>>, conditions array<struct<id:string,kind:string,check:string,quantity:string,op:string,value:decimal(12,2),depends_on:array<string>,within:string,text:string>>, documents array<struct<item:string,min_amount:decimal(12,2),by_currency:map<string,decimal(12,2)>>>, approval map<string,decimal(12,2)>, applies_to array<string>"


def clauses(spark):
    from decimal import Decimal as D

    number = lambda x: None if x is None else D(x)
    rows = [(a, b, c, d, e, [(D(x), y, z) for x, y, z in f], [(*x[:5], number(x[5]), *x[6:], None) for x in g], [(x, number(y), z and {k: D(v) for k, v in z.items()}) for x, y, z in h], {k: D(v) for k, v in i.items()}, j) for a, b, c, d, e, f, g, h, i, j in _CLAUSES]
    return spark.createDataFrame(rows, _CLAUSE_TYPE)


_CLAUSE_OF = "CASE document_id % 6 WHEN 0 THEN 'L-NIGHT' WHEN 1 THEN 'L-PERSON' WHEN 2 THEN 'L-MONTH' WHEN 3 THEN 'L-KM' WHEN 4 THEN 'L-SHARE' ELSE 'L-NONE' END"


def units(spark, d):
    """Facts derived from each document's own numbers, with nulls in all of them."""
    part = lambda k, n: F.pmod(F.floor(F.col("document_id") / k), F.lit(n))
    opt = lambda k, n, c: F.when(part(k, n) != 0, c)
    tri = lambda k: F.when(part(k, 3) == 1, True).when(part(k, 3) == 2, False)
    dims = F.map_filter(F.create_map(F.lit("tier"), F.when(part(11, 4) > 0, part(11, 4).cast("string"))), lambda _, v: v.isNotNull())
    return docs(spark, d).select(
        F.col("document_id").alias("unit_id"), F.expr(_CLAUSE_OF).alias("clause_id"), "currency", opt(7, 10, F.col("amount")).alias("base_amount"), opt(13, 5, F.col("price")).alias("base_of_percent"), opt(17, 6, part(17, 6)).cast("int").alias("nights"),
        opt(19, 4, part(19, 4)).cast("int").alias("days"), opt(23, 5, part(23, 5)).cast("int").alias("persons"), opt(29, 6, part(29, 300)).cast("decimal(10,2)").alias("distance_km"), opt(59, 8, part(59, 8)).cast("int").alias("grade_rank"), opt(61, 6, part(61, 60)).cast("int").alias("days_since_expense"), opt(31, 5, part(31, 5)).cast("int").alias("n_peers"), opt(31, 5, part(31, 5) * 1000).cast("decimal(12,2)").alias("peers_total"),
        dims.alias("dims"), F.create_map(F.lit("c1"), tri(37), F.lit("c3"), tri(41), F.lit("c4a"), tri(67), F.lit("c6aa"), tri(71), F.lit("c6b"), tri(73)).alias("judgments"), F.create_map(F.lit("invoice"), tri(43), F.lit("receipt"), tri(47)).alias("documentation"), tri(53).alias("approval_evidenced"),
    )


def _p(k: int, n: int) -> str:
    return f"((document_id // {k}) % {n})"


def _tri(k: int) -> str:
    return f"CASE {_p(k, 3)} WHEN 1 THEN true WHEN 2 THEN false END"


_UNITS = f"""{DOCS}, units AS (SELECT document_id AS unit_id, {_CLAUSE_OF} AS clause_id, currency, CASE WHEN {_p(7, 10)} <> 0 THEN amount END AS base, CASE WHEN {_p(13, 5)} <> 0 THEN price END AS share_of, CASE WHEN {_p(17, 6)} <> 0 THEN {_p(17, 6)} END AS nights,
  CASE WHEN {_p(23, 5)} <> 0 THEN {_p(23, 5)} END AS persons, CASE WHEN {_p(29, 6)} <> 0 THEN {_p(29, 300)} END::DECIMAL(10,2) AS km, CASE WHEN {_p(31, 5)} <> 0 THEN {_p(31, 5)} * 1000 END::DECIMAL(12,2) AS peers, CASE WHEN {_p(11, 4)} > 0 THEN {_p(11, 4)}::VARCHAR END AS tier,
  CASE WHEN {_p(59, 8)} <> 0 THEN {_p(59, 8)} END AS rank, CASE WHEN {_p(61, 6)} <> 0 THEN {_p(61, 60)} END AS since, {_tri(37)} AS c1, {_tri(41)} AS c3, {_tri(67)} AS c4a, {_tri(71)} AS c6aa, {_tri(73)} AS c6b, {_tri(43)} AS invoice, {_tri(47)} AS receipt, {_tri(53)} AS approved FROM docs),
lim(clause_id, unit, incl, amount, cur, tiers) AS (VALUES ('L-NIGHT', 'per_night', true, 900::DECIMAL(12,2), 'INR', ['1']), ('L-NIGHT', 'per_night', true, 600, 'INR', ['2', '3']), ('L-NIGHT', 'per_night', true, 70, 'USD', NULL), ('L-PERSON', 'per_person', false, 500, 'INR', NULL), ('L-PERSON', 'per_person', false, 500, 'USD', NULL),
  ('L-MONTH', 'per_month', true, 6000, 'INR', NULL), ('L-KM', 'per_km', true, 12, 'INR', NULL), ('L-KM', 'per_km', true, 1, 'USD', NULL), ('L-SHARE', 'percent_of_amount', true, 10, 'INR', NULL), ('L-SHARE', 'percent_of_amount', true, 10, 'USD', ['1']), ('L-SHARE', 'percent_of_amount', true, 20, 'USD', ['2'])),
cand AS (SELECT u.*, unit, incl, lim.amount AS lim_amount, tiers IS NOT NULL AND tier IS NULL AS open FROM units u JOIN lim ON u.clause_id = lim.clause_id AND u.currency = cur WHERE tiers IS NULL OR tier IS NULL OR list_contains(tiers, tier)),
val AS (SELECT *, CASE unit WHEN 'per_night' THEN round(base / nights::DECIMAL(10,0)::DOUBLE, 2)::DECIMAL(14,2) WHEN 'per_person' THEN round(base / persons::DOUBLE, 2)::DECIMAL(14,2) WHEN 'per_month' THEN (base + peers)::DECIMAL(14,2) WHEN 'per_km' THEN CASE WHEN km IS NOT NULL THEN base END ELSE CASE WHEN share_of IS NOT NULL THEN base END END::DECIMAL(14,2) AS compared,
  CASE unit WHEN 'per_km' THEN (lim_amount * km)::DECIMAL(14,2) WHEN 'percent_of_amount' THEN (lim_amount * share_of * 0.01)::DECIMAL(14,2) ELSE lim_amount::DECIMAL(14,2) END AS lv FROM cand),
agg AS (SELECT unit_id, bool_and(CASE WHEN incl THEN compared <= lv ELSE compared < lv END) AS all_in, bool_or(CASE WHEN incl THEN compared <= lv ELSE compared < lv END) AS some_in, count(DISTINCT lv) AS n, min(lv) AS least, max(lv) AS most, min(compared) AS compared,
  max(CASE WHEN compared IS NULL THEN CASE WHEN base IS NULL THEN 'document_amount' ELSE CASE unit WHEN 'per_night' THEN 'stay_nights' WHEN 'per_person' THEN 'attendee_count' WHEN 'per_month' THEN 'monthly_history' WHEN 'per_km' THEN 'distance_km' ELSE 'percent_base_amount' END END END) AS lacking, bool_or(open) AS open FROM val GROUP BY 1),
res AS (SELECT u.*, CASE WHEN u.clause_id = 'L-NONE' THEN NULL WHEN currency IS NULL THEN 'currency' WHEN currency NOT IN (SELECT cur FROM lim WHERE lim.clause_id = u.clause_id) THEN 'fx_rate' WHEN a.unit_id IS NULL THEN 'applicable_limit' WHEN lacking IS NOT NULL THEN lacking
  WHEN NOT open AND n > 1 THEN 'applicable_limit' WHEN open AND some_in AND NOT all_in THEN 'tier' END AS l_missing, a.all_in, CASE WHEN a.all_in THEN least ELSE most END AS lim_v, a.compared FROM units u LEFT JOIN agg a USING (unit_id)),
lims AS (SELECT *, CASE WHEN l_missing IS NOT NULL THEN 'not_evaluated' WHEN clause_id = 'L-NONE' THEN 'no_limit' WHEN NOT all_in THEN 'over_limit' WHEN compared < lim_v THEN 'within_limit' ELSE 'at_limit' END AS comparison,
  CASE WHEN l_missing IS NULL AND clause_id <> 'L-NONE' THEN compared END AS cmp, CASE WHEN l_missing IS NULL AND clause_id <> 'L-NONE' THEN lim_v END AS limit_applied FROM res)"""


@query("L2_candidate_limits", f"WITH {_UNITS} SELECT unit_id, lim_amount AS amount, open AS unresolved FROM cand")
def candidate_limits(spark, d):
    return L.candidate_limits(units(spark, d), clauses(spark)).select("unit_id", F.col("limit.amount").alias("amount"), (F.size("unresolved") > 0).alias("unresolved"))


@query("L3_per_unit_value", f"WITH {_UNITS} SELECT unit_id, lim_amount AS amount, compared, lv AS limit_value FROM val")
def per_unit_value(spark, d):
    return L.per_unit(L.candidate_limits(units(spark, d), clauses(spark))).select("unit_id", F.col("limit.amount").alias("amount"), "compared", "limit_value")


@query("L4_resolved_limits", f"WITH {_UNITS} SELECT unit_id, comparison, cmp AS compared, limit_applied, coalesce(l_missing, '') AS missing FROM lims")
def resolved_limits(spark, d):
    return L.resolve_limits(units(spark, d), clauses(spark)).withColumn("missing", F.array_join("missing", ","))


@query("L5_comparisons", f"WITH {_UNITS} SELECT clause_id, comparison, count(*) AS n FROM lims GROUP BY ALL")
def comparisons(spark, d):
    u = units(spark, d)
    return L.resolve_limits(u, clauses(spark)).join(u.select("unit_id", "clause_id"), "unit_id").groupBy("clause_id", "comparison").agg(F.count(F.lit(1)).alias("n"))


_COND = f"""{_UNITS}, cond0 AS (SELECT unit_id, 'c1' AS condition_id, c1 AS holds, NOT c1 AS violated, ['client_name'] AS lacks FROM units WHERE clause_id = 'L-NIGHT'
  UNION ALL SELECT unit_id, 'c2', persons >= 2, NOT persons >= 2, ['attendee_count'] FROM units WHERE clause_id = 'L-PERSON'
  UNION ALL SELECT unit_id, 'c4', c4a OR rank >= 5, NOT (c4a OR rank >= 5), [CASE WHEN c4a IS NULL THEN 'vehicle_ownership' END, CASE WHEN rank IS NULL THEN 'employee_grade' END] FROM units WHERE clause_id = 'L-PERSON'
  UNION ALL SELECT unit_id, 'c3', c3, c3, ['condition:c3'] FROM units WHERE clause_id = 'L-MONTH'
  UNION ALL SELECT unit_id, 'c5', since <= 30, since > 30, ['bill_date'] FROM units WHERE clause_id = 'L-KM'
  UNION ALL SELECT unit_id, 'c6', c6aa OR base > 3000 OR c6b, c6aa OR base > 3000 OR c6b, [CASE WHEN c6aa IS NULL AND base > 3000 IS NOT TRUE THEN 'bill_date' END, CASE WHEN c6aa IS NOT TRUE AND base IS NULL THEN 'document_amount' END, CASE WHEN c6b IS NULL THEN 'condition:c6b' END] FROM units WHERE clause_id = 'L-SHARE'),
cond AS (SELECT unit_id, condition_id, holds, coalesce(violated, false) AS violated, CASE WHEN holds IS NULL THEN list_filter(lacks, lambda x: x IS NOT NULL) ELSE [] END AS missing FROM cond0),
docu AS (SELECT unit_id, 'invoice' AS item, coalesce(base >= 1000 AND NOT invoice, false) AS violated, CASE WHEN base IS NULL THEN 'document_amount' WHEN base >= 1000 AND invoice IS NULL THEN 'documentation:invoice' END AS missing FROM units WHERE clause_id = 'L-NIGHT'
  UNION ALL SELECT unit_id, 'receipt', coalesce(NOT receipt, false), CASE WHEN receipt IS NULL THEN 'documentation:receipt' END FROM units WHERE clause_id = 'L-MONTH'
  UNION ALL SELECT unit_id, 'invoice', coalesce(currency = 'INR' AND base >= 2500 AND NOT invoice, false), CASE WHEN currency IS NULL THEN 'currency' WHEN currency <> 'INR' THEN 'fx_rate' WHEN base IS NULL THEN 'document_amount' WHEN base >= 2500 AND invoice IS NULL THEN 'documentation:invoice' END FROM units WHERE clause_id = 'L-KM'),
thr(clause_id, cur, t) AS (VALUES ('L-NIGHT', 'INR', 4000), ('L-NIGHT', 'USD', 4500), ('L-PERSON', 'INR', 0)),
appr AS (SELECT unit_id, coalesce(currency IS NOT NULL AND t IS NOT NULL AND base > t AND NOT coalesce(approved, false), false) AS needed, CASE WHEN currency IS NULL THEN 'currency' WHEN t IS NULL THEN 'fx_rate' WHEN base IS NULL THEN 'document_amount' END AS missing FROM units u LEFT JOIN thr ON u.clause_id = thr.clause_id AND currency = cur WHERE u.clause_id IN ('L-NIGHT', 'L-PERSON'))"""


@query("L6_any_of", f"WITH {_COND} SELECT unit_id, condition_id, holds, array_to_string(missing, ',') AS missing FROM cond WHERE condition_id IN ('c4', 'c6')")
def any_of(spark, d):
    """Conditions with alternatives, one of them with alternatives of its own, and what the unknown ones lack."""
    rows = L.check_conditions(units(spark, d), clauses(spark)).where("condition_id IN ('c4', 'c6')")
    return rows.select("unit_id", "condition_id", "holds", F.array_join("missing", ",").alias("missing"))


@query("L7_conditions", f"WITH {_COND} SELECT unit_id, condition_id, holds, violated, array_to_string(missing, ',') AS missing FROM cond")
def conditions(spark, d):
    return L.check_conditions(units(spark, d), clauses(spark)).withColumn("missing", F.array_join("missing", ","))


@query("L8_documentation", f"WITH {_COND} SELECT unit_id, item, violated, missing FROM docu")
def documentation(spark, d):
    return L.check_documentation(units(spark, d), clauses(spark))


@query("L9_approval", f"WITH {_COND} SELECT unit_id, needed, missing FROM appr")
def approval(spark, d):
    return L.check_approval(units(spark, d), clauses(spark))


_VERDICTS = f"""{_COND}, mis AS (SELECT unit_id, 0 AS k, l_missing AS m FROM lims UNION ALL SELECT unit_id, 100 * substr(condition_id, 2)::INT + j, missing[j] FROM (SELECT *, generate_subscripts(missing, 1) AS j FROM cond) UNION ALL SELECT unit_id, 1000, missing FROM docu UNION ALL SELECT unit_id, 2000, missing FROM appr),
m AS (SELECT unit_id, coalesce(string_agg(m, ',' ORDER BY k), '') AS missing FROM (SELECT unit_id, m, min(k) AS k FROM mis GROUP BY 1, 2) GROUP BY 1),
bad AS (SELECT unit_id FROM lims WHERE comparison = 'over_limit' OR clause_id = 'L-NONE' UNION SELECT unit_id FROM cond WHERE violated UNION SELECT unit_id FROM docu WHERE violated),
ver AS (SELECT unit_id, clause_id, CASE WHEN unit_id IN (SELECT unit_id FROM bad) THEN 'violation' WHEN unit_id IN (SELECT unit_id FROM appr WHERE needed) THEN 'needs_approval' WHEN missing <> '' THEN 'insufficient_information' ELSE 'compliant' END AS verdict, comparison, missing FROM lims JOIN m USING (unit_id))"""


@query("L10_verdicts", f"WITH {_VERDICTS} SELECT unit_id, verdict, comparison, missing FROM ver")
def verdicts(spark, d):
    return L.verdicts(units(spark, d), clauses(spark)).select("unit_id", "verdict", "comparison", F.array_join("missing", ",").alias("missing"))


@query("J2_category_clauses", "WITH t(category, clause_id) AS (VALUES ('PROMO BURNISHED COPPER', 'L-NIGHT'), ('ECONOMY ANODIZED STEEL', 'L-PERSON'), ('SMALL PLATED BRASS', 'L-MONTH'), ('LARGE BRUSHED STEEL', 'L-KM'), ('MEDIUM POLISHED TIN', 'L-SHARE'), ('STANDARD POLISHED TIN', 'L-NONE')) SELECT category, clause_id FROM t WHERE category IN (SELECT p_type FROM part) UNION SELECT DISTINCT p_type, 'L-MONTH' FROM part")
def category_clauses(spark, d):
    from tallyspark.plans.proxy import table

    return L.category_clauses(table(spark, d, "part").select(F.col("p_type").alias("category")).distinct(), clauses(spark))


@query("L17_idempotent_runs", """WITH r AS (SELECT o_orderkey AS claim_id, CASE o_custkey % 3 WHEN 0 THEN 'v2' ELSE 'v1' END AS policy_version, o_custkey % 4 = 0 AS force FROM orders), s AS (SELECT l_orderkey AS claim_id, CASE l_linenumber % 2 WHEN 0 THEN 'v1' ELSE 'v2' END AS policy_version, l_linenumber AS seq FROM lineitem WHERE l_linenumber > 1)
  SELECT claim_id, policy_version, 'p1' AS prompt_version, force, (CASE WHEN NOT force AND same IS NOT NULL THEN same ELSE coalesce((SELECT max(seq) FROM s WHERE s.claim_id = q.claim_id), 0) + 1 END)::BIGINT AS evaluation_seq, same IS NOT NULL AND NOT force AS reused
  FROM (SELECT r.*, (SELECT max(seq) FROM s WHERE s.claim_id = r.claim_id AND s.policy_version = r.policy_version) AS same FROM r) q""")
def idempotent_runs(spark, d):
    """Claims are asked for under one of two versions, some with force; runs of both versions are stored."""
    from tallyspark.plans.proxy import table

    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_custkey") % 3 == 0, "v2").otherwise("v1").alias("policy_version"), F.lit("p1").alias("prompt_version"), (F.col("o_custkey") % 4 == 0).alias("force"))
    stored = table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_linenumber") % 2 == 0, "v1").otherwise("v2").alias("policy_version"), F.lit("p1").alias("prompt_version"), F.col("l_linenumber").cast("long").alias("evaluation_seq"))
    return L.plan_runs(asked, stored)


#: Two runs of every third claim, one of the others, none of every fifth document; a run's clause follows from document and run.
_DECISIONS = "decisions AS (SELECT claim_id, document_id, s AS seq, 'C' || (document_id + s) % 2 AS clause_id FROM docs, range(1, 3) t(s) WHERE document_id % 5 > 0 AND (s = 1 OR claim_id % 3 = 0))"
_PEERS = f"""{_DECISIONS}, last AS (SELECT document_id, clause_id FROM decisions d WHERE seq = (SELECT max(seq) FROM decisions e WHERE e.claim_id = d.claim_id)),
  kin AS (SELECT *, date_trunc('month', bill_date)::DATE AS m FROM docs WHERE currency IS NOT NULL),
  peers AS (SELECT a.document_id, 'C' || a.document_id % 2 AS clause_id, count(*) FILTER (WHERE l.clause_id = 'C' || a.document_id % 2) AS n_peers, coalesce(sum(b.amount) FILTER (WHERE l.clause_id = 'C' || a.document_id % 2), 0)::DECIMAL(22,2) AS peers_total, count(*) FILTER (WHERE b.document_id IS NOT NULL AND l.clause_id IS NULL) AS n_unattributed
    FROM kin a LEFT JOIN kin b ON a.employee_id = b.employee_id AND a.category = b.category AND a.currency = b.currency AND a.m = b.m AND a.document_id <> b.document_id AND (b.claim_status = 'submitted' OR b.claim_id = a.claim_id) LEFT JOIN last l ON l.document_id = b.document_id GROUP BY 1)"""


def decisions(rows):
    """Stored decisions of the documents, see _DECISIONS."""
    runs = rows.where("document_id % 5 > 0").select("claim_id", "document_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("evaluation_seq")).where("evaluation_seq = 1 OR claim_id % 3 = 0")
    return runs.withColumn("clause_id", F.concat(F.lit("C"), ((F.col("document_id") + F.col("evaluation_seq")) % 2).cast("string")))


@query("J5_monthly_peers", f"WITH {DOCS}, {_PEERS} SELECT d.document_id, 'C' || d.document_id % 2 AS clause_id, n_peers, peers_total, n_unattributed FROM docs d LEFT JOIN peers USING (document_id)")
def monthly_peers(spark, d):
    """Peers by clause of their claim's latest run, and those without any run."""
    rows = docs(spark, d)
    units = rows.select("document_id", F.concat(F.lit("C"), (F.col("document_id") % 2).cast("string")).alias("clause_id"))
    return L.monthly_peers(units, rows, decisions(rows))


@query("P45_effective_verdict", f"WITH {_VERDICTS} SELECT unit_id, CASE WHEN unit_id % 10 = 3 THEN 'compliant' ELSE verdict END AS verdict FROM ver")
def effective_verdict(spark, d):
    human = units(spark, d).where("unit_id % 10 = 3").select("unit_id", F.lit("compliant").alias("human"))
    return L.verdicts(units(spark, d), clauses(spark)).join(human, "unit_id", "left").select("unit_id", F.coalesce("human", "verdict").alias("verdict"))


query("J14_applicable_limits", f"WITH {_UNITS} SELECT unit_id, lim_amount AS amount, open AS unresolved FROM cand")(candidate_limits)


@query("U2_thresholds", """WITH t(clause_id, currency, amount, kind, category) AS (VALUES ('L-NIGHT', 'INR', 4000::DECIMAL(12,2), 'approval', 'PROMO BURNISHED COPPER'), ('L-NIGHT', 'USD', 4500, 'approval', 'PROMO BURNISHED COPPER'), ('L-PERSON', 'INR', 0, 'approval', 'ECONOMY ANODIZED STEEL'), ('L-NIGHT', NULL, 1000, 'documentation', 'PROMO BURNISHED COPPER'))
  SELECT t.*, n FROM t LEFT JOIN (SELECT p_type, count(*) AS n FROM part GROUP BY 1) ON p_type = category""")
def all_thresholds(spark, d):
    """Approval and documentation thresholds of the clauses, one table."""
    rows = clauses(spark)
    approval = rows.select("clause_id", "applies_to", F.explode("approval").alias("currency", "amount")).select("clause_id", "currency", "amount", F.lit("approval").alias("kind"), F.explode("applies_to").alias("category"))
    receipt = rows.select("clause_id", "applies_to", F.explode("documents").alias("x")).where("x.min_amount IS NOT NULL").select("clause_id", F.lit(None).cast("string").alias("currency"), F.col("x.min_amount").alias("amount"), F.lit("documentation").alias("kind"), F.explode("applies_to").alias("category"))
    from tallyspark.plans.proxy import table

    parts = table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return approval.unionByName(receipt).join(parts, "category", "left")


_RULES = "# Rules\n1.1. not yet\n## 1. General\nintro\n1.1. First <T>\nmore\n\n| a | b |\n1.2. Second\n---\nstray\n- no bullet\n## 2. Terms\n2.1. term\n## 3. Caps\n1.5. of another section\n3.1.2. Deep <N>\n- of the clause\n4.1. no start\n3.1.2. again\n## 19. Never\n\nThese are never\npaid by us:\n- drinks <N>\n- fines\n19.9. numbered\n- its own\n## 4. End\n4.1. Last"


@query("L1_segments", """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), x AS (SELECT doc_id, t, unnest([('1.1', '1', 0, '1.1. First ' || t || chr(10) || 'more' || chr(10) || chr(10) || '| a | b |', false, false), ('1.2', '1', 1, '1.2. Second', false, false), ('3.1.2', '3', 2, '3.1.2. Deep ' || doc_id || chr(10) || '- of the clause' || chr(10) || '4.1. no start', false, true), ('3.1.2', '3', 3, '3.1.2. again', false, true),
  ('19.1', '19', 4, 'These are never paid by us:' || chr(10) || '- drinks ' || doc_id, true, false), ('19.2', '19', 5, 'These are never paid by us:' || chr(10) || '- fines', true, false), ('19.9', '19', 6, '19.9. numbered' || chr(10) || '- its own', false, false), ('4.1', '4', 7, '4.1. Last', false, false)]) AS c FROM t)
  SELECT doc_id, c[1] AS clause_id, c[2] AS section, c[3]::INT AS sort_order, md5(c[4]) AS digest, c[5] AS synthesized, c[6] AS duplicate FROM x""")
def segments(spark, d):
    """Rule texts with each document's text and number in them."""
    from tallyspark.operators.ruleset import segments as cut
    from tallyspark.plans.proxy import table

    text = F.replace(F.replace(F.lit(_RULES), F.lit("<T>"), F.trim(F.regexp_replace("text", r"\s+", " "))), F.lit("<N>"), F.col("doc_id").cast("string"))
    found = cut(table(spark, d, "documents").select("doc_id", text.alias("rules")), "doc_id", "rules")
    return found.select("doc_id", "clause_id", "section", "sort_order", F.md5("text").alias("digest"), "synthesized", "duplicate")


def _overridden(spark, d):
    """Parts are clauses; the patches are sound, of a missing clause, without a reason, of an unknown field, or a comment."""
    from tallyspark.operators.ruleset import override
    from tallyspark.plans.proxy import table

    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.floor("p_retailprice").cast("long").alias("n"))
    name = F.concat(F.lit("P"), F.col("k").cast("string"))
    clauses_ = rows.select(name.alias("clause_id"), F.format_string('{"limit_table":[{"amount":%d,"currency":"INR"}],"limit_unit":"per_trip","limit_amount":%d,"limit_currency":"INR","notes":null}', "n", "n").alias("body"))
    kind = F.col("k") % 6
    patch = F.when(kind == 0, F.format_string('{"_reason":"price","limit_table":[{"amount":%d,"currency":"USD"}],"notes":"n"}', F.col("n") + 1)).when(kind == 1, F.lit('{"_reason":"two","limit_table":[{"amount":1},{"amount":2}]}')).when(kind == 2, F.lit('{"limit_unit":"per_day"}')).when(kind == 3, F.lit('{"_reason":"x","limit_unit":"per_day","mood":1}')).otherwise('{"_reason":"x","notes":"y"}')
    patches = rows.where("k % 6 < 5").select(F.when(kind == 4, F.concat(F.lit("X"), name)).otherwise(name).alias("clause_id"), patch.alias("patch")).unionByName(rows.where("k % 6 = 5").select(F.concat(F.lit("_"), name).alias("clause_id"), F.lit("{}").alias("patch")))
    return override(clauses_, patches)


@query("L15_overrides", """SELECT 'P' || p_partkey AS clause_id, '{' || CASE p_partkey % 6 WHEN 0 THEN '"limit_amount":' || n + 1 || ',"limit_currency":"USD","limit_table":[{"amount":' || n + 1 || ',"currency":"USD"}],"limit_unit":"per_trip","notes":"n"' WHEN 1 THEN '"limit_amount":null,"limit_currency":null,"limit_table":[{"amount":1},{"amount":2}],"limit_unit":"per_trip","notes":null'
    ELSE '"limit_table":[{"amount":' || n || ',"currency":"INR"}],"limit_unit":"per_trip","limit_amount":' || n || ',"limit_currency":"INR","notes":null' END || '}' AS body FROM (SELECT *, floor(p_retailprice)::BIGINT AS n FROM part)""")
def clause_overrides(spark, d):
    return _overridden(spark, d)[0]


@query("L15_override_log", """SELECT 'P' || p_partkey AS clause_id, CASE p_partkey % 6 WHEN 0 THEN 'price' ELSE 'two' END AS reason, CASE p_partkey % 6 WHEN 0 THEN 'limit_table,notes' ELSE 'limit_table' END AS changed, '{"limit_table":[{"amount":' || floor(p_retailprice)::BIGINT || ',"currency":"INR"}]' || CASE p_partkey % 6 WHEN 0 THEN ',"notes":null' ELSE '' END || '}' AS before, NULL AS problem FROM part WHERE p_partkey % 6 < 2
  UNION ALL SELECT CASE p_partkey % 6 WHEN 4 THEN 'XP' ELSE 'P' END || p_partkey, NULL, NULL, NULL, CASE p_partkey % 6 WHEN 2 THEN 'no_reason' WHEN 3 THEN 'unknown_field:mood' ELSE 'unknown_clause' END FROM part WHERE p_partkey % 6 IN (2, 3, 4)""")
def override_log(spark, d):
    """What was changed and why, and what could not be."""
    _, log, problems = _overridden(spark, d)
    return log.withColumn("changed", F.array_join("changed", ",")).withColumn("problem", F.lit(None).cast("string")).unionByName(problems, allowMissingColumns=True)


@query("L16_publish", "SELECT s_name AS label, false AS is_active FROM supplier UNION ALL SELECT 'NEW', true")
def publish(spark, d):
    from tallyspark.plans.proxy import table

    return L.publish(table(spark, d, "supplier").select(F.col("s_name").alias("label"), F.lit(True).alias("is_active")), "NEW")


_LABEL = "CASE clause_id WHEN 'L-NIGHT' THEN 'per night' WHEN 'L-PERSON' THEN 'per person' WHEN 'L-MONTH' THEN 'per month' WHEN 'L-KM' THEN 'km rate x distance' ELSE '% of bill amount' END"
_SAID = f"{_shown('cmp', 'currency')} || ' vs ' || {_shown('limit_applied', 'currency')} || ' limit (' || {_LABEL} || ')'"


@query("L19_explanations", f"""WITH {_VERDICTS}, why AS (SELECT unit_id, 1 AS k, condition_id AS j, CASE WHEN condition_id IN ('c3', 'c6') THEN 'Excluded circumstance applies: ' ELSE 'Required condition not met: ' END || condition_id AS w FROM cond WHERE violated
    UNION ALL SELECT unit_id, 2, '', 'L-NONE is an unconditional prohibition' FROM units WHERE clause_id = 'L-NONE' UNION ALL SELECT unit_id, 3, '', 'Required proof missing: ' || item FROM docu WHERE violated
    UNION ALL SELECT unit_id, 4, '', CASE WHEN t > 0 THEN base || ' exceeds the ' || t::DECIMAL(12,2) || ' approval threshold and no approval is evidenced' ELSE u.clause_id || ' requires approval and none is evidenced' END FROM appr JOIN units u USING (unit_id) JOIN thr ON thr.clause_id = u.clause_id AND cur = currency WHERE needed),
  f AS (SELECT unit_id, arg_min(w, k || j) AS w FROM why GROUP BY 1)
  SELECT unit_id, CASE WHEN verdict = 'compliant' AND cmp IS NOT NULL THEN 'Within the limit under ' || v.clause_id || ': ' || {_SAID.replace('clause_id', 'v.clause_id')} || '.' WHEN verdict = 'compliant' THEN 'No limit is exceeded and no condition of ' || v.clause_id || ' is violated.'
    WHEN verdict = 'insufficient_information' THEN 'Cannot be decided under ' || v.clause_id || ': missing ' || replace(v.missing, ',', ', ') || '.' WHEN v.comparison = 'over_limit' THEN 'Over the limit under ' || v.clause_id || ': ' || {_SAID.replace('clause_id', 'v.clause_id')} || '.' ELSE w || ' (' || v.clause_id || ').' END AS explanation
  FROM ver v JOIN lims USING (unit_id) LEFT JOIN f USING (unit_id)""")
def explanations(spark, d):
    rows = L.verdicts(units(spark, d), clauses(spark))
    said = L.explanation(*[F.col(c) for c in ("verdict", "comparison", "compared", "limit_applied", "limit_unit", "currency", "missing", "reasons", "clause_id")])
    return rows.select("unit_id", said.alias("explanation"))
