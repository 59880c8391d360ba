"""Literal cases: grounding, signed references, judgments, segments of rules, overrides, pairs of lines, recovered items, run keys, peers."""

import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import evaluate as E
from tallyspark.operators import policy as L
from tallyspark.operators import responses as V
from tallyspark.operators import ruleset as B

RULES = [("duplicate_same_employee", "fired", "2 receipts", '{"vendor":"Toit","documents":[{"date":"2026-07-08","total":"3,240"},{"date":"2026-07-11"}],"gap":3}'), ("weekend_business", "fired", None, None), ("round_number", "clear", "500", '{"x":9999}')]
NARRATIVES = [
    ("not json", "not_json"), ('["x"]', "no_summary"), ('{"summary":3,"rules_referenced":["x"]}', "no_summary"), ('{"summary":"x"}', "no_rules"), ('{"summary":"x","rules_referenced":"weekend_business"}', "no_rules"),
    (json.dumps({"summary": "x", "rules_referenced": ["weekend_business", "round_number"]}), "unfired_rule:round_number"), ("Same vendor, a Round Number.", "mentions:round_number"), ("Flagged by the velocity rule.", "mentions:velocity"), ("It is just under it.", "mentions:threshold_gaming"),
    ("Billed 9999 twice.", "stray_number:9999"), ("A total of 6480.50 was claimed.", "stray_number:6480.5"), ("Toit receipts of 3240 dated 2026-07-08 and 2026-07-11, 3 days apart, 2 documents.", None), ("No number, on a Saturday.", None),
]


def test_grounding(spark):
    told = lambda a: json.dumps({"summary": a, "rules_referenced": ["duplicate_same_employee"]}) if a[0].isupper() else a
    rows = spark.createDataFrame([(k, told(a), RULES) for k, (a, _) in enumerate(NARRATIVES)], "k int, a string, rules array<struct<rule_id:string,status:string,reason:string,evidence:string>>")
    got = {r.k: r for r in V.grounded(rows, "a", "rules").collect()}
    assert [got[k].failure for k in range(len(NARRATIVES))] == [w for _, w in NARRATIVES]
    assert got[11].summary == NARRATIVES[11][0] and got[0].summary is None


@pytest.mark.parametrize("text, want", [('{"a1":[1,2,[]],"b":"x [3,4] {5"}', {1, 2, 3, 0, 34, 5}), ("[]", {0}), ('{"a":"1,234.50","b":[[1],["x"]]}', {D("1234.5"), 1, 2}), ('"\\" 7 ]"', {7})])
def test_evidence_numbers(spark, text, want):
    got = spark.range(1).select(V.evidence_numbers(F.lit(text)).alias("n")).first().n
    assert {x if x % 1 else int(x) for x in got} == want | ({3} if text.startswith('{"a1"') else set())


def test_signed_references(spark):
    leaves = spark.createDataFrame([(1, "amount", "₹ 32,181.59"), (1, "line_items[1].total", "(5.00)"), (1, "vendor", "Toit"), (1, "gone", None)], "doc long, path string, value string")
    refs = [(1, 0, 0, "amount", 1), (1, 0, 1, "line_items[1].total", -1), (1, 1, 0, "amount", 1), (1, 1, 1, "line_items[7].total", 1), (1, 2, 0, "vendor", 1), (1, 3, 0, "amount", 2), (1, 4, 0, "gone", 1)]
    sums = V.signed_sums(spark.createDataFrame(refs, "doc long, unit_id int, pos int, path string, sign int"), leaves, "doc")
    got = {r.unit_id: (r.total, r.failure) for r in sums.collect()}
    assert got == {0: (D("32186.59"), None), 1: (None, "path_not_found"), 2: (None, "not_an_amount"), 3: (None, "bad_sign"), 4: (None, "not_an_amount")}
    units = spark.createDataFrame([(1, 0, D("32186.59")), (1, 1, D(1)), (1, 5, D(1)), (1, 6, None)], "doc long, unit_id int, stated decimal(12,2)")
    assert {r.unit_id: r.failure for r in V.reconciled(units, sums, "doc").collect()} == {0: None, 1: "amount_ref_invalid", 5: "amount_without_refs", 6: None}


def test_segments(spark):
    text = "x\n## 1. A\n1.1. a\n1.2. b\n\n---\n## 2. Terms\n2.1. t\n## 19. No\nThese:\n- a\nand\n- b\n## 1. Again\n1.1. c"
    got = B.segments(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string"), "k", "t").orderBy("sort_order").collect()
    assert [(r.clause_id, r.text, r.synthesized, r.duplicate) for r in got] == [("1.1", "1.1. a", False, True), ("1.2", "1.2. b", False, False), ("19.1", "These:\n- a", True, False), ("19.2", "These: and\n- b", True, False), ("1.1", "1.1. c", False, True)]


def test_pairs_of_lines(spark):
    text = "**A**: 1\n\n| k | v |\n|---|---|\n| --- | x |\n**Key**\n\n| taken | row |\nName: Jo  Ref Number: 7\n* **B** two\n**C**\n**D**\n**E**"
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(text.split("\n"))], "doc int, pos int, line string")
    got = [(r.key, r.value) for r in E.pairs_of_lines(rows).orderBy("pos", "n").collect()]
    assert got == [("A", "1"), ("k", "v"), ("Key", "| taken | row |"), ("Name", "Jo  Ref Number: 7"), ("Name", "Jo"), ("Ref Number", "7"), ("B", "two"), ("C", "**D**")]


def test_run_keys(spark):
    """A stored run is used again; force or another version makes a new one, and stored rows stay."""
    stored = spark.createDataFrame([(1, "v1", "p1", 1, "violation"), (1, "v1", "p1", 2, "compliant"), (2, "v1", "p2", 4, "compliant")], "claim_id long, policy_version string, prompt_version string, evaluation_seq int, verdict string")
    asked = spark.createDataFrame([(1, "v1", "p1", False), (2, "v1", "p1", None), (3, "v1", "p1", True)], "claim_id long, policy_version string, prompt_version string, force boolean")
    plan = L.plan_runs(asked, stored)
    assert {r.claim_id: (r.evaluation_seq, r.reused) for r in plan.collect()} == {1: (2, True), 2: (5, False), 3: (1, False)}
    forced = L.plan_runs(asked.withColumn("force", F.lit(True)), stored)
    assert {r.claim_id: (r.evaluation_seq, r.reused) for r in forced.collect()} == {1: (3, False), 2: (5, False), 3: (1, False)}
    after = L.append_runs(plan, stored, spark.createDataFrame([(k, "violation") for k in (1, 2, 3)], "claim_id long, verdict string"))
    assert sorted((r.claim_id, r.evaluation_seq) for r in after.collect()) == [(1, 1), (1, 2), (2, 4), (2, 5), (3, 1)]


def test_peers_by_clause(spark):
    doc = lambda k, claim, status, amount, state="ready", category="mobile", day="2026-05-03": (k, claim, status, state, 9, category, "INR", D(amount) if amount else None, day)
    rows = [doc(1, 1, "draft", "10"), doc(2, 1, "draft", "20"), doc(3, 2, "submitted", "40"), doc(4, 2, "submitted", "80"), doc(5, 3, "draft", "160"), doc(6, 2, "submitted", "320", "removed"), doc(7, 2, "submitted", "640", day="2026-06-01"), doc(8, 4, "submitted", "1280"), doc(9, 2, "submitted", None)]
    docs = spark.createDataFrame(rows, "document_id long, claim_id long, claim_status string, doc_status string, employee_id long, category string, currency string, amount decimal(12,2), d string").withColumn("bill_date", F.to_date("d"))
    runs = spark.createDataFrame([(2, 3, "12.1", 1), (2, 3, "12.2", 2), (2, 4, "12.1", 2), (1, 2, "12.1", 1), (1, 1, "12.1", 1), (3, 5, "12.1", 1)], "claim_id long, document_id long, clause_id string, evaluation_seq int")
    units = spark.createDataFrame([(1, "12.1"), (1, "12.2"), (5, "12.1"), (4, "12.1")], "document_id long, clause_id string")
    got = {(r.document_id, r.clause_id): (r.n_peers, r.peers_total, r.n_unattributed) for r in L.monthly_peers(units, docs, runs).collect()}
    assert got == {(1, "12.1"): (2, D(100), 1), (1, "12.2"): (1, D(40), 1), (5, "12.1"): (1, D(80), 1), (4, "12.1"): (0, D(0), 1)}
    assert sorted(r.document_id for r in L.unattributed_peers(docs, runs).collect()) == [7, 8]  # that of June too, for its own month
