"""Boundary cases of limits, conditions, documentation, approval and verdicts."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import policy as L
from tallyspark.plans.policy import _CLAUSE_TYPE

UNIT = "unit_id long, clause_id string, currency string, base_amount decimal(12,2), base_of_percent decimal(12,2), nights int, days int, persons int, distance_km decimal(10,2), grade_rank int, days_since_expense int, n_peers int, peers_total decimal(12,2), dims map<string,string>, judgments map<string,boolean>, documentation map<string,boolean>, approval_evidenced boolean"


def verdict(spark, clause=None, **facts):
    c = {"unit": "per_night", "kind": "amount", "inclusive": True, "banned": False, "limits": [(D(100), "INR", {})], "conditions": [], "documents": [], "approval": {}} | (clause or {})
    f = {"currency": "INR", "base": D(100), "share_of": None, "nights": 1, "days": None, "persons": None, "km": None, "rank": None, "since": None, "n_peers": None, "peers": None, "dims": {}, "judgments": {}, "documentation": {}, "approved": None} | facts
    filled = lambda some, n: [(*x, *[None] * (n - len(x))) for x in some]
    clauses = spark.createDataFrame([("C", c["unit"], c["kind"], c["inclusive"], c["banned"], c["limits"], filled(c["conditions"], 9), filled(c["documents"], 3), c["approval"], ["*"])], _CLAUSE_TYPE)
    units = spark.createDataFrame([(1, "C", *f.values())], UNIT)
    r = L.verdicts(units, clauses).first()
    return r.verdict, r.comparison, list(r.missing)


TIERED = [(D(900), "INR", {"tier": ["1"]}), (D(600), "INR", {"tier": ["2", "3"]})]
CASES = [
    ({}, {}, ("compliant", "at_limit", [])),
    ({"inclusive": False}, {}, ("violation", "over_limit", [])),
    ({}, {"base": D("200.01"), "nights": 2}, ("violation", "over_limit", [])),
    ({}, {"base": D(150), "nights": 2}, ("compliant", "within_limit", [])),
    ({}, {"nights": None}, ("insufficient_information", "not_evaluated", ["stay_nights"])),
    ({}, {"base": None}, ("insufficient_information", "not_evaluated", ["document_amount"])),
    ({}, {"currency": None}, ("insufficient_information", "not_evaluated", ["currency"])),
    ({}, {"currency": "USD"}, ("insufficient_information", "not_evaluated", ["fx_rate"])),
    ({"unit": "unknown"}, {}, ("insufficient_information", "not_evaluated", ["policy_limit_unit"])),
    ({"limits": []}, {}, ("insufficient_information", "not_evaluated", ["policy_limit_missing"])),
    ({"limits": TIERED}, {"base": D(500)}, ("compliant", "within_limit", [])),
    ({"limits": TIERED}, {"base": D(950)}, ("violation", "over_limit", [])),
    ({"limits": TIERED}, {"base": D(700)}, ("insufficient_information", "not_evaluated", ["tier"])),
    ({"limits": TIERED}, {"base": D(700), "dims": {"tier": "2"}}, ("violation", "over_limit", [])),
    ({"limits": TIERED}, {"base": D(700), "dims": {"tier": "9"}}, ("insufficient_information", "not_evaluated", ["applicable_limit"])),
    ({"limits": [(D(90), "INR", {}), (D(100), "INR", {})]}, {}, ("insufficient_information", "not_evaluated", ["applicable_limit"])),
    ({"unit": "per_month"}, {"base": D(60), "n_peers": 1, "peers": D(50)}, ("violation", "over_limit", [])),
    ({"unit": "per_month"}, {"base": D(60)}, ("insufficient_information", "not_evaluated", ["monthly_history"])),
    ({"unit": "per_month", "kind": "count", "limits": [(D(2), None, {})]}, {"n_peers": 2}, ("violation", "over_limit", [])),
    ({"unit": "per_km", "limits": [(D(10), "INR", {})]}, {"km": D("9.5")}, ("violation", "over_limit", [])),
    ({"unit": "percent_of_amount", "limits": [(D(10), "INR", {})]}, {"share_of": D(1000)}, ("compliant", "at_limit", [])),
    ({"unit": "none", "limits": [], "banned": True}, {}, ("violation", "no_limit", [])),
    ({"conditions": [("c", "requires", "judgment", None, None, None)]}, {"judgments": {"c": False}}, ("violation", "at_limit", [])),
    ({"conditions": [("c", "excludes", "judgment", None, None, None)]}, {"judgments": {"c": True}}, ("violation", "at_limit", [])),
    ({"conditions": [("c", "requires", "judgment", None, None, None)]}, {}, ("insufficient_information", "at_limit", ["condition:c"])),
    ({"conditions": [("c", "requires", "numeric", "persons", ">=", D(2))]}, {"persons": 2}, ("compliant", "at_limit", [])),
    ({"conditions": [("c", "requires", "numeric", "persons", ">=", D(2))]}, {}, ("insufficient_information", "at_limit", ["attendee_count"])),
    ({"documents": [("invoice", D(50))]}, {"documentation": {"invoice": False}}, ("violation", "at_limit", [])),
    ({"documents": [("invoice", D(500))]}, {"documentation": {"invoice": False}}, ("compliant", "at_limit", [])),
    ({"documents": [("invoice", None)]}, {}, ("insufficient_information", "at_limit", ["documentation:invoice"])),
    ({"approval": {"INR": D(99)}}, {}, ("needs_approval", "at_limit", [])),
    ({"approval": {"INR": D(100)}}, {}, ("compliant", "at_limit", [])),
    ({"approval": {"INR": D(0)}}, {"approved": True}, ("compliant", "at_limit", [])),
    ({"approval": {"INR": D(50)}, "documents": [("x", None)]}, {}, ("needs_approval", "at_limit", ["documentation:x"])),
]


LEASED_OR_SENIOR = [("c1", "requires"), ("c1a", None, "judgment", None, None, None, ["vehicle_ownership"], "c1"), ("c1b", None, "numeric", "grade_rank", ">=", D(5), None, "c1")]
NESTED = [("c1", "excludes"), ("c2", None, None, None, None, None, None, "c1"), ("c3", None, "judgment", None, None, None, ["trip_id", "currency"], "c2"), ("c4", None, "numeric", "nights", ">", D(5), None, "c2"), ("c5", None, "judgment", None, None, None, ["claim_note"], "c1")]
WINDOW = [("c", "requires", "numeric", "days_since_expense", "<=", D(30))]
FREE = {"unit": "none", "limits": []}
CASES += [
    (FREE | {"conditions": LEASED_OR_SENIOR}, {"rank": 5}, ("compliant", "no_limit", [])),
    (FREE | {"conditions": LEASED_OR_SENIOR}, {"rank": 4, "judgments": {"c1a": True}}, ("compliant", "no_limit", [])),
    (FREE | {"conditions": LEASED_OR_SENIOR}, {"rank": 4, "judgments": {"c1a": False}}, ("violation", "no_limit", [])),
    (FREE | {"conditions": LEASED_OR_SENIOR}, {"rank": 4}, ("insufficient_information", "no_limit", ["vehicle_ownership"])),
    (FREE | {"conditions": LEASED_OR_SENIOR}, {"judgments": {"c1a": False}}, ("insufficient_information", "no_limit", ["employee_grade"])),
    (FREE | {"conditions": LEASED_OR_SENIOR}, {}, ("insufficient_information", "no_limit", ["vehicle_ownership", "employee_grade"])),
    (FREE | {"conditions": NESTED}, {}, ("insufficient_information", "no_limit", ["trip_id", "claim_note"])),
    (FREE | {"conditions": NESTED}, {"nights": None}, ("insufficient_information", "no_limit", ["trip_id", "stay_nights", "claim_note"])),
    (FREE | {"conditions": NESTED}, {"nights": 6}, ("violation", "no_limit", [])),
    (FREE | {"conditions": NESTED}, {"judgments": {"c3": False, "c5": False}}, ("compliant", "no_limit", [])),
    (FREE | {"conditions": NESTED}, {"judgments": {"c5": True}}, ("violation", "no_limit", [])),
    (FREE | {"conditions": WINDOW}, {"since": 30}, ("compliant", "no_limit", [])),
    (FREE | {"conditions": WINDOW}, {"since": 90}, ("violation", "no_limit", [])),
    (FREE | {"conditions": WINDOW}, {}, ("insufficient_information", "no_limit", ["bill_date"])),
    ({"conditions": [("c", "requires", "numeric", "unit_amount", "<", D(60))]}, {"nights": 2}, ("compliant", "within_limit", [])),
    ({"conditions": [("c", "requires", "judgment", None, None, None, ["bill_date"])]}, {}, ("insufficient_information", "at_limit", ["bill_date"])),
    ({"conditions": [("c", "requires", "judgment", None, None, None, ["bill_date", "client_name"])], "documents": [("x", None)]}, {"base": D(101)}, ("violation", "over_limit", ["client_name", "documentation:x"])),
    (FREE | {"documents": [("x", None, {"INR": D(500), "USD": D(10)})]}, {"base": D(499)}, ("compliant", "no_limit", [])),
    (FREE | {"documents": [("x", None, {"INR": D(500), "USD": D(10)})]}, {"currency": "USD", "base": D(10), "documentation": {"x": False}}, ("violation", "no_limit", [])),
    (FREE | {"documents": [("x", None, {"INR": D(500)})]}, {"currency": "EUR"}, ("insufficient_information", "no_limit", ["fx_rate"])),
    (FREE | {"documents": [("x", None, {"INR": D(500)})]}, {"currency": None}, ("insufficient_information", "no_limit", ["currency"])),
    (FREE | {"documents": [("x", None, {"INR": D(500)})]}, {"base": None}, ("insufficient_information", "no_limit", ["document_amount"])),
]


@pytest.mark.parametrize("clause, facts, want", CASES)
def test_verdict(spark, clause, facts, want):
    assert verdict(spark, clause, **facts) == want


def test_monthly_peers_read_the_documents_four_times(spark):
    """Units, keys, peers and decisions: once each."""
    from tallyspark.plans import registry

    plan = registry.queries()["J5_monthly_peers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 4


def test_explanation_prints_each_amount_once_a_sentence(spark):
    """Two sentences have two amounts each; what a condition lacks is worked out with the clause, before units meet it."""
    from tallyspark.plans import policy, registry

    plan = registry.queries()["L19_explanations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan[: plan.index("Project", 1)].count("decimal(30,10)") == 4
    clauses = policy.clauses(spark).select(L.prepared().alias("p"), "clause_id")
    lacks = {r.clause_id: {c.id: (c.numeric, c.parts, list(c.lacks)) for c in r.p} for r in clauses.collect()}
    assert lacks["L-PERSON"]["c2"] == (True, False, ["attendee_count"]) and lacks["L-PERSON"]["c4"][:2] == (False, True) and lacks["L-PERSON"]["c4a"] == (False, False, ["vehicle_ownership"])
    assert lacks["L-NIGHT"]["c1"] == (False, False, ["client_name"]) and lacks["L-MONTH"]["c3"] == (False, False, ["condition:c3"])


def test_facts_make_the_documents_once_and_deal_out_units_without_peers(spark):
    """Documents are read from what was made once; a unit that can have no peers has a key of its own."""
    from tallyspark.plans import registry

    plan = registry.queries()["L11_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Relation [l_orderkey") == 0
    assert any("hashpartitioning(employee_id" in x and "_alone" in x for x in plan.executedPlan().toString().splitlines())


def test_facts_of_documents(spark):
    """Claims with and without a row, a draft's own documents, another clause, two clauses of one run, an older run, unjudged ones, lacking currency, category, employee or claim."""
    doc = lambda k, claim, status="submitted", clause="c", currency="INR", category="x", employee=9, state="ready", kind="receipt", amount="1": (k, claim, status, state, employee, category, currency, D(amount) if amount else None, "2026-05-03", clause, kind)
    rows = [doc(1, 1, "draft"), doc(2, 1, "draft", kind="approval_correspondence"), doc(3, 2), doc(4, 2, clause="d"), doc(5, 3, clause=None), doc(6, 4), doc(7, 4, currency=None), doc(8, 4, category=None), doc(9, 4, employee=None), doc(10, None), doc(11, 2, state="removed"), doc(12, 2, amount=None), doc(13, 2, clause="")]
    docs = spark.createDataFrame(rows, "document_id long, claim_id long, claim_status string, doc_status string, employee_id long, category string, currency string, amount decimal(12,2), d string, clause_id string, document_type string").withColumn("bill_date", F.to_date("d")).drop("d")
    runs = spark.createDataFrame([(1, 1, "c", 1), (1, 2, "c", 1), (2, 3, "d", 1), (2, 3, "c", 2), (2, 4, "c", 2), (2, 4, "d", 2), (2, 12, "c", 2), (3, 5, None, 1), (4, 6, "c", 1), (None, 10, "c", 1)], "claim_id long, document_id long, clause_id string, evaluation_seq int")
    claims = spark.createDataFrame([(1, 9, " "), (2, 9, "agreed"), (4, 9, None)], "claim_id long, employee_id long, note string").withColumn("submitted_on", F.lit("2026-06-01").cast("date"))
    employees = spark.createDataFrame([(9, " l2 ")], "employee_id long, grade string")
    today = F.lit("2026-07-01").cast("date")
    peers = {r.document_id: (r.n_peers, r.peers_total, r.n_unattributed) for r in L.monthly_peers(docs.select("document_id", "clause_id"), docs, runs).collect()}
    for given in (claims, claims.drop("employee_id")):
        got = {r.document_id: r for r in L.facts(docs, given, employees, runs, today, ("L1", "L2")).collect()}
        assert sorted(got) == [1, 2, 3, 4, 6, 7, 8, 9, 11, 12, 13]
        assert {k: (r.n_peers, r.peers_total, r.n_unattributed) for k, r in got.items()} == {k: peers[k] for k in got}
        assert [got[k].approval_evidenced for k in (1, 2, 3, 6)] == [True, False, True, False] and {r.days_since_expense for r in got.values()} == {29}
        assert got[1].grade == "L2" and got[1].grade_rank == 2
    assert peers[1] == (4, D(4), 3) and peers[4][:2] == (0, D(0)) and peers[7] == (None, None, None)
