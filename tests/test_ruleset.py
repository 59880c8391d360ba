"""Findings on structured clauses, schema problems of stored entries, reference tables, summaries."""

from decimal import Decimal as D

import pytest

from tallyspark.functions.tables import FIELDS
from tallyspark.operators import ruleset as B

SOUND = {"clause_id": "8.1", "text": "8.1. Nightly caps of 6,000 INR for L3 (see § 2.1).", "synthesized": False, "failed": False, "manual": False, "limit_unit": "per_night", "limit_kind": "amount", "limit_inclusive": True, "unit_evidence": "Nightly caps", "is_prohibition": False,
         "limits": [(D(6000), "INR", {"grade": ["L3"]})], "conditions": [], "documents": [], "approval": {}, "applies_to": ["accommodation"], "dropped": [], "notes": None}


def found(spark, *changes):
    rows = [tuple((SOUND | c).values()) for c in changes]
    return sorted((r.kind, tuple(r.clause_ids)) for r in B.findings(spark.createDataFrame(rows, B.CLAUSE)).collect())


CASES = [
    ({}, []),
    ({"failed": True, "synthesized": True}, ["UNSTRUCTURED"]),
    ({"synthesized": True}, ["SYNTHESIZED_ID"]),
    ({"limit_unit": "unknown"}, ["UNIT_UNDETERMINED"]),
    ({"limit_unit": "none"}, ["UNIT_UNDETERMINED"]),
    ({"unit_evidence": None}, ["UNIT_UNDETERMINED"]),
    ({"unit_evidence": "per weekend"}, ["UNIT_UNDETERMINED"]),
    ({"unit_evidence": None, "manual": True}, []),
    ({"text": "Amount per day: 6,000.", "limit_unit": "per_trip", "unit_evidence": "Amount per day"}, ["UNIT_DISAGREES_WITH_TEXT"]),
    ({"text": "At most 6,000.", "unit_evidence": "at most"}, ["UNIT_DISAGREES_WITH_TEXT"]),
    ({"text": "At most 6,000 a claim.", "limit_unit": "per_claim", "unit_evidence": "a claim"}, []),
    ({"limits": [(D(9999), "INR", {})]}, ["NUMBER_NOT_IN_TEXT", "UNCAPTURED_NUMBERS"]),
    ({"text": "Nightly caps of 6,000 from 10 PM in Tier 1 for 14 days"}, ["UNCAPTURED_NUMBERS"]),
    ({"text": "Nightly caps of 6,000 from 10 PM in Tier 1 for 14 days", "notes": "14 days"}, []),
    ({"text": "Nightly caps of 6,000 for 2 persons", "conditions": [("c", "more than one person", "requires", [], D(2))]}, []),
    ({"text": "Nightly caps of 6,000, receipts from 500", "documents": [("receipt", D(500))]}, []),
    ({"approval": {"INR": D(6000)}}, ["LIMIT_EQUALS_APPROVAL_THRESHOLD"]),
    ({"approval": {"USD": D(6000)}}, []),
    ({"is_prohibition": True}, ["PROHIBITION_WITHOUT_TRIGGER"]),
    ({"is_prohibition": True, "conditions": [("c", "t", "excludes", [], None)]}, []),
    ({"conditions": [("c", "t", "requires", ["document_amount"], None)]}, []),
    ({"conditions": [("c", "t", "requires", ["gstin_on_invoice", "document_amount"], None)]}, ["STAGE1_GAP"]),
    ({"dropped": ["fuel"]}, ["CATEGORY_SCOPE"]),
    ({"text": "| L1 | rail |", "limits": [], "limit_unit": "none"}, ["TABLE_NOT_STRUCTURED"]),
    ({"text": "| L1 | rail |", "limits": [], "limit_unit": "none", "applies_to": []}, []),
    ({"text": "Nightly caps of 6,000 or 7,000", "limits": [(D(6000), "INR", {}), (D(7000), "INR", {})]}, ["OVERLAP"]),
    ({"text": "Nightly caps of 6,000 or 7,000", "limits": [(D(6000), "INR", {"grade": ["L1"]}), (D(7000), "INR", {"grade": ["L2"]})]}, []),
]


def test_findings_of_one_clause(spark):
    rows = [tuple((SOUND | change | {"clause_id": str(k), "applies_to": [f"c{k}"] if change.get("applies_to") != [] else []}).values()) for k, (change, _) in enumerate(CASES)]
    got = {}
    for r in B.findings(spark.createDataFrame(rows, B.CLAUSE)).collect():
        got.setdefault(int(r.clause_ids[0]), []).append(r.kind)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(want) for k, (_, want) in enumerate(CASES) if want}


def test_overlap_across_clauses(spark):
    other = {"clause_id": "8.3", "text": "Nightly caps of 1,500", "limits": [(D(1500), "INR", {})]}
    assert found(spark, {}, other) == [("OVERLAP", ("8.1", "8.3"))]
    assert found(spark, {}, other | {"applies_to": ["fuel"]}) == found(spark, {}, other | {"limits": [(D(1500), "USD", {})]}) == []
    assert found(spark, {}, other | {"text": "1,500 per night a day", "limit_unit": "per_day", "unit_evidence": "a day"})[0][0] != "OVERLAP"


@pytest.mark.parametrize("entry, want", [
    ('{"limit_unit":"per_night","limit_kind":null,"applies_to_categories":["fuel"],"limit_table":[{"amount":"1,5"}]}', ["limit_table[0].amount"]),
    ('{"limit_unit":"none","limit_kind":"none","applies_to_categories":[]}', []),
    ('{"limit_unit":"none","limit_kind":"weekly","applies_to_categories":[],"limit_table":[]}', []),
    ('{"applies_to_categories":["*"]}', ["limit_unit"]),
    ('{"limit_unit":"none","applies_to_categories":["*"],"conditions":["x",{"id":"a","text":"t","kind":"requires","depends_on":["bill_date"],"any_of":[{"id":"a","text":"t","check":"judgment"}]}]}', ["conditions[0]", "conditions[1].any_of[0].id"]),
    ('{"limit_unit":"none","applies_to_categories":[],"requires_approval_above":{}}', ["requires_approval_above"]),
    ('{"limit_unit":"none","applies_to_categories":[],"requires_approval_above":{"INR":"x"}}', ["requires_approval_above"]),
    ("[]", ["entry"]),
    (None, ["entry"]),
])
def test_schema_problems(spark, entry, want):
    rows = spark.createDataFrame([(1, entry)], "id long, entry string")
    assert sorted(r.problem for r in B.schema_problems(rows, "id", "entry", ["fuel"]).collect()) == sorted(want)


def test_reference_tables(spark):
    text = "| L1 | A |\n|---|---|\n| L2 | B |\n|Tier 2| Jaipur , Kochi|\n| Tier 3 | others |\n| Zone A | USA, West (France, Spain, etc.), Gulf (Oman) |\n| Zone B | rest |\nno | table"
    got = {(r.kind, r.name, r.value) for r in B.reference_tables(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id", "text").collect()}
    assert got == {("grade", "L1", "1"), ("grade", "L2", "2"), ("city", "jaipur", "2"), ("city", "kochi", "2"), ("country", "usa", "A"), ("country", "france", "A"), ("country", "spain", "A"), ("country", "oman", "A"), ("open_group", "West", "A")}


def test_summary_and_round_trip(spark):
    rows = [tuple((SOUND | c).values()) for c in ({}, {"clause_id": "2", "limits": [(D(5), "INR", {"grade": ["L1"]}), (D(7), None, {"tier": ["1"]})]}, {"clause_id": "3", "limits": []})]
    frame = spark.createDataFrame(rows, B.CLAUSE)
    assert [tuple(r)[1:6] for r in B.limit_summary(frame).orderBy("clause_id").collect()] == [(2, D(5), D(7), "INR", "gradextier"), (0, None, None, "", ""), (1, D(6000), D(6000), "INR", "grade")]
    back = B.from_json(B.to_json(frame))
    assert sorted(back.drop("limit_amount", "limit_currency").collect(), key=lambda r: r.clause_id) == sorted(frame.collect(), key=lambda r: r.clause_id)
    assert {r.clause_id: r.limit_amount for r in back.collect()} == {"8.1": D(6000), "2": None, "3": None}


def test_every_field_has_one_status():
    names = [f for fields in FIELDS.values() for f in fields]
    assert len(names) == len(set(names))
