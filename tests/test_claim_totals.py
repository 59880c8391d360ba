"""Totals of claims in one pass."""

from decimal import Decimal as D

from tallyspark.operators import versions as V
from tallyspark.plans import registry


def test_claim_totals_equal_the_two_steps(spark):
    rows = [(1, "confirmed", "INR", 5), (1, "confirmed", "INR", 6), (1, "needs_review", "USD", 7), (2, "confirmed", None, 1), (2, "confirmed", "INR", None), (3, "confirmed", "INR", 1), (3, "confirmed", "USD", 2), (4, "needs_review", "USD", 2), (5, "confirmed", None, 1), (5, "confirmed", "unknown", 2), (6, None, "INR", 3), (7, "confirmed", "USD", None), (None, "confirmed", "USD", 4)]
    docs = spark.createDataFrame([(a, b, c, d and D(d)) for a, b, c, d in rows], "claim_id long, doc_status string, currency string, amount decimal(12,2)")
    got = {tuple(r) for r in V.claim_totals(docs).collect()}
    want = {(1, D(11), "INR"), (2, D(1), "unknown"), (3, None, None), (4, D(0), "INR"), (5, D(3), "unknown"), (6, D(0), "INR"), (7, D(0), "INR")}
    assert {r for r in got if r[0]} == want == {tuple(r) for r in V.collapsed_totals(docs, V.totals_by_currency(docs)).where("claim_id IS NOT NULL").collect()}
    assert len(got) == 8


def test_claim_total_reads_and_sorts_line_items_once(spark):
    plan = registry.queries()["A2_claim_total"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber#") and plan.count("Window ") == 1
    assert plan.index("Join") < plan.index("Window ")  # numbered before the orders are joined
