"""Audits, stored answers' quantities and dimensions, categories' backfill and dispatch, on literal rows."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyspark.operators import audit as I
from tallyspark.operators import categorize as C
from tallyspark.operators import evaluate as E
from tallyspark.operators import paths as P
from tallyspark.operators import responses as V
from tallyspark.sources import readers


def test_immutability(spark):
    before = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "c", "x"), (4, "d", "x")], "id int, v string, reviewer string")
    after = spark.createDataFrame([(1, "a", "y"), (2, "b", "x"), (4, "d", None), (5, "e", "x")], "id int, v string, reviewer string")
    assert {r.id: r.finding for r in I.immutability(before, after, ["id"], ["reviewer"]).collect()} == {1: "same", 2: "changed", 3: "gone", 4: "same", 5: "new"}


def test_keys(spark):
    parents, children = spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([(1,), (7,), (None,)], "parent int")
    got = {r.rule: r.violations for r in I.keys({"p": parents, "c": children}, [("p", ["id"])], [("c", "parent", "p", "id")]).collect()}
    assert got == {"p(id) unique": 1, "c.parent -> p.id": 1}


def test_reviewer_labels(spark):
    clauses = spark.createDataFrame([("v1", "8.1"), ("v2", "8.2")], "policy_version string, clause_id string")
    rows = [(1, "v1", "compliant", "8.1"), (2, "v2", "violation", "8.1"), (3, "v1", "fine", None), (4, "v1", None, None), (5, "v1", "needs_approval", ""), (6, "v9", "violation", None)]
    labels = spark.createDataFrame(rows, "id int, policy_version string, human_verdict string, human_clause_id string")
    assert {r.id: r.problem for r in I.reviewer_labels(labels, clauses).collect()} == {1: None, 2: "unknown_clause", 3: "bad_verdict", 4: "bad_verdict", 5: None, 6: None}


def test_contract(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, None, "y"), (2, "b", None)], "id int, label string, source string")
    got = {r.check: r.problems for r in I.contract(rows, "id", ["label"], {"label": ["a"], "source": ["x", "y"]}, "source", 2).collect()}
    assert got == {"missing label": 1, "domain label": 1, "domain source": 0, "repeated id": 1, "few source": 2}


def test_units_quantities_dimensions(spark):
    answers = spark.createDataFrame([(1, '{"units":[{}]}'), (2, '{"units":[]}'), (3, '{"units":[1]}'), (4, "[]"), (5, "x"), (6, None)], "id int, a string")
    assert {r.id: r.f for r in answers.select("id", V.units_failure(F.col("a")).alias("f")).collect()} == {1: None, 2: "no_units", 3: "no_units", 4: "no_units", 5: "not_json", 6: "not_json"}
    leaves = spark.createDataFrame([(1, "in", "01/03/2026"), (1, "out", "04/03/2026"), (1, "n", "3 pax"), (1, "km", "12.5"), (1, "zero", "0"), (1, "none", None)], "id int, path string, value string")
    specs = [("nights", None, "in", "out"), ("days", None, "in", "out"), ("persons", "n", None, None), ("distance_km", "km", None, None)]
    rows = spark.createDataFrame([(1, *s) for s in specs], "id int, quantity string, path string, from_path string, to_path string")
    assert {r.quantity: r.value for r in V.quantities(rows, leaves, "id").collect()} == {"nights": D(3), "days": D(4), "persons": D(3), "distance_km": D("12.5")}
    odd = spark.createDataFrame([(1, "persons", "none", None, None), (1, "distance_km", "zero", None, None), (1, "nights", None, "in", "gone")], rows.schema)
    assert {r.quantity: (r.value, r.failure, r.note) for r in V.quantities(odd, leaves, "id").collect()} == {"persons": (None, None, "unreadable"), "distance_km": (None, None, "unreadable"), "nights": (None, "quantity_path_not_found", None)}
    clauses = spark.createDataFrame([("C", [(D(1), "INR", {"occasion": ["Routine"], "grade": ["L1"]})])], "clause_id string, limits array<struct<amount:decimal(12,2),currency:string,when:map<string,array<string>>>>")
    units = spark.createDataFrame([(1, "C", {"occasion": "ROUTINE", "grade": "L9"}), (2, "C", {"occasion": "wedding"}), (3, "C", {}), (4, "X", {"occasion": "wedding"})], "unit_id int, clause_id string, named map<string,string>")
    got = {r.unit_id: (r.failure, r.dimensions) for r in V.dimension_failures(units, clauses).collect()}
    assert got == {1: (None, {"occasion": "routine"}), 2: ("bad_dimension_value", None), 3: (None, {"occasion": None}), 4: (None, {})}


def test_categories(spark):
    rows = spark.createDataFrame([(1, "kept"), (2, None)], "id int, category string")
    filled = {r.id: (r.category, r.backfilled_by) for r in C.backfill(rows, "category", F.lit("hotel_invoice"), F.lit("")).collect()}
    assert filled == {1: ("kept", None), 2: ("accommodation", "rules")}
    evidence = C.backfill(rows, "category", F.lit("approval_correspondence"), F.lit("")).where("id = 2").first()
    assert evidence.category is None and evidence.backfilled_by is None
    c = rows.select(C.carried(F.lit("a"), F.lit(0.5), F.lit("rules"), F.lit("a")).alias("same"), C.carried(F.lit("a"), F.lit(0.5), F.lit("rules"), F.lit("b")).alias("edited")).first()
    assert tuple(c.same) == ("a", 0.5, "rules") and tuple(c.edited) == ("b", None, "employee")
    done = spark.createDataFrame([(1, "f1", None), (2, "f2", "timeout"), (3, "f2", None)], "id int, fingerprint string, error string")
    assert {r.id for r in C.to_do(spark.createDataFrame([(k,) for k in range(1, 5)], "id int"), done, "id", "f2").collect()} == {1, 2, 4}


def test_agreement_menus_paths_overrides(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), (None, None), (None, "a")], "silver string, gold string")
    assert {r.label: (r.n, r.agreed, r.overridden) for r in E.agreement(rows, "silver", "gold").collect()} == {"a": (2, 1, 1), "none": (2, 1, 1), None: (4, 2, 2)}
    menus = spark.createDataFrame([(1, '[{"nm":"a","price":"1","sub":[{"nm":"b"},5]},{"cnt":2},7]'), (2, '{"price":3}'), (3, "null"), (4, None)], "id int, m string")
    assert sorted((r.id, r.pos, r["sub"], r.nm, r.price) for r in E.menu_items(menus, "id", "m").na.fill(-1, ["sub"]).collect()) == [(1, 0, -1, "a", "1"), (1, 0, 0, "b", None), (2, 0, -1, None, "3")]
    leaves = P.flatten(spark.createDataFrame([(1, '{"a":{"b":null},"c":[1]}')], "id int, j string"), "id", "j")
    asked = spark.createDataFrame([(1, "a.b"), (1, "c[0]"), (1, "c[1]")], "id int, path string")
    assert {r.path: (r.value, r.found) for r in P.resolve(asked, leaves, "id").collect()} == {"a.b": (None, True), "c[0]": ("1", True), "c[1]": (None, False)}
    human = spark.createDataFrame([(1, "x", "why", True), (9, "y", None, None)], "id int, label string, notes string, ambiguous boolean")
    got = readers.with_overrides(spark.createDataFrame([(1, "s"), (2, "t")], "id int, label string"), human, "id")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", "why", True), (2, "t", None, False)]
