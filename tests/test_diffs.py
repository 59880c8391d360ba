"""Structural differences and corrections of edits."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import diffs as D

ITEMS = '[{"name":"Coffee","quantity":"1","total":"150.00"},{"name":"Tea","total":"150.00"}]'
CASES = [
    (ITEMS, ITEMS.replace('"1"', '"2"').replace('"quantity":"2","total":"150.00"', '"quantity":"2","total":"300"'), {("[0].quantity", "1", "2", None), ("[0].total", "150.00", "300", None)}),
    (ITEMS, ITEMS[:-1] + ',{"name":"Muffin","total":60}]', {("[2]", None, '{"name":"Muffin","total":60}', "row_added")}),
    (ITEMS, '[{"name":"Coffee","quantity":1,"total":150}]', {("[1]", '{"name":"Tea","total":"150.00"}', None, "row_removed")}),
    ('{"a":1,"b":null}', '{"a":"1.0","c":null}', set()),
    ('{"a":true}', '{"a":"true"}', {("a", "true", "true", None)}),
    ('{"a":[1,[2,{"b":[3]}]]}', '{"a":[1,[2,{"b":[4,5]}]]}', {("a[1][1].b[0]", "3", "4", None), ("a[1][1].b[1]", None, "5", "row_added")}),
    ('{"a":{"b":1}}', '{"a":[1]}', {("a", '{"b":1}', "[1]", None)}),
    ('{"a":{"x":"]]}}"}}', '{"a":{"x":"{{[["}}', {("a.x", "]]}}", "{{[[", None)}),
    ('{"a":[]}', '{"a":[]}', set()),
    ("null", '{"a":1}', {("", None, '{"a":1}', None)}),
]


@pytest.mark.parametrize("before, after, want", CASES)
def test_differences(spark, before, after, want):
    pairs = spark.createDataFrame([(1, before, after)], "id long, x string, y string").select("id", F.parse_json("x").alias("a"), F.parse_json("y").alias("b"))
    assert {tuple(r)[1:] for r in D.differences(pairs, "id").collect()} == want


def test_edits_of_trips_under_other_names(spark):
    fields = '{"vendor":"V","line_items":"none","travel_entries":[{"date":"1 May","place_of_visit":"P","purpose_of_travel":"M","client_name":"C","kms":"78","km":"5"},"odd"]}'
    edits = [
        ("travel_entries", '[{"date":"1 May","place":"P","purpose":"M","client":"C","kms":"999"},"odd",{"place":"ANDHERI"}]'),
        ("line_items", '[{"name":"x"}]'), ("vendor", '"V"'), ("travel_entries[0].date", '"2 May"'), ("tax.rate", "5"),
    ]
    documents = spark.createDataFrame([(1, fields)], "id long, j string").select("id", F.parse_json("j").alias("fields"))
    rows = spark.createDataFrame([(1, *e) for e in edits], "id long, path string, v string").select("id", "path", F.parse_json("v").alias("value"))
    assert {tuple(r)[1:] for r in D.edit_corrections(documents, rows, "id").collect()} == {
        ("travel_entries[0].kms", "78", "999", None), ("travel_entries[2]", None, '{"place":"ANDHERI"}', "row_added"), ("line_items[0]", None, '{"name":"x"}', "row_added"),
        ("travel_entries[0].date", "1 May", "2 May", None), ("tax.rate", None, "5", None),
    }


def test_a_bound_beyond_the_levels_changes_nothing_and_needs_one_side(spark):
    pairs = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(CASES)], "id long, x string, y string").select("id", F.parse_json("x").alias("a"), F.parse_json("y").alias("b"))
    assert {tuple(r) for r in D.differences(pairs, "id", depth=D.deepest(pairs, "b") + 1).collect()} == {(k, *w) for k, c in enumerate(CASES) for w in c[2]}


def test_a_level_reads_each_value_once(spark):
    pairs = spark.range(1).select("id", F.parse_json(F.lit('{"a":1}')).alias("a"), F.parse_json(F.lit('{"a":2}')).alias("b"))
    plan = D.differences(pairs, "id", depth=1)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapType(") == 2


@pytest.mark.parametrize("a, b, same", [('"1e1"', "10", True), ('" 5"', "5.0", True), ('"-.5"', "-0.5", True), ('"x1"', '"x2"', False), ('"+3"', "3", True), ('"١"', "1", True)])
def test_texts_that_are_numbers(spark, a, b, same):
    row = spark.range(1).select(F.parse_json(F.lit(a)).alias("a"), F.parse_json(F.lit(b)).alias("b")).select(D.equal(F.col("a"), F.col("b")).alias("e"), (D._text(F.col("a")).try_cast("decimal(38,12)") == D._text(F.col("b")).try_cast("decimal(38,12)")).alias("cast")).first()
    assert row.e == bool(row.cast) and row.e == same


def test_edits_are_made_once_with_their_documents_and_no_filter_opens_values(spark):
    from tallyspark.plans import registry

    plan = registry.queries()["D2_edited_roots"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
    assert not [x for x in plan.splitlines() if "Filter" in x and ("variant" in x or "parseJson" in x)]


def test_edits_beside_their_documents(spark):
    fields = '{"travel_entries":[{"location":"P","reason":null,"distance":"5"},{"km":1},"odd"],"a":{"b":[1]}}'
    edits = [("travel_entries", '[{"place":"P","kms":"6"}]'), ("a.b[0]", "1.0"), ("a", '{"b":[2]}'), ("line_items", "{}"), ("missing", "null")]
    rows = spark.createDataFrame([(1, fields, *e) for e in edits], "id long, j string, path string, v string").select("id", F.parse_json("j").alias("fields"), "path", F.parse_json("v").alias("value"))
    want = {("travel_entries[0].kms", "5", "6", None), ("travel_entries[1]", '{"kms":1}', None, "row_removed"), ("travel_entries[2]", "odd", None, "row_removed"), ("a", '{"b":[1]}', '{"b":[2]}', None), ("line_items", None, "{}", None)}
    assert {tuple(r)[1:] for r in D.corrections(rows, "id").collect()} == want
    assert {tuple(r)[1:] for r in D.corrections(rows, "id", depth=2).collect()} == want
    assert {tuple(r)[1:] for r in D.edit_corrections(rows.select("id", "fields").limit(1), rows.drop("fields"), "id").collect()} == want
