"""Flattening in one pass."""

from pyspark.sql import functions as F

from tallyspark.operators import paths as P


def test_flatten_reads_its_rows_once_and_keeps_odd_values(spark):
    body = '{"a":1,"b":{"c":[true,{"d":{"e":2}}],"x":{}},"n":null,"":{"k":"v"},"empty":[],"s":"' + "y" * 170 + '","f":1.50,"deep":[[[[1]]]]}'
    rows = spark.createDataFrame([(1, body), (2, "not json"), (3, None), (4, "7"), (5, "[[], 5]"), (6, "{}")], "id long, j string")
    found = P.flatten(rows, "id", "j")
    want = {(1, "a", "1"), (1, "b.c[0]", "true"), (1, "b.c[1]", '{"d":{"e":2}}'), (1, "n", None), (1, "k", "v"), (1, "s", "y" * 160 + "..."), (1, "f", "1.5"), (1, "deep[0][0]", "[[1]]"), (5, "[1]", "5")}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") <= 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_leaves_of_a_row_are_those_of_flatten(spark):
    long = "x" * 161
    texts = ['{"a":{"b":[1,{"c":{"d":2}}]},"n":null,"t":true,"s":"1.50"}', '[[1,[2,[3]]],{}]', "{}", "[]", "5", '"x"', "null", "no json", None, f'{{"l":"{long}","e":"","q":1.50,"":{{"":1}}}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, j string")
    for depth in (1, 3):
        want = sorted(map(tuple, P.flatten(rows, "id", "j", depth).collect()), key=str)
        assert sorted(map(tuple, rows.select("id", F.inline(P.leaves(F.col("j"), depth))).collect()), key=str) == want and len(want) > 8


def test_requests_read_the_documents_once(spark):
    from tallyspark.plans import registry

    plan = registry.queries()["V13_policy_requests"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
