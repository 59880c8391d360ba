"""Operators that SQL cannot express, against plain Python."""

import json
import random
from datetime import date
from decimal import Decimal as D

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import categorize as C
from tallyspark.operators import evaluate as E
from tallyspark.operators import responses as V
from tallyspark.operators import versions


def blocks(a, b):
    """Characters in matching blocks: the longest common block, the first in a and then in b, then what is left and right of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    return n + blocks(a[:i], b[:j]) + blocks(a[i + n :], b[j + n :]) if n else 0


def ratio(a, b):
    if not a or not b:
        return 0.0
    return 1.0 if a in b or b in a else 2 * blocks(a, b) / (len(a) + len(b))


def text(rnd, n=12):
    return "".join(rnd.choice("abc d") for _ in range(rnd.randint(0, n)))


def test_similarity(spark):
    rnd = random.Random(1)
    rows = [(k, text(rnd), text(rnd)) for k in range(300)] + [(300, None, "a"), (301, "", ""), (302, "abc", "xabcx")]
    got = {r.id: r.s for r in spark.createDataFrame(rows, "id long, a string, b string").select("id", E.similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(got[k] == pytest.approx(ratio(a or "", b or "")) for k, a, b in rows)


def test_greedy_matching(spark):
    rnd = random.Random(2)
    expected, found = {}, {}
    for doc in range(60):
        expected[doc] = [text(rnd) for _ in range(rnd.randint(0, 5))]
        found[doc] = [rnd.choice([text(rnd), *expected[doc]]) for _ in range(rnd.randint(0, 5))]
    frame = lambda x: spark.createDataFrame([(d, k, n) for d, names in x.items() for k, n in enumerate(names)], "doc long, pos int, name string").repartition(5)
    want = {}
    for doc in expected:
        left, matched = list(found[doc]), 0
        for name in expected[doc]:
            scores = [ratio(name, x) for x in left]
            if scores and max(scores) >= 0.6:
                left.pop(scores.index(max(scores)))
                matched += 1
        if expected[doc] or found[doc]:
            want[doc] = (matched, len(expected[doc]) - matched, len(found[doc]) - matched)
    got = {r.doc: (r.matched, r.missed, r.extra) for r in E.match_items(frame(expected), frame(found)).collect()}
    assert got == want


def test_a_task_compares_two_names_once(monkeypatch):
    seen = []
    monkeypatch.setattr(E, "_ratio", lambda a, b: seen.append((a, b)) or ratio(a, b))
    rows = pd.DataFrame([(d, side, name) for d in range(50) for side, name in ((0, "blue ring"), (0, "hot bolt"), (1, "bolt hot"), (1, "ring"))], columns=["doc", "side", "name"])
    got = pd.concat(E._matching(0.6)(iter([rows[:70], rows[70:]])))
    assert len(got) == 50 and len(seen) == len(set(seen)) <= 4


def test_classifier_predicts_held_out_labels(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(4, 8)) * 2
    labels = rng.integers(4, size=400)
    rows = [(k, (centers[y] + rng.normal(size=8) * 0.5).tolist(), int(y)) for k, y in enumerate(labels)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, label int")
    model = C.train_classifier(frame.where("id < 300"), "v", "label")
    got = C.classify(model, frame.where("id >= 300"), "v").collect()
    weights, bias = np.array(model.coefficientMatrix.toArray()), np.array(model.interceptVector)
    for r in got:
        z = weights @ np.array(r.v) + bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.predicted == p.argmax() and r.confidence == pytest.approx(p.max())
    assert np.mean([r.predicted == r.label for r in got]) > 0.95


def test_policy_requests(spark):
    docs = spark.createDataFrame([(1, 9, 5, "A", D(10), "meals"), (2, 9, 5, "B", None, "fuel"), (3, 8, 5, "C", D(1), "x")], "document_id long, claim_id long, employee_id long, vendor string, amount decimal(12,2), category string")
    clauses = spark.createDataFrame([("C1", "per_night", False, ["meals", "*"]), ("C2", "per_day", True, ["fuel"])], "clause_id string, limit_unit string, is_prohibition boolean, applies_to array<string>")
    got = {r.document_id: json.loads(r.request) for r in V.policy_requests(docs, clauses).collect()}
    both = [{"clause_id": "C1", "limit_unit": "per_night", "is_prohibition": False}, {"clause_id": "C2", "limit_unit": "per_day", "is_prohibition": True}]
    assert got[1] == {"claim_id": 9, "employee_id": 5, "document": {"document_id": 1, "vendor": "A", "amount": "10.00"}, "siblings": [{"document_id": 2, "vendor": "B"}], "clauses": both[:1]}
    assert got[2]["clauses"] == both and got[3]["clauses"] == both[:1] and got[3]["siblings"] == []


def test_cosine_leaks_in_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(120, 6))
    vectors[7] = 0
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(500, None)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    want = {(t, h) for t in range(120) for h in range(120) if t % 5 and h % 5 == 0 and unit[t] @ unit[h] > 0.5}
    for block in (7, 1000):
        got = C.cosine_leaks(frame.where("id % 5 > 0"), frame.where("id % 5 = 0"), 0.5, block).collect()
        assert {(r.train_id, r.held_id) for r in got} == want and len(got) == len(want)


def test_numbered_by_ranges(spark):
    rnd = random.Random(6)
    rows = [(k, rnd.choice("aaab"), rnd.randrange(10)) for k in range(500)] + [(900, None, 3)]
    got = versions.numbered(spark.createDataFrame(rows, "id long, g string, s int"), ["g"], [F.desc("s"), F.col("id")]).collect()
    for g in ("a", "b"):
        order = [k for k, x, s in sorted(rows, key=lambda r: (-r[2], r[0])) if x == g]
        assert {r.id: (r.turn, r["of"]) for r in got if r.g == g} == {k: (n + 1, len(order)) for n, k in enumerate(order)}


def test_latest_keeps_nulls_of_the_chosen_row(spark):
    rows = [(1, 1, "a", 5), (1, 2, None, 6), (2, 1, None, None)]
    got = versions.latest(spark.createDataFrame(rows, "k long, v int, a string, b int"), ["k"], "v").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, None, 6), (2, 1, None, None)]


def test_active_version_and_revert(spark):
    rows = [("v1", True, date(2026, 1, 1)), ("v2", True, date(2026, 2, 1)), ("v3", False, date(2026, 3, 1))]
    frame = spark.createDataFrame(rows, "label string, is_active boolean, created_on date")
    assert versions.active_version(frame).first().label == "v2" and versions.active_version(frame, "v3").first().label == "v3" and versions.active_version(frame, "v9").count() == 0
    edits = spark.createDataFrame([(1, 1, "ai", 5), (1, 2, "employee", 6), (1, 3, "ai", 7), (2, 1, "employee", 8)], "id long, version int, source string, amount int")
    assert [tuple(r) for r in versions.revert(edits, "id", F.col("source") == "ai").collect()] == [(1, 4, "employee", 5)]


def test_pruned_leaks_equal_all_pairs(spark):
    """Clustered vectors, one of them in many copies: the index gives what all pairs give, in a share of the work that falls as the clusters grow in number."""
    shares = []
    for clusters in (20, 80):
        rng = np.random.default_rng(clusters)
        centres = rng.normal(size=(clusters, 16))
        rows = [(k, (centres[k % clusters] + 0.15 * rng.normal(size=16)).tolist()) for k in range(25 * clusters)]
        rows += [(100_000 + k, rows[0][1]) for k in range(60)] + [(200_000, None), (200_001, [0.0] * 16)]
        frame = spark.createDataFrame(rows, "id long, v array<double>")
        train, held = frame.where("id % 5 > 0"), frame.where("id % 5 = 0")
        vectors = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and any(v)}
        want = {(a, b) for a in vectors if a % 5 for b in vectors if not b % 5 if vectors[a] @ vectors[b] > 0.95}
        for block in (20_000, 7):
            got = C.cosine_leaks(train, held, 0.95, block, pivots=40).collect()
            assert {(r.train_id, r.held_id) for r in got} == want and len(got) == len(want)
        work = C.compared_pairs(train, held, 0.95, pivots=40).first()
        shares.append(work.compared / work.possible)
    assert shares[1] < shares[0] < 0.3
    assert C.cosine_leaks(train, held.limit(0)).collect() == [] and C.cosine_leaks(train.limit(0), held).collect() == []


def test_leaks_of_spread_vectors_are_not_copied_to_cells(spark):
    """Pivots save nothing on spread vectors, so no row is multiplied; on clustered ones they cost less than all products."""
    rng = np.random.default_rng(9)
    frame = lambda v: spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    spread = frame(rng.normal(size=(3000, 24)))
    visits, members = C.leak_candidates(spread.where("id % 2 = 1"), spread.where("id % 2 = 0"), 0.25)
    assert visits.count() == members.count() == 1500 and visits.select("cell", "band").distinct().count() == 1
    centres = C._unit(rng.normal(size=(12, 24)))
    near = C._unit(np.repeat(centres, 20, axis=0) + 0.02 * rng.normal(size=(240, 24)))
    assert C._cost(centres, near[::2], near[1::2], 100_000, 0.2) < 50_000 < 100_000 < C._cost(centres, C._unit(rng.normal(size=(99, 24))), near, 100_000, 1.5)


def test_hits_of_copies_leave_in_parts():
    """400 copies on each side, all pairs of which are hits: no part holds them all, and none is lost."""
    rows = pd.DataFrame({"cell": 0, "band": 0, "t": 0, "h": 0, "side": [0] * 400 + [1] * 400, "id": range(800), "v": [np.ones(3)] * 800})
    parts = list(C._over(0.9, ["cell", "band", "t", "h", "side"], most=20_000)([rows[:150], rows[150:500], rows[500:]]))
    assert max(len(p) for p in parts) <= 120_000 and len(parts) > 1
    assert {(t, h) for p in parts for t, h in zip(p["train_id"], p["held_id"], strict=True)} == {(t, h) for t in range(400, 800) for h in range(400)}
    assert sum(len(p) for p in parts) == 160_000


def test_training_run(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    rng = np.random.default_rng(4)
    rows = [(k, (np.eye(4)[k % 4] * 3 + rng.normal(size=4)).tolist(), k % 4) for k in range(400)]
    held = [(1000 + k, rows[k][1], rows[k][2]) for k in range(5)]
    schema = "id long, v array<double>, label int"
    report, dropped = C.training_run(spark.createDataFrame(rows, schema), spark.createDataFrame(held, schema), "v", "label", f"{tmp_path}/model", limit=0.999)
    gone = {r.train_id for r in dropped.collect()}
    assert set(range(5)) <= gone
    found = {r.label: r for r in report.collect()}
    assert set(found) == {0, 1, 2, 3} and abs(sum(r.support for r in found.values()) - (400 - len(gone)) / 5) <= 4
    assert all(r.f1 > 0.75 for r in found.values())
    again = C.classify(LogisticRegressionModel.load(f"{tmp_path}/model"), spark.createDataFrame(held, schema), "v").collect()
    assert len(again) == 5


def test_policy_requests_with_fields_and_employees(spark):
    """Leaves of a table or of the row, employees of the document or of its claim; a document without a claim is asked for by none."""
    from tallyspark.operators import paths as P

    docs = spark.createDataFrame([(1, 9, 5, "A", D(10), "meals", '{"b":2,"a":["x"]}'), (2, 9, 5, None, None, None, "{}"), (3, 8, 6, "C", D(1), "x", None), (4, None, 5, "D", D(1), "x", "{}")], "document_id long, claim_id long, employee_id long, vendor string, amount decimal(12,2), category string, body string")
    clauses = spark.createDataFrame([("C1", "per_night", False, ["meals", "*"])], "clause_id string, limit_unit string, is_prohibition boolean, applies_to array<string>")
    employees, claims = spark.createDataFrame([(5, "N")], "employee_id long, name string"), spark.createDataFrame([(9, 5), (8, 6), (7, 5)], "claim_id long, employee_id long")
    read = lambda rows: {r.document_id: json.loads(r.request) for r in rows.collect()}
    joined = read(V.policy_requests(docs, clauses, employees, P.flatten(docs, "document_id", "body")))
    assert joined == read(V.policy_requests(docs, clauses, employees, fields=P.leaves(F.col("body")), claims=claims)) and sorted(joined) == [1, 2, 3]
    assert joined[1]["fields"] == [{"path": "a[0]", "value": "x"}, {"path": "b", "value": "2"}] and joined[1]["employee"] == {"name": "N"} and joined[1]["siblings"] == [{"document_id": 2}]
    assert "fields" not in joined[2] and "employee" not in joined[3]
