"""Hard negatives against plain sorting, on random, clustered, hostile and tied vectors; the Hilbert curve; bounds."""

import random

import numpy as np
import pytest

from tallyspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(table):
    rows = []
    for at, (i, v, label) in enumerate(table):
        if i is not None and i % 7 == 0 and label is not None:
            label = (label + 1) % 10
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            rows.append((at, i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in rows:
        if a[1] is None or a[1] % 50:
            continue
        best = lambda some: sorted(some, key=lambda b: (-score(a, b), b[1] is None, b[1] or 0))  # noqa: B023, E731
        for p in best([b for b in rows if b[3] == a[3] and b[0] != a[0]])[:5]:
            s = score(a, p)
            fit = best([b for b in rows if b[3] != a[3] and 50 * s <= 100 * score(a, b) <= 95 * s])[:3]
            out += [(a[1], p[1], k + 1, n[1], s, score(a, n)) for k, n in enumerate(fit)]
    return sorted(out, key=repr)


def run(spark, table):
    rows = spark.createDataFrame(table, SCHEMA)
    moved = hn.F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    got = hn.mine(rows.withColumn("label", moved).repartition(3), hn.F.col("vec_id") % 50 == 0)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_random_and_clustered(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 8), ("GROUP", 2), ("TOGETHER", 3), ("ZONES", 2)):
            monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    table = [(k, (0.3 * rng.normal(size=12) + centres[k % 6] * (k % 3)).astype(np.float32).tolist(), int(k * k % 4)) for k in range(600)]
    table += [(1000 + k, table[5][1], 1) for k in range(40)]  # one vector many times, ties of scores
    assert run(spark, table) == expected(table)


def test_hostile_rows(spark):
    rng = random.Random(1)
    table = [(k, [rng.uniform(-1, 1) for _ in range(rng.choice([3, 4]))], k % 2) for k in range(0, 120, 5)]
    table += [(None, [0.9, 0.9, 0.9], 0), (100, [0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5], 1), (150, None, 0), (200, [0.1, None], 0), (250, [float("nan"), 1.0], 1), (300, [float("inf")], 1), (350, [1.0, 0.2, 0.3], None), (400, [], 0), (450, [0.0, 0.0, 0.0], 7)]
    assert run(spark, table) == expected(table)


def test_empty_and_alone(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0], 1)]) == []
    assert run(spark, [(50, [1.0], 1), (51, [1.0], 1), (52, [0.9], 2)]) == [(50, 51, 1, 52, 65536, 58880)]


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[range(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = hn.hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    blocks = (rng.normal(size=(20, 50, 8)) * 10 + rng.normal(size=(20, 1, 8)) * 200).astype(int)
    anchors = (rng.normal(size=(30, 8)) * 200).astype(int)
    low, up = hn.bounds(anchors, blocks.min(axis=1), blocks.max(axis=1))
    scores = np.einsum("ad,bnd->abn", anchors, blocks)
    assert (low <= scores.min(axis=2)).all() and (scores.max(axis=2) <= up).all()
    assert (up < scores.max(axis=(1, 2))[:, None]).mean() > 0.5


def test_products_are_exact():
    big = np.array([[2**30, 1], [3, 5]])
    assert hn.products(big, big).tolist() == [[2**60 + 1, 3 * 2**30 + 5], [3 * 2**30 + 5, 34]]
