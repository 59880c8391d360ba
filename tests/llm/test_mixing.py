import random

from tallyspark.llm.mixing import mix


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Clamp and share again, step by step."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    rest, free, target = sum(sizes.values()), set(order), {}
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > epochs * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = epochs * sizes[s]
            rest -= target[s]
        free -= above
    return target


def run(spark, rows, **more):
    return mix(spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'t' AS target", "2 AS none").repartition(3), **more).collect()


def test_targets_and_taken(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(["w"] * rnd.randint(0, 90)), rnd.choices(["b", "a", "é", "Z", None, "hot"], [3, 1, 2, 1, 2, 9])[0]) for k in range(800)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, got = brute_targets(sizes), run(spark, rows)
    assert len(got) == len(rows)
    source, taken = {k: s for k, _, s in rows}, {}
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.repetitions * r["size"] + r.part and r.part <= max(0, r["size"] - 1)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 20 for s in want)
    assert sorted(got) == sorted(run(spark, rows))


def test_corners(spark):
    assert run(spark, []) == []
    got = run(spark, [(1, None, "a"), (2, "", None), (None, " \t\n", "b")])
    assert all(r.taken == 0 and r.target == 0 for r in got) and len(got) == 3
    got = run(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (2, "one two " * 50000, "x")])
    assert sorted(r.taken for r in got) == [3, 3, 100000]
