import hashlib
import random

import pytest

from tallyspark.llm.suffix_dedup import remove_repeats


def brute(rows, length=100):
    """(id, text) with distinct ids -> what remove_repeats gives."""
    first, out = {}, {}
    low = -(2**63)
    data = sorted((low if i is None else i, (t or "").encode()) for i, t in rows)
    for i, b in data:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (i, p))
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[None if i == low else i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS name", "1 AS lo", "2 AS id").repartition(3)
    return remove_repeats(docs, **more).collect()


def words(rnd, n):
    return " ".join(rnd.choice(["the", "of", "and", "erin", "thenté", "onwh", "ouerst", "heit"]) for _ in range(n))


@pytest.mark.parametrize("group", [20_000, 2])
def test_equals_brute_force(spark, group):
    rnd = random.Random(group)
    shared = [words(rnd, 40) for _ in range(4)]
    line = "this very common line stands in nearly every text of the table, as a banner does"
    rows = [(None, shared[0]), (0, None), (1, ""), (2, "ab" * 300), (3, "a" * 1000), (4, "x" * 99), (5, "x" * 100)]
    for k in range(10, 90):
        parts = [words(rnd, rnd.randint(1, 60))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 60)
            parts += [s[a : a + rnd.randint(80, 200)], words(rnd, rnd.randint(0, 20)), line]
        rows.append((k, "".join(parts)))
    rows += [(100, rows[20][1]), (101, rows[20][1][:150] + "!" + rows[20][1][150:])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, rows, group=group, hot_share=0.01 if group == 2 else 1e-3, hot_sample=1.0)}
    assert got == brute(rows)


def test_repeated_rows_are_one_document(spark):
    text = words(random.Random(1), 80)
    got = run(spark, [(1, text), (1, text), (2, text)])
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, len(text.encode()))]


def test_long_text_and_pieces(spark, monkeypatch):
    from tallyspark.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "_PIECE", 5000)
    rnd = random.Random(3)
    text = words(rnd, 6000)
    rows = [(1, text), (2, words(rnd, 500) + text[9000:16000])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, rows)}
    assert got == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
