"""Similarity links against all pairs, and what the pipeline's stage keeps."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import similarity, simhash

from test_brute_force import plain_print, vocabulary


def plain_shingles(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def plain_groups(texts, threshold=0.8, links=lambda a, b: False):
    """For each text the least index that links reach."""
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            same = texts[a] == texts[b] or links(a, b)
            alike = sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
            if same or alike:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return [find(k) for k in range(len(texts))]


def hostile(seed, count):
    """Edited copies at every distance, chains, a shared passage, short and repeated texts."""
    rnd = random.Random(seed)
    words = vocabulary(rnd, 300)
    draw = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, texts = draw(40), [None, "", " \t", "one", "One", "one two", "a a a a a a a", "a a a a a"]
    while len(texts) < count:
        kind = rnd.random()
        if kind < 0.3:
            texts.append(" ".join(draw(rnd.randint(1, 120))))
        elif kind < 0.45:
            texts.append(" ".join(draw(rnd.randint(1, 30)) + passage + draw(rnd.randint(1, 30))))
        else:
            w = (rnd.choice(texts) or "x").split() or ["y"]
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(len(w) + 1)
                w[at : at + rnd.randint(0, 2)] = draw(rnd.randint(0, 2))
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("block", [2048, 3])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    texts = hostile(block, 350)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(5).withColumn("h", F.xxhash64("text"))
    groups = similarity.linked(rows, spark.createDataFrame([], "u long, v long"))
    named = {r.k: r.c for r in rows.join(groups, rows["h"] == groups["node"], "left").select("k", F.coalesce("component", "h").alias("c")).collect()}
    first, got = {}, []
    for k in range(len(texts)):
        got.append(first.setdefault(named[k], k))
    assert got == plain_groups(texts)
    assert len(set(got)) < len(texts) - 60


def test_keep_one_by_similarity(spark):
    texts = hostile(5, 250)
    prints = [plain_print(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(r.doc_id for r in simhash.keep_one(rows, similarity=0.8).collect())
    near = lambda a, b: bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= 3
    want = plain_groups(texts, links=near)
    assert got == sorted(set(want))
    assert len(got) < simhash.keep_one(rows).count()


def test_empty_table(spark):
    rows = spark.createDataFrame([], "h long, text string")
    assert similarity.linked(rows, spark.createDataFrame([], "u long, v long")).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string, key int"), similarity=0.8).columns == ["doc_id", "text", "key"]
