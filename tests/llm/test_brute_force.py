"""Operators against plain versions of what they promise."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import xxhash

from tallyspark.llm import decontamination as D
from tallyspark.llm import html_text, licenses, pii, quality_fm, quality_rules, simhash, toxicity_crf

WORD = re.compile("[^\x20\x09-\x0d]+")


def vocabulary(rnd, n=300):
    return ["".join(rnd.choice("abcdeäéñ") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def plain_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rnd = random.Random(6)
    words = vocabulary(rnd)
    base = [[rnd.choice(words) for _ in range(rnd.randint(100, 300))] for _ in range(25)]
    rows = []
    for k in range(200):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(words).upper()
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    prints = [plain_print(t) for _, t in rows]
    assert [got[k].fingerprint for k, _ in rows] == [f"{p:016x}" for p in prints]
    want = plain_components([k for k, _ in rows], prints)
    assert {k: got[k].component_id for k in want} == want and len(set(want.values())) < 190


def test_hot_buckets_and_chains(spark):
    """A bucket of many classes, cut into pairs of small blocks, and chains of links."""
    rnd = random.Random(7)
    center, rows = rnd.getrandbits(64), []
    for k in range(400):
        p = center
        for b in rnd.sample(range(64), rnd.randint(0, 4)):
            p ^= 1 << b
        rows.append((k, p))
    for k in range(60):
        rows.append((1000 + k, rows[-1][1] ^ (7 << (k % 20 * 3))))
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in rows]
    frame = spark.createDataFrame(signed, "id long, print long")
    for block in (16, 4096):
        found = {r.print: r.component_id for r in simhash.hamming_components(frame, 3, block).collect()}
        assert {k: found[p] for k, p in signed} == plain_components([k for k, _ in rows], [p for _, p in rows])


def test_rows_without_id_link_others(spark):
    """Classes all of whose rows lack an id stand between others, and lend no id."""
    rows = [(1, 0), (None, 7), (None, 7), (3, 63), (None, 1 << 40), (5, -1), (None, -2), (4, -16)]
    found = {r.print: r.component_id for r in simhash.hamming_components(spark.createDataFrame(rows, "id long, print long"), 3).collect()}
    assert found == {0: 1, 7: 1, 63: 1, 1 << 40: 1, -1: 4, -2: 4, -16: 4}
    alone = spark.createDataFrame([(None, 0), (None, 1), (2, -1)], "id long, print long")
    assert {r.print: r.component_id for r in simhash.hamming_components(alone, 3).collect()} == {0: None, 1: None, -1: 2}


def test_masks_cover():
    rnd = random.Random(1)
    masks = [m % (1 << 64) for m in simhash.masks(3)]
    for _ in range(3000):
        bits = sum(1 << b for b in rnd.sample(range(64), 3))
        assert any(m & bits == 0 for m in masks)


def test_decontamination(spark):
    rnd = random.Random(8)
    words = vocabulary(rnd, 60)
    items = [(k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 12, 20, 20, 31, 45])]
    index = D.Index(items, len(items))

    def similarity(w, k):
        size = min(5, index.length[k])
        have, want = Counter(D._shingles(w, size)), index.counts[k]
        weigh = lambda x: index.weight.get(x, index.rare)
        return sum(weigh(x) * min(have[x], n) for x, n in want.items()) / sum(weigh(x) * max(have[x], want[x]) for x in {**have, **want})

    docs, wanted = [], {}
    for q in range(120):
        w = D.tokens(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        doc = [rnd.choice(words) for _ in range(rnd.randint(0, 40))] + w + [rnd.choice(words) for _ in range(rnd.randint(0, 9))]
        docs.append((q, " ".join(doc)))
        best = {}
        for k, n in enumerate(index.length):
            wide = min(n, len(doc))
            best[k] = max(similarity(doc[s : s + wide], k) for s in range(len(doc) - wide + 1))
        wanted[q] = ",".join(str(k) for k, r in best.items() if r >= 0.8 - 1e-12)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame, results = spark.createDataFrame(docs, "doc_id long, text string"), []
    for at in (D.Settings(), D.Settings(items=4)):
        results.append({r.doc_id: r.asDict() for r in D.contamination(frame, benchmark, at=at).collect()})
        assert {k: r["items"] for k, r in results[-1].items()} == wanted
        assert {r.doc_id for r in D.keep_clean(frame, benchmark, at=at).collect()} == {k for k, x in wanted.items() if not x}
    assert results[0] == results[1]  # weights, similarities and windows do not depend on the blocks


def test_decontamination_index_misses_none_within_the_radius():
    rng = np.random.default_rng(18)
    items = [(k, " ".join(rng.choice([f"w{j}" for j in range(900)], 12))) for k in range(300)]
    index = D.Index(items, len(items))
    prints = index.prints[rng.integers(300, size=400)].view(np.uint8)
    bits = np.unpackbits(prints, axis=1, bitorder="little")
    for row in bits:
        row[rng.choice(128, rng.integers(0, 40), replace=False)] ^= 1
    prints = np.packbits(bits, axis=1, bitorder="little").view(np.uint16)
    far = np.bitwise_count(prints[:, None] ^ index.prints[None]).sum(axis=2)
    assert set(zip(*(x.tolist() for x in index.within(prints)))) == set(zip(*(x.tolist() for x in np.nonzero(far <= 31))))


def test_decontamination_radius_holds_similar_windows():
    """Of windows with a similarity of at least 0.8 to items of 6 to 60 words, nearly all lie within the radius."""
    rnd, near, total = random.Random(19), 0, 0
    words = vocabulary(rnd, 4000)
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([6, 9, 12, 15, 25, 60])))) for k in range(400)]
    index = D.Index(items, len(items))
    for k, (_, text) in enumerate(items):
        for _ in range(6):
            w = text.split()
            cut, n = rnd.randint(0, 3), len(w)
            w = w[cut:] + [rnd.choice(words) for _ in range(cut)] if rnd.random() < 0.5 else [rnd.choice(words) for _ in range(cut)] + w[: n - cut]
            if n > 30:
                w[rnd.randrange(n)] = rnd.choice(words)
            have, want = Counter(D._shingles(w, 5)), index.counts[k]
            weigh = lambda x: index.weight.get(x, index.rare)
            similar = sum(weigh(x) * min(have[x], c) for x, c in want.items()) / sum(weigh(x) * max(have[x], want[x]) for x in {**have, **want})
            if 0.8 <= similar < 1:
                bits = np.packbits(index._signs(list(have.elements())).sum(axis=0) > 1e-9, bitorder="little").view(np.uint16)
                total += 1
                near += np.bitwise_count(bits ^ index.prints[k]).sum() <= 31
    assert total > 200 and near / total > 0.995


def test_quality_counts():
    rnd = random.Random(10)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "|", "a b a b ", " "]) for _ in range(rnd.randint(0, 60)))
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), sum(c.isascii() and c.isupper() for c in text))
        assert quality_rules.measure(text) == want


def test_quality_thresholds(spark):
    rnd = random.Random(11)
    rows = [(k, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(80)), "en", "s") for k in range(90)]
    rows += [(100 + k, " ".join(f"w{rnd.randrange(10**6)}###" for _ in range(80)), "en", "s") for k in range(8)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k].kept for k in range(90)) and all(got[100 + k].failed_rule == "symbol_rate" for k in range(8))


def test_same_value_other_group_other_verdict(spark):
    """Two sources, one of plain prose and one of text full of symbols: 20 symbols in 100 words fail in the first only."""
    rnd = random.Random(14)
    text = lambda marks: " ".join(f"w{rnd.randrange(10**6, 10**7)}{'#' if k < marks else ''}" for k in range(100))
    rows = [(k, text(0), "en", "prose") for k in range(60)] + [(100 + k, text(rnd.randint(10, 40)), "en", "code") for k in range(60)]
    rows += [(500, text(20), "en", "prose"), (501, text(20), "en", "code")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[500].failed_rule == "symbol_rate" and got[501].kept
    assert all(r.kept for k, r in got.items() if k != 500)


def test_sketches_merge(spark):
    rnd = random.Random(12)
    values = [(rnd.choice("ab"), int(rnd.lognormvariate(5, 2))) for _ in range(4000)]
    frame = spark.createDataFrame(values, "g string, v long")
    got = {r.g: r for r in quality_rules.thresholds(frame, ["g"], ["v"], [0.5, 0.9]).collect()}
    for g in "ab":
        own = np.sort([v for h, v in values if h == g])
        exact = [int(own[int(np.ceil(s * len(own))) - 1]) for s in (0.5, 0.9)]
        buckets = spark.createDataFrame([(x,) for x in exact], "v long").select(quality_rules.bucket("v").alias("b")).collect()
        assert [got[g].q0, got[g].q1] == [r.b for r in buckets]


def test_pii_base():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rnd = random.Random(7)
    for _ in range(5000):
        x = "".join(rnd.choice(["a", "@", ".", "-", "1", "23", "0", " ", "+", "(", ")", "x.y", "256", "9999", "4111 1111 1111 1111"]) for _ in range(rnd.randint(0, 30)))
        want = {
            "email": [m.span() for m in email.finditer(x)],
            "ip": [m.span() for m in ip.finditer(x) if all(int(p) <= 255 for p in m.group().split("."))],
            "card": [m.span() for m in card.finditer(x) if 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)],
            "phone": [m.span() for m in phone.finditer(x) if 8 <= sum(c.isdigit() for c in m.group()) <= 15],
        }
        assert pii.base_spans(x) == want


def test_pii_added_and_redacted():
    detector = pii.train()
    text = 'Write to jane.doe@mail.example.com or call (030) 555-1234, token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" on 2024-01-02.'
    spans = pii.find(text, detector)[5]
    assert "email:9:34" in spans and "secret:" in spans and "2024" in pii.redact_text(text, spans)
    assert "0b96a8c8" not in pii.redact_text(text, spans) and "jane" not in pii.redact_text(text, spans)
    assert pii.find("Version 2.0 has 1234 pages and costs 12 345 678 EUR.", detector)[5] == ""
    pii.base_spans("a" * 200_000), pii.base_spans("1" * 200_000 + "." + "2" * 100_000), pii.candidates("1 " * 100_000)


def test_html():
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div>
      <main><article class="post"><header class="entry-header"><h1>A &amp; B</h1></header><p>It was the best of&nbsp;times   and <b>bo</b>ld in <a href="x">one</a> place<br>only.</p><p>To.</p><aside>Related</aside>
      <form><p>Sign up</p></form></article><section class="comments"><article><p>I am the first and this is a great comment by a reader.</p></article></section></main><footer>&copy; 2020</footer></body></html>"""
    assert html_text.main_text(page) == "A & B\nIt was the best of times and bold in one place only.\nTo."
    prose = "the cat and the dog of the house is in the garden with you. " * 5
    assert html_text.main_text(f"<p>{prose}<p>short one<p>{prose}<div class=ad>Buy now</div><ul><li><a href=x>menu</a></ul>") == "\n".join([prose.strip(), "short one", prose.strip()])
    assert html_text.main_text("<") == "" and html_text.main_text(None) == ""
    for bad in ("<" * 50_000, '<a "' * 20_000, "<!--" * 20_000, "<script>" * 5_000, "<div>" * 3_000 + "x"):
        html_text.main_text(bad)


def test_licenses_equal_sql(spark):
    rows = [(1, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of it.\nThe above copyright notice and this permission notice shall be included in all copies.\nThe software is provided \"as is\", without warranty of any kind."), (2, None), (3, "Copyright (c) 2020 Jo\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (4, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published, either version 3 of the License, or any later version."), (5, "Licensed under the Frobnicate licence.")]
    got = {r.doc_id: tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: r for r in con.execute(licenses.SQL).fetchall()} == got
    assert [got[k][3] for k in range(1, 6)] == ["MIT", "", "Apache-2.0,CC-BY-NC", "GPL-3.0-or-later", ""] and got[5][4] == "Unknown;"


def corpus(rnd, n):
    words, nasty = vocabulary(rnd, 500), ["vilesnip", "vilegrab", "crudmuck"]
    rows = []
    for k in range(n):
        w, kind = [rnd.choice(words) for _ in range(rnd.randint(30, 120))], rnd.random()
        toxic, good = kind < 0.2, not 0.2 <= kind < 0.4
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(nasty) + rnd.choice(["", "er", "ly"]))
        if not good:
            w = [x + "$$$" for x in w]
        rows.append((k, " ".join(w), int(good), int(toxic)))
    return rows


def test_classifiers_hold_out(spark):
    rows = corpus(random.Random(9), 900)
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").repartition(4)
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", "quality", "toxic")
    truth = {k: (q, t) for k, _, q, t in rows}
    quality = quality_fm.classify(docs, quality_fm.train(docs, labels)).where("held_out").collect()
    assert len(quality) > 100 and np.mean([r.predicted == truth[r.doc_id][0] for r in quality]) > 0.97
    toxicity = toxicity_crf.score(docs, toxicity_crf.train(docs, labels)).where("held_out").collect()
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in toxicity]) > 0.97
    text = {k: t for k, t, _, _ in rows}
    spans = [text[r.doc_id][int(a) : int(b)] for r in toxicity for a, b in (s.split(":") for s in r.spans.split(",") if s)]
    assert np.mean([s.startswith(("vile", "crud")) for s in spans]) > 0.95 and len(spans) > 40


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = rng.choice(50, 9, replace=False), rng.normal(size=9)
    pairs = sum(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b] for a in range(9) for b in range(a))
    assert np.isclose(m.raw([(index, value)])[0], 0.3 + m.linear[index] @ value + pairs)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    field = toxicity_crf.Field(np.zeros(4), rng.normal(size=(2, 2)), np.zeros(3))
    sequences = [rng.normal(size=n) for n in (1, 5, 0, 3)]
    for e, got in zip(sequences, field.marginals(sequences), strict=True):
        total, inside = 0.0, np.zeros(len(e))
        for code in range(2 ** len(e)):
            s = [code >> k & 1 for k in range(len(e))]
            weight = np.exp(sum(x for x, y in zip(e, s) if y) + sum(field.moves[a, b] for a, b in zip(s, s[1:])))
            total += weight
            inside += weight * np.array(s)
        assert np.allclose(got, inside / total)


def test_gradient_of_the_likelihood():
    """Observed less expected counts are the slopes of the likelihood, which is summed over all state sequences."""
    rng = np.random.default_rng(3)
    index, length = rng.integers(1, 12, (7, 3)), np.array([5, 4, 4, 1])
    ids, gold = rng.integers(0, 7, length.sum()), rng.integers(0, 2, length.sum()).astype(float)

    def likelihood(weights, moves):
        total, end = 0.0, 0
        for n in length:
            e, y = weights[index].sum(axis=1)[ids[end : end + n]], gold[end : end + n].astype(int)
            end += n
            weigh = lambda s: sum(x for x, b in zip(e, s) if b) + sum(moves[a, b] for a, b in zip(s, s[1:]))
            total += weigh(y) - np.log(sum(np.exp(weigh([code >> k & 1 for k in range(n)])) for code in range(2**n)))
        return total

    weights, moves, small = rng.normal(size=12), rng.normal(size=(2, 2)), 1e-5
    by_weight, by_move = toxicity_crf.gradient(toxicity_crf.Field(weights, moves, np.zeros(3)), index, ids, length, gold)
    for k in range(1, 12):
        step = small * (np.arange(12) == k)
        assert np.isclose(by_weight[k], (likelihood(weights + step, moves) - likelihood(weights - step, moves)) / (2 * small), atol=1e-5)
    for a in (0, 1):
        for b in (0, 1):
            step = np.zeros((2, 2))
            step[a, b] = small
            assert np.isclose(by_move[a, b], (likelihood(weights, moves + step) - likelihood(weights, moves - step)) / (2 * small), atol=1e-5)


def test_short_documents_train_too():
    """Documents of a few tokens are segments like others."""
    rnd = random.Random(15)
    words = vocabulary(rnd)
    texts = [" ".join(rnd.choice(words) for _ in range(6)) + (" vilegrab" if k % 4 == 0 else "") for k in range(200)]
    toxic = np.array([float(k % 4 == 0) for k in range(200)])
    field = toxicity_crf.fit(texts, toxic)
    marginals = field.marginals([np.array([field.emission(w) for w in x.split()]) for x in (f"{words[0]} {words[1]} vilegrab", " ".join(words[:3]), "")])
    assert marginals[0][2] > 0.5 > marginals[0][:2].max() and marginals[1].max() < 0.5
    assert (field.score(marginals) >= 0.5).tolist() == [True, False, False]
