"""run() against the stages in plain Python, on documents with planted copies, benchmark passages, poor texts and e-mail addresses."""

import hashlib
import random
import re

import corpus_pipeline
from tallyspark.llm import decontamination, pii, quality_fm

from test_brute_force import WORD, plain_components, plain_print, vocabulary
from test_mixing import brute_targets


def test_run_equals_plain_stages(spark, tmp_path):
    rnd = random.Random(13)
    words = vocabulary(rnd, 400)
    sentence = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(k, " ".join(sentence(24))) for k in range(6)]
    docs, quality = [], []
    for k in range(420):
        w, kind = sentence(rnd.randint(60, 140)), rnd.random()
        if kind < 0.25:
            w = [x + "$$$" for x in w]
        elif kind < 0.35:
            w[10:10] = rnd.choice(items)[1].split()
        elif kind < 0.5 and docs:
            w = rnd.choice(docs)[1].split()
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = rnd.choice(words)
        elif kind < 0.6:
            w[5:5] = ["mail", f"jane.{k}@mail.example.org", "now"]
        docs.append((k, " ".join(w), "en", rnd.choice(["a", "b", "hot", "hot", None])))
        quality.append((k, int("$$$" not in docs[-1][1]), 0))
    schema = "doc_id long, text string, lang string, source string"
    frame, labels = spark.createDataFrame(docs, schema), spark.createDataFrame(quality, "doc_id long, quality int, toxic int")
    for name, table in {"documents": frame, "labels": labels, "benchmark": spark.createDataFrame(items, "item_id long, text string")}.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    machine = quality_fm.train(frame, labels)
    kept = [d for d in docs if machine.score([quality_fm.features(d[1], quality_fm.Settings.words)])[0] >= 0.3]
    assert {d[0] for d in docs} - {d[0] for d in kept} == {k for k, good, _ in quality if not good}
    first = plain_components([d[0] for d in kept], [plain_print(d[1]) for d in kept])
    single = [d for d in kept if first[d[0]] == d[0]]
    assert len(single) < len(kept) - 10

    def leaked(text):
        have = decontamination.tokens(text)
        for _, item in items:
            want = decontamination.tokens(item)
            if any(have[s : s + len(want)] == want for s in range(len(have))):
                return True
        return False

    clean = [d for d in single if not leaked(d[1])]
    assert len(clean) < len(single) - 5
    detector = pii.train()
    redacted = {d[0]: (re.sub(r"jane\.\d+@mail\.example\.org", "<email>", d[1]), d[3]) for d in clean}
    assert all(pii.redact_text(d[1], pii.find(d[1], detector)[5]) == redacted[d[0]][0] for d in clean)
    assert {k: (r.text, r.source) for k, r in got.items()} == redacted

    size = {k: len(WORD.findall(t)) for k, (t, _) in redacted.items()}
    total = {}
    for k, (_, s) in redacted.items():
        total[s] = total.get(s, 0) + size[k]
    target = brute_targets(total)
    for k, (_, s) in redacted.items():
        draw = int(hashlib.md5(f"5:{k}:{size[k]}".encode()).hexdigest()[:13], 16) / 2**52
        assert got[k]["size"] == size[k] and abs(got[k].target - target[s]) < 1e-6
        assert abs(got[k].taken - min(3 * size[k], target[s] / total[s] * size[k] + draw - 0.5)) <= 0.5 + 1e-6
