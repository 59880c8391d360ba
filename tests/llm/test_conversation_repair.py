"""Repairs against a search over all edit sequences, with conversations cut into pieces; ranks against sorted audits."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from tallyspark.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least cost, then ASCII-least audit, by Dijkstra's search over (cost, audit)."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return faults, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        name = "user" if to == 2 else "assistant"
        heapq.heappush(queue, (cost + 3, audit + "I", i, to, (*out, f"{name}:")))
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                heapq.heappush(queue, (cost + 3 + late, audit + "R", i + 1, to, (*out, f"{name}:{text}")))
                onto = 1 if role[:1] == "s" and state == 0 else to if role[:1] == name[0] else None
                if onto is not None:
                    heapq.heappush(queue, (cost + late, audit + "K", i + 1, onto, (*out, f"{role}:{text}")))


def expected(table):
    by = {}
    for conv, turn, role, text in table:
        by.setdefault(conv, []).append((turn, role, text))
    found = {}
    for conv, rows in by.items():
        kept = []
        for turn, role, text in rows:
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in kept if t is not None}
        pairs = [(r, x) for _, r, x in kept]
        faults, cost, audit, digest = cheapest(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        found[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return found


def hostile(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle", "sage"]
    texts = ["Yes.", "No!", "why", "", None, " \t", "Well?  ", "é日本。", "x" * 5000 + ".", "A. b"]
    table = []
    for conv in [None, *range(25)]:
        for turn in range(rng.randrange(12)):
            turn = rng.choice([turn, turn, turn, None, turn + 3])
            table.append((conv, turn, rng.choice(roles), f"{turn} {rng.choice(texts)}" if rng.random() < 0.6 else rng.choice(texts)))
    table = list({(c, t, r): (c, t, r, x) for c, t, r, x in table}.values())
    for turn in range(60):  # one conversation over many pieces
        table.append((99, turn, rng.choice(roles[:5]), rng.choice(["Same.", f"{turn}.", f"{turn}"])))
    return table


def run(spark, table):
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    found = cr.Repair(cr.damaged(rows), present=cr.F.col("present")).digests().collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


@pytest.mark.parametrize("piece", [1 << 16, 3])
def test_against_search(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = hostile(piece)
        assert run(spark, table) == expected(table)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(cr, "PIECE", 4)
    rows = [(1, 0, "user", "Hi.")] * 40 + [(1, 1, "assistant", "Yes.")]
    got = cr.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).digests().first()
    assert (got.duplicate, got.illegal, got.cost, got.audit) == (39, 39, 156, "K" + "D" * 39 + "K")


def test_edits_and_names(spark):
    rows = spark.createDataFrame([("a:b", 0, "system", "S."), ("a:b", 1, "assistant", "A."), (None, 5, "user", None)], "c string, t int, who string, text string").selectExpr("*", "1 AS key", "2 AS gid", "3 AS symbol", "4 AS pid")
    got = cr.Repair(rows, "c", "t", "who").edits().collect()
    assert [(r.c, r.edit, r.who if "who" in r else r.role, r.text) for r in got if r.c] == [("a:b", "K", "system", "S."), ("a:b", "I", "user", ""), ("a:b", "K", "assistant", "A.")]
    assert [(r.edit, r.role, r.text) for r in got if r.c is None] == [("D", "user", " ")]


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.Repair(rows).digests().collect() == [] and cr.Repair(rows).edits().collect() == []


def test_ranks_sort_audits():
    rng = np.random.default_rng(3)
    n = 300  # arcs lead to higher nodes, so every path ends
    letter = np.full((n, 4), -1)
    target = np.zeros((n, 4), np.int64)
    for v in range(n - 1):
        some = np.sort(rng.choice(4, size=rng.integers(0, 4) if v < n - 20 else 0, replace=False))
        letter[v, : len(some)] = some
        target[v, : len(some)] = rng.integers(v + 1, min(n, v + 6), size=len(some))
    audit = [""] * n
    for v in range(n - 1, -1, -1):
        audit[v] = min((cr.LETTERS[k] + audit[w] for k, w in zip(letter[v], target[v], strict=True) if k >= 0), default="")
    leaps, rank = cr.doubled(target, letter)
    order = {a: k for k, a in enumerate(sorted(set(audit)))}
    assert [order[a] for a in audit] == rank.tolist()
