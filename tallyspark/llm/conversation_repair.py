"""Repair of conversations by the cheapest edits, ties decided by ranks that double the length of audit they compare.

A conversation is good if its roles' initials are nothing or s?(ua)+. Each row is kept (K), given another role (R) or deleted (D), and
rows are inserted (I); the letters in order are the audit. Nodes are (rows read, state), the state being the last role written.
A pass from the last row to the first gives each node its least remaining cost; arcs that keep to it are optimal. Ranks of nodes by the
first letter of their audits, then by 2, 4, 8, ... letters, follow from the rank before and that of the node to which the doubled
pointer leads. As no two arcs of a node bear the same letter, a node's least audit of any length leads to one node. A path is
read off the doubled pointers, largest leap first.

Rows are sorted by conversation and turn into partitions, so a long conversation is cut into pieces. A piece's costs follow from
those at its right end, which a table of at most two pieces a partition hands from piece to piece; audits are found for each
state in which a piece may be entered, and joined in the last pass, which reads a conversation's rows in order without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, read

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 40
#: Rows of a piece at most.
PIECE = 1 << 16
#: States: nothing written, a system row, a user row (an answer must follow), an answer. Where a user or assistant row leads from each.
START, SYSTEM, USER, ANSWER = range(4)
NEXT = (USER, USER, ANSWER, USER)
LETTERS = "DIKR"
#: What a row is to the repair: a number of 4 x initial (s, u, a, other) + truncated, or one to delete, or none at all.
GONE, NONE = 32, 33


def _layer(right: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], tuple[tuple[int, ...], ...]]:
    """Costs of the four states before a row, given those after it, and for each state the optimal letters (as indexes of LETTERS)."""
    initial, late = "sua?"[symbol // 4 % 4] if symbol < GONE else "", TRUNCATED * (symbol % 4)
    ways: list[dict[int, int]] = []
    for state in range(4):
        found = {0: DELETE + right[state]}
        if symbol < GONE:
            found[3] = REROLE + late + right[NEXT[state]]
            to = SYSTEM if initial == "s" and state == START else NEXT[state] if initial == ("a" if state == USER else "u") else None
            if to is not None:
                found[2] = late + right[to]
        ways.append(found)
    return _inserted(ways)


def _inserted(ways: list[dict[int, int]]) -> tuple[tuple[int, ...], tuple[tuple[int, ...], ...]]:
    """Adds the insertions, which stay before the same row."""
    plain = [min(w.values(), default=NEVER) for w in ways]
    user, answer = min(plain[USER], INSERT + plain[ANSWER]), min(plain[ANSWER], INSERT + plain[USER])
    costs = [min(plain[START], INSERT + user), min(plain[SYSTEM], INSERT + user), user, answer]
    for state, w in enumerate(ways):
        w[1] = INSERT + costs[NEXT[state]]
    return tuple(min(c, NEVER) for c in costs), tuple(tuple(sorted(k for k, c in w.items() if c == costs[s] and c < NEVER)) for s, w in enumerate(ways))


class _Layers:
    """Layers by (costs after the row less their least, symbol); there are few, so most rows cost one lookup."""

    def __init__(self):
        self.known: dict[tuple[tuple[int, ...], int], tuple[int, tuple[int, ...], int]] = {}
        self.letters: list[tuple[tuple[int, ...], ...]] = []

    def back(self, right: tuple[int, ...], symbols: list[int]) -> tuple[tuple[int, ...], list[int]]:
        """Costs before the first row, and the kind of layer of each row."""
        kinds, total = [], min(right)
        costs = tuple(min(c - total, NEVER) for c in right)
        for symbol in reversed(symbols):
            if (costs, symbol) not in self.known:
                left, letters = _layer(costs, symbol)
                least = min(left)
                self.known[costs, symbol] = least, tuple(NEVER if c >= NEVER else c - least for c in left), len(self.letters)
                self.letters.append(letters)
            least, costs, kind = self.known[costs, symbol]
            total += least
            kinds.append(kind)
        return tuple(min(c + total, NEVER) for c in costs), kinds[::-1]

    def end(self) -> tuple[tuple[int, ...], int]:
        """Costs after a conversation's last row: nothing or an answer is a good end; insertions are still possible."""
        stop = len(LETTERS)
        costs, letters = _inserted([{stop: 0}, {}, {}, {stop: 0}])
        self.letters.append(tuple(() if stop in some else some for some in letters))
        return costs, len(self.letters) - 1


def doubled(target: np.ndarray, letter: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For nodes with up to four arcs (target and letter by place, -1 for none; a node without any is an end): pointers along the least
    audits over 1, 2, 4, ... edits, and the nodes' ranks by their whole least audits, an ended audit coming before those it begins."""
    first = np.where(letter < 0, len(LETTERS), letter).argmin(axis=1)
    nodes = np.arange(len(target))
    ends = letter[nodes, first] < 0
    leaps = [np.where(ends, nodes, target[nodes, first])]
    rank = np.where(ends, 0, letter[nodes, first] + 1)
    while not ends[leaps[-1]].all():
        _, rank = np.unique(rank * (len(nodes) + len(LETTERS) + 1) + rank[leaps[-1]], return_inverse=True)
        leaps.append(leaps[-1][leaps[-1]])
    return leaps, rank


def _walk(leaps: list[np.ndarray], ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the start, node) of every node on the paths from starts, in order, without their ends."""
    path, place, node = np.arange(len(starts)), np.zeros(len(starts), np.int64), starts
    live = ~ends[node]
    path, place, node = path[live], place[live], node[live]
    for k in range(len(leaps) - 1, -1, -1):
        onward = leaps[k][node]
        live = ~ends[onward]
        path, place, node = np.concatenate([path, path[live]]), np.concatenate([place, place[live] + (1 << k)]), np.concatenate([node, onward[live]])
    order = np.lexsort([place, path])
    return path[order], node[order]


def audits(pieces: list[list[int]], rights: list[tuple[int, ...] | None], starts: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], list[tuple[int, str]]]]:
    """For each piece (its rows' symbols; the costs at its right end, None at a conversation's end; the states in which it may be entered):
    the costs of the four states before it, and (state, audit) for each start."""
    layers, kinds, costs, firsts, wide = _Layers(), [], [], [], [0]
    last_costs, last_kind = layers.end()
    bare = len(layers.letters)
    layers.letters.append(((), (), (), ()))
    for symbols, right in zip(pieces, rights, strict=True):
        left, own = layers.back(last_costs if right is None else right, symbols)
        costs.append(left)
        firsts.append(wide[-1])
        kinds += [*own, last_kind if right is None else bare]
        wide.append(len(kinds))
    table = np.full((len(layers.letters), 4, 4), -1)
    for kind, by_state in enumerate(layers.letters):
        for state, letters in enumerate(by_state):
            table[kind, state, : len(letters)] = letters
    symbols = np.array([s for p in pieces for s in [*p, NONE]], np.int64)
    letter = table[np.array(kinds, np.int64)].reshape(-1, 4) if kinds else np.zeros((0, 4), np.int64)
    row, state = np.divmod(np.arange(len(letter)), 4)
    initial = np.where(symbols < GONE, symbols // 4 % 4, -1)[row]
    kept = np.where((initial == 0) & (state == START), SYSTEM, np.array(NEXT)[state])
    to = np.stack([4 * (row + 1) + state, 4 * row + np.array(NEXT)[state], 4 * (row + 1) + kept, 4 * (row + 1) + np.array(NEXT)[state]], axis=1)
    target = np.where(letter < 0, 0, np.take_along_axis(to, np.maximum(letter, 0), axis=1)) if len(letter) else letter
    leaps, rank = doubled(target, letter) if len(letter) else ([], np.zeros(0, np.int64))
    asked = [(p, s) for p, some in enumerate(starts) for s in some]
    at = np.array([4 * firsts[p] + s for p, s in asked], np.int64)
    if not len(at):
        return [(c, []) for c in costs]
    # of a node's arcs that of least letter, and then of least rank behind it, begins its least audit
    arc = np.where(letter < 0, len(LETTERS), letter) * (len(rank) + 1) + (rank[target] if len(rank) else 0)
    best = arc.min(axis=1) // (len(rank) + 1)
    path, node = _walk(leaps, best == len(LETTERS), at)
    text = np.frombuffer(LETTERS.encode(), np.uint8)[best[node]].tobytes().decode()
    ends = np.searchsorted(path, np.arange(len(at) + 1))
    found: list[list[tuple[int, str]]] = [[] for _ in pieces]
    for k, (p, s) in enumerate(asked):
        found[p].append((s, text[ends[k] : ends[k + 1]]))
    return list(zip(costs, found, strict=True))


def _matrix(symbols: list[int]) -> list[int]:
    """Least cost from each state before the rows to each after them."""
    columns = [_Layers().back(tuple(0 if s == end else NEVER for s in range(4)), symbols)[0] for end in range(4)]
    return [columns[end][start] for start in range(4) for end in range(4)]


def _by_piece(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """The pieces of each partition of rows, partition by partition: rows come sorted by (pid, gid)."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for pid, some in batch.groupby("pid", sort=False):
            if held and held[0]["pid"].iloc[0] != pid:
                yield _split(pd.concat(held))
                held = []
            held.append(some)
    if held:
        yield _split(pd.concat(held))


def _split(rows: pd.DataFrame) -> list[pd.DataFrame]:
    key = rows["key"].to_numpy()
    edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(rows)]
    return [rows.iloc[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def _symbols(rows: pd.DataFrame) -> list[int]:
    symbol = rows["symbol"].to_numpy()
    return symbol[symbol != NONE].tolist()


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and the last piece of each partition, the only ones that others may continue."""
    for pieces in _by_piece(batches):
        some = [pieces[0], *pieces[1:][-1:]]
        yield pd.DataFrame([(p["pid"].iloc[0], p["key"].iloc[0], _matrix(_symbols(p))) for p in some], columns=["pid", "key", "matrix"])


def _hand_on(pieces: pd.DataFrame) -> pd.DataFrame:
    """For a conversation's pieces: the costs at each one's right end, none for its last; whether it is the first."""
    pieces = pieces.sort_values("pid")
    costs, rows = _Layers().end()[0], []
    for k in range(len(pieces) - 1, -1, -1):
        rows.append((pieces["pid"].iloc[k], pieces["key"].iloc[k], None if k == len(pieces) - 1 else list(costs), k == 0))
        m = np.array(pieces["matrix"].iloc[k], np.int64).reshape(4, 4)
        costs = tuple(min(int(c), NEVER) for c in (m + np.array(costs)).min(axis=1))
    return pd.DataFrame(rows, columns=["pid", "key", "after", "opens"])


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pieces in _by_piece(batches):
        rights = [None if (a := p["after"].iloc[0]) is None else tuple(int(c) for c in a) for p in pieces]
        opens = [bool(p["opens"].iloc[0]) for p in pieces]
        solved = audits([_symbols(p) for p in pieces], rights, [(START,) if o else (START, SYSTEM, USER, ANSWER) for o in opens])
        rows = [(p["key"].iloc[0], p["gid"].iloc[0], c[START], s, audit) for p, (c, some) in zip(pieces, solved, strict=True) for s, audit in some]
        yield pd.DataFrame(rows, columns=["key", "gid", "cost", "enter", "letters"])


_EDITS = "key string, cost long, edit string, role string, text string"


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, gid, kind), each piece's audits (kind 0) before its rows, become the edits in order; one audit is held at a time.

    A conversation begins with a row without an edit, which has its cost. A row that only names its conversation gives no edit.
    """
    key, piece, state, audit, at = None, None, START, "", 0

    def wrote(letter: str, role: str | None, text: str) -> tuple:
        nonlocal state
        if letter == "D":
            return key, 0, letter, role, text
        state = SYSTEM if letter == "K" and state == START and role[:1] == "s" else NEXT[state]
        return key, 0, letter, role if letter == "K" else "user" if state == USER else "assistant", text

    def inserts() -> Iterator[tuple]:
        nonlocal at
        while audit[at : at + 1] == "I":
            at += 1
            yield wrote("I", None, "")

    for batch in batches:
        out: list[tuple] = []
        for k, gid, kind, cost, enter, letters, present, role, text in zip(*(batch[c].tolist() for c in ("key", "gid", "kind", "cost", "enter", "letters", "present", "role", "text")), strict=True):
            if kind == 0:
                if gid != piece or k != key:
                    out += inserts()
                    if k != key:
                        key, state = k, START
                        out.append((k, int(cost), None, None, None))
                    piece = gid
                    audit, at, entered = "", 0, state
                if enter == entered:
                    audit = letters
            elif present:
                out += inserts()
                at += 1
                out.append(wrote(audit[at - 1], role, text))
        yield pd.DataFrame(out, columns=["key", "cost", "edit", "role", "text"])
    yield pd.DataFrame(list(inserts()), columns=["key", "cost", "edit", "role", "text"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, cost, audit, repaired_sha256) of edits in order."""
    key, cost, audit, digest, empty = None, 0, [], hashlib.sha256(), True
    columns = ["key", "cost", "audit", "repaired_sha256"]
    for batch in batches:
        out = []
        for k, c, edit, role, text in zip(*(batch[x].tolist() for x in ("key", "cost", "edit", "role", "text")), strict=True):
            if edit is None:
                if key is not None:
                    out.append((key, cost, "".join(audit), digest.hexdigest()))
                key, cost, audit, digest, empty = k, c, [], hashlib.sha256(), True
                continue
            audit.append(edit)
            if edit != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame([] if key is None else [(key, cost, "".join(audit), digest.hexdigest())], columns=columns)


class Repair:
    """The repair of a table of rows (conv, turn, role, text); `present` is false for rows that only name their conversation.

    Nulls in role and text are one space; rows without a conversation are one conversation. Rows are taken by turn, nulls first; of
    equal turns by role, then by the text's first 64 characters, then by its hash, so equal rows are neighbours. A blank or repeated row
    (role and text seen earlier in its conversation) is deleted. Empty conversations have an empty audit and cost nothing; long texts are
    read whole; an empty table gives empty ones. Other columns are not read, so their names may clash.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None):
        self.name, self.type = conv_col, rows.schema[conv_col].dataType
        space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        given = rows.select(F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("key"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), (F.lit(True) if present is None else present).alias("present"))
        order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text")]
        salt = F.xxhash64(F.monotonically_increasing_id())  # many equal rows may be dealt over several partitions, where their order is all one
        gid = F.col("gid")
        placed = given.repartitionByRange(*order, salt).sortWithinPartitions(*order)
        self.rows = cut(placed.withColumn("gid", F.monotonically_increasing_id()))
        body = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
        marked = self.rows.withColumn("blank", body == "").withColumn("late", ~F.substring(body, -1, 1).isin(".", "!", "?"))
        firsts = marked.where("present AND NOT blank").groupBy("key", "role", F.sha2("text", 256)).agg(F.min("gid").alias("gid")).select("gid", F.lit(True).alias("new"))
        fault = F.when(~F.col("present"), None).when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("late"), "truncated")
        initial = reduce(lambda found, k: found.when(F.substring("role", 1, 1) == "sua"[k], k), range(3), F.when(F.lit(False), 0)).otherwise(3)
        pid = F.shiftright(gid, 33) * (1 << 33) + F.floor(gid.bitwiseAND((1 << 33) - 1) / PIECE)
        marked = marked.select("key", "gid", "turn", "present", "blank", "late", initial.alias("initial")).join(firsts, "gid", "left").select("key", "gid", "turn", "initial", fault.alias("fault"), pid.alias("pid"), "present")
        symbol = F.when(~F.col("present"), NONE).when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(4 * F.col("initial") + F.when(F.col("fault") == "truncated", 1).otherwise(0))
        self.marks = cut(marked.withColumn("symbol", symbol))

    def _pieces(self, rows: DataFrame, work: Callable, schema: str) -> DataFrame:
        return rows.repartition("pid").sortWithinPartitions("pid", "gid").mapInPandas(work, schema)

    def faults(self) -> DataFrame:
        """(key, gaps, blank, duplicate, truncated, illegal) of each conversation."""
        count = lambda fault: F.coalesce(F.sum((F.col("fault") == fault).cast("long")), F.lit(0)).alias(fault)
        counts = self.marks.groupBy("key").agg(count("blank"), count("duplicate"), count("truncated"))
        turns = self.marks.where("present AND turn IS NOT NULL").groupBy("key", "turn").count().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
        pieces = self._pieces(self.marks.where("present"), _pairs, "key string, pid long, illegal long, first int, last int")
        before = F.lag("last").over(Window.partitionBy("key").orderBy("pid"))  # a row for each piece
        across = pieces.withColumn("across", F.when(before.isNotNull() & ~F.concat(before, F.lit(""), F.col("first")).isin("01", "12", "21"), 1).otherwise(0))
        illegal = across.groupBy("key").agg(F.sum(F.col("illegal") + F.col("across")).alias("illegal"))
        found = counts.join(turns, "key", "left").join(illegal, "key", "left")
        return found.select("key", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal"))

    def _edits(self) -> DataFrame:
        """Edits by conversation, in order in their partition; each conversation begins with a row that has its cost and no edit."""
        edges = self._pieces(self.marks, _edges, "pid long, key string, matrix array<long>")
        after = edges.groupBy("key").applyInPandas(_hand_on, "pid long, key string, after array<long>, opens boolean")
        rows = self.marks.select("key", "gid", "pid", "symbol").join(after, ["pid", "key"], "left").withColumn("opens", F.coalesce("opens", F.lit(True)))
        solved = self._pieces(rows, _solved, "key string, gid long, cost long, enter int, letters string")
        audits = solved.select("key", "gid", F.lit(0).alias("kind"), "cost", "enter", "letters", F.lit(True).alias("present"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        texts = self.rows.select("key", "gid", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("enter"), F.lit(None).cast("string").alias("letters"), "present", "role", "text")
        return audits.union(texts).repartition("key").sortWithinPartitions("key", "gid", "kind").mapInPandas(_applied, _EDITS)

    def _named(self, df: DataFrame) -> DataFrame:
        name = F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(self.type)).alias(self.name)
        return df.select(name, *[c for c in df.columns if c != "key"])

    def edits(self) -> DataFrame:
        """(conv, edit, role, text): the edits, a conversation's in order within one partition; those that are not D are its repaired rows."""
        return self._named(self._edits().where("edit IS NOT NULL").drop("cost"))

    def digests(self) -> DataFrame:
        """One row for each conversation: its faults, the least cost, the audit and the hash of what is repaired."""
        found = self._edits().mapInPandas(_digests, "key string, cost long, audit string, repaired_sha256 string")
        return self._named(self.faults().join(found, "key"))


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each piece its illegal pairs of neighbours and its first and last initial."""
    for pieces in _by_piece(batches):
        rows = []
        for p in pieces:
            x = p["initial"].to_numpy(np.int64)
            pair = 4 * x[:-1] + x[1:]
            rows.append((p["key"].iloc[0], p["pid"].iloc[0], int((~np.isin(pair, (1, 6, 9))).sum()), x[0], x[-1]))
        yield pd.DataFrame(rows, columns=["key", "pid", "illegal", "first", "last"])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the crc32 of `conv_id:turn` deals out, and `present`, false for those that it drops."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fault == 4, "user").otherwise(space("role"))
    times = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault != 0).alias("present"), times.alias("time")).drop("time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repair(damaged(read(spark, sf_dir, "conversations")), present=F.col("present")).digests()
