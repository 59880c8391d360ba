"""Removal of repeated byte strings by distributed prefix doubling.

Every byte that lies in a string of `length` bytes which also starts earlier (smaller document, or same document and earlier
start) is removed. Prefix doubling ranks positions by longer and longer prefixes, sorts the ranks and goes on with those that
are not unique, until the prefixes have the wanted length. Two things make that fit a cluster's disks:

* A rank is a name: the name of 2h bytes is a hash of the names of its halves, so tasks name prefixes without a global sort.
* Round one sorts only anchors. A window's anchor is the position with the least 32-byte name in it; equal windows have equal
  anchors at equal offsets. Neighbouring windows share anchors, so there is about one anchor for 30 bytes.

Round one (32 bytes, and the whole context of the windows that share an anchor): Spark sorts (name, context, position). Equal
contexts: all windows but the first context's are repeats. Names that occur in one context only are unique and leave.
Round two (100 bytes): what is left is renamed by whole windows, sorted again, and all but the first window go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, read

_K = 32
_U = np.uint64
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_TIMES = _RNG.integers(0, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)
_POS = _U((1 << 24) - 1)
#: Bytes that are named at a time; texts above are cut into pieces that overlap by a window.
_PIECE = 1 << 22
#: A name with more contexts than this is compared window by window over the whole cluster, not in one task.
GROUP = 20_000
#: Stands for a null id, before all others.
_NONE = -(2**63)


def _names(data: np.ndarray, upto: int = 64) -> dict[int, np.ndarray]:
    """Names of all substrings of 1, 2, 4 ... upto bytes, by start."""
    out = {1: _BYTE[data]}
    h, level = 1, 0
    while h < upto and len(data) > h:
        q = out[h][:-h] * _TIMES[level]
        q += out[h][h:]
        q ^= q >> _U(29)
        h, level = 2 * h, level + 1
        out[h] = q[: len(data) - h + 1]
    return out


def _anchors(data: np.ndarray, n: np.ndarray, length: int):
    """For texts of n bytes each, laid end to end in data: text index, first and last window start (in the text), name, context's name of each anchor."""
    ends = np.cumsum(n)
    starts = ends - n
    names = _names(data)
    order = names[_K] * _TIMES[7]
    least = (order & ~_POS) | np.arange(len(order), dtype=np.uint64)
    span, h = length - _K + 1, 1
    while 2 * h <= span:
        least, h = np.minimum(least[:-h], least[h:]), 2 * h
    if h < span:
        least = np.minimum(least[: h - span], least[span - h :])
    anchor = (least & _POS).astype(np.int64)
    text = np.repeat(np.arange(len(n)), n)[: len(anchor)]
    valid = np.flatnonzero(np.arange(len(anchor)) + length <= ends[text])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    new = np.flatnonzero(np.concatenate([[True], anchor[valid[1:]] != anchor[valid[:-1]]]))
    lo, hi = valid[new], valid[np.concatenate([new[1:] - 1, [len(valid) - 1]])]
    size, whole = hi - lo + length, names[64]
    context = (whole[lo] * _TIMES[0] + whole[lo + (size - 64) // 2]) * _TIMES[1] + whole[hi + length - 64]
    context = (context ^ (context >> _U(31))) * _TIMES[2] + size.astype(np.uint64)
    return text[lo], lo - starts[text[lo]], hi - starts[text[lo]], names[_K][anchor[lo]], context


def _blobs(docs: list[tuple], length: int, most: int = 1 << 16):
    """Groups texts, or pieces of long ones, to about `most` bytes: lists of (document's index, offset, bytes)."""
    some, size = [], 0
    for k, (_, _, text) in enumerate(docs):
        for at in range(0, max(0, len(text) - length) + 1, _PIECE):
            piece = text[at : at + _PIECE + length - 1]
            some.append((k, at, piece))
            size += len(piece)
            if size >= most:
                yield some
                some, size = [], 0
    if some:
        yield some


def _anchor_rows(length: int):
    """(doc, th, text) -> anchors (gone false) and the windows whose context stands earlier in the same batch (gone true)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                texts = [x if x is not None else b"" for x in part.column(2).to_pylist()]
                docs = sorted(((d, t, x) for d, t, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True) if len(x) >= length), key=lambda r: r[:2])
                found = []
                for blob in _blobs(docs, length):
                    text, lo, hi, name, context = _anchors(np.frombuffer(b"".join(x for _, _, x in blob), np.uint8), np.array([len(x) for _, _, x in blob]), length)
                    k, offset = np.array([b[0] for b in blob])[text], np.array([b[1] for b in blob])[text]
                    found.append((k, lo + offset, hi + offset, name, context))
                if found:
                    yield emit(docs, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def emit(docs, k, lo, hi, name, context) -> pa.RecordBatch:
        order = np.argsort(name * _TIMES[3] + context, kind="stable")  # rows come in the order of documents and positions
        k, lo, hi, name, context = (x[order] for x in (k, lo, hi, name, context))
        again = np.concatenate([[False], (name[1:] == name[:-1]) & (context[1:] == context[:-1])])
        doc, th = np.array([d[0] for d in docs], np.int64)[k], np.array([d[1] for d in docs], np.int64)[k]
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(k))))
        twin = again & (doc == doc[first]) & (th == th[first]) & (lo == lo[first])  # a repeated row, not an earlier place
        name = np.where(again, (doc + 1).astype(np.uint64) * _TIMES[4] + lo.astype(np.uint64), name).view(np.int64)
        place = lo << 8 | again << 7 | (hi - lo)  # 8 bytes for three columns: most rows of the whole run are these
        columns = [name, context.view(np.int64), doc, th, place]
        return pa.RecordBatch.from_arrays([pa.array(x[~twin]) for x in columns], names=["name", "context", "doc", "th", "place"])

    return rows


_ANCHOR = "name long, context long, doc long, th long, place long"


def _rank(hot: frozenset):
    """Reads anchors sorted by name, context and position. Repeats of a context are gone; firsts of contexts go on if their name has another context, or is hot."""
    many = np.array(sorted(hot), np.int64)
    columns = ["name", "doc", "th", "place", "gone"]

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, pending, alike = None, None, False  # last row's first; a first of which it is open whether its name comes again
        for batch in batches:
            batch = batch.assign(gone=(batch["place"].to_numpy() & 128) > 0)
            yield batch.loc[batch["gone"], columns]
            rows = batch[~batch["gone"]]
            if not len(rows):
                continue
            if before is not None:
                rows = pd.concat([before, rows], ignore_index=True)
            name, context = rows["name"].to_numpy(), rows["context"].to_numpy()
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (context[1:] != context[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
            places = rows[["doc", "th", "place"]].to_numpy()
            again = ~new & (places != places[first]).any(axis=1)
            yield rows.loc[again, columns].assign(gone=True)
            firsts = rows.iloc[np.flatnonzero(new)]
            if before is not None:
                firsts = firsts.iloc[1:]
            before = rows.iloc[[first[-1]]]
            if pending is not None:
                firsts = pd.concat([pending, firsts], ignore_index=True)
            if not len(firsts):
                continue
            names = firsts["name"].to_numpy()
            same = names[1:] == names[:-1]
            more = np.concatenate([[alike], same]) | np.concatenate([same, [False]]) | np.isin(names, many)
            pending, alike = firsts.iloc[[-1]], bool(more[-1])
            yield firsts.iloc[:-1].loc[more[:-1], columns]
        if pending is not None and alike:
            yield pending[columns]

    return rank


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of closed intervals, neighbours joined."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    cuts = np.flatnonzero(lo[1:] > reach[:-1] + 1) + 1
    return lo[np.concatenate([[0], cuts])], reach[np.concatenate([cuts - 1, [len(lo) - 1]])]


def _ends(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of packed places."""
    places = np.asarray(places, np.int64)
    return places >> 8, (places >> 8) + (places & 127)


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row of a document's places -> its merged gone intervals, and those that go on."""
    for batch in batches:
        out = []
        for doc, th, gone, names, places in zip(*(batch[c] for c in ("doc", "th", "gone", "names", "places")), strict=True):
            lo, hi = _ends(gone)
            out.append((doc, th, *(_merged(lo, hi) if len(lo) else (lo, hi)), names, *_ends(places)))
        yield pd.DataFrame(out, columns=["doc", "th", "lo", "hi", "names", "los", "his"])


def _windows(rows: pd.DataFrame, length: int):
    """All windows of the rows' contexts: row, start in the text, and the two names that make up a window's."""
    n = (rows["hi"] - rows["lo"] + 1).to_numpy()
    names = _names(np.frombuffer(b"".join(rows["bytes"]), np.uint8))[64]
    starts = np.cumsum(n + length - 1) - (n + length - 1)
    row = np.repeat(np.arange(len(rows)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    where = starts[row] + at
    return row, rows["lo"].to_numpy()[row] + at, names[where], names[where + length - 64]


def _compare(length: int):
    """Reads contexts sorted by name and position; yields the windows that stand earlier under the same name."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            data = batch if held is None else pd.concat([held, batch], ignore_index=True)
            name = data["name"].to_numpy()
            cuts = np.flatnonzero(name[1:] != name[:-1]) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            held = data.iloc[last:]
            yield from solve(data.iloc[:last])
        if held is not None:
            yield from solve(held)

    def solve(data: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(data):
            return
        row, start, one, two = _windows(data, length)
        name = data["name"].to_numpy()[row]
        order = np.argsort(one * _TIMES[0] + two * _TIMES[1] + name.view(np.uint64) * _TIMES[2], kind="stable")
        row, start, one, two, name = (x[order] for x in (row, start, one, two, name))
        again = np.concatenate([[False], (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (name[1:] == name[:-1])])
        doc, th = data["doc"].to_numpy()[row], data["th"].to_numpy()[row]
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(row))))
        again &= (doc != doc[first]) | (th != th[first]) | (start != start[first])
        keys = np.sort(row[again].astype(np.int64) << 32 | start[again])
        if len(keys):
            cuts = np.flatnonzero(np.diff(keys) != 1) + 1
            a, b = keys[np.concatenate([[0], cuts])], keys[np.concatenate([cuts - 1, [len(keys) - 1]])]
            own = data.iloc[a >> 32]
            yield pd.DataFrame({"doc": own["doc"].to_numpy(), "th": own["th"].to_numpy(), "lo": (a & 0xFFFFFFFF).astype(np.int32), "hi": (b & 0xFFFFFFFF).astype(np.int32)})

    return compare


def _spread(length: int):
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, start, one, two = _windows(batch, length)
            yield pd.DataFrame({"one": one.view(np.int64), "two": two.view(np.int64), "doc": batch["doc"].to_numpy()[row], "th": batch["th"].to_numpy()[row], "lo": start.astype(np.int32)})

    return spread


def _digest(length: int):
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, *parts in zip(*(batch[c] for c in ("id", "text", "lo1", "hi1", "lo2", "hi2")), strict=True):
                text = text or b""
                lo1, hi1, lo2, hi2 = (np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in parts)
                lo, hi = np.concatenate([lo1, lo2]), np.concatenate([hi1, hi2]) + length - 1
                if len(lo):
                    lo, hi = _merged(lo, hi)
                sha, at = hashlib.sha256(), 0
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    sha.update(text[at:a])
                    at = b + 1
                sha.update(text[at:])
                out.append((key, len(text), int((hi - lo + 1).sum()), len(lo), sha.hexdigest()))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"id": "Int64"})

    return digest


def _hot_names(texts: DataFrame, length: int, share: float, fraction: float) -> frozenset:
    """Names of over `share` of a sample's anchors, 1/share of them at most. They only decide how rows are dealt out."""
    counts = texts.sample(fraction, seed=4).mapInArrow(_anchor_rows(length), _ANCHOR).where("place & 128 = 0").groupBy("name").count()
    top = counts.orderBy(F.desc("count")).limit(int(1 / share)).collect()
    least = max(100, share * sum(r["count"] for r in top))
    return frozenset(r["name"] for r in top if r["count"] > least)


def _settled(texts: DataFrame, length: int, share: float, fraction: float) -> DataFrame:
    """Round one: a row for each document with gone windows, or with places whose names come again under other contexts."""
    hot = _hot_names(texts, length, share, fraction)
    salt = [F.when(F.col("name").isin(*hot), F.pmod(F.col("context"), F.lit(1024)))] if hot else []
    dealt = texts.mapInArrow(_anchor_rows(length), _ANCHOR).repartition("name", *salt).sortWithinPartitions("name", "context", "doc", "th", "place")
    ranked = dealt.mapInPandas(_rank(hot), "name long, doc long, th long, place long, gone boolean")
    gathered = [F.collect_list(F.when(F.col("gone"), F.col("place"))).alias("gone"), *[F.collect_list(F.when(~F.col("gone"), F.col(c))).alias(f"{c}s") for c in ("name", "place")]]
    per_doc = ranked.groupBy("doc", "th").agg(*gathered)
    return cut(per_doc.mapInPandas(_settle, "doc long, th long, lo array<int>, hi array<int>, names array<long>, los array<int>, his array<int>"))


def _round_two(texts: DataFrame, settled: DataFrame, length: int, group: int) -> DataFrame:
    """(doc, th, lo, hi) of windows that stand earlier under the same name but in another context."""
    piece = lambda z: F.struct(z["names"].alias("name"), z["los"].alias("lo"), z["his"].alias("hi"), F.substring(F.col("text"), z["los"] + 1, z["his"] - z["los"] + length).alias("bytes"))
    open_rows = settled.where(F.size("names") > 0).select("doc", "th", F.arrays_zip("names", "los", "his").alias("z"))
    contexts = open_rows.join(texts, ["doc", "th"]).select("doc", "th", F.explode(F.transform("z", piece)).alias("p")).select("p.name", "doc", "th", "p.lo", "p.hi", "p.bytes")
    large = settled.select(F.explode("names").alias("name")).groupBy("name").count().where(F.col("count") > group).select("name")
    some = not large.isEmpty()
    small = contexts.join(large, "name", "left_anti") if some else contexts
    one_task = small.repartition("name").sortWithinPartitions("name", "doc", "th", "lo").mapInPandas(_compare(length), "doc long, th long, lo int, hi int")
    if not some:
        return one_task
    windows = contexts.join(large, "name", "left_semi").mapInPandas(_spread(length), "one long, two long, doc long, th long, lo int")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("doc", "th", "lo")).alias("first"))
    return one_task.union(windows.join(first, ["one", "two"]).where(F.struct("doc", "th", "lo") > F.col("first")).select("doc", "th", "lo", F.col("lo").alias("hi")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, group: int = GROUP, hot_share: float = 1e-3, hot_sample: float = 0.01) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, for strings of `length` bytes (64 to 112).

    Null texts count as empty; texts under `length` bytes lose nothing. Null ids come before all others. Rows that repeat an
    id are ordered by a hash of the text; equal rows are one document, not repeats of each other. Extra columns are ignored.
    """
    if not 64 <= length <= 112:
        raise ValueError("length must be from 64 to 112 bytes")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("doc")
    unique = docs.select(doc).groupBy("doc").count().where("count > 1").isEmpty()
    th = F.lit(0).cast("long") if unique else F.xxhash64(F.col(text_col))
    texts = docs.select(doc, th.alias("th"), F.col(text_col).cast("binary").alias("text"))
    settled = _settled(texts, length, hot_share, hot_sample)
    found = _round_two(texts, settled, length, group).groupBy("doc", "th").agg(F.collect_list("lo").alias("lo2"), F.collect_list("hi").alias("hi2"))
    gone = settled.select("doc", "th", F.col("lo").alias("lo1"), F.col("hi").alias("hi1")).join(found, ["doc", "th"], "left")
    done = texts.join(gone, ["doc", "th"], "left").select(F.when(F.col("doc") != _NONE, F.col("doc")).alias("id"), "text", "lo1", "hi1", "lo2", "hi2")
    return done.mapInPandas(_digest(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
