"""Benchmark decontamination with SimHash windows of the items' sizes.

A document's window of as many words as an item has gets a 128-bit SimHash fingerprint of its weighted five-word shingles.
The index keeps the items by the value of each 16-bit block of their fingerprints: two fingerprints within the radius agree,
in some block, up to the block's share of the radius, so looking up every value within that share of the window's own, block
by block, misses none within the radius. Full distances follow, then the exact weighted similarity
sum(w min(a, b)) / sum(w max(a, b)) of the shingle counts, with w = log(1 + items / items with the shingle).
Only windows that share a shingle with some item are made; the others have similarity 0 with every item.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, read

_TOKEN = re.compile(r"\w+")
_HITS = "array<struct<item:long,start:long,words:long,similarity:double>>"
_BITS, _BLOCK = 128, 16
#: Windows that are looked up at a time.
_PIECE = 64


@dataclass(frozen=True)
class Settings:
    """radius: of 128 bits; at similarity 0.8 windows differ in 19 bits on average, and more than 31 are three deviations off."""

    shingle: int = 5
    similarity: float = 0.8
    radius: int = 31
    #: Items, and characters of items, that a job's tasks hold, about; larger benchmarks are worked off one block after the other.
    #: A worker and the driver take some 110 bytes for each character (measured: 214 MB for 1.95 million), so about 220 MB.
    items: int = 20_000
    chars: int = 2_000_000


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _shingles(words: list[str], size: int) -> list[tuple[str, ...]]:
    return [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]


class Index:
    """Items of one block, by the values of their fingerprints' blocks.

    total and shares (items that have a shingle) are those of the whole benchmark, so that an item's weights and matches
    don't depend on the block that it is in; shares are counted from the given items where they are all.
    """

    def __init__(self, items: list[tuple[int, str]], total: int, at: Settings = Settings(), shares: dict[tuple[str, ...], int] | None = None):
        self.at, self.rare = at, math.log(1 + max(total, 1))
        words = [(item, w) for item, text in items if (w := tokens(text))]
        self.item = [item for item, _ in words]
        self.length = np.array([len(w) for _, w in words], np.int64)
        self.sizes = sorted({min(at.shingle, n) for n in self.length.tolist()})
        self.counts = [Counter(_shingles(w, min(at.shingle, len(w)))) for _, w in words]
        own: Counter = Counter(s for c in self.counts for s in c)
        self.weight = {s: math.log(1 + max(total, 1) / (shares or own)[s]) for s in own}
        self.mass = [sum(self.weight[s] * n for s, n in c.items()) for c in self.counts]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in words for w in ws}))}
        self.leads: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for n, c in zip(self.length.tolist(), self.counts, strict=True):
            for s in c:
                self.leads[s].add(n)
        self.codes = {size: np.unique(self._codes(np.array([[self.number[w] for w in s] for s in own if len(s) == size], np.uint64).T)) for size in self.sizes}
        prints = [np.packbits(self._signs(list(c.elements())).sum(axis=0) > 1e-9, bitorder="little") for c in self.counts]
        self.prints = np.array(prints, np.uint8).reshape(-1, _BITS // 8).view(np.uint16)  # a column for each block
        share = at.radius // self.prints.shape[1]
        self.near = np.array([sum(1 << b for b in bits) for k in range(share + 1) for bits in combinations(range(_BLOCK), k)], np.uint16)
        self.order = np.argsort(self.prints, axis=0, kind="stable").T.astype(np.int32)
        self.first = np.stack([np.searchsorted(column[order], np.arange((1 << _BLOCK) + 1)) for column, order in zip(self.prints.T, self.order, strict=True)]).astype(np.int32)

    @staticmethod
    def _codes(columns) -> np.ndarray:
        code = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            code = (code ^ c) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(32)
        return code

    def _signs(self, shingles: list[tuple[str, ...]]) -> np.ndarray:
        """Weighted +1 and -1 for the bits of each shingle's hash."""
        hashes = b"".join(xxhash.xxh3_128_digest(" ".join(s).encode("utf-8", "surrogatepass")) for s in shingles)
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, _BITS // 8), axis=1, bitorder="little").astype(np.float64)
        return (2 * bits - 1) * np.array([self.weight.get(s, self.rare) for s in shingles])[:, None]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of every pair within the radius, by look-ups in the blocks; prints has a row of blocks for each window."""
        windows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(prints), _PIECE):
            part = prints[at : at + _PIECE]
            for block in range(part.shape[1]):
                values = part[:, block, None] ^ self.near
                first, last = self.first[block][values], self.first[block][values.astype(np.int32) + 1]
                w, v = np.nonzero(last > first)
                first, n = first[w, v], (last - first)[w, v]
                each = np.repeat(np.arange(len(w)), n)
                place = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                windows.append(w[each] + at)
                items.append(self.order[block][place])
        pairs = np.unique(np.concatenate(windows) * len(self.item) + np.concatenate(items))
        w, k = pairs // max(len(self.item), 1), pairs % max(len(self.item), 1)
        near = np.bitwise_count(prints[w] ^ self.prints[k]).sum(axis=1) <= self.at.radius
        return w[near], k[near]

    def _starts(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For each item length, ranges of starts of windows that share a shingle with an item of that length."""
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.uint64, len(words))
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size in self.sizes:
            n = len(words) - size + 1
            if n <= 0:
                continue
            known = ids[:n] > 0
            for k in range(1, size):
                known &= ids[k : n + k] > 0
            at = np.flatnonzero(known)
            if not len(at):
                continue
            codes = self._codes([ids[at + k] for k in range(size)])
            wanted = self.codes[size]
            for p in at[wanted[np.searchsorted(wanted[:-1], codes)] == codes].tolist():
                for length in self.leads.get(tuple(words[p : p + size]), ()):
                    if min(self.at.shingle, length) == size:
                        wide = min(length, len(words))
                        found[length].append((max(0, p - wide + size), min(p, len(words) - wide)))
        return found

    def search(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of each item's best window of at least the wanted similarity, by item."""
        words, best = tokens(text), {}
        for length, ranges in self._starts(words).items():
            size, wide = min(self.at.shingle, length), min(length, len(words))
            if wide < size:
                continue
            ranges.sort()
            merged = [list(ranges[0])]
            for a, b in ranges[1:]:
                if a <= merged[-1][1] + 1 and b - merged[-1][0] < 4096:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([max(a, merged[-1][1] + 1), b])
            for a, b in merged:
                if a <= b:
                    self._windows(words, a, b, size, wide, length, best)
        return [(self.item[k], s, n, r) for k, (r, s, n) in sorted(best.items(), key=lambda x: self.item[x[0]])]

    def _windows(self, words, a, b, size, wide, length, best) -> None:
        bag = _shingles(words[a : b + wide], size)
        sums = np.concatenate([np.zeros((1, _BITS)), np.cumsum(self._signs(bag), axis=0)])
        per = wide - size + 1
        prints = np.packbits(sums[per:] - sums[:-per] > 1e-9, axis=1, bitorder="little").view(np.uint16)
        starts, items = self.within(prints)
        fits = self.length[items] == length
        for s, k in zip(starts[fits].tolist(), items[fits].tolist(), strict=True):
            window = Counter(bag[s : s + per])
            both = sum(self.weight[x] * min(n, window[x]) for x, n in self.counts[k].items() if x in window)
            mass = sum(self.weight.get(x, self.rare) * n for x, n in window.items())
            r = both / (self.mass[k] + mass - both)
            if r >= self.at.similarity - 1e-12 and (k not in best or r > best[k][0]):
                best[k] = (r, a + s, wide)


def _search(index: Index):
    @F.pandas_udf(_HITS)
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([[dict(zip(("item", "start", "words", "similarity"), h, strict=True)) for h in index.search(x)] for x in some], dtype=object)

    return hits


def _blocks(benchmark: DataFrame, at: Settings) -> tuple[int, Iterator[Index]]:
    """The number of blocks of the benchmark, and their indexes, one at a time; shingles are counted over all items, in Spark."""

    @F.pandas_udf("array<string>")
    def shingles(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([[" ".join(s) for s in dict.fromkeys(_shingles(w, min(at.shingle, len(w))))] if w else [] for w in map(tokens, some)], dtype=object)

    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").alias("words")).where("item IS NOT NULL AND words IS NOT NULL").dropDuplicates()
    items = cut(items.withColumn("s", shingles("words")))
    total, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    blocks = max(1, -(-total // at.items), -(-chars // at.chars))
    long = items.select(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).alias("block"), F.explode("s").alias("s"))
    counted = cut(long.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.collect_set("block").alias("blocks")))

    def indexes() -> Iterator[Index]:
        for k in range(blocks):
            rows = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).select("item", "words").collect()
            shares = {tuple(r["s"].split(" ")): r["n"] for r in counted.where(F.array_contains("blocks", k)).select("s", "n").collect()}
            yield Index(sorted((r["item"], r["words"]) for r in rows), total, at, shares)

    return blocks, indexes()


def _key(text: Column) -> Column:
    """Stands for a text: those with equal keys are taken to be equal."""
    return F.struct(F.xxhash64(text), F.hash(text), F.length(text))


def _found(docs: DataFrame, text_col: str, indexes: Iterator[Index]) -> DataFrame:
    """(key, hits) of the texts that have any, one job and one written table for each block, so no task holds two of them."""
    text, tables = F.col(text_col), []
    for index in indexes:
        rows = docs.select(_key(text).alias("key"), _search(index)(text).alias("hits")).where(F.size("hits") > 0)
        tables.append(cut(rows.dropDuplicates(["key"])))
    return reduce(DataFrame.union, tables).groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", at: Settings = Settings()) -> DataFrame:
    """One row per row of docs: id, contaminated, n_items, items (ids, comma-joined), similarity (best, 0 if none), windows ("item:start:words,...").

    A benchmark of up to at.items items goes to the tasks as it is, and documents are not shuffled; a larger one is worked off
    block after block, with the same results, and the hits, which few texts have, are joined by the texts' hashes. Words are
    runs of letters, digits and _, in lower case; items of under five words have one shingle, of all their words; documents
    shorter than an item are one window; long ones are searched whole. Null and empty texts and items match nothing; items
    with a null id are left out, repeated ones count once; repeated rows give repeated rows; an empty table gives an empty
    one. Other columns are not read, so their names may clash.
    """
    blocks, indexes = _blocks(benchmark, at)
    if blocks == 1:
        found = docs.select(F.col(id_col), _search(next(indexes))(F.col(text_col)).alias("hits"))
    else:
        found = docs.select(F.col(id_col), _key(F.col(text_col)).alias("key")).join(_found(docs, text_col, indexes), "key", "left")
    found = found.select(F.col(id_col), F.array_sort(F.coalesce("hits", F.array().cast(_HITS))).alias("hits"))
    window = lambda h: F.concat_ws(":", h["item"], h["start"], h["words"])
    return found.select(
        id_col,
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.array_join(F.transform("hits", lambda h: h["item"].cast("string")), ",").alias("items"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["similarity"])), F.lit(0.0)).alias("similarity"),
        F.array_join(F.transform("hits", window), ",").alias("windows"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", at: Settings = Settings()) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    blocks, indexes = _blocks(benchmark, at)
    if blocks == 1:
        return docs.where(F.size(_search(next(indexes))(F.col(text_col))) == 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(F.col(text_col)).alias("key"))
    rows = rows.join(_found(docs, text_col, indexes).select("key"), "key", "left_anti")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
