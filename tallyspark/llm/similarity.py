"""Exact similarity links between texts: pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A prefix filter finds candidates. With one order over all shingles, two sets of similarity t share their first common shingle
among the first n - ceil(t n) + 1 of each, so texts meet on these alone. Any order gives the same links; common shingles come
last, so that passages which many texts share are seldom keys. Each text is compared with the least text of each of its keys
first. What these links connect needs no further comparison; only pairs of a key that they leave apart are compared after that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tallyspark.llm.common import cut, written
from tallyspark.llm.components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles that a partition names as common, and those that the order knows in all. Both bound memory; links do not depend on them.
LOCAL, COMMON = 20_000, 200_000
#: Texts of one key that meet in one task, about; larger keys are dealt out.
BLOCK = 2048


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the text's runs of `size` words, ascending; fewer words are one run, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, 42) for x in words), np.uint64, len(words))
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(runs)]
    return np.unique(runs.view(np.int64))


def _tallies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's most common shingles; single ones are dropped whenever too many are held."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for part in range(0, len(batch), 500):
            found = [keys, *(shingles(x) for x in batch["text"].iloc[part : part + 500])]
            weight = np.concatenate([counts, np.ones(sum(map(len, found[1:])), np.int64)])
            keys, inverse = np.unique(np.concatenate(found), return_inverse=True)
            counts = np.bincount(inverse, weight, len(keys)).astype(np.int64)
            if len(keys) > 1 << 20:
                keys, counts = keys[counts > 1], counts[counts > 1]
                if len(keys) > 1 << 19:
                    top = np.sort(np.argpartition(-counts, 1 << 19)[: 1 << 19])
                    keys, counts = keys[top], counts[top]
    top = np.argsort(-counts, kind="stable")[:LOCAL]
    top = top[counts[top] > 1]
    yield pd.DataFrame({"key": keys[top], "times": counts[top]})


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, ascending, and how common each is."""
    tallied = texts.mapInPandas(_tallies, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    top = tallied.orderBy(F.desc("times"), "key").limit(COMMON).toPandas().sort_values("key")
    return top["key"].to_numpy(np.int64), top["times"].to_numpy(np.int64)


def _prefixes(common, threshold: float):
    """Yields (key, h, n, pos) for each shingle of each text's prefix; copies within a partition are read once."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, times = common.value
        seen = set()
        for batch in batches:
            rows, held = [], 0
            for h, text in zip(batch["h"].tolist(), batch["text"], strict=True):
                if h in seen:
                    continue
                seen.add(h)
                found = shingles(text)
                if not len(found):
                    continue
                weight = np.zeros(len(found), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, found), len(names) - 1)
                    weight = np.where(names[at] == found, times[at], 0)
                prefix = found[np.lexsort((found, weight))][: len(found) - math.ceil(threshold * len(found) - 1e-9) + 1]
                rows.append((prefix, h, len(found)))
                held += len(prefix)
                if held > 1 << 18:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        sizes = [len(p) for p, _, _ in rows]
        each = lambda i: np.repeat(np.array([r[i] for r in rows], np.int64), sizes)
        return pd.DataFrame({"key": np.concatenate([p for p, _, _ in rows]), "h": each(1), "n": each(2), "pos": np.concatenate([np.arange(s) for s in sizes])})

    return keys


@F.pandas_udf(ArrayType(LongType()))
def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield pd.Series([shingles(x) for x in some], index=some.index, dtype=object)


def _possible(n, pos, n2, pos2, threshold: float):
    """Whether two texts whose first common shingle stands at these places can be similar enough."""
    return F.least(n - pos, n2 - pos2) * (1 + threshold) >= threshold * (n + n2) - 1e-6


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (u, v) of text hashes that are similar enough, by their whole sets."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct()
    sets = written(texts.join(ends, "h", "left_semi").dropDuplicates(["h"]).select("h", _sets("text").alias("s")), "sets")
    both = pairs.join(sets.select(F.col("h").alias("u"), F.col("s").alias("s1")), "u").join(sets.select(F.col("h").alias("v"), F.col("s").alias("s2")), "v")
    alike = F.size(F.array_intersect("s1", "s2")) * (1 + threshold) >= threshold * (F.size("s1") + F.size("s2")) - 1e-6
    return written(both.where(alike).select("u", "v"), "similar")


def linked(texts: DataFrame, known: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(h, text) rows and known links (u, v) of hashes -> (node, component) over the known links and all similar pairs.

    h is a 64-bit hash of the text: rows with equal h are one text. Texts without words have no shingles and get no links.
    Texts in no link are left out. Empty tables give an empty one. Very long texts are read whole.
    """
    common = texts.sparkSession.sparkContext.broadcast(_common(texts))
    found = texts.mapInPandas(_prefixes(common, threshold), "key long, h long, n int, pos int")
    key, order = Window.partitionBy("key"), Window.partitionBy("key").orderBy("h")
    found = found.select("*", F.first(F.struct("h", "n", "pos")).over(order).alias("first"), F.lag("h").over(order).alias("before"), F.max("h").over(key).alias("last"))
    found = found.where("first.h <> last AND (before IS NULL OR before <> h)")
    near = _possible(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos"), threshold)
    shared = written(found.select("key", "h", "n", "pos", F.when(near & (F.col("h") > F.col("first.h")), F.col("first.h")).alias("first")), "shared")  # in order of keys and texts, which Parquet stores in a few bytes
    tried = cut(shared.where("first IS NOT NULL").select(F.col("h").alias("u"), F.col("first").alias("v")).distinct())
    links = known.union(_verified(tried, texts, threshold))
    groups = components(links)

    rows = shared.join(groups, F.col("h") == F.col("node"), "left").select("key", "h", "n", "pos", F.coalesce("component", "h").alias("c"))
    apart = rows.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b")
    rows = rows.join(apart.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    left = rows.select("key", F.col("h").alias("u"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("c").alias("c1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    met = left.join(rows.drop("blocks"), ["key", "own"]).where("c1 <> c AND u > h")
    met = met.where(_possible(F.col("n1"), F.col("p1"), F.col("n"), F.col("pos"), threshold)).select("u", F.col("h").alias("v")).distinct()
    more = _verified(cut(met.join(tried, ["u", "v"], "left_anti")), texts, threshold)
    return groups if more.isEmpty() else components(links.union(more))
