"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint of its three-word shingles. Documents whose fingerprints differ in at most three
bits are linked. For radius r, 2^(r+1) - 1 bit masks are built so that any two fingerprints within r bits agree on all bits
of some mask: bit i gets a vector m(i) of r + 1 bits, and mask v, a non-zero vector, holds the bits with <m(i), v> odd. At
most r differing bits give at most r vectors, so some v is orthogonal to all of them, and its mask holds none of these bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallyspark.llm.common import cut, read, written
from tallyspark.llm.components import components
from tallyspark.llm.similarity import linked

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Distinct fingerprints that one task compares with one another at most, about; larger buckets are dealt out as pairs of blocks.
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash as a signed number: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = (starts[: 1 - shingle or None], ends[shingle - 1 :]) if len(words) >= shingle else (starts[:1], ends[-1:])
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(first), 1 << 16):
        some = zip(first[k : k + (1 << 16)].tolist(), last[k : k + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in some], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(first), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield pd.Series([fingerprint(x) for x in some], dtype="int64")


def masks(radius: int) -> list[int]:
    """The covering masks, as signed 64-bit numbers; the bits are dealt evenly to the non-zero vectors."""
    vectors = np.resize(np.arange(1, 2 ** (radius + 1)), 64)
    np.random.default_rng(0).shuffle(vectors)
    return [int(np.packbits([bin(m & v).count("1") & 1 for m in vectors], bitorder="little").view(np.int64)[0]) for v in range(1, 2 ** (radius + 1))]


def _spanning(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints of one bucket: indexes (member, its component's first), firsts left out."""
    rest, members, firsts = np.arange(len(prints)), [], []
    while len(rest):
        first, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(prints[rest] ^ prints[queue.pop()]) <= radius
            found, rest = rest[near], rest[~near]
            queue.extend(found)
            members.append(found)
            firsts.append(np.full(len(found), first))
    return (np.concatenate(members), np.concatenate(firsts)) if members else (rest, rest)


def _bucket_links(radius: int):
    """Reads rows sorted by bucket and yields links (u, v) that connect what the bucket's true pairs connect."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            data = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = data[["mask", "bits", "one", "two"]].to_numpy()
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            last = int(edge[-1]) if len(edge) else 0
            held = data.iloc[last:]
            if last:
                yield from solve(data.iloc[:last], edge)
        if held is not None and len(held):
            yield from solve(held, np.array([len(held)]))

    def solve(data: pd.DataFrame, edge: np.ndarray) -> Iterator[pd.DataFrame]:
        prints, ids = data["print"].to_numpy(np.int64).view(np.uint64), data["print"].to_numpy()  # bits of negative numbers are not counted as they are stored
        starts = np.concatenate([[0], edge[edge < len(data)]])
        sizes = np.diff(np.concatenate([starts, [len(data)]]))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= 8, sizes)
        for d in range(1, 8):
            at = np.flatnonzero((group[d:] == group[:-d]) & small[d:]) if len(data) > d else np.array([], int)
            at = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= radius]
            if len(at):
                yield pd.DataFrame({"u": ids[at + d], "v": ids[at]})
        for k in np.flatnonzero(sizes > 8):
            a, b = starts[k], starts[k] + sizes[k]
            _, once = np.unique(prints[a:b], return_index=True)
            u, v = _spanning(prints[a:b][once], radius)
            if len(u):
                yield pd.DataFrame({"u": ids[a:b][once][u], "v": ids[a:b][once][v]})

    return links


def hamming_components(prints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(id, print) -> (print, component_id): the least id among all rows whose fingerprints are linked, directly or through others.

    Equal fingerprints are one class, found by aggregation. Classes meet in the buckets of the covering masks. A bucket with
    over `block` classes is cut into blocks and every pair of blocks goes to a task of its own, so no task holds a whole hot
    bucket and no pair is left out; a task emits links that span each component, not all pairs.
    """
    classes = cut(prints.groupBy("print").agg(F.min("id").alias("rep")))
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("print").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks(radius))]))
    rows = classes.select("print", tables.alias("b")).select("b.mask", "b.bits", "print")
    sizes = rows.groupBy("mask", "bits").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    rows = rows.join(sizes.drop("count"), ["mask", "bits"])
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)))))
    rows = rows.select("mask", "bits", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "print")
    dealt = rows.repartition("mask", "bits", "one", "two").sortWithinPartitions("mask", "bits", "one", "two", "print")
    linked = components(dealt.mapInPandas(_bucket_links(radius), "u long, v long"))  # components of fingerprints, so classes without an id link too
    named = classes.join(linked, classes["print"] == linked["node"], "left").select("print", "rep", F.coalesce("component", "print").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(least, "component").select("print", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the least id reachable, its own included).

    Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows give repeated rows. A row
    without an id links others like any row and gets its component, but lends it no id; a component of such rows only is null. An
    empty table gives an empty one; very long texts are read whole. Other
    columns of docs are neither read nor returned.
    """
    prints = cut(docs.select(F.col(id_col).cast("long").alias("id"), _fingerprints(F.col(text_col)).alias("print")))
    found = prints.join(hamming_components(prints, radius), "print", "left")
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def _text_groups(docs: DataFrame, prints: DataFrame, groups: DataFrame, text_col: str, threshold: float) -> DataFrame:
    """(h, component_id) over the links of the fingerprints and those of all pairs of texts that are similar enough."""
    texts = prints.join(groups, "print").select("h", "component_id").distinct()
    hubs = texts.groupBy("component_id").agg(F.min("h").alias("v"))
    known = written(texts.join(hubs, "component_id").where("h <> v").select(F.col("h").alias("u"), "v"), "known")  # Spark cannot unite a checkpoint of renamed columns
    found = linked(docs.select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text")), known, threshold)
    return prints.select("h").distinct().join(found, F.col("h") == F.col("node"), "left").select("h", F.coalesce("component", "h").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each group of near-duplicates, that with the least id, with all its columns, whatever their names.

    With `similarity`, texts whose sets of five-word shingles are at least that similar are linked too, every such pair: a
    radius of few bits misses most edited copies, and one that covers them needs buckets of a large share of all rows.

    Of rows with equal ids the one with the least fingerprint and then the least hash of its text counts, in a group and
    among the groups' first rows, so an id stays once at most. Rows without an id are members like others, and link others; one of them stays only where no row of the group has an id. Null
    and empty texts are one group. An empty table gives an empty one.

    Groups and their firsts are found on ids, fingerprints and hashes alone. The documents then meet the keys of the rows
    that go, which AQE broadcasts if they are few, and are shuffled once if not; only keys that repeat are dealt with apart.
    """
    key = lambda t: [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k"), F.col(id_col).isNull().alias("bare"), F.xxhash64(t).alias("h")]
    prints = cut(docs.select(*key(F.col(text_col)), _fingerprints(F.col(text_col)).alias("print")).groupBy("k", "bare", "h", "print").agg(F.count(F.lit(1)).alias("times")))
    groups = hamming_components(prints.select(F.col("print").alias("id"), "print"), radius)
    if similarity:
        groups, member = _text_groups(docs, prints, groups, text_col, similarity), "h"
    else:
        member = "print"
    least = F.min(F.struct("bare", "k", "print", "h", "times")).alias("first")
    firsts = prints.groupBy(member).agg(least).join(groups, member).groupBy("component_id").agg(F.min("first").alias("first")).select("first.*")
    named = firsts.where("NOT bare").groupBy("k").agg(F.min(F.struct("print", "h", "times")).alias("f")).select("k", F.lit(False).alias("bare"), "f.h", "f.times")
    stay = cut(named.union(firsts.where("bare").select("k", "bare", "h", "times")))
    keys = ["k", "bare", "h"]
    gone = prints.select(keys).distinct().join(stay, keys, "left_anti")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key(F.col(text_col))).join(gone, keys, "left_anti")
    again = stay.where("times > 1").select(keys)
    if not again.isEmpty():
        rows = rows.join(again, keys, "left_anti").union(rows.join(again, keys, "left_semi").dropDuplicates(keys))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
