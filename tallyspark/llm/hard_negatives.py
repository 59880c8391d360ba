"""Hard negatives by zone maps over Hilbert-ordered blocks.

Vectors are sorted by label and by their place on a Hilbert curve through the components that vary most, cut into blocks of one
label each, and written as Parquet. A zone map holds each block's least and greatest value of every component. For an anchor a
and a block, interval arithmetic bounds all inner products with the block's rows:

    sum_d min(a_d lo_d, a_d hi_d)  <=  <a, v>  <=  sum_d max(a_d lo_d, a_d hi_d)

An anchor reads a block of its own label only if the upper bound reaches a score that enough rows are known to reach, by their bounds
or in the anchor's own block, and a block of another label only if the bounds meet one of its windows of scores. Anchors that lie near each other share what they read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, read, written

#: Rows of a block, blocks of a group that one task reads, anchors that are compared at a time, groups whose zone maps one task reads.
BLOCK, GROUP, TOGETHER, ZONES = 64, 64, 1024, 64
#: Components and bits for each of the Hilbert curve; together they fit a long.
AXES, BITS = 15, 4


@dataclass(frozen=True)
class Settings:
    """How many positives and negatives, and the negative's share of the positive's score, in hundredths."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells, whose columns are numbers of `bits` bits: the bits are turned and reflected
    axis by axis from the highest level to the lowest, Gray-coded and interleaved."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        one, below = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            turned = (x[i] & one) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    fold = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        fold ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= fold
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(len(x)):
            place = place << 1 | (x[i] >> level) & 1
    return place


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled with zeros."""
    width = max(map(len, vectors), default=0)
    return np.array([np.pad(v, (0, width - len(v))) for v in vectors], np.int64).reshape(len(vectors), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, of whole numbers: by floating point where that is exact, else in 64-bit numbers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each anchor can have with each block's rows."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def _edges(scores: pd.Series, w: int, window: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the positive of place w: whether each anchor has one, and the ends of its window of scores, as columns."""
    has = np.array([len(x) > w for x in scores], bool)[:, None]
    of = np.array([x[w] if len(x) > w else 0 for x in scores], np.int64)[:, None]
    return has, -(-of * window.low // 100), of * window.high // 100


def _ordered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows with gid (their order), z (their group) and block, written as Parquet; the number of groups and of partitions."""
    spread = rows.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("d").collect()  # a row for each component
    count = rows.count()
    dims = sorted(range(len(spread)), key=lambda d: (-spread[d].s, d))[:AXES]
    mean, unit = np.array([spread[d].m for d in dims]), np.array([max(spread[d].s, 1e-9) for d in dims])

    @F.pandas_udf("long")
    def place(vectors: pd.Series) -> pd.Series:
        if not dims:
            return pd.Series(np.zeros(len(vectors), np.int64))
        x = _matrix(vectors)
        x = np.pad(x, ((0, 0), (0, max(0, dims[0] + 1, max(dims) + 1 - x.shape[1]))))[:, dims]
        return pd.Series(hilbert(np.clip(((x - mean) / unit / 3 + 1) * 2 ** (BITS - 1), 0, 2**BITS - 1), BITS))

    size = BLOCK * GROUP
    parts = max(1, min(-(-count // size), 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = rows.withColumn("place", place("vector")).repartitionByRange(parts, "label", "place", F.xxhash64("id", "vector")).sortWithinPartitions("label", "place", "id")
    stored = written(placed.withColumn("gid", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("gid", 33)).drop("place"), "blocks")
    within = F.col("gid").bitwiseAND((1 << 33) - 1)
    most = stored.agg(F.max(within), F.max("pid")).first()
    each, parts = (most[0] or 0) // size + 1, (most[1] or 0) + 1
    stored = stored.withColumn("z", F.col("pid") * each + F.floor(within / size)).withColumn("block", F.col("pid") * each * GROUP + F.floor(within / BLOCK))
    return stored, each * parts, parts


def _zones(stored: DataFrame) -> DataFrame:
    """One row for each block and label: rows, least and greatest of every component."""

    def zones(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (z, block, label), some in rows.groupby(["z", "block", "label"]):
            x = _matrix(some["vector"])
            found.append((z, block, label, len(x), x.min(axis=0), x.max(axis=0)))
        return pd.DataFrame(found, columns=["z", "block", "label", "n", "lo", "hi"])

    return stored.select("z", "block", "label", "vector").groupBy("z").applyInPandas(zones, "z long, block long, label long, n long, lo array<long>, hi array<long>")


def _seeds(window: Settings):
    """Anchors with `seed`, the score of the last positive wanted within their own block, the least number there is where it has too few rows."""

    def seeds(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, some in rows.groupby(["block", "label"]):
            asks = some["anchor"].to_numpy()
            if asks.any():
                x = _matrix(some["vector"])
                scores = products(x[asks], x)
                scores[np.arange(asks.sum()), np.flatnonzero(asks)] = np.iinfo(np.int64).min
                k = window.positives
                last = np.partition(scores, -k, axis=1)[:, -k] if k <= len(some) else np.full(len(scores), np.iinfo(np.int64).min)
                found.append(some.loc[asks, ["pid", "label", "gid", "id", "vector"]].assign(seed=last))
        return pd.concat(found) if found else pd.DataFrame(columns=["pid", "label", "gid", "id", "vector", "seed"])

    return seeds


def _reads(anchors: DataFrame, zones: DataFrame, groups: int, chunks: int, window: Settings, own: bool) -> DataFrame:
    """(chunk, z, block, label) that some anchor of the chunk must read: of its own label for positives, of others for negatives."""
    span = -(-groups // ZONES)
    left = anchors.withColumn("zz", F.explode(F.sequence(F.lit(0), F.lit(span - 1))))
    right = zones.withColumn("zz", F.floor(F.col("z") / ZONES).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def choose(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        lo, hi, n, label = _matrix(b["lo"]), _matrix(b["hi"]), b["n"].to_numpy(), b["label"].to_numpy()
        need = np.zeros(len(b), bool)
        for k in range(0, len(a) if len(b) else 0, TOGETHER):
            some = a.iloc[k : k + TOGETHER]
            low, up = bounds(_matrix(some["vector"]), lo, hi)
            same = some["label"].to_numpy()[:, None] == label[None, :]
            floor = np.iinfo(np.int64).min
            if own:  # a block of the label with enough rows besides the anchor gives a score that the last positive reaches
                sure = np.maximum(np.where(same & (n > window.positives)[None, :], low, floor).max(axis=1, initial=floor), some["seed"].to_numpy())
                need |= (same & (up >= sure[:, None])).any(axis=0)
                continue
            for w in range(window.positives):
                has, least, most = _edges(some["scores"], w, window)
                inside = ~same & (n >= window.negatives)[None, :] & (low >= least) & (up <= most)
                sure = np.maximum(np.where(inside, low, floor).max(axis=1, initial=floor)[:, None], least)
                need |= (~same & has & (up >= sure) & (low <= most)).any(axis=0)
        return b.loc[need, ["chunk", "z", "block", "label"]]

    return left.groupBy("chunk", "zz").cogroup(right.groupBy("chunk", "zz")).applyInPandas(choose, "chunk int, z long, block long, label long")


def _read(anchors: DataFrame, stored: DataFrame, reads: DataFrame, compare, schema: str) -> DataFrame:
    """compare() for each chunk of anchors and each group of blocks that it reads."""
    reads = cut(reads)
    rows = stored.select("block", "label", "gid", "id", "vector").join(reads, ["block", "label"])
    asked = anchors.join(reads.select("chunk", "z").distinct(), "chunk")
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own, as both sides come from the same tables
    return asked.groupBy("chunk", "z").cogroup(rows.groupBy("chunk", "z")).applyInPandas(compare, schema)


def _first(groups: list[np.ndarray], scores: np.ndarray, ids: pd.Series, gids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k first of each group: higher scores, then smaller ids, none last, then the order of rows."""
    bare = ids.isna().to_numpy()
    order = np.lexsort([gids, ids.fillna(0).to_numpy(np.int64), bare, -scores, *groups[::-1]])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)
    starts = np.flatnonzero(new)
    return order[np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) < k]


def _positives(window: Settings):
    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, vectors, label, gid = [], _matrix(b["vector"]), b["label"].to_numpy(), b["gid"].to_numpy()
        for k in range(0, len(a) if len(b) else 0, TOGETHER):
            some = a.iloc[k : k + TOGETHER].reset_index(drop=True)
            scores = products(_matrix(some["vector"]), vectors)
            i, j = np.nonzero((some["label"].to_numpy()[:, None] == label[None, :]) & (some["gid"].to_numpy()[:, None] != gid[None, :]))
            keep = _first([i], scores[i, j], b["id"].iloc[j], gid[j], window.positives)
            i, j = i[keep], j[keep]
            out.append(pd.DataFrame({"anchor": some["gid"].to_numpy()[i], "gid": gid[j], "id": b["id"].to_numpy()[j], "score": scores[i, j]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["anchor", "gid", "id", "score"])

    return compare


def _negatives(window: Settings):
    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, vectors, label, gid = [], _matrix(b["vector"]), b["label"].to_numpy(), b["gid"].to_numpy()
        for k in range(0, len(a) if len(b) else 0, TOGETHER):
            some = a.iloc[k : k + TOGETHER].reset_index(drop=True)
            scores = products(_matrix(some["vector"]), vectors)
            other = some["label"].to_numpy()[:, None] != label[None, :]
            for w in range(window.positives):
                has, least, most = _edges(some["scores"], w, window)
                fit = np.where(other & has & (scores >= least) & (scores <= most), scores, np.iinfo(np.int64).min)
                if fit.shape[1] > window.negatives:  # what lies under the last one wanted can't be among the first
                    last = np.partition(fit, -window.negatives, axis=1)[:, [-window.negatives]]
                    i, j = np.nonzero((fit > np.iinfo(np.int64).min) & (fit >= last))
                else:
                    i, j = np.nonzero(fit > np.iinfo(np.int64).min)
                keep = _first([i], scores[i, j], b["id"].iloc[j], gid[j], window.negatives)
                i, j = i[keep], j[keep]
                out.append(pd.DataFrame({"anchor": some["gid"].to_numpy()[i], "w": np.full(len(i), w), "gid": gid[j], "id": b["id"].to_numpy()[j], "score": scores[i, j]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["anchor", "w", "gid", "id", "score"])

    return compare


def whole(vector: Column) -> Column:
    """Components as floor(256 x), taken as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", window: Settings | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` holds.

    A row takes no part if its label, its vector or a component is null, or a component is not finite. Positives are the first rows
    of an anchor's label other than itself, negatives the first rows of other labels whose score lies in the window; higher scores
    are first, ties go by smaller id, rows without an id last. Repeated rows count as rows, so each is another's positive, and an
    anchor that stands twice is answered twice. Vectors may differ in length: missing components are zero; a vector without any
    scores 0. Scores are 64-bit numbers and wrap beyond. A positive without a negative gives no row; an empty table gives an empty
    one. Other columns are not read, so their names may clash.

    No partners are capped: every block that the bounds can't rule out is read whole. Rows of a task are bounded by BLOCK, GROUP and
    the anchors of a chunk; a hot label is many blocks.
    """
    window = window or Settings()
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    given = given.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine)).withColumn("vector", whole(F.col("vector")))
    stored, groups, parts = _ordered(given)
    zones = written(_zones(stored), "zones")
    asking = stored.groupBy("z").applyInPandas(_seeds(window), "pid long, label long, gid long, id long, vector array<long>, seed long")
    merged = max(1, parts * TOGETHER // max(1, stored.where("anchor").count()))  # partitions whose anchors make a chunk
    chunks = -(-parts // merged)
    asking = cut(asking.select(F.floor(F.col("pid") / merged).cast("int").alias("chunk"), "label", "gid", "id", "vector", "seed"))

    found = _read(asking, stored, _reads(asking, zones, groups, chunks, window, own=True), _positives(window), "anchor long, gid long, id long, score long")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "gid"))
    positives = cut(found.withColumn("w", first("anchor") - 1).where(F.col("w") < window.positives))
    scores = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "score"))), lambda x: x["score"]).alias("scores"))
    asking = cut(asking.join(scores.withColumnRenamed("anchor", "gid"), "gid"))
    found = _read(asking, stored, _reads(asking, zones, groups, chunks, window, own=False), _negatives(window), "anchor long, w int, gid long, id long, score long")
    ranked = found.withColumn("rank", first("anchor", "w")).where(F.col("rank") <= window.negatives)
    negatives = ranked.select("anchor", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(asking.select(F.col("gid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    pairs = named.select("anchor", "w", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(negatives, ["anchor", "w"])
    return pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; labels of ids divisible by 7 move on by one before."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)
