"""Quality classifier: a factorisation machine on hashed words, structure statistics and size.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairs cost linear time, because
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import held_out, read
from tallyspark.llm.training import labelled_sample

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>=~^_{}[]\\@+"
_DIGITS = bytes(range(48, 58))
_PAUSES = b"!?"
_BINS = 16
_STATS = 12
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """What the model is fitted with.

    The sample is bounded: at most good + bad labelled rows, of at most most_chars characters each (longer texts are left out
    of training, never of scoring).
    """

    words: int = 1 << 13
    rank: int = 8
    good: int = 3000
    bad: int = 3000
    most_chars: int = 100_000
    epochs: int = 12
    rate: float = 0.05
    l2: float = 1e-4
    seed: int = 9


def features(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values: hashed lower-case words, scaled to length 1, then one bin for each of the statistics."""
    data = (text or "").encode("utf-8", "surrogatepass")
    count = Counter(data.lower().split())
    n, size = sum(count.values()), len(data)
    without = lambda kind: size - len(data.translate(None, kind))
    upper, lower = without(_UPPER), without(_LOWER)
    lines = [x for x in data.split(b"\n") if x.strip()]
    top = max(count.values(), default=0)
    share = lambda a, b: min(_BINS - 1, int(_BINS * math.sqrt(a / b))) if b else 0
    stats = [
        min(_BINS - 1, int(math.log2(n + 1))),
        min(_BINS - 1, int(math.log2(size + 1))),
        share(upper, upper + lower),
        share(without(_SYMBOLS), size),
        share(without(_DIGITS), size),
        share(without(_PAUSES), size),
        share(len(count), n),
        share(top, n),
        min(_BINS - 1, int(size / n)) if n else 0,
        min(_BINS - 1, int(math.log2(n / len(lines) + 1))) if lines else 0,
        share(len(lines) - len(set(lines)), len(lines)),
        share(without(b".,;:"), size),
    ]
    index = np.fromiter((zlib.crc32(w) % words for w in count), np.int64, len(count))
    value = np.sqrt(np.fromiter(count.values(), np.float64, len(count)))
    if n:
        value /= np.sqrt((value**2).sum())
    return np.concatenate([index, words + np.arange(_STATS) * _BINS + np.array(stats)]), np.concatenate([value, np.full(_STATS, 0.5)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        index, value, starts = _flat(rows)
        return self._sums(index, value, starts)[0]

    def _sums(self, index, value, starts):
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs, sums

    def score(self, rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def _flat(rows):
    sizes = np.array([len(i) for i, _ in rows])
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, at: Settings = Settings()) -> Machine:
    """Logistic loss, Adagrad, minibatches; both classes weigh as they come. No rows: a machine that scores 0.5."""
    rng = np.random.default_rng(at.seed)
    width = at.words + _STATS * _BINS
    m = Machine(0.0, np.zeros(width), rng.normal(0, 0.01, (width, at.rank)))
    seen_w, seen_v, seen_b = np.full(width, 1e-6), np.full((width, at.rank), 1e-6), 1e-6
    for _ in range(at.epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            index, value, starts = _flat([rows[i] for i in some])
            raw, sums = m._sums(index, value, starts)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
            each = np.repeat(g, np.diff(np.append(starts, len(index))))
            of = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(index))))
            used, place = np.unique(index, return_inverse=True)
            gw = np.bincount(place, each * value) + at.l2 * m.linear[used]
            dv = (each * value)[:, None] * (sums[of] - m.factors[index] * value[:, None])
            gv = np.stack([np.bincount(place, dv[:, f]) for f in range(at.rank)], axis=1) + at.l2 * m.factors[used]
            seen_b += g.sum() ** 2
            m.bias -= at.rate * g.sum() / math.sqrt(seen_b)
            seen_w[used] += gw**2
            m.linear[used] -= at.rate * gw / np.sqrt(seen_w[used])
            seen_v[used] += gv**2
            m.factors[used] -= at.rate * gv / np.sqrt(seen_v[used])
    return m


def train(docs: DataFrame, labels: DataFrame, at: Settings = Settings()) -> Machine:
    """Features are made on the executors; the driver gets those of the bounded sample."""
    sample = labelled_sample(docs, labels, "quality", {1: at.good, 0: at.bad}, at.most_chars)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(x, at.words) for x in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "label": batch["label"], "index": [i.astype(np.int32) for i, _ in found], "value": [v.astype(np.float32) for _, v in found]})

    rows = sorted(sample.mapInPandas(extract, "key long, label int, index array<int>, value array<float>").collect(), key=lambda r: r["key"])
    data = [(np.array(r["index"], np.int64), np.array(r["value"], np.float64)) for r in rows]
    return fit(data, np.array([r["label"] for r in rows], float), at)


def score_of(text: Column, machine: Machine, words: int = Settings.words) -> Column:
    """The score of a text; null and empty texts are scored by their statistics alone."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            out = [machine.score([features(x, words) for x in some.iloc[k : k + 256]]) for k in range(0, len(some), 256)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(text)


def classify(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = Settings.words) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Null and empty texts are scored by their statistics; long texts are read whole; null ids are not held out; repeated rows
    get equal scores; an empty table gives an empty one. Other columns are not read, so their names may clash.
    """
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_of(F.col(text_col), machine, words).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns."""
    return docs.where(score_of(F.col(text_col), machine) >= threshold)


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, train(docs, read(spark, sf_dir, "labels")))
