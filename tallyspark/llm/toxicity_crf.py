"""Toxicity: a linear-chain conditional random field tags toxic tokens.

Tokens are labelled from the documents' labels: a token of a toxic document is toxic if its word or one of its beginnings is
typical of toxic documents. The field has two states, emissions from the word, its beginnings, its end and its shape, and
transitions; both are fitted together by gradient ascent on the labels' likelihood, whose gradient is the observed less the
expected counts of features and of moves. Forward-backward marginals give the document's score (a logistic curve over their
evidence, in all and by the text's length) and the offsets of tokens with a marginal of at least one half.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import held_out, read
from tallyspark.llm.training import labelled_sample

_TOKEN = re.compile(r"\w+")
_WIDTH = 1 << 16
#: Lengths of the beginnings that are looked at.
_HEADS = (3, 4, 5, 6, 7, 8)
_FEATURES = len(_HEADS) + 3


@dataclass(frozen=True)
class Settings:
    """What the field is fitted with.

    The sample is bounded: at most toxic + clean labelled rows, of at most most_chars characters each (longer texts are left
    out of training, never of scoring). All their tokens are trained on, in segments of `segment` tokens, the last one of a
    document with what is left. A unit is typical from `least` documents, or `least_share` of the toxic ones, if it is
    `odds` times as frequent in toxic ones.
    """

    toxic: int = 2000
    clean: int = 3000
    most_chars: int = 20_000
    least: int = 8
    least_share: float = 0.02
    odds: float = 5.0
    steps: int = 30
    rate: float = 0.3
    l2: float = 1.0
    segment: int = 64


def units(token: str) -> list[str]:
    """A lower-case token's word and beginnings."""
    return ["=" + token] + ["^" + token[:k] for k in _HEADS if len(token) > k]


def token_features(token: str) -> list[int]:
    """The hashed features of a token, _FEATURES of them; 0 stands for none."""
    low = token.lower()
    shape = "A" if token.isupper() else "a" if token.islower() else "1" if token.isdigit() else "x"
    found = [1 + zlib.crc32(u.encode("utf-8", "surrogatepass")) % (_WIDTH - 1) for u in [*units(low), "$" + low[-3:], "~" + shape + str(min(len(low), 12))]]
    return found + [0] * (_FEATURES - len(found))


@dataclass
class Field:
    """weights: of the toxic state's emissions over the clean one's; moves[a, b]: log weight of state b after a; curve: of the score."""

    weights: np.ndarray
    moves: np.ndarray
    curve: np.ndarray

    def emission(self, token: str) -> float:
        return float(self.weights[token_features(token)].sum())

    def _messages(self, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the messages into each token, from before and from behind; the sequences lie end to end, the longest first."""
        ends = np.cumsum(length)
        starts, t = ends - length, np.exp(self.moves)
        ahead, back = np.empty_like(flat), np.empty_like(flat)
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # sequences longer than s
        state = np.zeros(len(length))
        for s in range(length[0]):
            n = active[s]
            at = starts[:n] + s
            if s:
                odds = np.exp(np.clip(state[:n] + flat[at - 1], -40, 40))
                state[:n] = np.log((odds * t[1, 1] + t[0, 1]) / (odds * t[1, 0] + t[0, 0]))
            ahead[at] = state[:n]
        state[:] = 0
        for s in range(length[0]):
            n = active[s]
            at = ends[:n] - 1 - s
            if s:
                odds = np.exp(np.clip(state[:n] + flat[at + 1], -40, 40))
                state[:n] = np.log((odds * t[1, 1] + t[1, 0]) / (odds * t[0, 1] + t[0, 0]))
            back[at] = state[:n]
        return ahead, back

    def expected(self, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each token, and the expected numbers of moves from a to b in all sequences together."""
        ahead, back = self._messages(flat, length)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(length) - length] = False  # a sequence's first token has no move before it
        at = np.flatnonzero(inner)
        left, right = np.exp(np.clip(ahead[at - 1] + flat[at - 1], -40, 40)), np.exp(np.clip(flat[at] + back[at], -40, 40))
        t = np.exp(self.moves)
        each = np.array([[np.full(len(at), t[0, 0]), t[0, 1] * right], [t[1, 0] * left, t[1, 1] * left * right]])
        return _logistic(ahead + flat + back), (each / each.sum(axis=(0, 1))).sum(axis=2)

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of each token of each sequence, by forward-backward over all sequences side by side."""
        order = sorted(range(len(emissions)), key=lambda k: -len(emissions[k]))
        length = np.array([len(emissions[k]) for k in order], np.int64)
        if not len(length) or not length[0]:
            return [np.zeros(0) for _ in emissions]
        flat = np.concatenate([emissions[k] for k in order])
        ahead, back = self._messages(flat, length)
        p, out = _logistic(ahead + flat + back), [np.zeros(0)] * len(emissions)
        for k, end, n in zip(order, np.cumsum(length), length, strict=True):
            out[k] = p[end - n : end]
        return out

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        return _logistic(_summary(marginals) @ self.curve)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _summary(marginals: list[np.ndarray]) -> np.ndarray:
    """One, the evidence in all, and by the text's length. Tokens that are likely clean add nothing, however many there are."""
    rows = []
    for p in marginals:
        sure = np.maximum(p - 0.1, 0).sum()
        rows.append((1.0, np.log1p(sure), np.log1p(100 * sure / (len(p) + 10))))
    return np.array(rows).reshape(-1, 3)


def _typical(tokens: list[set[str]], toxic: np.ndarray, at: Settings) -> set[str]:
    """Units that are typical of toxic documents. Near copies count once: a document is left out if the least hash of its words has been seen."""
    seen, counts, totals = set(), {True: Counter(), False: Counter()}, Counter()
    for words, y in zip(tokens, toxic, strict=True):
        key = min((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), default=0), bool(y)
        if y and key in seen:
            continue
        seen.add(key)
        totals[bool(y)] += 1
        counts[bool(y)].update({u for w in words for u in units(w)})
    n, m = totals[True], totals[False]
    return {u for u, k in counts[True].items() if k >= max(at.least, at.least_share * n) and k / n >= at.odds * (counts[False][u] + 0.25) / max(m, 1)}


def gradient(field: Field, index: np.ndarray, ids: np.ndarray, length: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood, by weights and by moves: observed less expected counts. index: features of each distinct token; ids: the tokens."""
    p, moved = field.expected(field.weights[index].sum(axis=1)[ids], length)
    off = np.bincount(ids, gold - p, len(index))
    by_weight = np.bincount(index.ravel(), np.repeat(off, index.shape[1]), len(field.weights))
    by_weight[0] = 0  # no feature
    states = gold.astype(np.int64)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(length) - length] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(2 * states[at - 1] + states[at], minlength=4).reshape(2, 2)
    return by_weight, seen - moved


def fit(texts: list[str], toxic: np.ndarray, at: Settings = Settings()) -> Field:
    """Fits emissions and moves by gradient ascent on the labelled tokens' likelihood, then the curve on the documents. No rows: a field that scores 0.5."""
    field = Field(np.zeros(_WIDTH), np.zeros((2, 2)), np.zeros(3))
    if not len(texts):
        return field
    tokens = [_TOKEN.findall(x) for x in texts]
    typical = _typical([{w.lower() for w in t} for t in tokens], toxic, at)
    number = {w: k for k, w in enumerate(dict.fromkeys(w for t in tokens for w in t))}
    sure = np.array([any(u in typical for u in units(w.lower())) for w in number], bool)
    numbered = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in tokens]
    index = np.array([token_features(w) for w in number], np.int32).reshape(-1, _FEATURES)
    parts = sorted(((n[k : k + at.segment], y) for n, y in zip(numbered, toxic, strict=True) for k in range(0, len(n), at.segment)), key=lambda x: -len(x[0]))
    if parts:
        ids, length = np.concatenate([n for n, _ in parts]), np.array([len(n) for n, _ in parts])
        gold = np.concatenate([sure[n] & bool(y) for n, y in parts]).astype(float)
        seen, moved = np.full(_WIDTH, 1e-8), np.full((2, 2), 1e-8)
        for _ in range(at.steps):
            by_weight, by_move = gradient(field, index, ids, length, gold)
            by_weight, by_move = (by_weight - at.l2 * field.weights) / len(ids), (by_move - at.l2 * field.moves) / len(ids)
            seen += by_weight**2
            moved += by_move**2
            field.weights += at.rate * by_weight / np.sqrt(seen)
            field.moves += at.rate * by_move / np.sqrt(moved)
    emissions = field.weights[index].sum(axis=1)
    x = _summary(field.marginals([emissions[n] for n in numbered]))
    share = np.where(toxic > 0, 0.5 / max(toxic.sum(), 1), 0.5 / max((toxic == 0).sum(), 1))
    for _ in range(300):
        p = _logistic(x @ field.curve)
        w = share * p * (1 - p) + 1e-9
        field.curve += np.linalg.solve((x * w[:, None]).T @ x + 1e-4 * np.eye(3), x.T @ (share * (toxic - p)) - 1e-4 * field.curve) * 0.5
    return field


def train(docs: DataFrame, labels: DataFrame, at: Settings = Settings()) -> Field:
    """Fits on the driver, on the bounded sample."""
    rows = sorted(labelled_sample(docs, labels, "toxic", {1: at.toxic, 0: at.clean}, at.most_chars).collect(), key=lambda r: r["key"])
    return fit([r["text"] for r in rows], np.array([r["label"] for r in rows], float), at)


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted, n_toxic (tokens), spans ("start:end,..." in code points).

    Null and empty texts have no tokens and get the curve's lowest score; long texts are tagged whole; null ids are not held
    out; repeated rows get equal results; an empty table gives an empty one. Other columns are not read, so names may clash.
    """

    @F.pandas_udf("score double, n_toxic long, spans string")
    def tag(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for some in texts:
            done = []
            for k in range(0, len(some), 512):
                part = [x or "" for x in some.iloc[k : k + 512]]
                if len(known) > 1_000_000:
                    known.clear()
                rows = []
                for text in part:
                    tokens = _TOKEN.findall(text)
                    for w in set(tokens).difference(known):
                        known[w] = field.emission(w)
                    rows.append(np.fromiter(map(known.__getitem__, tokens), float, len(tokens)))
                marginals = field.marginals(rows)
                scores = field.score(marginals)
                for text, p, s in zip(part, marginals, scores, strict=True):
                    hits = np.flatnonzero(p >= 0.5)
                    spans = ""
                    if len(hits):
                        hit = set(hits.tolist())
                        spans = ",".join(f"{m.start()}:{m.end()}" for j, m in enumerate(_TOKEN.finditer(text)) if j in hit)
                    done.append((float(s), len(hits), spans))
            yield pd.DataFrame(done, columns=["score", "n_toxic", "spans"])

    found = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), tag(F.col(text_col)).alias("t"))
    return found.select(id_col, "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= threshold).cast("int").alias("predicted"), F.col("t.n_toxic").alias("n_toxic"), F.col("t.spans").alias("spans"))


def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
