"""Expense categories by rules, by a classifier and by both; training and evaluation of predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions import tables as T
from tallyspark.functions.joins import small
from tallyspark.operators.versions import numbered
from tallyspark.sources.readers import stored


def input_text(vendor: Column, items: Column, markdown: Column) -> Column:
    """Vendor, items joined by commas and the text's first 2000 characters, empty parts left out."""
    parts = [F.nullif(p, F.lit("")) for p in (vendor, F.array_join(items, ", "), F.substring(markdown, 1, 2000))]
    return F.concat_ws(" ", *parts)


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def rule_category(document_type: Column, text: Column) -> Column:
    """struct(category, confidence, keyword). Keywords match anywhere, inside words too; groups count in order."""
    low = F.lower(text)
    pick = lambda c, p, k=None: F.struct(F.lit(c).cast("string").alias("category"), F.lit(p).alias("confidence"), (F.lit(None).cast("string") if k is None else k).alias("keyword"))
    meal = F.when(_any(low, T.CLIENT_HINTS), pick("client_entertainment", 0.7)).when(_any(low, T.TEAM_HINTS), pick("team_events", 0.7)).otherwise(pick("travel_meals", 0.85))
    direct = F.struct(S.category_of_type(document_type).alias("category"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("keyword"))
    found = F.when(document_type.isin(*T.EVIDENCE_TYPES), pick(None, 1.0)).when(document_type == "restaurant_bill", meal).when(document_type.isin(*T.DIRECT_TYPES), direct)
    for category, words in T.KEYWORDS:
        first = F.try_element_at(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(1))
        found = found.when(first.isNotNull(), pick(category, 0.65, F.trim(first)))
    return found.otherwise(F.struct(F.coalesce(S.category_of_type(document_type), F.lit("other")).alias("category"), F.lit(0.4).alias("confidence"), F.lit(None).cast("string").alias("keyword")))


def hybrid(classifier: DataFrame, fallback: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The classifier's category where it is confident, else the fallback's."""
    joined = classifier.alias("a").join(fallback.alias("b"), "id", "left")
    sure = F.coalesce(F.col("a.confidence") >= threshold, F.lit(False))
    return joined.select("id", F.when(sure, F.col("a.category")).otherwise(F.col("b.category")).alias("category"), F.when(sure, "classifier").otherwise("fallback").alias("method"))


def stratified_split(rows: DataFrame, label: str, key: str, train: float = 0.8) -> DataFrame:
    """Rows with `part`: the same share of every label, by a hash of the key; the key is unique."""
    placed = numbered(rows, [label], [F.md5(F.col(key).cast("string")), F.col(key)])
    share = F.coalesce(F.try_divide(F.col("turn") - 1, F.col("of") - 1), F.lit(0.0))
    return placed.withColumn("part", F.when(share < train, "train").otherwise("test")).drop("turn", "of")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, weight = n / (classes x n of the label)."""
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return per.crossJoin(F.broadcast(total)).select(label, (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))


def train_classifier(rows: DataFrame, features: str, label: str):
    """Class-balanced multinomial logistic regression on an embedding column (array of float). Returns the fitted Spark ML model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    weighted = rows.join(small(class_weights(rows, label)), label)
    data = weighted.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), "weight")
    return LogisticRegression(weightCol="weight", maxIter=30, regParam=0.01).fit(data)


def classify(model, rows: DataFrame, features: str) -> DataFrame:
    """rows with predicted and confidence."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(rows.withColumn("features", array_to_vector(F.col(features).cast("array<double>"))))
    return scored.withColumn("confidence", F.array_max(vector_to_array("probability"))).withColumn("predicted", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


_CELL = "id long, v array<double>, cell int, band int"
_VISITS = 10_000  # rows with a vector that leave a Python worker at once


def _placed(pivots: np.ndarray, reach: float, visits: bool):
    """Vectors by the pivot that is nearest and the band of their angle to it, or, for visits, by every pivot and band where a vector within
    reach of them can be."""

    def place(batches):
        for rows in batches:
            v = _unit(np.stack(rows["v"])) if len(rows) else np.zeros((0, pivots.shape[1]))
            angle = np.arccos(np.clip(v @ pivots.T, -1, 1))
            if not visits:
                cell = angle.argmin(axis=1) if len(v) else np.zeros(0, int)
                band = (angle[np.arange(len(v)), cell] / reach).astype(int)
                yield pd.DataFrame({"id": rows["id"].to_numpy(), "v": rows["v"].to_numpy(), "cell": cell, "band": band})
                continue
            # one whose nearest pivot this is lies at most `reach` nearer to it, and at most `reach` farther from any other
            row, cell = np.nonzero(angle <= angle.min(axis=1, initial=np.pi, keepdims=True) + 2 * reach + 1e-7)
            at = angle[row, cell]
            first = np.maximum(np.floor((at - reach - 1e-7) / reach), 0).astype(int)
            times = np.floor((at + reach + 1e-7) / reach).astype(int) - first + 1
            again = np.repeat(np.arange(len(row)), times)
            step = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            for k in range(0, max(len(again), 1), _VISITS):
                some, on = again[k : k + _VISITS], step[k : k + _VISITS]
                yield pd.DataFrame({"id": rows["id"].to_numpy()[row[some]], "v": rows["v"].to_numpy()[row[some]], "cell": cell[some], "band": first[some] + on})

    return place


def _cost(pivots: np.ndarray, held: np.ndarray, train: np.ndarray, rows: int, reach: float) -> float:
    """What a training vector costs with these pivots and `rows` held rows, in products; a visit is as dear as a thousand. Judged by sampled vectors."""
    frame = lambda v: pd.DataFrame({"id": np.arange(len(v)), "v": list(v)})
    members = next(_placed(pivots, reach, False)([frame(held)])).groupby(["cell", "band"]).size().rename("n")
    visits = pd.concat([next(_placed(pivots, reach, True)([frame(train[k : k + 1])])) for k in range(len(train))])[["cell", "band"]]
    return (visits.join(members, on=["cell", "band"])["n"].sum() / len(held) * rows + 1000 * len(visits)) / len(train)


def leak_candidates(train: DataFrame, held: DataFrame, limit: float = 0.95, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(visits, members): training rows and held rows with the (cell, band) in which pairs over the limit meet, each pair in one.

    An index by the triangle inequality on angles. Up to `pivots` held vectors (at most one for each 64 and 256, unless given), of least hash, are
    pivots: a bounded sample, which decides the work and never the result. A held vector stands in the cell of its nearest pivot, in a band of its angle to it. With the limit's angle
    r, a training vector visits a cell only if its angle to the pivot is within 2r of that to its own nearest pivot, and
    there the bands within r of that angle. 256 vectors of each side tell how many pivots cost least; where none save what their visits cost, as on
    spread vectors, all rows are in one cell.
    """
    reach = float(np.arccos(np.clip(limit, -1, 1))) or 1e-9
    usable = lambda side: side.where("v IS NOT NULL").where(F.exists("v", lambda x: x != 0)).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    held, train = usable(held), usable(train)
    least = lambda side, n: [r.v for r in side.orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()]
    if pivots is None:
        rows = held.count()
        n = min(256, max(1, rows // 64))
        near, far = least(held, n + 256), least(train, 256)
        base = _unit(np.array(near[:n])) if near else np.zeros((0, 1))
        costs = {k: _cost(base[:k], np.array(near[n:]), np.array(far), rows, reach) for k in {max(1, n >> i) for i in range(9)}} if len(near) > n and far else {0: rows}
        best = min(costs, key=lambda k: (costs[k], k))
        base, indexed = base[:best], costs[best] < rows
    else:
        some = least(held, pivots)
        base, indexed = _unit(np.array(some)) if some else np.zeros((0, 1)), bool(some)
    if not indexed:
        return tuple(side.select("*", F.lit(0).alias("cell"), F.lit(0).alias("band")) for side in (train, held))
    return train.mapInPandas(_placed(base, reach, True), _CELL), held.mapInPandas(_placed(base, reach, False), _CELL)


def compared_pairs(train: DataFrame, held: DataFrame, limit: float = 0.95, pivots: int | None = None) -> DataFrame:
    """compared, the pairs that cosine_leaks() multiplies out, and possible, all pairs there are."""
    visits, members = leak_candidates(train, held, limit, pivots)
    per = lambda side, name: side.groupBy("cell", "band").agg(F.count(F.lit(1)).alias(name))
    met = per(visits, "a").join(per(members, "b"), ["cell", "band"]).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("compared"))
    return met.withColumn("possible", F.lit(train.count() * held.count()))


def cosine_leaks(train: DataFrame, held: DataFrame, limit: float = 0.95, block: int = 10_000, pivots: int | None = None) -> DataFrame:
    """(train_id, held_id, cosine) over the limit, exactly. Columns: id, v (array of double, of one length).

    Rows meet in the cells and bands of leak_candidates(). A cell and band with over `block` rows is cut into blocks by a hash, each
    pair of which is dealt out on its own. A task reads sorted rows and holds the held rows of one block, beside which training rows stream
    by, and their hits leave it in parts. Rows without a vector, or with zeros only, match nothing.
    """
    visits, members = leak_candidates(train, held, limit, pivots)
    visits, members = stored(visits), stored(members)
    place = ["cell", "band"]
    count = lambda side, n: side.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n))
    sizes = small(stored(count(members, "bn").join(count(visits, "an"), place)))

    def dealt(side: DataFrame, number: int, own: str, n: str, other: str, m: str) -> DataFrame:
        rows = side.join(sizes, place)
        return rows.select(*place, F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other), F.lit(number).alias("side"), "id", "v")

    key = [*place, "t", "h"]
    sides = dealt(members, 0, "h", "bn", "t", "an").unionByName(dealt(visits, 1, "t", "an", "h", "bn"))
    rows = sides.repartition(*key).sortWithinPartitions(*key, "side")
    return rows.mapInPandas(_over(limit, [*key, "side"]), "train_id long, held_id long, cosine double")


def _over(limit: float, order: list[str], most: int = 1_000_000):
    """Pairs over the limit of rows that come sorted: a block's held rows (side 0), then its training rows. At most `most` products are held at once."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, held, found, n = None, [], None, [], 0
        for batch in batches:
            if not len(batch):
                continue
            marks, ids, v = batch[order].to_numpy(), batch["id"].to_numpy(), _unit(np.stack(batch["v"]))
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1), len(marks)]
            for first, end in zip(cuts, cuts[1:], strict=False):
                *here, side = marks[first]
                if at != here:
                    at, parts, held = here, [], None
                if side == 0:
                    parts.append((ids[first:end], v[first:end]))
                    continue
                if not parts:
                    continue
                if held is None:
                    held = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                step = max(1, most // len(held[0]))
                for k in range(first, end, step):
                    cosine = v[k : min(k + step, end)] @ held[1].T
                    t, h = np.nonzero(cosine > limit)
                    found.append((ids[k + t], held[0][h], cosine[t, h]))
                    n += len(t)
                    if n >= 100_000 or len(found) >= 1000:
                        yield _hits(found)
                        found, n = [], 0
        if found:
            yield _hits(found)

    return meet


def _hits(found: list) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("train_id", "held_id", "cosine"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))


def training_run(train: DataFrame, held: DataFrame, features: str, label: str, path: str, key: str = "id", limit: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(report, dropped) of one training job, whose model is stored at path.

    Training rows over the limit of cosine with a held row are dropped; of the rest, a share of every label is kept out, a class-balanced
    model is fitted on the others and reported on it: label, precision, recall, f1, support. The stored model is fitted on all that is left. Rows
    without a vector take no part.
    """
    side = lambda rows: rows.select(F.col(key).alias("id"), F.col(features).alias("v"))
    dropped = stored(cosine_leaks(side(train), side(held), limit).groupBy("train_id").agg(F.max("cosine").alias("cosine")))
    left = train.where(F.col(features).isNotNull() & F.col(label).isNotNull()).join(dropped.select(F.col("train_id").alias(key)), key, "left_anti")
    parts = stored(stratified_split(left, label, key))
    scored = classify(train_classifier(parts.where("part = 'train'"), features, label), parts.where("part = 'test'"), features)
    gold, found = F.col(label), F.col("predicted")
    marks = scored.select(F.explode(F.array(F.struct(gold.cast("int").alias("label"), F.lit(1).alias("support"), F.lit(0).alias("claimed"), (gold == found).cast("int").alias("hit")), F.struct(found.alias("label"), F.lit(0).alias("support"), F.lit(1).alias("claimed"), F.lit(0).alias("hit")))).alias("m")).select("m.*")
    sums = marks.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hit")])
    ratio = lambda of: F.coalesce(F.try_divide("hit", of), F.lit(0.0))
    report = sums.select("label", ratio("claimed").alias("precision"), ratio("support").alias("recall"), F.coalesce(F.try_divide(2 * F.col("hit"), F.col("claimed") + F.col("support")), F.lit(0.0)).alias("f1"), "support")
    train_classifier(parts, features, label).write().save(path)
    return report, dropped


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def backfill(rows: DataFrame, category: str, document_type: Column, text: Column) -> DataFrame:
    """rows whose category is missing get the rules' one, with its confidence and method "rules"; evidence documents stay without; the others stay as they are."""
    missing, found = F.col(category).isNull(), rule_category(document_type, text)
    return rows.select(*[c for c in rows.columns if c != category], F.when(missing, found["category"]).otherwise(F.col(category)).alias(category), F.when(missing, found["confidence"]).alias("backfilled_confidence"), F.when(missing & found["category"].isNotNull(), "rules").alias("backfilled_by"))


def carried(before: Column, confidence: Column, method: Column, after: Column) -> Column:
    """struct(category, confidence, method) of an edited version: what it had, or "employee" without a confidence where the category was changed."""
    same = before.eqNullSafe(after)
    return F.struct(after.alias("category"), F.when(same, confidence).alias("confidence"), F.when(same, method).otherwise("employee").alias("method"))


def dispatch(rows: DataFrame, key: str, methods: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(key, method, category, confidence): the predictions of every method, each a function of rows -> key, category, confidence."""
    some = [run(rows).select(key, F.lit(name).alias("method"), "category", F.col("confidence").cast("double").alias("confidence")) for name, run in methods.items()]
    return reduce(DataFrame.unionByName, some)


def to_do(rows: DataFrame, predictions: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """rows without a valid prediction: one of this fingerprint and without an error."""
    valid = predictions.where((F.col("fingerprint") == fingerprint) & F.col("error").isNull())
    return rows.join(valid.select(key), key, "left_anti")
