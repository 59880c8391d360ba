"""Accuracy of predictions and of extractions. predictions: method, id, gold, predicted (null counts as the label none)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyspark.functions import scalars as S
from tallyspark.functions import tables as T


def labelled(predictions: DataFrame) -> DataFrame:
    return predictions.where("gold IS NOT NULL").withColumn("predicted", F.coalesce("predicted", F.lit("none")))


def accuracy(predictions: DataFrame) -> DataFrame:
    return labelled(predictions).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("correct"), F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy"))


def per_class(predictions: DataFrame) -> DataFrame:
    """precision, recall, f1, support of each label that is gold or predicted; a zero denominator gives 0."""
    pairs = labelled(predictions).groupBy("method", "gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    gold = pairs.groupBy("method", F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    given = pairs.groupBy("method", F.col("predicted").alias("label")).agg(F.sum("n").alias("given"))
    both = gold.join(given, ["method", "label"], "full_outer").na.fill(0, ["support", "hits", "given"])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    both = both.withColumn("precision", ratio("hits", "given")).withColumn("recall", ratio("hits", "support"))
    return both.select("method", "label", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"), "support")


def macro_f1(predictions: DataFrame) -> DataFrame:
    return per_class(predictions).groupBy("method").agg(F.avg("f1").alias("macro_f1"))


def confusion(predictions: DataFrame) -> DataFrame:
    return labelled(predictions).groupBy("method", "gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share; nulls for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest((middle - spread) / (1 + z * z / n), F.lit(0.0)), F.least((middle + spread) / (1 + z * z / n), F.lit(1.0))


def paired(predictions: DataFrame, a: str, b: str) -> DataFrame:
    """How often both, one or neither of two methods are right on the rows that both have."""
    right = lambda m, name: labelled(predictions).where(F.col("method") == m).select("id", (F.col("gold") == F.col("predicted")).alias(name))
    joined = right(a, "a").join(right(b, "b"), "id")
    return joined.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"))


def decide(metrics: DataFrame, fallback: str = "rules") -> DataFrame:
    """metrics: method, accuracy_all, accuracy_real. The one method that is strictly best on both, else the fallback."""
    best = lambda c: metrics.agg(F.max(c).alias("m")).join(metrics, F.col("m") == F.col(c)).agg(F.count(F.lit(1)).alias("k"), F.first("method").alias("w")).select(F.when(F.col("k") == 1, F.col("w")).alias("w"))
    return best("accuracy_all").select(F.col("w").alias("a")).crossJoin(best("accuracy_real").select(F.col("w").alias("b"))).select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(fallback)).alias("chosen"))


def error_groups(predictions: DataFrame) -> DataFrame:
    """method, gold, predicted, n, first_id and place, from 1: a method's largest groups first, ties by labels."""
    wrong = labelled(predictions).where("gold <> predicted")
    groups = wrong.groupBy("method", "gold", "predicted").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    order = Window.partitionBy("method").orderBy(F.desc("n"), "gold", "predicted")  # as many as there are pairs of labels
    return groups.withColumn("place", F.row_number().over(order))


def error_members(predictions: DataFrame) -> DataFrame:
    """The wrong predictions with their group's n and place, a row each."""
    groups = error_groups(predictions).select("method", "gold", "predicted", "n", "place")
    return labelled(predictions).where("gold <> predicted").join(groups, ["method", "gold", "predicted"])


def run_stats(predictions: DataFrame) -> DataFrame:
    """Of each method's predictions with a gold label: n_scored, parse_failures, their reasons (sorted, "?" for none given), mean_latency_ms, total_tokens
    (null if none has any), total_cost, latency_p50_ms (the exact median) and cost_per_1000. A missing latency or cost counts as 0."""
    latency, cost = F.coalesce("latency_ms", F.lit(0)), F.coalesce("cost", F.lit(0)).cast("decimal(20,8)")
    failed = F.coalesce("parse_failure", F.lit(False))
    reasons = F.sort_array(F.collect_set(F.when(failed, F.coalesce("parse_failure_reason", F.lit("?")))))
    return predictions.where("gold IS NOT NULL").groupBy("method").agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(failed).alias("parse_failures"), reasons.alias("reasons"), F.avg(latency).alias("mean_latency_ms"), F.sum("total_tokens").alias("total_tokens"), F.sum(cost).alias("total_cost"),
        F.median(latency).alias("latency_p50_ms"), (F.avg(cost.cast("double")) * 1000).alias("cost_per_1000"),
    )


def promoted(rows: DataFrame, overrides: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows with gold_label, ambiguous, notes and overridden, the ids of overrides that match no row).

    An override's label counts even if it is null; its ambiguous and notes do where they are given, notes if not empty. overrides: key, label, ambiguous, notes.
    """
    named = overrides.select(key, F.struct("label", "ambiguous", "notes").alias("o"))
    rest = [c for c in rows.columns if c not in ("ambiguous", "notes")]
    hit = F.col("o").isNotNull()
    given = F.when(hit, F.nullif(F.col("o.notes"), F.lit("")))
    found = rows.join(named, key, "left").select(*rest, F.when(hit, F.col("o.label")).otherwise(F.col("silver_label")).alias("gold_label"), F.coalesce("o.ambiguous", "ambiguous").alias("ambiguous"), F.coalesce(given, "notes").alias("notes"), hit.alias("overridden"))
    return found, overrides.select(key).join(rows.select(key), key, "left_anti")


def silver_labels(rows: DataFrame, manual: DataFrame, made: str = "synthetic_image", exception: tuple[str, str] = ("synth-team_events-", "travel_meals")) -> DataFrame:
    """rows with silver_label, ambiguous and labelled: the manual label, else, for rows of the source `made`, the category that their notes expect.

    Rows of the exception's prefix that are marked ambiguous get its label instead, as a reader would conclude. Others stay without. rows: id,
    source, notes, ambiguous; manual: id, category (null: none), ambiguous.
    """
    named = manual.select("id", F.struct("category", "ambiguous").alias("m"))
    is_made = F.coalesce(F.col("source") == made, F.lit(False))
    doubtful = F.col("id").startswith(exception[0]) & F.coalesce("ambiguous", F.lit(False))
    expected = F.nullif(S.strip(F.regexp_extract("notes", r"expected category: ([^.,]*)", 1)), F.lit(""))
    label = F.when(F.col("m").isNotNull(), F.col("m.category")).when(is_made, F.when(doubtful, exception[1]).otherwise(expected))
    unsure = F.coalesce("m.ambiguous", is_made & doubtful) | F.coalesce("ambiguous", F.lit(False))
    return rows.join(named, "id", "left").select(*[c for c in rows.columns if c != "ambiguous"], label.alias("silver_label"), unsure.alias("ambiguous"), (F.col("m").isNotNull() | is_made).alias("labelled"))


def what_if(predictions: DataFrame, least: int = 3) -> DataFrame:
    """Accuracy after taking the largest group of errors as right, where it has at least `least` members; ties go to the greatest labels."""
    groups = error_groups(predictions)
    top = groups.groupBy("method").agg(F.max(F.struct("n", "gold", "predicted")).alias("t")).where(F.col("t.n") >= least)
    return accuracy(predictions).join(top, "method").select("method", F.col("t.n").alias("flipped"), ((F.col("correct") + F.col("t.n")) / F.col("n")).alias("accuracy"))


def threshold_sweep(predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """coverage and accuracy of predictions at least as confident as each threshold."""
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    sure = F.col("confidence") >= F.col("threshold")
    return predictions.select("*", steps).groupBy("threshold").agg(F.count_if(sure).alias("covered"), F.avg(sure.cast("double")).alias("coverage"), F.avg(F.when(sure, (F.col("gold") == F.col("predicted")).cast("double"))).alias("accuracy"))


def score_field(expected: Column, found: Column) -> Column:
    """match if two amounts differ by less than 1, both_absent, else mismatch."""
    return F.when(expected.isNull() & found.isNull(), "both_absent").when(F.coalesce(F.abs(expected - found) < 1, F.lit(False)), "match").otherwise("mismatch")


def pooled(scores: DataFrame) -> DataFrame:
    """One row for all documents: samples, succeeded, matched, missed, extra, zero_extracted (nothing matched and nothing extra), precision and recall of all
    items together, mean_tokens (missing ones are 0) and mean_seconds. scores: success, matched, missed, extra, total_tokens, seconds; failed ones count as samples only."""
    sums = scores.groupBy().agg(F.count(F.lit(1)).alias("samples"))
    right = scores.where("success").agg(
        F.count(F.lit(1)).alias("succeeded"), *[F.sum(c).alias(c) for c in ("matched", "missed", "extra")], F.count_if((F.col("matched") == 0) & (F.col("extra") == 0)).alias("zero_extracted"),
        F.avg(F.coalesce("total_tokens", F.lit(0))).alias("mean_tokens"), F.avg("seconds").alias("mean_seconds"),
    )
    ratio = lambda of: F.try_divide("matched", F.col("matched") + F.col(of))
    return sums.crossJoin(F.broadcast(right)).select("*", ratio("extra").alias("precision"), ratio("missed").alias("recall"))


def type_counts(scores: DataFrame, plausible: list[str]) -> DataFrame:
    """document_type, n, plausible of the documents that succeeded."""
    return scores.where("success").groupBy("document_type").agg(F.count(F.lit(1)).alias("n")).withColumn("plausible", F.coalesce(F.col("document_type").isin(*plausible), F.lit(False)))


#: Pairs of names whose similarity a task keeps.
MEMO = 20_000


def _ratio(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    if not a or not b:
        return 0.0
    return 1.0 if a in b or b in a else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 if one text holds the other, else the share of matching blocks; 0 if either is empty. No built-in function has it."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b, strict=True)])


def _matching(least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What match_items() does with a task's sorted rows."""

    def greedy(score: Callable[[str, str], float], wanted: list[str], left: list[str]) -> tuple[int, int, int]:
        matched, left = 0, list(left)
        for name in wanted:
            scores = [score(name, x) for x in left]
            if scores and max(scores) >= least:
                left.pop(scores.index(max(scores)))
                matched += 1
        return matched, len(wanted) - matched, len(left)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, doc, names = lru_cache(MEMO)(_ratio), None, ([], [])
        for batch in batches:
            out = []
            for d, side, name in zip(batch["doc"].tolist(), batch["side"].tolist(), batch["name"].tolist(), strict=True):
                if doc is not None and d != doc:
                    out.append((doc, *greedy(score, *names)))
                    names = ([], [])
                doc = d
                names[side].append(name)
            yield pd.DataFrame(out, columns=["doc", "matched", "missed", "extra"])
        if doc is not None:
            yield pd.DataFrame([(doc, *greedy(score, *names))], columns=["doc", "matched", "missed", "extra"])

    return documents


def match_items(expected: DataFrame, found: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc, pos, name) tables -> matched, missed, extra per document. Each expected item, in order, takes the best item that is left: sequential in a document, parallel over documents.

    Tasks read their documents one after the other from sorted rows, so that small documents cost no call each, and keep the similarity of the pairs of
    names that they met last, as names repeat between documents.
    """
    sides = expected.select("doc", F.lit(0).alias("side"), "pos", "name").unionByName(found.select("doc", F.lit(1).alias("side"), "pos", "name"))
    dealt = sides.where("doc IS NOT NULL").repartition("doc").sortWithinPartitions("doc", "side", "pos")
    return dealt.mapInPandas(_matching(least), "doc long, matched long, missed long, extra long")


def awaiting(lines: DataFrame, key: str, order: str, alone: Column) -> DataFrame:
    """lines with `waits` (a line that asks for the next one) and `taken` (one that a line before it has asked for), and `answer`, the next line's order.

    alone: the line asks for an answer, unless it is one: in a run of such lines every second one answers the one before. Windows over a
    key's lines in order; no line is read twice.
    """
    turn = Window.partitionBy(key).orderBy(order)
    rows = lines.withColumn("_alone", F.coalesce(alone, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_alone"), 0).otherwise(1)).over(turn))
    place = F.row_number().over(Window.partitionBy(key, "_run", "_alone").orderBy(order))
    rows = rows.withColumn("waits", F.col("_alone") & (place % 2 == 1))
    return rows.withColumn("taken", F.coalesce(F.lag("waits").over(turn), F.lit(False))).withColumn("answer", F.when(F.col("waits"), F.lead(order).over(turn))).drop("_alone", "_run")


def pairs_of_lines(lines: DataFrame) -> DataFrame:
    """(doc, pos, line) -> (doc, pos, n, key, value): the pairs of a text's lines, n by place in the line.

    Forms, in order: a table row of two cells; "**Key**: value"; "**Key**" alone, whose value is the next line that isn't blank, whatever it is; else
    "Key: value" and, besides, every "Key: value" that two spaces or the line's end close. Lines that served as a value and lines
    that rule tables off are not searched.
    """
    rows = lines.select("doc", "pos", S.strip(F.col("line")).alias("line")).where("line <> ''")
    ruled = F.col("line").rlike(r"^\|---|^[| -]*$")
    has = lambda pattern: F.col("line").rlike(pattern)
    part = lambda pattern, n: F.regexp_extract("line", pattern, n)
    pair = lambda pattern: F.array(F.struct(part(pattern, 1).alias("key"), part(pattern, 2).alias("value")))
    table = has(T.PAIR_TABLE_ROW) & ~F.contains(part(T.PAIR_TABLE_ROW, 1), F.lit("---"))
    rows = awaiting(rows, "doc", "pos", has(T.PAIR_KEY_ALONE) & ~ruled & ~table & ~has(T.PAIR_BOLD))
    after = F.lead("line").over(Window.partitionBy("doc").orderBy("pos"))
    inline = F.zip_with(F.regexp_extract_all("line", F.lit(T.PAIR_INLINE), 1), F.regexp_extract_all("line", F.lit(T.PAIR_INLINE), 2), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    none = F.array().cast("array<struct<key: string, value: string>>")
    found = (
        F.when(F.col("taken"), none)
        .when(F.col("waits"), F.when(F.col("answer").isNotNull(), F.array(F.struct(part(T.PAIR_KEY_ALONE, 1).alias("key"), F.col("next").alias("value")))).otherwise(none))
        .when(ruled, none)
        .when(table, pair(T.PAIR_TABLE_ROW))
        .when(has(T.PAIR_BOLD), pair(T.PAIR_BOLD))
        .otherwise(F.concat(F.when(has(T.PAIR_PLAIN), pair(T.PAIR_PLAIN)).otherwise(none), inline))
    )
    return rows.withColumn("next", after).select("doc", "pos", F.posexplode(found).alias("n", "p")).select("doc", "pos", "n", "p.key", "p.value")


def recovered_items(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, pos, source, item): the items of extracted receipts, wherever they landed; the first place that has any counts.

    A field (other than additional_fields) that is a list of objects; a further field's text that is a JSON list; further fields like item_1_name and
    "Item 2 qty", put together by their number into nm, price and cnt. Fields are searched in the order in which they stand. item is a
    variant; a conveyance form's trips are no items.
    """
    v, more = F.col("v"), F.try_variant_get("v", "$.additional_fields", "map<string,variant>")
    is_kind = lambda x, kind: F.coalesce(F.schema_of_variant(x).startswith(kind), F.lit(False))
    listed = lambda x: F.try_variant_get(x, "$", "array<variant>")
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    text_of = lambda x: F.when(is_kind(x, "STRING"), F.try_variant_get(x, "$", "string"))
    parsed = rows.select(key, F.col(json).alias("j"), F.try_parse_json(F.col(json)).alias("v")).where(is_kind(v, "OBJECT"))
    parsed = parsed.withColumn("fields", fields).withColumn("more", F.coalesce(more, F.create_map().cast("map<string,variant>"))).withColumn("names", F.json_object_keys("j")).withColumn("more_names", F.coalesce(F.json_object_keys(F.get_json_object("j", "$.additional_fields")), F.array().cast("array<string>")))
    trips = (F.try_variant_get("v", "$.document_type", "string") == "local_conveyance_form") & is_kind(F.try_element_at("fields", F.lit("travel_entries")), "ARRAY")
    lists = F.transform(F.filter("names", lambda n: n != "additional_fields"), lambda n: listed(F.when(is_kind(F.try_element_at("fields", n), "ARRAY"), F.try_element_at("fields", n))))
    first_list = F.get(F.filter(lists, lambda x: x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: is_kind(e, "OBJECT"))), F.lit(0))
    texts = F.transform(F.filter("more_names", lambda n: F.coalesce(F.ltrim(text_of(F.try_element_at("more", n))).startswith("["), F.lit(False))), lambda n: F.try_parse_json(text_of(F.try_element_at("more", n))))
    first_text = F.get(F.filter(F.transform(texts, lambda x: F.when(is_kind(x, "ARRAY"), listed(x))), lambda x: x.isNotNull()), F.lit(0))
    match = lambda n, k: F.regexp_extract(F.trim(n), T.NUMBERED_ITEM, k)
    entry = lambda n: F.struct(match(n, 1).alias("number"), F.lower(match(n, 2)).alias("field"), F.nullif(F.coalesce(text_of(F.try_element_at("more", n)), F.to_json(F.try_element_at("more", n))), F.lit("")).alias("value"))
    entries = F.transform(F.filter("more_names", lambda n: match(n, 1) != ""), entry)
    parsed = parsed.withColumn("entries", entries).withColumn("numbers", F.array_sort(F.array_distinct(F.transform("entries", lambda e: F.struct(e["number"].cast("decimal(38,0)").alias("n"), e["number"].alias("number"))))))
    last = lambda number, field: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("entries", lambda e: (e["number"] == number) & (e["field"] == field)), lambda e: e["value"])), -1)
    item = lambda number: F.parse_json(F.to_json(F.struct(*[F.coalesce(*[last(number, F.lit(f)) for f in names]).alias(name) for name, names in T.ITEM_FIELDS.items()]), {"ignoreNullFields": "false"}))
    numbered = F.transform("numbers", lambda x: item(x["number"]))
    source = F.when(F.coalesce(trips, F.lit(False)), None).when(F.col("a").isNotNull(), "list").when(F.col("b").isNotNull(), "json_text").when(F.size("c") > 0, "numbered")
    found = parsed.withColumn("trips", trips).select(key, "v", "fields", F.when(~F.coalesce("trips", F.lit(False)), first_list).alias("a"), first_text.alias("b"), numbered.alias("c")).withColumn("source", source)
    items = F.when(F.col("source") == "list", F.col("a")).when(F.col("source") == "json_text", F.col("b")).when(F.col("source") == "numbered", F.col("c"))
    return found.select(key, "source", F.posexplode(items).alias("pos", "item")).select(key, "pos", "source", "item")


def corpus_summary(scores: DataFrame) -> DataFrame:
    """scores: doc, correct, found, total. documents, pairs, accuracy (correct of all pairs), value_recall (values found anywhere), all_correct and its share. Documents without pairs are skipped."""
    per = scores.where("total > 0")
    right = F.count_if(F.col("correct") == F.col("total"))
    sums = per.agg(F.count(F.lit(1)).alias("documents"), F.sum("total").alias("pairs"), F.try_divide(F.sum("correct"), F.sum("total")).alias("accuracy"), F.try_divide(F.sum("found"), F.sum("total")).alias("value_recall"), right.alias("all_correct"))
    return sums.withColumn("all_correct_share", F.try_divide("all_correct", "documents"))


def agreement(rows: DataFrame, silver: str, gold: str) -> DataFrame:
    """label, n, agreed, overridden for each silver label and, with label null, for all rows: the most overridden labels are the first ones by `overridden`."""
    same = F.col(silver).eqNullSafe(F.col(gold))
    per = rows.select(F.col(silver).alias("label"), same.alias("same")).rollup("label").agg(F.grouping("label").alias("all"), F.count(F.lit(1)).alias("n"), F.count_if("same").alias("agreed"))
    return per.select(F.when(F.col("all") == 0, F.coalesce(F.col("label").cast("string"), F.lit("none"))).alias("label"), "n", "agreed", (F.col("n") - F.col("agreed")).alias("overridden"))


def menu_items(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, pos, sub, nm, price, cnt): a menu is an object or an array of objects; an entry counts if it has a name or a price, and each of its sub-items beside it."""
    listed = lambda v: F.when(F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False)), F.try_variant_get(v, "$", "array<variant>")).when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.array(v)).otherwise(F.array().cast("array<variant>"))
    whole = lambda vs: F.filter(vs, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "string").alias(name)
    entries = rows.select(key, F.try_parse_json(F.col(json)).alias("m")).select(key, F.posexplode(whole(listed(F.col("m")))).alias("pos", "v"))
    own = entries.select(key, "pos", F.lit(None).cast("int").alias("sub"), field("nm"), field("price"), field("cnt")).where("nm IS NOT NULL OR price IS NOT NULL")
    subs = entries.select(key, "pos", F.posexplode(whole(listed(F.try_variant_get("v", "$.sub", "variant")))).alias("sub", "v"))
    return own.unionByName(subs.select(key, "pos", "sub", field("nm"), field("price"), field("cnt")))
