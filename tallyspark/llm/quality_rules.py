"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document's measures are integers. A sketch is a histogram with buckets of bounded relative width (an integer's leading
five bits and its size), so sketches of parts add up to the sketch of the whole, in any order, exactly. There is one for each
language and source. The filter joins each document to its group's thresholds.

No cutoff is fixed. A rate is smoothed by one occurrence, (a + 1) / (b + 1): among documents that have none of a thing, it
still differs by their size, so the sketch also knows how far chance alone spreads a measure that is mostly zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyspark.llm.common import cut, read

_CAPITALS = bytes(range(65, 91))
_SYMBOL = re.compile("[#*$%&|<>]")
#: Smoothed ratios per 10,000 that the adaptive rules look at; high is bad.
MEASURES = {
    "symbol_rate": ("n_symbols", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "capital_rate": ("n_capitals", "word_chars"),
}
#: Distances from median to upper quartile that a sound document may lie above that quartile, in buckets of the sketch.
WIDTH = 5


def measure(text: str | None, window: int = 3) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (A-Z) of a text; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else [data] * bool(n)
    repeated = 0
    if n > window:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        code = ids[: n - window + 1].copy()
        for k in range(1, window):  # an exact number for each distinct window, renumbered before it could overflow
            if len(number) ** 2 * n > 2**62:
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(number) + ids[k : n - window + 1 + k]
        _, place, times = np.unique(code, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[place] > 1)
        if len(twice):
            covered = np.zeros(n, bool)
            for k in range(window):
                covered[twice + k] = True
            repeated = int(covered.sum())
    return n, chars, len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), len(data) - len(data.translate(None, _CAPITALS))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@F.pandas_udf(StructType([StructField(c, LongType()) for c in _COUNTS]))
def _measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for some in texts:
        yield pd.DataFrame([measure(x) for x in some], columns=list(_COUNTS), dtype="int64")


def bucket(name: str) -> Column:
    """Bucket of an integer column >= 0: itself below 32, else 16 buckets for each power of two; the order is kept."""
    return F.expr(f"CASE WHEN {name} < 32 THEN {name} ELSE (length(bin({name})) - 5) * 16 + shiftright({name}, length(bin({name})) - 5) END")


def thresholds(measured: DataFrame, by: list[str], names: list[str], shares: list[float]) -> DataFrame:
    """(by..., name, group's rows n, least bucket that holds each of the shares q0, q1, ...) from counts that merge before the shuffle."""
    long = measured.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).alias("v")) for m in names])).alias("x")).select(*by, "x.name", "x.v")
    counts = long.where("v IS NOT NULL").withColumn("bucket", bucket("v")).groupBy(*by, "name", "bucket").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by, "name")
    counts = counts.withColumn("so_far", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    return counts.groupBy(*by, "name").agg(F.max("all").alias("n"), *[F.min(F.when(F.col("so_far") >= F.col("all") * s, F.col("bucket"))).alias(f"q{k}") for k, s in enumerate(shares)])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 50, most_repeated: float = 0.5, width: int = WIDTH, least_rows: int = 30) -> DataFrame:
    """One row per row of docs: id, the five counts, base_failed, kept, and the adaptive rule that failed (null if none).

    Fixed base: under least_words words, or over most_repeated of the words in repeated three-word windows. Adaptive: among
    the documents of its language and source that pass the base, a measure is an outlier if its bucket lies more than `width`
    times the distance from median to upper quartile (one bucket at least) above that quartile. Nothing else decides: the
    same value can pass in one group and fail in another. A group of under least_rows documents takes its language's
    thresholds; if these rest on under least_rows documents too, only the base counts. Null languages and sources are groups
    like others. Null and empty texts have zero counts and fail the base; long texts are counted whole; repeated rows get
    equal verdicts; an empty table gives an empty one. Other columns are not read, so their names may clash.
    """
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select(F.col(id_col).alias("id"), text_or(lang_col).alias("lang"), text_or(source_col).alias("source"), _measured(F.col(text_col)).alias("m"))
    rows = rows.select("id", "lang", "source", *[F.col("m")[c].alias(c) for c in _COUNTS])
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > F.col("n_words") * F.lit(most_repeated))
    ratios = {m: F.expr(f"({a} + 1) * 10000 div ({b} + 1)") for m, (a, b) in MEASURES.items()}
    rows = cut(rows.withColumn("base_failed", failed).withColumns(ratios))
    names, sound = list(MEASURES), rows.where("NOT base_failed")

    def limits(by: list[str], to: str) -> DataFrame:
        limit = F.when(F.col("n") >= least_rows, F.col("q1") + width * F.greatest(F.col("q1") - F.col("q0"), F.lit(1)))
        wide = thresholds(sound, by, names, [0.5, 0.75]).withColumn("limit", limit).groupBy(*by).pivot("name", names).agg(F.first("limit"))
        return wide.select(*by, *[F.col(m).alias(f"{to}_{m}") for m in names])

    judged = rows.join(limits(["lang", "source"], "group"), ["lang", "source"], "left").join(limits(["lang"], "lang"), "lang", "left")
    outlier = [F.when(bucket(m) > F.coalesce(f"group_{m}", f"lang_{m}"), F.lit(m)) for m in MEASURES]
    judged = judged.withColumn("failed_rule", F.when(~F.col("base_failed"), F.coalesce(*outlier)))
    return judged.select(F.col("id").alias(id_col), *_COUNTS[:5], "base_failed", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), "failed_rule")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


#: With the defaults of quality_rules(). No limit is no outlier.
_BUCKET = "CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END"
_LONG = ", ".join(f"{{'place': {k}, 'name': '{m}', 'v': ({a} + 1) * 10000 // ({b} + 1)}}" for k, (m, (a, b)) in enumerate(MEASURES.items()))


def _limits(by: str) -> str:
    return f"""(SELECT {by}, name, CASE WHEN max(n_rows) >= 30 THEN min(bucket) FILTER (so_far >= n_rows * 0.75) + {WIDTH} * greatest(min(bucket) FILTER (so_far >= n_rows * 0.75) - min(bucket) FILTER (so_far >= n_rows * 0.5), 1) END AS most
    FROM (SELECT {by}, name, bucket, sum(count(*)) OVER (PARTITION BY {by}, name ORDER BY bucket) AS so_far, sum(count(*)) OVER (PARTITION BY {by}, name) AS n_rows FROM sketch WHERE NOT base_failed GROUP BY {by}, name, bucket) GROUP BY {by}, name)"""


SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS (SELECT row_id, x[1] AS k, count(*) OVER (PARTITION BY row_id, x[2], x[3], x[4]) AS times FROM (SELECT row_id, unnest(list_zip(range(1, len(w) - 1), w, w[2:], w[3:], true)) AS x FROM d)),
repeated AS (SELECT row_id, count(DISTINCT spot) AS n FROM (SELECT row_id, unnest([k, k + 1, k + 2]) AS spot FROM windows WHERE times > 1) GROUP BY 1),
counted AS (SELECT row_id, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals FROM d LEFT JOIN repeated USING (row_id)),
judged AS MATERIALIZED (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM counted),
sketch AS MATERIALIZED (SELECT *, {_BUCKET} AS bucket FROM (SELECT row_id, lang, source, base_failed, unnest([{_LONG}], recursive := true) FROM judged)),
failed AS (SELECT row_id, arg_min(s.name, place) AS failed_rule FROM sketch s LEFT JOIN {_limits('lang, source')} g USING (lang, source, name) LEFT JOIN {_limits('lang')} l USING (lang, name)
  WHERE NOT base_failed AND bucket > coalesce(g.most, l.most) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rule IS NULL AS kept, failed_rule FROM judged LEFT JOIN failed USING (row_id)"""
