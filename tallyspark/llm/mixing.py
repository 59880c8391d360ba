"""Mixing sources to target weights by capped water-filling.

A source's share of the mix is its weight's share of all words, but no source is repeated more than `epochs` times: it stops
at epochs x its size, and what it can't give is shared again among the others by weight, until none is above. The outcome is
one water level L with target = min(weight x L, epochs x size); every round is one small aggregate over the sources.
A document gives its source's rate (target / size) in whole repetitions and a seeded, fractional one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, cut, read

WEIGHTS = (5.0, 2.0, 1.0)
#: The columns that the mix adds.
MIXED = ("size", "source_size", "target", "repetitions", "part", "taken")
#: Sources, of a name and three numbers each, that may be broadcast.
BROADCAST = 50_000


def turns(sources: DataFrame, key: str) -> DataFrame:
    """sources with `turn`, the place of its key in order (from 0, null last), and its lineage cut: ranges of keys are counted, then ranked each in its own task."""
    ranged = sources.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = cut(ranged)
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.range") < F.col("a.range"), "left").groupBy("a.range").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col(key).asc_nulls_last()))
    return cut(ranged.withColumn("place", place).join(F.broadcast(before), "range").withColumn("turn", F.col("before") + F.col("place") - 1).drop("range", "place", "before"))


def water_fill(sources: DataFrame, epochs: float) -> DataFrame:
    """(source, source_size, weight) -> the same and target. Sizes and weights must not be negative; a source of no weight gets nothing.

    Starts with every source below the level; those that it would fill over their cap are clamped and the rest is shared
    again by weight, until no further source is clamped. Each round is one aggregate of a few numbers.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    total, level, full = float(sources.agg(F.sum("source_size")).first()[0] or 0), float("inf"), -1
    clamped, free = 0.0, float(sources.agg(F.sum("weight")).first()[0] or 0)
    while free > 0:
        level = (total - clamped) / free
        over = (F.col("weight") > 0) & (cap < F.col("weight") * F.lit(level))
        n, clamped, free = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == full:
            break
        full = n
    if free <= 0:
        level = float("inf")
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.least(cap, F.col("weight") * F.lit(level))).otherwise(0.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, epochs: float = 3.0, seed: int = 5, carry: bool = False) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, repetitions (whole ones), part (words of one more), taken; after the columns of docs if carry is set.

    size counts words; a null text has none. Sources take the weights in turn, in the order of their code points, with the
    null source last. taken = floor(rate x size + u) with u in [0, 1) drawn from the seed, the id and the size alone, so that
    reruns agree, sums come near the targets and no document gives more than epochs x its size. Rows with equal ids draw the
    same u. Each source is summed before the shuffle. Its one row is joined back: broadcast if the sources are counted and
    at most BROADCAST, else by an equi-join that AQE splits if it is skewed. Long texts are counted whole; an empty table
    gives an empty one; other columns are not read, and carried ones that have the name of a column of the mix give way to it.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in MIXED]) if carry else F.struct(F.col(id_col))
    sized = docs.select(kept.alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    targets = water_fill(turns(sums, "source").withColumn("weight", weight).drop("turn"), epochs).drop("weight")
    targets = cut(targets.withColumn("none", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit(""))))
    if targets.count() <= BROADCAST:
        targets = F.broadcast(targets)
    keyed = sized.withColumn("none", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.col("size").cast("string")))
    draw = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    most = F.floor(F.col("size") * F.lit(float(epochs)))
    found = keyed.join(targets, ["source", "none"]).withColumn("taken", F.least(most, F.floor(rate * F.col("size") + draw)))
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0).cast("long"))
    return found.select("row.*", "size", "source_size", "target", whole.alias("repetitions"), (F.col("taken") - whole * F.col("size")).alias("part"), "taken")


def emit(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """What mix(carry=True) takes, as rows with its columns: each document in whole as often as its repetitions say, and once more with its first `part` words.

    Documents of which nothing is taken have no row, so the words of a source's rows are its taken ones. White space before
    and between the words of a part stays; n_chars, where there is one, counts the row's own text.
    """
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    first = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")
    texts = F.array_repeat(F.col(text_col), F.col("repetitions").cast("int"))
    texts = F.when(F.col("part") > 0, F.concat(texts, F.array(first))).otherwise(texts)
    rows = mixed.select(F.struct(*[F.col(f"`{c}`") for c in mixed.columns]).alias("row"), F.explode(texts).alias("text"))
    new = {text_col: F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in mixed.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


#: With the defaults of mix().
SQL = """WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS full_at FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, level LIMIT 1)) AS target FROM l),
k AS (SELECT doc_id, size, source_size, target, least(size * 3, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END * size + ('0x' || left(md5(concat_ws(':', 5, doc_id, size)), 13))::BIGINT / 4503599627370496.0::DOUBLE))::BIGINT AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT *, CASE WHEN size > 0 THEN taken // size ELSE 0 END AS repetitions, taken - CASE WHEN size > 0 THEN taken // size ELSE 0 END * size AS part FROM k"""
