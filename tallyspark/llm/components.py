"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut


def _down(pairs: DataFrame) -> DataFrame:
    """Pairs with u above v, each once."""
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of u to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and its lesser neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame):
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    return edges.agg(F.count(F.lit(1)), total(F.xxhash64("u", "v")), total(F.col("v"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, component), component being the least node that is reachable.

    Loops and repeated pairs are allowed; pairs with a null are dropped; an empty table gives an empty one. Minima are
    combined before each shuffle and AQE can split the joins, so a hub is no hot spot. The number of rounds grows with
    the logarithm of the longest path; every round is cut by a checkpoint.
    """
    edges, before = cut(_down(edges)), None
    now = _state(edges)
    while now[0] and now != before:
        edges = cut(_down(_small_star(_down(_large_star(edges)))))
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
