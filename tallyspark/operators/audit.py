"""Audits of stored tables: immutability between snapshots, keys, reviewers' labels, data set contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.tables import VERDICTS


def immutability(before: DataFrame, after: DataFrame, key: list[str], reviewer: list[str]) -> DataFrame:
    """(key..., finding): gone, changed, new or same for every row of two snapshots of one table. Columns that reviewers write may change; all others may not."""
    fixed = [c for c in before.columns if c not in (*key, *reviewer)]
    side = lambda rows, name: rows.select(*key, F.struct(*fixed).alias(name), F.lit(True).alias(f"has_{name}"))
    both = side(before, "a").join(side(after, "b"), key, "full_outer")
    finding = F.when(F.col("has_b").isNull(), "gone").when(F.col("has_a").isNull(), "new").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return both.select(*key, finding.alias("finding"))


def keys(tables: dict[str, DataFrame], unique: list[tuple[str, list[str]]], foreign: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, violations): keys that stand more than once, and rows whose reference (child, column, parent, column) leads nowhere. Null references are none."""
    found = []
    for name, columns in unique:
        twice = tables[name].groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(twice.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"{name}({','.join(columns)}) unique").alias("rule"), "violations"))
    for child, column, parent, target in foreign:
        lost = tables[child].where(F.col(column).isNotNull()).select(F.col(column).alias("k")).join(tables[parent].select(F.col(target).alias("k")).distinct(), "k", "left_anti")
        found.append(lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"{child}.{column} -> {parent}.{target}").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, found)


def reviewer_labels(labels: DataFrame, clauses: DataFrame) -> DataFrame:
    """labels: key columns, policy_version, human_verdict, human_clause_id -> the same with problem: bad_verdict, or unknown_clause for a clause that this version of the policy does not have."""
    known = clauses.select("policy_version", F.col("clause_id").alias("human_clause_id"), F.lit(True).alias("known")).distinct()
    rows = labels.join(known, ["policy_version", "human_clause_id"], "left")
    bad = ~F.coalesce(F.col("human_verdict").isin(*VERDICTS), F.lit(False))
    problem = F.when(bad, "bad_verdict").when(F.coalesce(F.col("human_clause_id") != "", F.lit(False)) & F.col("known").isNull(), "unknown_clause")
    return rows.select(*labels.columns, problem.alias("problem"))


def contract(rows: DataFrame, id_col: str, required: list[str], domains: dict[str, list[str]], category: str, least: int) -> DataFrame:
    """(check, problems) of a data set: rows without a required value, ids that repeat, values outside their domain (null is in it), and categories of fewer than `least` rows."""
    sums = [F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c in required]
    sums += [F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)).alias(f"domain {c}") for c, allowed in domains.items()]
    sums.append((F.count(F.lit(1)) - F.count_distinct(id_col)).alias(f"repeated {id_col}"))
    one = rows.agg(*sums)
    long = one.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("problems")) for c in one.columns]))).alias("check", "problems"))
    few = rows.where(F.col(category).isNotNull()).groupBy(category).count().where(F.col("count") < least).agg(F.count(F.lit(1)).alias("problems"))
    return long.unionByName(few.select(F.lit(f"few {category}").alias("check"), "problems"))
