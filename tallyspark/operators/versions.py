"""Versions, totals and frequencies of documents and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.tables import VERDICTS
from tallyspark.sources.readers import stored


def _picked(rows: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    """An aggregate for each column, combined before the shuffle; the value of the chosen row counts, null or not."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    best = {F.max_by: F.max, F.min_by: F.min}[pick]
    return rows.groupBy(*keys).agg(best(order).alias(order), *[pick(c, order).alias(c) for c in rest]).select(rows.columns)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest `order` of each key; `order` is not null and does not repeat within a key."""
    return _picked(rows, keys, order, F.max_by)


def earliest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least `order` of each key, as latest()."""
    return _picked(rows, keys, order, F.min_by)


def latest_run(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """All rows of each key's last run."""
    last = F.max(seq).over(Window.partitionBy(key))
    return rows.where(F.col(key).isNotNull()).withColumn("_last", last).where(F.col(seq) == F.col("_last")).drop("_last")


def next_sequence(rows: DataFrame, key: str, seq: str) -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max(seq), F.lit(0)) + 1).alias("next_seq"))


def claim_documents(claims: DataFrame, versions: DataFrame, checks: DataFrame, employees: DataFrame) -> DataFrame:
    """A row for each claim and document: the employee's name, the document's latest version and its checks, an array of (name, passed) by name.

    Claims without documents have a row of nulls; a version without checks an empty array. A version's checks are few. claims: claim_id, employee_id; versions: claim_id,
    document_id, version, and more; checks: document_id, version, name, passed; employees: employee_id, name.
    """
    newest = latest(versions, ["document_id"], "version")
    per = checks.groupBy("document_id", "version").agg(F.array_sort(F.collect_list(F.struct("name", "passed"))).alias("checks"))
    documents = newest.join(per, ["document_id", "version"], "left")
    named = claims.join(employees.select("employee_id", F.col("name").alias("employee")), "employee_id", "left")
    return named.join(documents, "claim_id", "left").withColumn("checks", F.coalesce("checks", F.array().cast("array<struct<name: string, passed: boolean>>")))


def totals_by_currency(docs: DataFrame) -> DataFrame:
    """Sums of confirmed documents per claim and currency; a null currency is "unknown", null amounts are skipped."""
    counted = docs.where("doc_status = 'confirmed' AND amount IS NOT NULL")
    return counted.groupBy("claim_id", F.coalesce("currency", F.lit("unknown")).alias("currency")).agg(F.sum("amount").alias("total"))


def collapsed_totals(claims: DataFrame, totals: DataFrame) -> DataFrame:
    """One total per claim: of its only currency; 0 INR without any; null where currencies mix."""
    per = claims.select("claim_id").distinct().join(totals, "claim_id", "left").groupBy("claim_id").agg(F.count("currency").alias("n"), F.max("total").alias("t"), F.max("currency").alias("c"))
    zero = F.lit(0).cast("decimal(22,2)")
    return per.select("claim_id", F.when(F.col("n") == 0, zero).when(F.col("n") == 1, F.col("t")).alias("total_amount"), F.when(F.col("n") == 0, "INR").when(F.col("n") == 1, F.col("c")).alias("currency"))


def claim_totals(docs: DataFrame) -> DataFrame:
    """collapsed_totals() of the documents' own claims and their totals_by_currency(), in one pass over the documents."""
    counted = (F.col("doc_status") == "confirmed") & F.col("amount").isNotNull()
    per = docs.groupBy("claim_id", F.when(counted, F.coalesce("currency", F.lit("unknown"))).alias("c")).agg(F.sum(F.when(counted, F.col("amount"))).alias("t"))
    sums = per.groupBy("claim_id").agg(F.count("c").alias("n"), F.max("t").alias("t"), F.max("c").alias("c"))
    zero = F.lit(0).cast("decimal(22,2)")
    return sums.select("claim_id", F.when(F.col("n") == 0, zero).when(F.col("n") == 1, F.col("t")).alias("total_amount"), F.when(F.col("n") == 0, "INR").when(F.col("n") == 1, F.col("c")).alias("currency"))


def severity(verdict: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict)


def roll_up(verdicts: DataFrame, key: str, verdict: str = "verdict") -> DataFrame:
    """The worst verdict of each key; a key with none is insufficient_information."""
    worst = F.max(severity(F.col(verdict)))
    return verdicts.groupBy(key).agg(F.coalesce(F.try_element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.nullif(worst, F.lit(0)).cast("int")), F.lit("insufficient_information")).alias("verdict"))


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows with a batch number, `size` rows a batch, within the group that the first order column names."""
    turn = Window.partitionBy(order[0]).orderBy(*order[1:])
    return rows.withColumn("batch", F.floor((F.row_number().over(turn) - 1) / size))


def carry_forward(lines: DataFrame, doc: str, pos: str, mark: str) -> DataFrame:
    """Every line with the last mark at or before it in its document."""
    up_to = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(mark, ignorenulls=True).over(up_to))


def top_with_ties(rows: DataFrame, key: str, score: str) -> DataFrame:
    """The best rows of each key and whether they are tied."""
    ranked = rows.withColumn("_rank", F.rank().over(Window.partitionBy(key).orderBy(F.desc(score))))
    best = ranked.where("_rank = 1").drop("_rank")
    return best.withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy(key)) > 1)


def active_version(versions: DataFrame, label: str | None = None) -> DataFrame:
    """versions: label, is_active, created_on and more. The version of this label, or without one the newest that is active; one row or none."""
    if label is not None:
        return versions.where(F.col("label") == label)
    return versions.where("is_active").orderBy(F.desc("created_on"), F.desc("label")).limit(1)


def revert(versions: DataFrame, key: str, ai: Column) -> DataFrame:
    """A new version of each document that copies everything of its first AI version (where `ai` holds), numbered after its last; documents without one have none."""
    rest = [c for c in versions.columns if c not in (key, "version", "source")]
    first = F.min_by(F.when(ai, F.struct(*rest)), F.when(ai, F.col("version"))).alias("copy")
    per = versions.groupBy(key).agg((F.max("version") + 1).alias("version"), first).where("copy IS NOT NULL")
    return per.select(key, "version", F.lit("employee").alias("source"), "copy.*")


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows with `turn`, their place in the group from 1 in this order, which must not tie, and `of`, the group's rows.

    A group may hold most rows, so rows are dealt out in ranges of group and order; each range is numbered in its own task and
    starts after the rows of the ranges before it, which are counted.
    """
    ranged = stored(rows.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    up_to, whole = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    starts = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("of"))
    turn = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    return ranged.withColumn("_turn", turn).join(starts, [*group, "_part"]).withColumn("turn", F.col("_turn") + F.col("_before")).select(*rows.columns, "turn", "of")
