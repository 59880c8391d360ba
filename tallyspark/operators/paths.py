"""JSON documents as (path, value) rows, and edits on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S

_NODES = "array<struct<path: string, v: variant>>"


def flatten(rows: DataFrame, key: str, json: str, depth: int = 3, cut: int = 160) -> DataFrame:
    """(key, path, value) of every leaf down to `depth` levels: a.b for fields, a[0] for items, strings cut to `cut` characters and "...".

    A level's values are leaves if they are neither objects nor arrays; what is deeper than `depth` stays as JSON text. A row is read
    once: finished leaves are carried along while the others are opened, level by level.
    """
    node = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    path, v = F.col("n.path"), F.col("n.v")
    level = rows.select(key, node(F.lit(""), F.try_parse_json(F.col(json))).alias("n")).where(v.isNotNull())
    dotted = lambda name: F.when(path == "", name).otherwise(F.concat_ws(".", path, name))
    for _ in range(depth):
        fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: node(dotted(e["key"]), e["value"]))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: node(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x))
        kind = F.schema_of_variant(v)
        level = level.select(key, F.explode(F.when(kind.startswith("OBJECT"), fields).when(kind.startswith("ARRAY"), items).otherwise(F.array("n")).cast(_NODES)).alias("n"))
    kind = F.schema_of_variant(v)
    text = F.when(kind != "VOID", F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    short = F.when(F.length(text) > cut, F.concat(F.left(text, F.lit(cut)), F.lit("..."))).otherwise(text)
    return level.where(path != "").select(key, path.alias("path"), short.alias("value"))


def leaves(json: Column, depth: int = 3, cut: int = 160) -> Column:
    """The (path, value) of flatten() as an array, within the row; empty for what is no object or array."""
    node = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    dotted = lambda path, name: F.when(path == "", name).otherwise(F.concat_ws(".", path, name))

    def opened(n: Column) -> Column:
        path, v = n["path"], n["v"]
        fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: node(dotted(path, e["key"]), e["value"]))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: node(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x))
        return F.coalesce(fields.cast(_NODES), items.cast(_NODES), F.array(n).cast(_NODES))

    def said(n: Column) -> Column:
        text = F.when(F.schema_of_variant(n["v"]) != "VOID", F.coalesce(F.try_variant_get(n["v"], "$", "string"), F.to_json(n["v"])))
        return F.struct(n["path"].alias("path"), text.alias("value"))

    parsed = F.try_parse_json(json)
    found = F.transform(F.array(parsed), lambda v: node(F.lit(""), v)).cast(_NODES)
    for _ in range(depth):
        found = F.flatten(F.transform(found, opened))
    texts = F.transform(F.filter(found, lambda n: n["path"] != ""), said)
    return F.transform(texts, lambda t: F.struct(t["path"].alias("path"), F.when(F.length(t["value"]) > cut, F.concat(F.left(t["value"], F.lit(cut)), F.lit("..."))).otherwise(t["value"]).alias("value")))


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Leaf changes between two flattened versions; a missing leaf equals null; numbers are compared as numbers."""
    a, b = before.withColumnRenamed("value", "ai_value"), after.withColumnRenamed("value", "employee_value")
    both = a.join(b, [key, "path"], "full_outer")
    return both.where(~S.values_equal(F.col("ai_value"), F.col("employee_value"))).select(key, F.col("path").alias("field_path"), "ai_value", "employee_value")


def apply_edits(leaves: DataFrame, edits: DataFrame, key: str, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new leaves, rejected edits): edits at allowed roots replace or add leaves, others are rejected."""
    root = F.regexp_extract("path", r"^([^.\[]+)", 1)
    allowed, rejected = edits.where(root.isin(*roots)), edits.where(~root.isin(*roots))
    new = leaves.join(allowed.select(key, "path", F.col("value").alias("edited"), F.lit(True).alias("hit")), [key, "path"], "full_outer")
    return new.select(key, "path", F.when(F.col("hit"), F.col("edited")).otherwise(F.col("value")).alias("value")), rejected


def tagged(changes: DataFrame, suggestions: DataFrame, key: str) -> DataFrame:
    """Changes whose new value equals the suggestion for that field are suggestion_applied."""
    joined = changes.join(suggestions.select(key, F.col("field").alias("field_path"), F.col("suggested").cast("string").alias("suggested")), [key, "field_path"], "left")
    same = F.col("suggested").isNotNull() & S.values_equal(F.col("employee_value"), F.col("suggested"))
    return joined.withColumn("change_type", F.when(same, "suggestion_applied").otherwise("edit")).drop("suggested")


def reason_required(changes: DataFrame, failing: Column, printed: Column) -> DataFrame:
    """changes with direction and change_type. A money edit on a failing document, an increase of money or quantity, or a money value that is not printed."""
    money, grows = S.money_field(F.col("field_path")), S.inflatable_field(F.col("field_path")) & (F.col("direction") == "increase")
    free = F.col("change_type") == "suggestion_applied"
    return changes.withColumn("reason_required", (money & failing) | (~free & (grows | (money & ~printed))))


def resolve(requests: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """requests (key, path, and more) with value and found: a path whose value is null is found, one that is not there is not."""
    there = leaves.select(key, "path", "value", F.lit(True).alias("found"))
    return requests.join(there, [key, "path"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
