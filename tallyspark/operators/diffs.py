"""Structural differences of JSON values, as corrections: one for each changed leaf and for each element added or removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import tables as T

_EXACT = "decimal(38,12)"
#: How a text begins that may be a number; a cast that fails costs far more than this test.
_NUMERIC = r"^[\x00-\x20\x7f]*[+-]?[.\p{Nd}]"
#: A part of two values: still to be opened or a leaf (open), and whether it is known to differ (done).
_NODE = "array<struct<path: string, a: variant, b: variant, change: string, open: boolean, done: boolean>>"


def _listed(v: Column) -> Column:
    """The elements of an array, null for anything else; far cheaper than the schema of the whole value."""
    return F.try_variant_get(v, "$", "array<variant>")


def _kind(v: Column) -> Column:
    """STRING, BOOLEAN, VOID and the like; null for null. What an array has inside is not looked at."""
    return F.when(_listed(v).isNotNull(), "ARRAY").otherwise(F.schema_of_variant(v))


def _text(v: Column, kind: Column | None = None) -> Column:
    """Strings as they are, other values as JSON; null for null."""
    kind = F.schema_of_variant(v) if kind is None else kind
    return F.when(v.isNull() | (kind == "VOID"), None).when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _same(a: Column, b: Column, kind_a: Column, kind_b: Column, x: Column, y: Column) -> Column:
    """Whether values of these kinds and texts are equal."""
    number = lambda s: F.when(s.rlike(_NUMERIC), s.try_cast(_EXACT))
    mixed = F.coalesce((kind_a == "BOOLEAN") & (kind_b == "STRING"), F.lit(False)) | F.coalesce((kind_a == "STRING") & (kind_b == "BOOLEAN"), F.lit(False))
    printed = ~kind_a.eqNullSafe(kind_b) & F.to_json(a).eqNullSafe(F.to_json(b))
    return (x.eqNullSafe(y) & ~mixed) | F.coalesce(number(x) == number(y), F.lit(False)) | printed


def equal(a: Column, b: Column) -> Column:
    """Equal as they are or as numbers; a missing value is null. A truth value is no text."""
    return _same(a, b, F.schema_of_variant(a), F.schema_of_variant(b), _text(a), _text(b))


def nesting(v: Column) -> Column:
    """Levels of objects and arrays of a value."""
    marks = F.split(F.regexp_replace(F.to_json(v), r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++', ""), "")
    now = F.transform(marks, lambda m: F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0))
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.coalesce(F.aggregate(now, state, lambda s, m: F.struct((s["now"] + m).alias("now"), F.greatest(s["most"], s["now"] + m).alias("most")), lambda s: s["most"]), F.lit(0))


def deepest(rows: DataFrame, value: str) -> int:
    """The most levels of a column of variants: a bound for differences() that needs no join, as pairs are opened no further than both sides go."""
    return rows.agg(F.max(nesting(F.col(value)))).first()[0] or 0


def differences(pairs: DataFrame, key: str, before: str = "a", after: str = "b", path: str | None = None, whole: str | None = None, depth: int | None = None) -> DataFrame:
    """(key, field_path, ai_value, employee_value, change_type) of each difference of the variants `before` and `after`.

    Arrays are compared place by place; what one has beyond the other is row_added or row_removed with the whole element. Objects are
    compared by the union of their keys. Values of different kinds are one change, as are leaves (change_type null). Values are
    texts: strings as they are, others as JSON. path names the column of the path where a pair begins; pairs whose column `whole`
    is true are compared as leaves. Rows carry their parts along, level by level, in one stage without a shuffle; a level reads each
    value once, and leaves are compared once, at the end. The levels are counted in the data unless `depth` gives them.

    Equal leaves leave by way of explode, not of a filter, as Spark moves a filter below the columns that it names and works each out again for each use.
    """
    a, b = F.col(before), F.col(after)
    whole_ = F.coalesce(F.col(whole), F.lit(False)) if whole else F.lit(False)
    if depth is None:
        depth = pairs.where(~whole_).agg(F.max(F.least(nesting(a), nesting(b)))).first()[0] or 0
    node = lambda p, x, y, change, open_, done: F.struct(p.alias("path"), x.alias("a"), y.alias("b"), change.alias("change"), open_.alias("open"), done.alias("done"))
    none, yes, no = F.lit(None).cast("string"), F.lit(True), F.lit(False)
    rows = pairs.select(key, node(F.col(path) if path else F.lit(""), a, b, none, ~whole_, no).alias("n"))
    x, y, at, open_, done = (F.col(f"n.{c}") for c in ("a", "b", "path", "open", "done"))
    xs, ys, xm, ym = (F.col(c) for c in ("xs", "ys", "xm", "ym"))
    change = lambda i: F.when(i >= F.size(ys), "row_removed").when(i >= F.size(xs), "row_added")
    item = lambda e, i: node(F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), e["xs"], e["ys"], change(i), change(i).isNull(), change(i).isNotNull())
    field = lambda k: node(F.when(at == "", k).otherwise(F.concat_ws(".", at, k)), F.try_element_at(xm, k), F.try_element_at(ym, k), none, yes, no)
    leaf = F.array(node(at, x, y, none, no, no))
    for _ in range(depth):
        inside = lambda v, kind: F.when(open_, F.try_variant_get(v, "$", kind))
        rows = rows.select(key, "n", *[inside(v, kind).alias(c) for c, v, kind in (("xs", x, "array<variant>"), ("ys", y, "array<variant>"), ("xm", x, "map<string,variant>"), ("ym", y, "map<string,variant>"))])
        items, fields = F.transform(F.arrays_zip(xs, ys), item), F.transform(F.array_distinct(F.concat(F.map_keys(xm), F.map_keys(ym))), field)
        arrays, objects = xs.isNotNull() & ys.isNotNull(), xm.isNotNull() & ym.isNotNull()
        rows = rows.select(key, F.explode(F.when(~open_, F.array("n")).when(arrays, items).when(objects, fields).otherwise(leaf).cast(_NODE)).alias("n"))
    rows = rows.select(key, "n", _kind(x).alias("ka"), _kind(y).alias("kb"))
    ka, kb, tx, ty = (F.col(c) for c in ("ka", "kb", "tx", "ty"))
    rows = rows.select(key, "n", "ka", "kb", _text(x, ka).alias("tx"), _text(y, kb).alias("ty"))
    differ = done | ~_same(x, y, ka, kb, tx, ty)
    found = rows.select(key, at.alias("field_path"), tx.alias("ai_value"), ty.alias("employee_value"), F.col("n.change").alias("change_type"), differ.alias("differ"))
    return found.select(*[c for c in found.columns if c != "differ"], F.explode(F.when(F.col("differ"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))).drop("col")


def canonical_trips(trips: Column) -> Column:
    """The trips of an array of variants by their canonical names; of several names that an entry has the first counts, and names that it lacks it has not."""

    def trip(e: Column) -> Column:
        first = lambda names: F.coalesce(*[F.when(F.map_contains_key(e["m"], n), F.coalesce(F.try_element_at(e["m"], F.lit(n)), F.parse_json(F.lit("null")))) for n in names])
        named = F.create_map(*[x for name, names in T.TRIP_FIELDS.items() for x in (F.lit(name), first(names))])
        return F.when(e["m"].isNotNull(), F.to_variant_object(F.map_filter(named, lambda _, v: v.isNotNull()))).otherwise(e["v"])

    opened = F.transform(trips, lambda v: F.struct(v.alias("v"), F.try_variant_get(v, "$", "map<string,variant>").alias("m")))
    return F.transform(opened, trip)


def corrections(rows: DataFrame, key: str, fields: str = "fields", depth: int | None = None) -> DataFrame:
    """Corrections of edits that stand beside the fields of their document: rows of key, path, value and `fields`, see edit_corrections()."""
    path, value, inside = F.col("path"), F.col("value"), F.try_variant_get(fields, "$", "map<string,variant>")
    # a path that is not known in advance is read anew for each row, which a plain name does not need
    stored = F.when(path.rlike(r"^[A-Za-z_]\w*$"), F.try_element_at(inside, path)).otherwise(F.try_variant_get(fields, F.concat(F.lit("$."), path), "variant"))
    table = F.when(path.isin(*T.ROW_FIELDS), _listed(value).isNotNull()).otherwise(F.lit(False))
    rows = rows.select(key, "path", "value", stored.alias("stored"), table.alias("table"))
    if depth is None:
        depth = deepest(rows.where("table"), "value")
    listed = F.coalesce(_listed(F.col("stored")), F.array().cast("array<variant>"))
    named = F.when(path == T.TRIP_ROWS, canonical_trips(listed)).otherwise(listed)
    before = F.when(F.col("table"), F.to_variant_object(named)).otherwise(F.col("stored"))
    return differences(rows.select(key, "path", before.alias("a"), value.alias("b"), (~F.col("table")).alias("whole")), key, path="path", whole="whole", depth=depth)


def edit_corrections(documents: DataFrame, edits: DataFrame, key: str, fields: str = "fields", depth: int | None = None) -> DataFrame:
    """Corrections of edits (key, path, value: a variant) to the documents' fields (a variant), as differences() gives them.

    A whole list of line items or trips is compared cell by cell, the stored trips under their canonical names; any other edit is
    one correction of what stands at its path, if that differs. A stored value that is no list counts as an empty one. `depth` is the most levels
    of an edited list; without it they are counted in the edits.
    """
    if depth is None:
        depth = deepest(edits.where(F.col("path").isin(*T.ROW_FIELDS) & _listed(F.col("value")).isNotNull()), "value")
    return corrections(edits.join(documents.select(key, fields), key), key, fields, depth)
