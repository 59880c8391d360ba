"""Checks of a rule set before it is used: the schema of stored answers, findings on structured clauses, reference tables.

clauses: clause_id, text, synthesized, failed, manual, limit_unit, limit_kind, limit_inclusive, unit_evidence, is_prohibition,
limits array<struct<amount,currency,when:map<string,array<string>>>>,
conditions array<struct<id,text,kind,depends_on:array<string>,value>>, documents array<struct<item,min_amount>>,
approval map<string,decimal>, applies_to array<string>, dropped array<string> (proposed categories outside the section's),
notes. Arrays and maps may be empty, not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions import tables as T
from tallyspark.operators.policy import overlapping_limits

CLAUSE = (
    "clause_id string, text string, synthesized boolean, failed boolean, manual boolean, limit_unit string, limit_kind string, limit_inclusive boolean, unit_evidence string, is_prohibition boolean, "
    "limits array<struct<amount:decimal(20,4),currency:string,when:map<string,array<string>>>>, conditions array<struct<id:string,text:string,kind:string,depends_on:array<string>,value:decimal(20,4)>>, "
    "documents array<struct<item:string,min_amount:decimal(20,4)>>, approval map<string,decimal(20,4)>, applies_to array<string>, dropped array<string>, notes string"
)
_NUMBER = "decimal(30,4)"


def structured_numbers(without_null: bool = True) -> Column:
    """Every number that a clause's structure holds."""
    parts = (
        F.transform("limits", lambda x: x["amount"].cast(_NUMBER)),
        F.transform(F.map_values("approval"), lambda x: x.cast(_NUMBER)),
        F.transform("conditions", lambda x: x["value"].cast(_NUMBER)),
        F.transform("documents", lambda x: x["min_amount"].cast(_NUMBER)),
    )
    found = F.array_distinct(F.concat(*parts))
    return F.array_compact(found) if without_null else found


def findings(clauses: DataFrame, fields: dict[str, tuple[str, ...]] = T.FIELDS) -> DataFrame:
    """(kind, clause_ids) of every finding, twelve kinds. A clause that could not be structured has that finding only.

    fields: facts by status; conditions on facts whose status is not "extracted" are gaps. Overlaps are given once for each
    clause and each pair of clauses, from an equi-join on category, unit, kind and currency.
    """
    text, unit, has_limit = F.col("text"), F.col("limit_unit"), F.size("limits") > 0
    numbers, structured = S.numbers_in(text), structured_numbers()
    cleaned = text
    for pattern in T.NO_AMOUNTS:
        cleaned = F.regexp_replace(cleaned, pattern, " ")
    mentioned = F.concat_ws(" ", F.transform("conditions", lambda x: x["text"]), "notes", F.transform("documents", lambda x: x["item"]))
    uncaptured = F.array_except(F.array_except(S.numbers_in(cleaned), structured), S.numbers_in(mentioned))
    invented = F.filter(F.array_except(structured, numbers), lambda n: n != 0)
    quoted = F.coalesce((F.trim("unit_evidence") != "") & F.contains(F.lower(text), F.lower(F.trim("unit_evidence"))), F.lit(False))
    hinted = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in T.UNIT_HINTS]))
    known = F.lit(True) & ~unit.isin("unknown", "none")
    extracted = F.array(*[F.lit(x) for x in fields["extracted"]])
    rules = {
        "SYNTHESIZED_ID": F.col("synthesized"),
        "UNIT_UNDETERMINED": (unit == "unknown") | (has_limit & ((unit == "none") | (~F.coalesce("manual", F.lit(False)) & ~quoted))),
        "UNIT_DISAGREES_WITH_TEXT": has_limit & known & F.when(F.size(hinted) > 0, ~F.array_contains(hinted, unit)).otherwise(unit.isin(*T.WORDED_UNITS)),
        "NUMBER_NOT_IN_TEXT": F.size(invented) > 0,
        "UNCAPTURED_NUMBERS": F.size(uncaptured) > 0,
        "LIMIT_EQUALS_APPROVAL_THRESHOLD": F.exists("limits", lambda x: F.coalesce(F.try_element_at("approval", x["currency"]) == x["amount"], F.lit(False))),
        "PROHIBITION_WITHOUT_TRIGGER": F.col("is_prohibition") & ~F.exists("conditions", lambda x: F.coalesce(x["kind"] == "excludes", F.lit(False))),
        "STAGE1_GAP": F.exists("conditions", lambda x: F.size(F.array_except(F.coalesce(x["depends_on"], F.array().cast("array<string>")), extracted)) > 0),
        "CATEGORY_SCOPE": F.size("dropped") > 0,
        "TABLE_NOT_STRUCTURED": F.contains(text, F.lit("|")) & ~has_limit & (F.size("conditions") == 0) & (F.size("applies_to") > 0),
    }
    failed = F.coalesce("failed", F.lit(False))
    kinds = F.when(failed, F.array(F.lit("UNSTRUCTURED"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))
    own = clauses.select(F.explode(kinds).alias("kind"), F.array("clause_id").alias("clause_ids"))
    sound = clauses.where(~failed & known)
    pairs = overlapping_limits(sound, ["limit_unit", "limit_kind"]).select(F.array_distinct(F.array("a_clause_id", "b_clause_id")).alias("clause_ids"))
    return own.unionByName(pairs.distinct().select(F.lit("OVERLAP").alias("kind"), "clause_ids"))


def _is(x: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(x).startswith(kind), F.lit(False))


def _text(x: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(x, path, "string"), F.lit(""))


def _bad_number(x: Column) -> Column:
    """A value that is no number and no text of one; missing values are none."""
    return F.coalesce(_is(x, "BOOLEAN") | F.try_variant_get(x, "$", "string").try_cast("decimal(38,10)").isNull(), F.lit(True))


def _list(x: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(x, path, "array<variant>"), F.array().cast("array<variant>"))


def _in(value: Column, allowed) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def schema_problems(entries: DataFrame, key: str, json: str, categories, fields: dict[str, tuple[str, ...]] = T.FIELDS) -> DataFrame:
    """(key, problem): every schema problem of a structured clause, by its place ("limit_table[1].amount"); a valid entry has no row.

    A clause without limits needs no limit kind. Categories are a list of known ids or "*". Ids of conditions and of their
    alternatives are unique in a clause, in the order in which they stand; a condition without id or text has that problem only.
    """
    known = [f for names in fields.values() for f in names]
    at = lambda name, k: F.concat(F.lit(f"{name}["), k.cast("string"), F.lit("]"))
    listed = lambda *problems: F.array_compact(F.array(*problems))
    named = lambda where, bad, suffix="": F.when(bad, F.concat(where, F.lit(suffix)))
    v = F.col("_v")

    def limit(x: Column, k: Column) -> Column:
        where, when = at("limit_table", k), F.try_variant_get(x, "$.when", "variant")
        values = F.map_values(F.try_variant_get(when, "$", "map<string,variant>"))
        odd = when.isNotNull() & ~_is(when, "VOID") & (~_is(when, "OBJECT") | F.exists(values, lambda y: ~_is(y, "ARRAY") & ~_is(y, "STRING")))
        return F.when(~_is(x, "OBJECT"), F.array(where)).otherwise(listed(named(where, _bad_number(F.try_variant_get(x, "$.amount", "variant")), ".amount"), named(where, odd, ".when")))

    def numeric(x: Column, where: Column) -> Column:
        n = F.try_variant_get(x, "$.numeric", "variant")
        odd = ~_in(_text(n, "$.quantity"), T.NUMERIC_QUANTITIES) | ~_in(_text(n, "$.op"), T.NUMERIC_OPS)
        return F.when(odd, F.concat(where, F.lit(".numeric"))).when(_bad_number(F.try_variant_get(n, "$.value", "variant")), F.concat(where, F.lit(".numeric.value")))

    def shared(x: Column, where: Column) -> list[Column]:
        depends = F.coalesce(F.try_variant_get(x, "$.depends_on", "array<string>"), F.array().cast("array<string>"))
        return [named(where, F.exists(depends, lambda d: ~_in(d, known)), ".depends_on")]

    def checked(x: Column, where: Column) -> list[Column]:
        check = _text(x, "$.check")
        return [named(where, ~_in(check, ("judgment", "numeric")), ".check"), F.when(check == "numeric", numeric(x, where))]

    whole = lambda x: _is(x, "OBJECT") & _text(x, "$.id").isNotNull() & _text(x, "$.text").isNotNull()

    def condition(x: Column, k: Column) -> Column:
        where, subs = at("conditions", k), _list(x, "$.any_of")
        top = named(where, ~_in(_text(x, "$.kind"), T.CONDITION_KINDS), ".kind")
        inner = F.flatten(F.transform(subs, lambda y, j: F.when(~whole(y), F.array(F.concat(where, F.lit("."), at("any_of", j)))).otherwise(listed(*shared(y, F.concat(where, F.lit("."), at("any_of", j))), *checked(y, F.concat(where, F.lit("."), at("any_of", j)))))))
        return F.when(~whole(x), F.array(where)).when(F.size(subs) > 0, F.concat(listed(top, *shared(x, where)), inner)).otherwise(listed(top, *shared(x, where), *checked(x, where)))

    def document(x: Column, k: Column) -> Column:
        where, least = at("documentation_required", k), F.try_variant_get(x, "$.min_amount", "variant")
        amounts = F.map_values(F.try_variant_get(least, "$", "map<string,variant>"))
        odd = F.when(_is(least, "OBJECT"), F.exists(amounts, _bad_number)).otherwise(least.isNotNull() & ~_is(least, "VOID") & _bad_number(least))
        return F.when(~_is(x, "OBJECT") | _text(x, "$.item").isNull(), F.array(where)).otherwise(listed(named(where, F.coalesce(odd, F.lit(False)), ".min_amount")))

    conditions = _list(v, "$.conditions")
    id_of = lambda x, where: F.when(whole(x), F.struct(where.alias("where"), _text(x, "$.id").alias("id")))
    placed = F.array_compact(F.flatten(F.transform(conditions, lambda x, k: F.when(whole(x), F.concat(F.array(id_of(x, at("conditions", k))), F.transform(_list(x, "$.any_of"), lambda y, j: id_of(y, F.concat(at("conditions", k), F.lit("."), at("any_of", j)))))).otherwise(F.array(id_of(x, at("conditions", k)))))))
    again = F.transform(F.filter(placed, lambda x, k: F.exists(F.slice(placed, F.lit(1), k), lambda y: y["id"] == x["id"])), lambda x: F.concat(x["where"], F.lit(".id")))
    limits, kind, proposed, approval = _list(v, "$.limit_table"), _text(v, "$.limit_kind"), F.try_variant_get(v, "$.applies_to_categories", "variant"), F.try_variant_get(v, "$.requires_approval_above", "variant")
    no_categories = ~_is(proposed, "ARRAY") | F.coalesce(F.exists(F.try_variant_get(proposed, "$", "array<string>"), lambda c: ~_in(c, [*categories, "*"])), F.lit(False))
    amounts = F.try_variant_get(approval, "$", "map<string,variant>")
    bad_approval = F.when(approval.isNull() | _is(approval, "VOID"), F.lit(False)).otherwise(~_is(approval, "OBJECT") | F.coalesce(F.size(amounts) == 0, F.lit(True)) | F.coalesce(F.exists(F.map_values(amounts), _bad_number), F.lit(False)))
    problems = F.concat(
        listed(named(F.lit("limit_unit"), ~_in(_text(v, "$.limit_unit"), T.LIMIT_UNITS)), named(F.lit("limit_kind"), (F.size(limits) > 0) & kind.isNotNull() & ~_in(kind, (*T.LIMIT_KINDS, "none"))), named(F.lit("applies_to_categories"), no_categories)),
        F.flatten(F.transform(limits, limit)),
        F.flatten(F.transform(conditions, condition)),
        again,
        F.flatten(F.transform(_list(v, "$.documentation_required"), document)),
        listed(named(F.lit("requires_approval_above"), bad_approval)),
    )
    rows = entries.select(key, F.try_parse_json(F.col(json)).alias("_v"))
    return rows.select(key, F.explode(F.when(~_is(v, "OBJECT"), F.array(F.lit("entry"))).otherwise(problems)).alias("problem"))


def segments(texts: DataFrame, key: str, text: str, without: tuple[str, ...] = T.REFERENCE_SECTIONS, bulleted: tuple[str, ...] = T.BULLET_SECTIONS) -> DataFrame:
    """(key, clause_id, section, sort_order, text, synthesized, duplicate): the clauses of rule texts with sections "## 8. Title".

    A clause begins with a number of its own section ("8.4. ", "5.3.1. ") and goes on until the next one, a rule "---" or a heading.
    Sections in `without` are no clauses, nor is what stands before the first. In sections in `bulleted` each bullet outside a clause is one, with a made
    number (19.1, 19.2, ...) and the section's lines before it, joined to one line, as its first line. duplicate: the text has the number more
    than once. sort_order counts from 0. Windows carry section, clause and count forward over a text's lines.
    """
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")).alias("pos", "line"))
    turn = Window.partitionBy(key).orderBy("pos")
    heading = F.nullif(F.regexp_extract("line", r"^## (\d+)\. .+?\s*$", 1), F.lit(""))
    rows = lines.withColumn("heading", heading).withColumn("head", F.last(F.when(F.col("heading").isNotNull(), F.struct("heading", "pos")), ignorenulls=True).over(turn))
    rows = rows.withColumn("section", F.col("head.heading")).where(F.col("section").isNotNull() & ~F.col("section").isin(*without))
    number = F.nullif(F.regexp_extract("line", r"^(\d+\.\d+(?:\.\d+)?)\.\s", 1), F.lit(""))
    starts = number.isNotNull() & (F.substring_index(number, ".", 1) == F.col("section"))
    ends = F.col("heading").isNotNull() | (F.trim("line") == "---")
    mark = F.when(ends, F.struct(F.lit(None).cast("string").alias("id"), F.col("pos").alias("at"))).when(starts, F.struct(number.alias("id"), F.col("pos").alias("at")))
    rows = rows.withColumn("ends", ends).withColumn("clause", F.last(mark, ignorenulls=True).over(turn))
    within = F.col("clause.id").isNotNull()
    whole = rows.where(within).groupBy(key, "section", F.col("clause.id").alias("clause_id"), F.col("clause.at").alias("at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")  # the lines of one clause
    numbered = whole.agg(S.strip(joined).alias("text")).withColumn("synthesized", F.lit(False))
    loose = rows.where(~within & ~F.col("ends") & F.col("section").isin(*bulleted)).withColumn("bullet", F.col("line").rlike(r"^- .+$"))
    part = Window.partitionBy(key, "head.pos").orderBy("pos")
    intro = F.concat_ws(" ", F.collect_list(F.when(~F.col("bullet"), F.nullif(S.strip(F.col("line")), F.lit("")))).over(part))  # a section's introduction is a few lines
    loose = loose.withColumn("intro", intro).withColumn("n", F.sum(F.col("bullet").cast("int")).over(part)).where("bullet")
    made = loose.select(key, "section", F.concat_ws(".", "section", F.col("n").cast("string")).alias("clause_id"), F.col("pos").alias("at"), F.when(F.col("intro") != "", F.concat_ws("\n", "intro", "line")).otherwise(F.col("line")).alias("text"), F.lit(True).alias("synthesized"))
    found = numbered.unionByName(made)
    times = F.count(F.lit(1)).over(Window.partitionBy(key, "clause_id"))
    return found.select(key, "clause_id", "section", (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("sort_order"), "text", "synthesized", (times > 1).alias("duplicate"))


def override(clauses: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clauses, log, problems) of manual corrections.

    clauses: clause_id, body (the clause as a JSON object). patches: clause_id, patch, a JSON object of new values by field and "_reason", one for
    each clause; ids that begin with "_" are comments. The log has the reason, the changed fields, sorted, and what they were, as JSON. problems has
    (clause_id, problem): unknown_clause, no_reason, unknown_field:name; a clause with a problem stays as it was. The scalar limit
    follows the only limit of limit_table, if it has one.
    """
    objects = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
    asked = patches.where(~F.col("clause_id").startswith("_")).withColumn("p", objects(F.col("patch")))
    both = asked.join(clauses.withColumn("b", objects(F.col("body"))), "clause_id", "left").withColumn("names", F.array_sort(F.array_except(F.map_keys("p"), F.array(F.lit("_reason")))))
    both = both.withColumn("reason", F.nullif(F.try_variant_get(F.try_element_at("p", F.lit("_reason")), "$", "string"), F.lit("")))
    unknown = F.transform(F.filter("names", lambda n: ~F.map_contains_key("b", n)), lambda n: F.concat(F.lit("unknown_field:"), n))
    both = both.withColumn("problems", F.when(F.col("b").isNull(), F.array(F.lit("unknown_clause"))).when(F.col("reason").isNull(), F.array(F.lit("no_reason"))).otherwise(unknown))
    sound = both.where(F.size("problems") == 0)
    value = lambda n: F.to_json(F.try_element_at("b", n))
    before = F.concat(F.lit("{"), F.array_join(F.transform("names", lambda n: F.concat(F.lit('"'), n, F.lit('":'), F.coalesce(value(n), F.lit("null")))), ","), F.lit("}"))
    log = sound.select("clause_id", "reason", F.col("names").alias("changed"), before.alias("before"))
    one = lambda m, f: F.when(F.map_contains_key(m, "limit_table"), F.coalesce(F.when(F.size(limits(m)) == 1, F.try_variant_get(F.get(limits(m), F.lit(0)), f"$.{f}", "variant")), F.parse_json(F.lit("null"))))
    limits = lambda m: F.try_variant_get(F.try_element_at(m, F.lit("limit_table")), "$", "array<variant>")
    merged = F.map_concat(F.map_filter("b", lambda k, _: ~F.array_contains("names", k)), F.map_filter("p", lambda k, _: k != "_reason"))
    rows = sound.select("clause_id", merged.alias("m"))
    scalars = F.map_filter(F.create_map(F.lit("limit_amount"), one(F.col("m"), "amount"), F.lit("limit_currency"), one(F.col("m"), "currency")), lambda _, v: v.isNotNull())
    rows = rows.withColumn("scalars", scalars).select("clause_id", F.map_concat(F.map_filter("m", lambda k, _: ~F.map_contains_key("scalars", k)), "scalars").alias("m"))
    new = clauses.join(rows, "clause_id", "left").select("clause_id", F.coalesce(F.when(F.col("m").isNotNull(), _object(F.col("m"))), "body").alias("body"))
    return new, log, both.select("clause_id", F.explode("problems").alias("problem"))


def _object(m: Column) -> Column:
    """A map of variants as JSON, its keys sorted."""
    parts = F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(F.to_json(F.create_map(k, F.lit(0))).substr(F.lit(2), F.length(F.to_json(F.create_map(k, F.lit(0)))) - 3), F.coalesce(F.to_json(F.try_element_at(m, k)), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def table_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, cells) of the pipe-table rows of texts, in their order, without the lines that only rule tables off."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("line", S.strip(F.col("line")))
    rows = lines.where(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|[\s|-]+\|?$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), S.strip)
    return rows.select(key, "pos", cells.alias("cells"))


def reference_tables(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name, value) out of pipe tables: grades with their rank, cities of tiers 1 and 2, countries of zone A, and zone A's open groups.

    A group with members, "Western Europe (France, Spain, etc.)", gives its members; one that ends in "etc." is open. Names are
    in lower case, but for grades and groups. A document's tables are few, so ranks come from a window over its grades.
    """
    rows = table_rows(texts, key, text).withColumn("head", F.col("cells")[0]).withColumn("rest", F.get("cells", F.lit(1)))
    grades = rows.where(F.col("head").rlike(r"^L\d$")).withColumn("value", F.row_number().over(Window.partitionBy(key).orderBy("pos")).cast("string"))
    tiers = rows.where(F.col("head").rlike(r"^Tier [12]$")).select(key, F.lit("city").alias("kind"), F.explode(F.split("rest", ",")).alias("name"), F.right("head", F.lit(1)).alias("value"))
    tiers = tiers.withColumn("name", F.lower(S.strip(F.col("name")))).where("name <> ''")
    groups = rows.where("head = 'Zone A'").select(key, F.explode(F.regexp_extract_all("rest", F.lit(r"([^,(]+(?:\([^)]*\))?)"), 1)).alias("part")).withColumn("part", S.strip(F.col("part"))).where("part <> ''")
    members = F.transform(F.split(F.regexp_extract("part", r"\((.*)\)", 1), ","), S.strip)
    etc = lambda x: F.lower(F.rtrim(x, F.lit("."))) == "etc"
    zones = groups.withColumn("members", F.when(F.contains("part", F.lit("(")), members)).withColumn("group", S.strip(F.regexp_extract("part", r"^([^(]*)", 1)))
    countries = zones.select(key, F.explode(F.coalesce(F.filter("members", lambda x: ~etc(x)), F.array("part"))).alias("name"))
    opened = zones.where(F.exists("members", etc)).select(key, F.lit("open_group").alias("kind"), F.col("group").alias("name"), F.lit("A").alias("value"))
    return (
        grades.select(key, F.lit("grade").alias("kind"), F.col("head").alias("name"), "value")
        .unionByName(tiers)
        .unionByName(countries.select(key, F.lit("country").alias("kind"), F.lower("name").alias("name"), F.lit("A").alias("value")))
        .unionByName(opened)
    )


def limit_summary(clauses: DataFrame) -> DataFrame:
    """clause_id, n_limits, least, most, currencies, dimensions (both sorted, joined by "/" and "x"), inclusive; clauses without limits have nulls and empty texts."""
    amounts, sorted_set = F.transform("limits", lambda x: x["amount"]), lambda xs: F.array_sort(F.array_distinct(F.array_compact(xs)))
    keys = F.flatten(F.transform("limits", lambda x: F.map_keys(x["when"])))
    return clauses.select("clause_id", F.size("limits").alias("n_limits"), F.array_min(amounts).alias("least"), F.array_max(amounts).alias("most"), F.array_join(sorted_set(F.transform("limits", lambda x: x["currency"])), "/").alias("currencies"), F.array_join(sorted_set(keys), "x").alias("dimensions"), "limit_inclusive")


def to_json(clauses: DataFrame) -> DataFrame:
    """clause_id, json: the clause with its only limit as scalar limit_amount and limit_currency, null with none or several."""
    only = lambda f: F.when(F.size("limits") == 1, F.col("limits")[0][f])
    rest = [c for c in clauses.columns if c != "clause_id"]
    return clauses.select("clause_id", F.to_json(F.struct("clause_id", *rest, only("amount").alias("limit_amount"), only("currency").alias("limit_currency")), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Clauses of JSON texts, with the scalar limits that were stored."""
    return rows.select(F.from_json("json", CLAUSE + ", limit_amount decimal(20,4), limit_currency string").alias("c")).select("c.*")
