"""Queries for rule sets: structured clauses, stored entries and reference tables made from parts and customers, each with a known flaw."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import policy as L
from tallyspark.operators import ruleset as B
from tallyspark.plans.policy import _PEERS, decisions
from tallyspark.plans.proxy import DOCS, docs, table
from tallyspark.plans.registry import query
from tallyspark.sources.readers import saved

_AMOUNT = "CAST(floor(p_retailprice) AS BIGINT)"


def clauses(spark, d):
    """A clause for each part: a nightly cap of its price, sound or with the flaw that its key modulo 13 names."""
    amount = F.floor("p_retailprice").cast("decimal(20,4)")
    k = F.col("p_partkey") % 13
    digits = amount.cast("bigint").cast("string")
    limit = lambda x: F.struct(x.cast("decimal(20,4)").alias("amount"), F.lit("INR").alias("currency"), F.create_map().cast("map<string,array<string>>").alias("when"))
    condition = F.struct(F.lit("c1").alias("id"), F.lit("the number is shown").alias("text"), F.lit("requires").alias("kind"), F.array(F.lit("gstin_on_invoice"), F.lit("document_amount")).alias("depends_on"), F.lit(None).cast("decimal(20,4)").alias("value"))
    text = F.concat(F.lit("8.1. Nightly cap of "), digits, F.when(k == 11, F.concat(F.lit(" or "), (amount + 7).cast("bigint").cast("string"))).otherwise(F.lit("")), F.lit(" INR per night, Tier 1, see § 2.2."))
    return table(spark, d, "part").select(
        F.concat(F.lit("C"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("clause_id"),
        F.when(k == 10, "8.1. | L1 | by train |").otherwise(text).alias("text"),
        (k == 2).alias("synthesized"),
        (k == 1).alias("failed"),
        F.lit(False).alias("manual"),
        F.when(k == 3, "unknown").when(k == 4, "per_trip").when(k == 10, "none").otherwise("per_night").alias("limit_unit"),
        F.lit("amount").alias("limit_kind"),
        F.lit(True).alias("limit_inclusive"),
        F.when(k != 12, "Per night").alias("unit_evidence"),
        (k == 7).alias("is_prohibition"),
        F.when(k == 10, F.array().cast("array<struct<amount:decimal(20,4),currency:string,when:map<string,array<string>>>>")).when(k == 5, F.array(limit(amount + 1))).when(k == 11, F.array(limit(amount), limit(amount + 7))).otherwise(F.array(limit(amount))).alias("limits"),
        F.when(k == 8, F.array(condition)).otherwise(F.array().cast("array<struct<id:string,text:string,kind:string,depends_on:array<string>,value:decimal(20,4)>>")).alias("conditions"),
        F.array().cast("array<struct<item:string,min_amount:decimal(20,4)>>").alias("documents"),
        F.when(k == 6, F.create_map(F.lit("INR"), amount)).otherwise(F.create_map().cast("map<string,decimal(20,4)>")).alias("approval"),
        F.array(F.concat(F.lit("g"), F.when(k == 0, F.floor(F.col("p_partkey") / 26)).otherwise(-F.col("p_partkey")).cast("string"))).alias("applies_to"),
        F.when(k == 9, F.array(F.lit("fuel"))).otherwise(F.array().cast("array<string>")).alias("dropped"),
        F.lit(None).cast("string").alias("notes"),
    )


_ID = "'C' || lpad({}::VARCHAR, 9, '0')"
_FLAWS = "CASE p_partkey % 13 WHEN 1 THEN ['UNSTRUCTURED'] WHEN 2 THEN ['SYNTHESIZED_ID'] WHEN 3 THEN ['UNIT_UNDETERMINED'] WHEN 4 THEN ['UNIT_DISAGREES_WITH_TEXT'] WHEN 5 THEN ['NUMBER_NOT_IN_TEXT', 'UNCAPTURED_NUMBERS'] WHEN 6 THEN ['LIMIT_EQUALS_APPROVAL_THRESHOLD'] WHEN 7 THEN ['PROHIBITION_WITHOUT_TRIGGER'] WHEN 8 THEN ['STAGE1_GAP'] WHEN 9 THEN ['CATEGORY_SCOPE'] WHEN 10 THEN ['TABLE_NOT_STRUCTURED'] WHEN 11 THEN ['OVERLAP'] WHEN 12 THEN ['UNIT_UNDETERMINED'] ELSE [] END"


@query("L13_findings", f"""SELECT unnest({_FLAWS}) AS kind, {_ID.format('p_partkey')} AS clause_ids FROM part
  UNION ALL SELECT 'OVERLAP', {_ID.format('a.p_partkey')} || ',' || {_ID.format('b.p_partkey')} FROM part a JOIN part b ON a.p_partkey % 13 = 0 AND b.p_partkey % 13 = 0 AND a.p_partkey // 26 = b.p_partkey // 26 AND a.p_partkey < b.p_partkey AND floor(a.p_retailprice) <> floor(b.p_retailprice)""")
def findings(spark, d):
    return B.findings(clauses(spark, d)).select("kind", F.array_join("clause_ids", ",").alias("clause_ids"))


@query("L12_overlapping_limits", """WITH p AS (SELECT DISTINCT p_type, p_type || '/' || p_brand AS c, floor(p_retailprice / 5) AS a FROM part)
  SELECT DISTINCT x.c AS a_clause_id, y.c AS b_clause_id FROM p x JOIN p y ON x.p_type = y.p_type AND x.c <= y.c AND x.a <> y.a""")
def overlapping_clauses(spark, d):
    """Each clause and pair of clauses once, whose limits overlap."""
    return L.overlapping_limits(_priced(spark, d)).select("a_clause_id", "b_clause_id").distinct()


@query("J15_limit_overlaps", """WITH p AS (SELECT DISTINCT p_type, p_type || '/' || p_brand AS c, floor(p_retailprice / 5)::DECIMAL(12,2) AS a FROM part), r AS (SELECT *, (row_number() OVER (PARTITION BY c ORDER BY a) - 1)::INT AS k FROM p)
  SELECT x.c AS a_clause_id, x.k AS a_k, y.c AS b_clause_id, y.k AS b_k FROM r x JOIN r y ON x.p_type = y.p_type AND (x.c < y.c OR x.c = y.c AND x.k < y.k) AND x.a <> y.a""")
def limit_overlaps(spark, d):
    return L.overlapping_limits(_priced(spark, d))


def _priced(spark, d):
    """Each brand's part type is a clause with all its prices, in steps of 5, as limits; the types are the categories."""
    prices = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.sort_array(F.collect_set(F.floor(F.col("p_retailprice") / 5).cast("decimal(12,2)"))).alias("a"))
    limit = lambda x: F.struct(x.alias("amount"), F.lit("INR").alias("currency"), F.create_map().cast("map<string,array<string>>").alias("when"))
    return prices.select(F.concat_ws("/", "p_type", "p_brand").alias("clause_id"), F.lit("per_item").alias("limit_unit"), F.array("p_type").alias("applies_to"), F.transform("a", limit).alias("limits"))


#: Stored entries, one for each flaw, with <N> for the part's price; and the places of their problems.
_ENTRIES = (
    ('{"limit_unit":"per_night","limit_kind":"amount","applies_to_categories":["fuel"],"limit_table":[{"amount":<N>,"currency":"INR","when":{"grade":["L1"],"zone":"A"}}],"conditions":[{"id":"c1","text":"t","kind":"requires","check":"judgment","depends_on":["bill_date"]}],"documentation_required":[{"item":"invoice","min_amount":{"INR":5}}],"requires_approval_above":{"INR":<N>}}', ()),
    ('{"limit_unit":"per_fortnight","limit_kind":null,"applies_to_categories":"fuel","limit_table":[],"x":<N>}', ("limit_unit", "applies_to_categories")),
    ('{"limit_unit":"none","limit_kind":"weekly","applies_to_categories":["*"],"limit_table":[{"amount":"<N>"}]}', ("limit_kind",)),
    ('{"limit_unit":"per_day","applies_to_categories":["nowhere"],"limit_table":["<N>",{"amount":"abc","when":3},{"amount":true}]}', ("applies_to_categories", "limit_table[0]", "limit_table[1].amount", "limit_table[1].when", "limit_table[2].amount")),
    ('{"limit_unit":"none","applies_to_categories":[],"conditions":[{"id":"c1"},{"id":"c1","text":"<N>","kind":"may","check":"guess","depends_on":["nope"]}]}', ("conditions[0]", "conditions[1].kind", "conditions[1].depends_on", "conditions[1].check")),
    ('{"limit_unit":"none","applies_to_categories":[],"conditions":[{"id":"a","text":"<N>","kind":"requires","check":"judgment"},{"id":"a","text":"t","kind":"requires","check":"numeric","numeric":{"quantity":"mood","op":">"}}]}', ("conditions[1].numeric", "conditions[1].id")),
    ('{"limit_unit":"none","applies_to_categories":[],"conditions":[{"id":"c1","text":"<N>","kind":"excludes","any_of":[{"id":"c1a","text":"t","check":"numeric","numeric":{"quantity":"amount","op":"<=","value":"x"}},{"id":"c1b"},{"id":"c1","text":"t","check":"judgment"}]}]}', ("conditions[0].any_of[0].numeric.value", "conditions[0].any_of[1]", "conditions[0].any_of[2].id")),
    ('{"limit_unit":"none","applies_to_categories":[],"documentation_required":[{"min_amount":<N>},{"item":"bill","min_amount":{"INR":"x"}}],"requires_approval_above":[]}', ("documentation_required[0]", "documentation_required[1].min_amount", "requires_approval_above")),
    ("entry <N>", ("entry",)),
)


@query("L14_schema_problems", "SELECT p_partkey, unnest(CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {list(p)}::VARCHAR[]" for k, (_, p) in enumerate(_ENTRIES)) + " END) AS problem FROM part")
def schema_problems(spark, d):
    """Every problem of an entry is listed, not only the first."""
    raw = F.element_at(F.array(*[F.lit(x) for x, _ in _ENTRIES]), (F.col("p_partkey") % len(_ENTRIES) + 1).cast("int"))
    entries = table(spark, d, "part").select("p_partkey", F.replace(raw, F.lit("<N>"), F.floor("p_retailprice").cast("string")).alias("entry"))
    return B.schema_problems(entries, "p_partkey", "entry", ["fuel", "accommodation"])


_K = "c_custkey % 4"


@query("L18_reference_tables", """SELECT c_custkey, unnest(CASE WHEN c_custkey % 4 = 3 THEN ['grade'] ELSE ['grade', 'grade', 'city', 'city', 'city', 'country', 'country', 'country', 'country', 'open_group'] END) AS kind,
  unnest(CASE WHEN c_custkey % 4 = 3 THEN ['L7'] ELSE ['L1', 'L2', 'mumbai', 'new town ' || c_custkey, 'jaipur', 'usa', 'france', 'land ' || c_custkey, 'japan', 'Western Europe'] END) AS name,
  unnest(CASE WHEN c_custkey % 4 = 3 THEN ['1'] ELSE ['1', '2', '1', '1', '2', 'A', 'A', 'A', 'A', 'A'] END) AS value FROM customer""")
def reference_tables(spark, d):
    """Grades, tiers and zones out of the pipe tables of a text for each customer."""
    number = F.col("c_custkey").cast("string")
    full = F.concat(F.lit("## Tables\n\n| Grade | Title |\n|---|---|\n| L1 | Associate |\n| L2 | Lead |\n\n| Tier | Cities |\n| :-- | --- |\n| Tier 1 | Mumbai, New Town "), number, F.lit(" |\n| Tier 2 | Jaipur |\n| Tier 3 | All other places |\n\ntext | with a bar\n| Zone | Destinations |\n|---|---|\n| Zone A | USA, Western Europe (France, Land "), number, F.lit(", etc.), Japan |\n| Zone B | All others |"))
    texts = table(spark, d, "customer").select("c_custkey", F.when(F.expr(f"{_K} = 3"), "| L7 | Chief |").otherwise(full).alias("text"))
    return B.reference_tables(texts, "c_custkey", "text")


@query("L18_table_rows", "SELECT doc_id, n AS n_rows FROM (SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: starts_with(x, '|') AND NOT regexp_matches(x, '^\\|[\\s|-]+\\|?$')))::BIGINT AS n FROM (SELECT doc_id, replace(text, ' | ', chr(10) || '| ') AS text FROM documents)) WHERE n > 0")
def table_rows(spark, d):
    """Rows of the documents' lists, laid out as tables."""
    texts = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" | "), F.lit("\n| ")).alias("text"))
    return B.table_rows(texts, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("A16_limit_summary", """SELECT p_type || '/' || p_brand AS clause_id, count(DISTINCT floor(p_retailprice / 5))::INT AS n_limits, min(floor(p_retailprice / 5))::DECIMAL(12,2) AS least, max(floor(p_retailprice / 5))::DECIMAL(12,2) AS most, 'INR' AS currencies, '' AS dimensions FROM part GROUP BY 1
  UNION ALL SELECT 'L-NONE', 0, NULL, NULL, '', '' UNION ALL SELECT 'L-NIGHT', 3, 70, 900, 'INR/USD', 'tier'""")
def limit_summary(spark, d):
    from tallyspark.plans.policy import clauses as few

    listed = few(spark).where("clause_id IN ('L-NONE', 'L-NIGHT')").select("clause_id", "limits", "limit_inclusive")
    return B.limit_summary(_priced(spark, d).select("clause_id", "limits", F.lit(True).alias("limit_inclusive")).unionByName(listed)).drop("limit_inclusive")


@query("P49_clause_round_trip", f"SELECT {_ID.format('p_partkey')} AS clause_id, CASE WHEN p_partkey % 13 NOT IN (10, 11) THEN ({_AMOUNT} + CASE WHEN p_partkey % 13 = 5 THEN 1 ELSE 0 END)::DECIMAL(20,4) END AS limit_amount, CASE p_partkey % 13 WHEN 10 THEN 0 WHEN 11 THEN 2 ELSE 1 END::INT AS n_limits, true AS same FROM part")
def clause_round_trip(spark, d):
    """To JSON and back; the only limit of a clause is its scalar limit."""
    before = clauses(spark, d)
    back = B.from_json(B.to_json(before))
    digest = F.sha2(F.to_json(F.struct(*before.columns)), 256)
    both = back.select("clause_id", "limit_amount", F.size("limits").alias("n_limits"), digest.alias("a")).join(before.select("clause_id", digest.alias("b")), "clause_id")
    return both.select("clause_id", "limit_amount", "n_limits", (F.col("a") == F.col("b")).alias("same"))


@query("L11_days_since_expense", f"WITH {DOCS} SELECT document_id, CASE WHEN bill_date - created_on >= 0 THEN (bill_date - created_on)::INT END AS days FROM docs")
def days_since(spark, d):
    days = F.datediff("bill_date", "created_on")
    return docs(spark, d).select("document_id", F.when(days >= 0, days).alias("days"))


@query("L11_facts", f"""WITH {DOCS}, {_PEERS}, c AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderstatus = 'F' THEN (o_orderdate + INTERVAL 200 DAY)::DATE END AS submitted_on, CASE WHEN o_orderpriority LIKE '1%' THEN 'agreed' ELSE ' ' END AS note FROM orders),
  a AS (SELECT claim_id, count(*) AS n FROM docs WHERE currency IS NULL GROUP BY 1)
  SELECT d.document_id, CASE WHEN employee_id % 7 > 0 THEN 'L' || employee_id % 7 END AS grade, nullif(employee_id % 7, 0)::INT AS grade_rank, coalesce(submitted_on, DATE '1999-06-01') - bill_date AS days_since_expense, trim(note) <> '' OR coalesce(n, 0) > CASE WHEN currency IS NULL THEN 1 ELSE 0 END AS approval_evidenced, n_peers, peers_total
  FROM docs d JOIN c USING (claim_id) LEFT JOIN a USING (claim_id) LEFT JOIN peers p ON p.document_id = d.document_id""")
def facts(spark, d):
    """Grade and its rank, days since the expense, evidence of approval and the month's peers of each latest document. Documents are made once, for themselves and their decisions."""
    made = saved(docs(spark, d).select("document_id", "claim_id", "employee_id", "category", "currency", "amount", "bill_date", "doc_status", "claim_status"))
    rows = made.withColumn("document_type", F.when(F.col("currency").isNull(), "approval_correspondence").otherwise("generic_receipt")).withColumn("clause_id", F.concat(F.lit("C"), (F.col("document_id") % 2).cast("string")))
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("employee_id"), F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), 200)).alias("submitted_on"), F.when(F.col("o_orderpriority").startswith("1"), "agreed").otherwise(" ").alias("note"))
    employees = table(spark, d, "customer").select(F.col("c_custkey").alias("employee_id"), F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit(" l"), (F.col("c_custkey") % 7).cast("string"), F.lit(" "))).alias("grade"))
    found = L.facts(rows, claims, employees, decisions(made), F.lit("1999-06-01").cast("date"), tuple(f"L{k}" for k in range(1, 7)))
    return found.select("document_id", "grade", "grade_rank", "days_since_expense", "approval_evidenced", "n_peers", "peers_total")
