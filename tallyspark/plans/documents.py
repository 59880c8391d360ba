"""Queries for document checks: documents built from line items, with every type, missing values and broken sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import documents as Q
from tallyspark.plans.proxy import table
from tallyspark.plans.registry import query

_D = "decimal(20,4)"
_TYPES = ("telecom_bill", "restaurant_bill", "local_conveyance_form", "generic_receipt", "approval_correspondence")
_KIND = "CASE l_suppkey % 5 WHEN 0 THEN 'telecom_bill' WHEN 1 THEN 'restaurant_bill' WHEN 2 THEN 'local_conveyance_form' WHEN 3 THEN 'generic_receipt' ELSE 'approval_correspondence' END"


def claims(spark, d):
    dec = lambda e: F.expr(e).cast(_D)
    off = "(CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.4 WHEN 2 THEN 5 ELSE 0 END)"
    rows = table(spark, d, "lineitem").withColumns({"q": dec("l_quantity"), "p": dec("l_extendedprice")})
    text = F.concat(F.when(F.col("l_partkey") % 3 == 0, "Round off 0.4\n").otherwise(""), F.lit("Sum "), F.when(F.col("l_partkey") % 5 < 3, (F.col("q") + F.col("p")).cast("decimal(20,2)").cast("string")).otherwise("unreadable"))
    total = (F.col("q") + F.col("p") + F.expr(off).cast(_D)).cast(_D)
    fields = F.when(F.col("l_linenumber") == 1, F.create_map(F.lit("GSTIN No"), F.when(F.col("l_partkey") % 2 == 0, "27ABCDE1234F1Z5").otherwise("bad"))).when(F.col("l_linenumber") == 2, F.create_map(F.lit("Sales tax"), F.col("q").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    null = F.lit(None).cast(_D)
    return rows.select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey)").alias("document_id"), F.expr(_KIND).alias("document_type"), text.alias("text"), fields.alias("fields"),
        F.when(F.col("l_linenumber") < 6, F.col("p")).alias("subtotal"), F.when(F.col("l_linenumber") != 2, F.col("q")).alias("tax"), total.alias("total"), F.col("q").alias("cgst"), F.lit(0).cast(_D).alias("sgst"), total.alias("grand_total"), F.when(F.col("l_linenumber") < 7, total).alias("amount"),
        (F.col("q") * 2).cast(_D).alias("total_kms"), F.when(F.col("l_partkey") % 7 > 0, F.col("q")).alias("total_conveyance_amount"), F.col("p").alias("daily_allowance_amount"), null.alias("vehicle_maintenance_amount"), null.alias("mobile_allowance_amount"), total.alias("total_claimed"),
        F.array(F.struct(F.lit("item").alias("name"), F.col("p").alias("total")), F.struct(F.lit("Service charge").alias("name"), F.when(F.col("l_partkey") % 2 == 0, F.col("q")).alias("total"))).alias("line_items"),
        F.when(F.col("l_partkey") % 6 == 0, F.array(F.lit("x"))).otherwise(F.array(F.col("q").cast("string"), F.when(F.col("l_partkey") % 6 > 2, F.col("q").cast("string")), F.lit("n/a"))).alias("kms"), F.col("l_discount").alias("confidence"),
    )


_SQL = f"""c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS document_id, {_KIND} AS document_type, l_linenumber AS ln, l_partkey AS pk, l_quantity::DECIMAL(20,4) AS q, l_extendedprice::DECIMAL(20,4) AS p,
  (l_quantity::DECIMAL(12,2) + l_extendedprice::DECIMAL(12,2) + CASE l_partkey % 4 WHEN 1 THEN 0.4 WHEN 2 THEN 5 ELSE 0 END)::DECIMAL(20,4) AS t, CASE WHEN l_partkey % 3 = 0 THEN 1.00 ELSE 0.01 END::DECIMAL(4,2) AS tol, l_discount FROM lineitem),
f AS (SELECT *, CASE WHEN ln < 6 THEN p END AS subtotal, q AS tax_any, CASE WHEN ln < 7 THEN t END AS amount, CASE WHEN pk % 6 = 0 THEN NULL WHEN pk % 6 > 2 THEN 2 * q ELSE q END AS kms, CASE WHEN pk % 7 > 0 THEN q END AS conv FROM c),
g AS (SELECT document_id, 'gstin_format:GSTIN No' AS name, pk % 2 = 0 AS passed FROM f WHERE ln = 1),
tele AS (SELECT document_id, 'subtotal + tax == total' AS name, coalesce(ln <> 2 AND abs(subtotal + q - t) <= tol, false) AS passed FROM f WHERE document_type = 'telecom_bill'),
rest AS (SELECT document_id, 'subtotal + cgst + sgst == grand_total' AS name, coalesce(abs(subtotal + q - t) <= tol, false) AS passed FROM f WHERE document_type = 'restaurant_bill'),
conv AS (SELECT document_id, CASE WHEN kms IS NULL THEN 'sum(travel_entries.kms) computed' ELSE 'sum(travel_entries.kms) == total_kms' END AS name, coalesce(abs(kms - 2 * q) <= 1, false) AS passed FROM f WHERE document_type = 'local_conveyance_form'
  UNION ALL SELECT document_id, 'conveyance_amount + daily_allowance + vehicle_maintenance + mobile_allowance == total_claimed', abs(coalesce(conv, 0) + p - t) <= tol FROM f WHERE document_type = 'local_conveyance_form' AND kms IS NOT NULL),
gen AS (SELECT document_id, 'subtotal + tax == amount' AS name, abs(subtotal + q - amount) <= tol AS passed FROM f WHERE document_type = 'generic_receipt' AND subtotal IS NOT NULL AND amount IS NOT NULL
  UNION ALL SELECT document_id, 'sum(line items) == subtotal or amount', coalesce(abs(p + CASE WHEN pk % 2 = 0 THEN q ELSE 0 END - subtotal) <= tol, false) OR coalesce(abs(p + CASE WHEN pk % 2 = 0 THEN q ELSE 0 END - amount) <= tol, false) FROM f WHERE document_type = 'generic_receipt' AND (subtotal IS NOT NULL OR amount IS NOT NULL)),
checks AS (SELECT * FROM tele UNION ALL SELECT * FROM rest UNION ALL SELECT * FROM conv UNION ALL SELECT * FROM gen UNION ALL SELECT * FROM g)"""


@query("Q1_checks", f"WITH {_SQL} SELECT document_id, name, passed FROM checks")
def checks(spark, d):
    return Q.check_rows(claims(spark, d))


def _of(kind: str):
    return lambda spark, d: Q.check_rows(claims(spark, d).where(F.col("document_type") == kind)).where(Q.arithmetic(F.col("name")))


query("Q2_telecom", f"WITH {_SQL} SELECT * FROM tele")(_of("telecom_bill"))
query("Q3_restaurant", f"WITH {_SQL} SELECT * FROM rest")(_of("restaurant_bill"))
query("Q4_conveyance", f"WITH {_SQL} SELECT * FROM conv")(_of("local_conveyance_form"))
query("Q6_generic", f"WITH {_SQL} SELECT * FROM gen")(_of("generic_receipt"))


@query("Q5_conveyance_balance", f"WITH {_SQL} SELECT document_id, passed FROM conv WHERE name LIKE 'conveyance%'")
def conveyance_balance(spark, d):
    return Q.check_rows(claims(spark, d).where("document_type = 'local_conveyance_form'")).where("startswith(name, 'conveyance')").select("document_id", "passed")


@query("Q7_item_sum", f"WITH {_SQL} SELECT document_id, passed FROM gen WHERE name LIKE 'sum%'")
def item_sum(spark, d):
    return Q.check_rows(claims(spark, d).where("document_type = 'generic_receipt'")).where("startswith(name, 'sum')").select("document_id", "passed")


@query("Q8_gstin", f"WITH {_SQL} SELECT * FROM g")
def gstin(spark, d):
    return Q.check_rows(claims(spark, d)).where(~Q.arithmetic(F.col("name")))


@query("F4_failing_arithmetic", f"WITH {_SQL} SELECT document_id, count(*) AS failing FROM checks WHERE name NOT LIKE 'gstin_format:%' AND NOT passed GROUP BY 1")
def failing_arithmetic(spark, d):
    return Q.check_rows(claims(spark, d)).where(Q.arithmetic(F.col("name")) & ~F.col("passed")).groupBy("document_id").agg(F.count(F.lit(1)).alias("failing"))


@query("Q9_moved_charges", f"WITH {_SQL} SELECT document_id, 1::BIGINT AS n_items, CASE WHEN ln <> 2 THEN q WHEN pk % 2 = 0 THEN q END AS tax, (CASE WHEN ln IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN ln <> 2 AND pk % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_fields FROM f")
def moved_charges(spark, d):
    return Q.move_charges(claims(spark, d)).select("document_id", F.size("line_items").cast("long").alias("n_items"), "tax", F.size("fields").cast("long").alias("n_fields"))


_PRINTED = "pk % 5 < 3"


_FIX = f"""SELECT document_id, 'total' AS field, subtotal + q AS suggested FROM f WHERE document_type = 'telecom_bill' AND ln <> 2 AND abs(subtotal + q - t) > tol AND {_PRINTED}
  UNION ALL SELECT document_id, 'amount', subtotal + q FROM f WHERE document_type = 'generic_receipt' AND abs(subtotal + q - amount) > tol AND {_PRINTED}"""
_FIX_BILL = f"SELECT document_id, 'grand_total' AS field, subtotal + q AS suggested FROM f WHERE document_type = 'restaurant_bill' AND abs(subtotal + q - t) > tol AND {_PRINTED}"


def _stands(v: str) -> str:
    """SQL: whether a number below 1000 stands in the document's text x."""
    text = f"({v})::DECIMAL(20,2)::VARCHAR"
    return f"regexp_matches(x, '(^|[^0-9])' || split_part({text}, '.', 1) || CASE WHEN split_part({text}, '.', 2) = '00' THEN '(\\.00)?' ELSE '\\.' || split_part({text}, '.', 2) END || '([^0-9]|$)')"


_TEXTS = f"(SELECT *, CASE WHEN pk % 3 = 0 THEN 'Round off 0.4' || chr(10) ELSE '' END || 'Sum ' || CASE WHEN {_PRINTED} THEN (q + p)::DECIMAL(20,2)::VARCHAR ELSE 'unreadable' END AS x FROM f WHERE document_type = 'local_conveyance_form')"
_FIX_TRIP = f"""SELECT document_id, 'total_kms' AS field, kms AS suggested FROM {_TEXTS} WHERE abs(kms - 2 * q) > tol AND {_stands('kms')}
  UNION ALL SELECT document_id, 'total_conveyance_amount', t - p FROM {_TEXTS} WHERE coalesce(abs(t - p - conv) > tol, true) AND {_stands('t - p')}"""


@query("Q12_suggestions", f"WITH {_SQL} {_FIX}")
def suggestions(spark, d):
    return Q.suggestion_rows(claims(spark, d).where("document_type IN ('telecom_bill', 'generic_receipt')"))


@query("Q13_restaurant_fix", f"WITH {_SQL} {_FIX_BILL}")
def restaurant_fix(spark, d):
    return Q.suggestion_rows(claims(spark, d).where("document_type = 'restaurant_bill'"))


@query("Q14_conveyance_fix", f"WITH {_SQL} {_FIX_TRIP}")
def conveyance_fix(spark, d):
    return Q.suggestion_rows(claims(spark, d).where("document_type = 'local_conveyance_form'"))


@query("Q16_needs_review", f"WITH {_SQL}, bad AS (SELECT document_id, count(*) FILTER (NOT passed AND name NOT LIKE 'gstin_format:%') AS n FROM checks GROUP BY 1) SELECT document_id, coalesce(n, 0) > 0 OR document_type <> 'approval_correspondence' AND l_discount < 0.85 AS needs_review FROM f LEFT JOIN bad USING (document_id)")
def needs_review(spark, d):
    rows = claims(spark, d)
    return Q.needs_review(Q.check_rows(rows), rows)


#: Documents may repeat; here every row counts for itself.
_ROWS = _SQL.replace("c AS (", "c AS MATERIALIZED (", 1).replace("l_partkey AS document_id", "l_partkey || '#' || row_number() OVER () AS document_id")


@query("Q17_bundle", f"""WITH {_ROWS}, fixes AS ({_FIX} UNION ALL {_FIX_BILL} UNION ALL {_FIX_TRIP}), n AS (SELECT document_id, count(*) AS n_suggestions FROM fixes GROUP BY 1),
  k AS (SELECT document_id, count(*) AS n_checks, bool_or(NOT passed AND name NOT LIKE 'gstin_format:%') AS failing FROM checks GROUP BY 1)
  SELECT split_part(document_id, '#', 1) AS document_id, coalesce(n_checks, 0)::INT AS n_checks, coalesce(n_suggestions, 0)::INT AS n_suggestions, CASE WHEN failing THEN 'needs_review' ELSE 'ready' END AS status FROM f LEFT JOIN k USING (document_id) LEFT JOIN n USING (document_id)""")
def bundle(spark, d):
    """Checks, suggestions and status of each document in one projection."""
    rows = Q.prepared(claims(spark, d)).select("document_id", Q.checks_of().alias("checks"), Q.suggestions_of().alias("suggestions"))
    failing = F.exists("checks", lambda c: Q.arithmetic(c["name"]) & ~c["passed"])
    return rows.select("document_id", F.size("checks").alias("n_checks"), F.size("suggestions").alias("n_suggestions"), F.when(failing, "needs_review").otherwise("ready").alias("status"))


@query("Q18_better_attempt", "SELECT l_orderkey AS document_id, CASE WHEN count(*) FILTER (l_linenumber % 2 = 0 AND l_discount > 0.05) > count(*) FILTER (l_linenumber % 2 = 1 AND l_discount > 0.05) THEN 2 ELSE 1 END AS chosen FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 2) = 2")
def better_attempt(spark, d):
    attempt = F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(1).alias("attempt")
    tries = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), attempt).agg(F.count_if(F.col("l_discount") > 0.05).alias("passed"))
    both = tries.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("document_id")
    return Q.better_attempt(tries.join(both, "document_id"))


@query("Q10_item_amounts", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(20,4)) AS first, l_partkey % 3 = 0 AS noted FROM lineitem")
def item_amounts(spark, d):
    """Amounts inside items parsed, with a note where one is not readable."""
    from tallyspark.functions import scalars as S

    items = F.array(F.struct(F.lit("a").alias("name"), F.concat(F.lit("Rs. "), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("total")), F.struct(F.lit("b").alias("name"), F.when(F.col("l_partkey") % 3 == 0, "RM 5").otherwise("5").alias("total")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", items.alias("raw"))
    rows = rows.withColumn("amounts", S.amounts_read(F.transform("raw", lambda i: i["total"])))
    rows = rows.withColumn("items", F.zip_with("raw", "amounts", lambda i, a: i.withField("total", a["value"])))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("items")[0]["total"].alias("first"), F.exists("amounts", lambda a: a["unparseable"]).alias("noted"))


@query("Q11_typed_claims", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END::DECIMAL(20,4) AS amount, CASE WHEN l_partkey % 2 = 0 THEN 'USD' ELSE 'INR' END AS currency, l_partkey % 5 = 0 AS fallback FROM lineitem")
def typed_claims(spark, d):
    """Every amount parsed and the currency resolved in one projection; what can't be read falls back."""
    from tallyspark.functions import scalars as S

    printed = F.when(F.col("l_partkey") % 5 == 0, "five").otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    text = F.when(F.col("l_partkey") % 2 == 0, "total $").otherwise("total")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.parse_amount(printed).alias("amount"), S.resolve_currency(F.lit(None).cast("string"), text).alias("currency"), S.amount_unparseable(printed).alias("fallback"))


@query("Q15_dropped_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 > 0 THEN 1 ELSE 0 END::BIGINT AS n_dropped FROM lineitem")
def dropped_numbers(spark, d):
    """Numbers on a labelled line that nothing captured; dates are no numbers."""
    from tallyspark.functions import scalars as S

    text = F.concat(F.lit("Form\nTotal  KMs on 12/03/2026: "), F.col("l_partkey").cast("string"), F.lit("\nend"))
    line = F.regexp_replace(S.line_with(text, F.lit("total kms")), r"\b\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\b", "")
    captured = F.when(F.col("l_partkey") % 3 == 0, F.array(F.col("l_partkey").cast("decimal(30,4)"))).otherwise(F.array().cast("array<decimal(30,4)>"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.size(F.array_except(S.numbers_in(line), captured)).cast("long").alias("n_dropped"))


@query("P48_pruned_pages", "SELECT conv_id, count(*) AS n_pages FROM conversations GROUP BY 1")
def pruned_pages(spark, d):
    """Page records without their layout fields."""
    page = F.struct("turn", F.col("text").alias("markdown"), F.lit("[0,0]").alias("layout"), F.lit("img").alias("image"))
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(page).alias("pages"))
    slim = pages.withColumn("pages", F.transform("pages", lambda p: p.dropFields("layout", "image")))
    return slim.select("conv_id", F.size("pages").cast("long").alias("n_pages"))


@query("D10_dry_run", f"WITH {_SQL} SELECT * FROM tele")
def dry_run(spark, d):
    """The checks that an edit set would give, with nothing stored."""
    rows = claims(spark, d).where("document_type = 'telecom_bill'")
    return Q.check_rows(rows).where(Q.arithmetic(F.col("name")))
