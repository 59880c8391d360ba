"""Arithmetic checks of documents, suggested fixes and review flags.

claims: document_id, document_type, text, fields map<string,string> (additional fields), amounts as columns (subtotal, tax,
total, cgst, sgst, grand_total, amount, total_kms, total_conveyance_amount, daily_allowance_amount,
vehicle_maintenance_amount, mobile_allowance_amount, total_claimed), line_items array<struct<name,total>>, kms array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S

_D = "decimal(20,4)"
_CHECKS = "array<struct<name:string,passed:boolean>>"


def _check(name: str, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"))


def _tolerance() -> Column:
    return S.tolerance(S.roundoff_evidence(F.col("text"), F.col("fields")))


def _from_fields(pattern: str) -> Column:
    return S.first_amount(F.map_entries("fields"), pattern)


def kms_sum() -> Column:
    """The sum of the parseable distances, null if there is none."""
    found = F.array_compact(S.parse_amounts(F.col("kms")))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast(_D), lambda a, x: (a + x).cast(_D)))


def prepared(claims: DataFrame) -> DataFrame:
    """claims with what several checks and fixes share, each computed once: _tolerance, _kms (forms only), _subtotal, _tax, _target (named fields before additional ones; types without checks of their own only)."""
    own = F.col("document_type").isin("telecom_bill", "restaurant_bill", "local_conveyance_form", "approval_correspondence")
    other = ~F.coalesce(own, F.lit(False))
    return claims.withColumns({
        "_tolerance": _tolerance(),
        "_kms": F.when(F.col("document_type") == "local_conveyance_form", kms_sum()),
        "_subtotal": F.when(other, F.coalesce("subtotal", _from_fields("subtotal"))),
        "_tax": F.when(other, F.coalesce("tax", _from_fields("tax"))),
        "_target": F.when(other, F.coalesce("amount", _from_fields("total"))),
    })


def telecom_check() -> Column:
    return F.array(_check("subtotal + tax == total", F.coalesce(S.close(F.col("subtotal") + F.col("tax"), F.col("total"), F.col("_tolerance")), F.lit(False))))


def restaurant_check() -> Column:
    return F.array(_check("subtotal + cgst + sgst == grand_total", F.coalesce(S.close(F.col("subtotal") + F.col("cgst") + F.col("sgst"), F.col("grand_total"), F.col("_tolerance")), F.lit(False))))


def conveyance_checks() -> Column:
    """Without any distance only the first check, failed; its tolerance is 1. A sum that fits the amount instead of the distance is a suspected swap."""
    s, one = F.col("_kms"), F.lit(1)
    kms = F.coalesce(S.close(s, F.col("total_kms"), one), F.lit(False))
    parts = [F.col(c) for c in ("total_conveyance_amount", "daily_allowance_amount", "vehicle_maintenance_amount", "mobile_allowance_amount")]
    total = sum((F.coalesce(p, F.lit(0).cast(_D)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0).cast(_D)))
    balanced = F.coalesce(F.coalesce(*parts).isNotNull() & S.close(total, F.col("total_claimed"), F.col("_tolerance")), F.lit(False))
    full = F.array(_check("sum(travel_entries.kms) == total_kms", kms), _check("conveyance_amount + daily_allowance + vehicle_maintenance + mobile_allowance == total_claimed", balanced))
    return F.when(s.isNull(), F.array(_check("sum(travel_entries.kms) computed", F.lit(False)))).otherwise(full)


def swap_suspected() -> Column:
    s, one = kms_sum(), F.lit(1)
    return F.coalesce(S.close(s, F.col("total_conveyance_amount"), one), F.lit(False)) & ~F.coalesce(S.close(s, F.col("total_kms"), one), F.lit(False))


def generic_checks() -> Column:
    """Checks whose inputs are absent give no row; named fields come before additional ones."""
    subtotal, tax, target = F.col("_subtotal"), F.col("_tax"), F.col("_target")
    totals = F.filter(F.transform("line_items", lambda i: i["total"]), lambda x: x.isNotNull())
    items = F.aggregate(totals, F.lit(0).cast(_D), lambda a, x: (a + x).cast(_D))
    first = F.when(subtotal.isNotNull() & tax.isNotNull() & target.isNotNull(), _check("subtotal + tax == amount", S.close(subtotal + tax, target, F.col("_tolerance"))))
    matches = F.coalesce(S.close(items, subtotal, F.col("_tolerance")), F.lit(False)) | F.coalesce(S.close(items, target, F.col("_tolerance")), F.lit(False))
    second = F.when((F.size(totals) > 0) & (subtotal.isNotNull() | target.isNotNull()), _check("sum(line items) == subtotal or amount", matches))
    return F.array_compact(F.array(first, second))


def gstin_checks() -> Column:
    tax_ids = F.filter(F.map_entries("fields"), lambda e: e["key"].rlike("(?i)gstin|gst_no"))
    return F.transform(tax_ids, lambda e: F.struct(F.concat(F.lit("gstin_format:"), e["key"]).alias("name"), S.gstin_valid(e["value"]).alias("passed")))


def checks_of() -> Column:
    """The checks of a row of prepared()."""
    kind = F.col("document_type")
    own = F.when(kind == "telecom_bill", telecom_check()).when(kind == "restaurant_bill", restaurant_check()).when(kind == "local_conveyance_form", conveyance_checks()).when(kind == "approval_correspondence", F.array().cast(_CHECKS)).otherwise(generic_checks())
    return F.concat(own, F.coalesce(gstin_checks(), F.array().cast(_CHECKS)))


def check_rows(claims: DataFrame) -> DataFrame:
    """One row per document and check."""
    return prepared(claims).select("document_id", F.explode(checks_of()).alias("c")).select("document_id", "c.name", "c.passed")


def arithmetic(name: Column) -> Column:
    return ~name.startswith("gstin_format:")


def _fix(when: Column, field: str, value: Column) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), value.cast(_D).alias("suggested")))


def _total_or_tax(subtotal: Column, tax: Column, total: Column, field: str) -> Column:
    """The total if subtotal + tax is printed, else the tax if the difference is."""
    off = F.coalesce(~S.close(subtotal + tax, total, F.col("_tolerance")), F.lit(False))
    sum_printed = S.printed_on(subtotal + tax, F.col("text"))
    return F.coalesce(_fix(off & sum_printed, field, subtotal + tax), _fix(off & ~sum_printed & S.printed_on(total - subtotal, F.col("text")), "tax", total - subtotal))


def suggestions_of() -> Column:
    """For a row of prepared(): fixes of failing checks whose number is itself printed on the document; distances use the money tolerance here, not 1."""
    kind, text = F.col("document_type"), F.col("text")
    telecom = F.array(_total_or_tax(F.col("subtotal"), F.col("tax"), F.col("total"), "total"))
    generic = F.array(_total_or_tax(F.col("_subtotal"), F.col("_tax"), F.col("amount"), "amount"))
    bill = F.col("subtotal") + F.col("cgst") + F.col("sgst")
    restaurant = F.array(_fix(F.coalesce(~S.close(bill, F.col("grand_total"), F.col("_tolerance")), F.lit(False)) & S.printed_on(bill, text), "grand_total", bill))
    s = F.col("_kms")
    rest = F.col("total_claimed") - sum((F.coalesce(c, F.lit(0).cast(_D)) for c in ("vehicle_maintenance_amount", "mobile_allowance_amount")), F.coalesce("daily_allowance_amount", F.lit(0).cast(_D)))
    fits = lambda a, b: F.coalesce(S.close(a, F.col(b), F.col("_tolerance")), F.lit(False))
    conveyance = F.array(_fix(s.isNotNull() & ~fits(s, "total_kms") & S.printed_on(s, text), "total_kms", s), _fix((rest >= 0) & ~fits(rest, "total_conveyance_amount") & S.printed_on(rest, text), "total_conveyance_amount", rest))
    chosen = F.when(kind == "telecom_bill", telecom).when(kind == "restaurant_bill", restaurant).when(kind == "local_conveyance_form", conveyance).when(kind == "approval_correspondence", None).otherwise(generic)
    return F.array_compact(F.coalesce(chosen, F.array().cast("array<struct<field:string,suggested:decimal(20,4)>>")))


def suggestion_rows(claims: DataFrame) -> DataFrame:
    return prepared(claims).select("document_id", F.explode(suggestions_of()).alias("s")).select("document_id", "s.field", "s.suggested")


def move_charges(claims: DataFrame) -> DataFrame:
    """Items that are charges leave line_items: the first into an empty tax, the others into fields; those without an amount are dropped."""
    charge = F.filter("line_items", lambda i: S.charge_like(i["name"]))
    keep = F.filter("line_items", lambda i: ~S.charge_like(i["name"]))
    rows = claims.withColumn("_charges", F.filter(charge, lambda i: i["total"].isNotNull())).withColumn("line_items", keep)
    to_tax = F.col("tax").isNull() & (F.size("_charges") > 0)
    rest = F.when(to_tax, F.slice("_charges", 2, F.greatest(F.size("_charges") - 1, F.lit(0)))).otherwise(F.col("_charges"))
    added = F.map_from_entries(F.transform(rest, lambda i: F.struct(i["name"], i["total"].cast("string"))))
    rows = rows.withColumn("fields", F.map_concat("fields", added)).withColumn("tax", F.when(to_tax, F.try_element_at(F.col("_charges"), F.lit(1))["total"]).otherwise(F.col("tax")))
    return rows.drop("_charges")


def needs_review(checks: DataFrame, claims: DataFrame) -> DataFrame:
    """A failing arithmetic check, or low confidence on a document that needs confirming."""
    failing = checks.where(arithmetic(F.col("name"))).groupBy("document_id").agg(F.count_if(~F.col("passed")).alias("failing"))
    joined = claims.select("document_id", "document_type", "confidence").join(failing, "document_id", "left")
    low = (F.col("document_type") != "approval_correspondence") & F.coalesce(F.col("confidence") < 0.85, F.lit(False))
    return joined.select("document_id", (low | (F.coalesce("failing", F.lit(0)) > 0)).alias("needs_review"))


def better_attempt(attempts: DataFrame) -> DataFrame:
    """attempts: document_id, attempt, passed. The repair wins only if strictly more checks pass."""
    return attempts.groupBy("document_id").agg(F.max_by("attempt", F.struct("passed", -F.col("attempt"))).alias("chosen"))


def run_summary(checks: DataFrame, attempts: DataFrame, price_in: Column, price_out: Column) -> DataFrame:
    """document_id, passed, n_checks, tokens, cost. checks: document_id, passed; attempts: document_id, prompt, completion, of the first attempt and of a repair. A document without checks has 0 of 0."""
    from tallyspark.functions import scalars as S

    cost = S.call_cost(F.col("prompt"), F.col("completion"), price_in, price_out)
    spent = attempts.groupBy("document_id").agg(F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.sum(cost).alias("cost"))
    done = checks.groupBy("document_id").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("n_checks"))
    return spent.join(done, "document_id", "left").select("document_id", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("n_checks", F.lit(0)).alias("n_checks"), "tokens", "cost")
