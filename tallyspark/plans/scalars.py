"""Queries for the column functions, on strings printed from the tables' numbers and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions.tables import CHARGE_NAME, CITY_ALIASES, COUNTRY_ALIASES, GSTIN, INFLATABLE_EXTRA, MONEY_FIELDS, VENDOR_NOISE
from tallyspark.plans.proxy import table
from tallyspark.plans.registry import query

_ID = ["l_orderkey", "l_linenumber", "l_partkey"]
_PRINTED = """CASE l_partkey % 13
  WHEN 0 THEN p WHEN 1 THEN concat('Rs. ', p) WHEN 2 THEN concat('$', substr(p, 1, length(p) - 6), ',', substr(p, length(p) - 5)) WHEN 3 THEN concat('(', p, ')')
  WHEN 4 THEN concat('- ', p) WHEN 5 THEN concat('RM ', p) WHEN 6 THEN concat('₹', substr(p, 1, length(p) - 6), ',', substr(p, length(p) - 5), ' INR') WHEN 7 THEN ''
  WHEN 8 THEN concat(substr(p, 1, 1), ',', substr(p, 2)) WHEN 9 THEN concat('  inr ', p, '  ') WHEN 10 THEN '.' WHEN 11 THEN concat(substr(p, 1, length(p) - 3), '.') ELSE concat('€', p) END"""
_P = f"(SELECT l_orderkey, l_linenumber, l_partkey, {_PRINTED} AS printed FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS p FROM lineitem))"
_BODY = f"""(SELECT *, CASE WHEN s LIKE '(%)' THEN trim(substr(s, 2, length(s) - 2)) WHEN s LIKE '-%' THEN trim(substr(s, 2)) ELSE s END AS body, (s LIKE '(%)' OR s LIKE '-%') AS neg
  FROM (SELECT *, trim(regexp_replace(trim(printed), 'Rs\\.?|INR|₹|\\$', '', 'gi')) AS s FROM {_P}))"""
_OK = "regexp_full_match(body, '[0-9,]*(\\.[0-9]*)?')"


def _printed(spark, d):
    lines = table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    return lines.select(*_ID, F.expr(_PRINTED).alias("printed"))


@query("P1_parse_amount", f"""SELECT l_orderkey, l_linenumber, l_partkey, printed, CASE WHEN body <> '' AND {_OK} THEN
  TRY_CAST(CASE WHEN replace(split_part(body, '.', 1), ',', '') = '' THEN '0' ELSE replace(split_part(body, '.', 1), ',', '') END || regexp_extract(body, '(\\.[0-9]*)$', 1) AS DECIMAL(20,4)) * CASE WHEN neg THEN -1 ELSE 1 END END AS amount,
  body <> '' AND NOT {_OK} AS unparseable FROM {_BODY}""")
def parse_amount(spark, d):
    rows = _printed(spark, d)
    return rows.select(*_ID, "printed", S.parse_amount(F.col("printed")).alias("amount"), S.amount_unparseable(F.col("printed")).alias("unparseable"))


@query("P2_odd_grouping", f"""SELECT l_orderkey, l_linenumber, l_partkey, {_OK} AND contains(split_part(body, '.', 1), ',')
  AND NOT regexp_full_match(split_part(body, '.', 1), '[0-9]*(,[0-9]{{3}})+') AND NOT regexp_full_match(split_part(body, '.', 1), '[0-9]*(,[0-9]{{2}})*,[0-9]{{3}}') AS odd FROM {_BODY}""")
def odd_grouping(spark, d):
    return _printed(spark, d).select(*_ID, S.odd_grouping(F.col("printed")).alias("odd"))


_MARK = """CASE l_partkey % 7 WHEN 0 THEN 'Rs.' WHEN 1 THEN ' usd ' WHEN 2 THEN '₹' WHEN 3 THEN 'RM' WHEN 4 THEN 'EUR' WHEN 5 THEN '£' END"""
_TEXT = """concat('Total ', CASE l_suppkey % 6 WHEN 0 THEN '$12 or EUR 4' WHEN 1 THEN 'Rs. 99' WHEN 2 THEN 'rs 99' WHEN 3 THEN 'usd 5, $5' WHEN 4 THEN 'plain' ELSE '£4 INR 3' END, ' paid')"""
_SQL_NORM = "CASE lower(trim(c)) WHEN 'rs.' THEN 'INR' WHEN 'rs' THEN 'INR' WHEN '₹' THEN 'INR' WHEN 'inr' THEN 'INR' WHEN 'rupees' THEN 'INR' WHEN '$' THEN 'USD' WHEN 'usd' THEN 'USD' WHEN '€' THEN 'EUR' WHEN 'eur' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN 'gbp' THEN 'GBP' ELSE c END"
_CANDS = """list_sort(list_distinct(list_filter([CASE WHEN contains(t, '$') OR regexp_matches(t, '(?i)\\bUSD\\b') THEN 'USD' END, CASE WHEN contains(t, '€') OR regexp_matches(t, '(?i)\\bEUR\\b') THEN 'EUR' END,
  CASE WHEN contains(t, '£') OR regexp_matches(t, '(?i)\\bGBP\\b') THEN 'GBP' END, CASE WHEN contains(t, '₹') OR regexp_matches(t, '\\bRs\\.?\\b') OR regexp_matches(t, '(?i)\\bINR\\b') THEN 'INR' END], lambda x: x IS NOT NULL)))"""


@query("P3_normalize_currency", f"SELECT l_orderkey, l_linenumber, l_partkey, {_SQL_NORM} AS currency FROM (SELECT *, {_MARK} AS c FROM lineitem)")
def normalize_currency(spark, d):
    return table(spark, d, "lineitem").select(*_ID, S.normalize_currency(F.expr(_MARK)).alias("currency"))


@query("P4_currency_candidates", f"SELECT l_orderkey, l_linenumber, l_partkey, array_to_string({_CANDS}, ',') AS candidates FROM (SELECT *, {_TEXT} AS t FROM lineitem)")
def currency_candidates(spark, d):
    return table(spark, d, "lineitem").select(*_ID, F.array_join(S.currency_candidates(F.expr(_TEXT)), ",").alias("candidates"))


@query("P5_detect_currency", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN len(c) = 1 THEN c[1] END AS currency FROM (SELECT *, {_CANDS} AS c FROM (SELECT *, {_TEXT} AS t FROM lineitem))")
def detect_currency(spark, d):
    return table(spark, d, "lineitem").select(*_ID, S.detect_currency(F.expr(_TEXT)).alias("currency"))


@query("P6_resolve_currency", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c IS NOT NULL THEN {_SQL_NORM} WHEN len(f) = 1 THEN f[1] WHEN len(f) = 0 THEN 'INR' END AS currency FROM (SELECT *, {_CANDS} AS f FROM (SELECT *, {_TEXT} AS t, {_MARK} AS c FROM lineitem))")
def resolve_currency(spark, d):
    return table(spark, d, "lineitem").select(*_ID, S.resolve_currency(F.expr(_MARK), F.expr(_TEXT)).alias("currency"))


_GST = "CASE c_custkey % 5 WHEN 0 THEN concat('27abcde', lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 4, '0'), 'f1Z5') WHEN 1 THEN '-' WHEN 2 THEN concat('27 ABCDE 1234F1Z', CAST(c_custkey % 10 AS VARCHAR(9))) WHEN 3 THEN concat('27ABCDE1234F0Z', CAST(c_custkey % 10 AS VARCHAR(9))) END"


@query("P7_validate_gstin", f"SELECT c_custkey, g IS NULL OR lower(trim(g)) IN ('-', 'n/a', 'na', 'none', 'nil', 'null', '') OR regexp_matches(upper(replace(g, ' ', '')), '{GSTIN}') AS valid FROM (SELECT *, {_GST} AS g FROM customer)")
def validate_gstin(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.gstin_valid(F.expr(_GST)).alias("valid"))


_FORMS = {
    0: ("yyyy-MM-dd", "%Y-%m-%d"), 1: ("yyyy/MM/dd", "%Y/%m/%d"), 2: ("dd/MM/yyyy", "%d/%m/%Y"), 3: ("d-M-yyyy", "%-d-%-m-%Y"), 4: ("dd.MM.yy", "%d.%m.%y"), 5: ("d MMM yyyy", "%-d %b %Y"), 6: ("d MMMM yyyy", "%-d %B %Y"),
    7: ("dd-MMM-yy", "%d-%b-%y"), 8: ("MMM d, yyyy", "%b %-d, %Y"), 9: ("MMMM d yyyy", "%B %-d %Y"), 10: ("yyyy-MM-dd'T'HH:mm", "%Y-%m-%dT%H:%M"),
}
_DATE_SPARK = "CASE " + " ".join(f"WHEN l_partkey % 13 = {k} THEN date_format(l_shipdate, \"{a}\")" for k, (a, _) in _FORMS.items()) + " WHEN l_partkey % 13 = 11 THEN concat(date_format(l_shipdate, 'd'), 'th   ', date_format(l_shipdate, 'MMM yyyy')) ELSE '31/02/2026' END"


@query("P8_parse_date", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 13 <> 12 THEN CAST(l_shipdate AS DATE) END AS parsed FROM lineitem")
def parse_date(spark, d):
    return table(spark, d, "lineitem").select(*_ID, S.parse_date(F.expr(_DATE_SPARK)).alias("parsed"))


_SPAN = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) - CAST(l_partkey % 60 AS INTEGER) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _spans(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(*_ID, F.to_date("o_orderdate").alias("a"), F.date_sub(F.to_date("l_shipdate"), (F.col("l_partkey") % 60).cast("int")).alias("b"))


@query("P9_nights_between", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b - a >= 1 THEN CAST(b - a AS INTEGER) END AS nights FROM ({_SPAN})")
def nights(spark, d):
    return _spans(spark, d).select(*_ID, S.nights_between(F.col("a"), F.col("b")).alias("nights"))


@query("P10_inclusive_days", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b - a + 1 >= 1 THEN CAST(b - a + 1 AS INTEGER) END AS days FROM ({_SPAN})")
def days(spark, d):
    return _spans(spark, d).select(*_ID, S.inclusive_days(F.col("a"), F.col("b")).alias("days"))


_COUNT = "CASE l_partkey % 5 WHEN 0 THEN concat(CAST(l_linenumber AS {s}), ' pax') WHEN 1 THEN concat('  ', CAST(l_suppkey AS {s}), '.00') WHEN 2 THEN concat(CAST(l_linenumber AS {s}), '.5') WHEN 3 THEN '0' ELSE concat('x', CAST(l_linenumber AS {s})) END"


@query("P11_parse_count", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n >= 1 THEN n END AS n FROM (SELECT *, TRY_CAST(regexp_extract(t, '^\\s*(\\d+)(?:\\.0+)?\\b', 1) AS BIGINT) AS n FROM (SELECT *, {_COUNT.format(s='VARCHAR')} AS t FROM lineitem))")
def parse_count(spark, d):
    return table(spark, d, "lineitem").select(*_ID, S.parse_count(F.expr(_COUNT.format(s="STRING"))).alias("n"))


@query("P12_money", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(14,2)) AS rounded FROM lineitem")
def money(spark, d):
    product = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
    return table(spark, d, "lineitem").select(*_ID, S.money(product).alias("rounded"))


def _by(n: int, digits: str) -> str:
    """SQL: commas between groups of n digits, from the right."""
    return f"reverse(rtrim(regexp_replace(reverse({digits}), '(\\d{{{n}}})', '\\1,', 'g'), ','))"


def _indian(digits: str) -> str:
    return f"CASE WHEN length({digits}) <= 3 THEN {digits} ELSE {_by(2, f'left({digits}, length({digits}) - 3)')} || ',' || right({digits}, 3) END"


def _shown(amount: str, code: str) -> str:
    """SQL: an amount of at least 0 with its currency's mark, decimals only where there are some."""
    text = f"({amount})::DECIMAL(14,2)::VARCHAR"
    whole, cents = f"split_part({text}, '.', 1)", f"split_part({text}, '.', 2)"
    mark = f"CASE {code} WHEN 'INR' THEN '₹' WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' ELSE {code} || ' ' END"
    return f"{mark} || CASE WHEN {code} = 'INR' THEN {_indian(whole)} ELSE {_by(3, whole)} END || CASE WHEN {cents} <> '00' THEN '.' || {cents} ELSE '' END"


@query("P13_group_indian", f"SELECT o_orderkey, {_indian('t')} AS grouped FROM (SELECT o_orderkey, trunc(o_totalprice * 100)::BIGINT::VARCHAR AS t FROM orders)")
def group_indian(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.group_indian((F.col("o_totalprice") * 100).cast("long").cast("string")).alias("grouped"))


@query("P14_format_money", f"SELECT o_orderkey, CASE WHEN o_custkey % 9 > 0 THEN {_shown('o_totalprice', 'c')} ELSE '-' END AS shown FROM (SELECT *, ['INR', 'USD', 'CHF', 'EUR'][o_orderkey % 4 + 1] AS c FROM orders)")
def format_money(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in ("INR", "USD", "CHF", "EUR")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", S.format_money(F.when(F.col("o_custkey") % 9 > 0, F.col("o_totalprice")), code).alias("shown"))


@query("P15_format_comparison", f"SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN {_shown('o_totalprice', 'c')} || ' vs ₹1,200 limit (' || ['per night', 'km rate x distance', 'other'][o_orderkey % 3 + 1] || ')' END AS shown FROM (SELECT *, 'INR' AS c FROM orders)")
def format_comparison(spark, d):
    unit = F.element_at(F.array(*[F.lit(x) for x in ("per_night", "per_km", "other")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", S.format_comparison(F.col("o_totalprice"), F.when(F.col("o_custkey") % 4 > 0, F.lit(1200)), unit, F.lit("INR")).alias("shown"))


_VENDOR = "CASE c_custkey % 5 WHEN 0 THEN concat('The ', c_name, ' Pvt. Ltd.') WHEN 1 THEN concat(c_name, ', Inc') WHEN 2 THEN 'THE' WHEN 3 THEN NULL ELSE concat(c_name, '-Limitededition') END"


@query("P16_normalize_vendor", f"SELECT c_custkey, nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(v), '[^a-z0-9 ]', ' ', 'g'), '\\b({'|'.join(VENDOR_NOISE)})\\b', ' ', 'g'), ' +', ' ', 'g')), '') AS vendor FROM (SELECT *, {_VENDOR} AS v FROM customer)")
def normalize_vendor(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.normalize_vendor(F.expr(_VENDOR)).alias("vendor"))


@query("P17_numbers_in", "SELECT doc_id, len(n)::BIGINT AS n_numbers, n[1] AS least FROM (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: TRY_CAST(replace(x, ',', '') AS DECIMAL(30,4))), lambda x: x IS NOT NULL))) AS n FROM documents)")
def numbers_in(spark, d):
    found = table(spark, d, "documents").select("doc_id", S.numbers_in(F.col("text")).alias("n"))
    return found.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.try_element_at("n", F.lit(1)).alias("least"))


_ROUND = "CASE WHEN l_partkey % 11 = 0 THEN 'Round-Off 0.4' WHEN l_partkey % 11 = 1 THEN 'rounding' ELSE 'plain' END"


@query("P18_roundoff_evidence", f"SELECT l_orderkey, l_linenumber, l_partkey, regexp_matches({_ROUND}, '(?i)round[\\s\\-]?off|rounding') OR l_suppkey % 7 = 0 AS evidence FROM lineitem")
def roundoff_evidence(spark, d):
    fields = F.when(F.col("l_suppkey") % 7 == 0, F.create_map(F.lit("Round off"), F.lit("0.4")))
    return table(spark, d, "lineitem").select(*_ID, S.roundoff_evidence(F.expr(_ROUND), fields).alias("evidence"))


@query("P19_tolerance", f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN regexp_matches({_ROUND}, '(?i)round[\\s\\-]?off|rounding') THEN 1.00 ELSE 0.01 END AS DECIMAL(4,2)) AS tolerance FROM lineitem")
def tolerance(spark, d):
    return table(spark, d, "lineitem").select(*_ID, S.tolerance(S.roundoff_evidence(F.expr(_ROUND), F.lit(None).cast("map<string,string>"))).alias("tolerance"))


@query("P20_close", "SELECT l_orderkey, l_linenumber, l_partkey, abs(CAST(l_discount AS DECIMAL(4,2)) - CAST(l_tax AS DECIMAL(4,2))) <= 0.01 AS close FROM lineitem")
def close(spark, d):
    dec = lambda c: F.col(c).cast("decimal(4,2)")
    return table(spark, d, "lineitem").select(*_ID, S.close(dec("l_discount"), dec("l_tax"), F.lit("0.01").cast("decimal(4,2)")).alias("close"))


_BILL = "concat('Total: ', CASE l_partkey % 5 WHEN 0 THEN p WHEN 1 THEN concat(substr(p, 1, length(p) - 6), ',', substr(p, length(p) - 5)) WHEN 2 THEN concat('1', p) WHEN 3 THEN concat(p, '7') ELSE substr(p, 1, length(p) - 3) END, ' due')"


@query("P21_printed_on", f"""SELECT l_orderkey, l_linenumber, l_partkey, regexp_matches(t, '(^|[^0-9])(' || split_part(p, '.', 1) || '|' || g || ')' || CASE WHEN split_part(p, '.', 2) = '00' THEN '(\\.00)?' ELSE '\\.' || split_part(p, '.', 2) END || '([^0-9]|$)') AS printed
  FROM (SELECT *, {_BILL} AS t, CASE WHEN length(p) > 6 THEN substr(p, 1, length(p) - 6) || ',' || substr(p, length(p) - 5, 3) ELSE split_part(p, '.', 1) END AS g FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS p FROM lineitem))""")
def printed_on(spark, d):
    rows = table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    return rows.select(*_ID, S.printed_on(F.col("p").cast("decimal(12,2)"), F.expr(_BILL)).alias("printed"))


@query("P22_line_with", "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(lower(regexp_replace(x, '\\s+', '', 'g')), 'ofthe'))[1] AS line FROM documents")
def line_with(spark, d):
    return table(spark, d, "documents").select("doc_id", S.line_with(F.col("text"), F.lit("Of The")).alias("line"))


_ITEM = "CASE p_partkey % 6 WHEN 0 THEN concat('Tax ', p_type) WHEN 1 THEN 'Service  Charge 5%' WHEN 2 THEN concat('SGST', p_type) WHEN 3 THEN ' tip' WHEN 4 THEN NULL ELSE p_name END"


@query("P23_charge_like", f"SELECT p_partkey, coalesce(regexp_matches(trim(i), '{CHARGE_NAME}'), false) AS charge FROM (SELECT *, {_ITEM} AS i FROM part)")
def charge_like(spark, d):
    return table(spark, d, "part").select("p_partkey", S.charge_like(F.expr(_ITEM)).alias("charge"))


@query("P24_first_amount", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_partkey % 3 > 0 THEN l_quantity ELSE l_extendedprice END AS DECIMAL(20,4)) AS tax FROM lineitem")
def first_amount(spark, d):
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entries = F.array(entry("note", F.lit("5")), entry("Sales Tax", F.when(F.col("l_partkey") % 3 > 0, F.col("l_quantity").cast("decimal(12,2)").cast("string")).otherwise("n/a")), entry("TAX2", F.col("l_extendedprice").cast("decimal(12,2)").cast("string")))
    return table(spark, d, "lineitem").select(*_ID, S.first_amount(entries, "tax").alias("tax"))


@query("P25_text_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def text_fields(spark, d):
    """JSON fields as text, nested values as JSON, nulls dropped."""
    fields = F.map_filter(F.from_json("props", "map<string,string>"), lambda _, v: v.isNotNull())
    return table(spark, d, "events").select("event_id", F.try_element_at(fields, F.lit("k")).alias("k"))


@query("P26_notes", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS n_notes FROM events")
def notes(spark, d):
    """A note or an array of notes becomes an array; anything else an empty one."""
    raw = F.element_at(F.array(F.lit('"one"'), F.lit('["a","b"]'), F.lit("7")), (F.col("event_id") % 3 + 1).cast("int"))
    v = F.parse_json(raw)
    found = F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))).when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", F.size(found).alias("n_notes"))


@query("P27_trip_kms", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey AS VARCHAR) AS kms FROM lineitem")
def trip_kms(spark, d):
    key = F.element_at(F.array(F.lit("kms"), F.lit("km"), F.lit("distance")), (F.col("l_partkey") % 3 + 1).cast("int"))
    entry = F.create_map(key, F.col("l_partkey").cast("string"))
    one = lambda k: F.try_element_at(entry, F.lit(k)).alias(k)
    return table(spark, d, "lineitem").select(*_ID, F.struct(one("kms"), one("km"), one("distance")).alias("e")).select(*_ID, S.trip_kms(F.col("e")).alias("kms"))


_TYPE = "CASE l_partkey % 4 WHEN 0 THEN 'telecom_bill' WHEN 1 THEN 'restaurant_bill' WHEN 2 THEN 'local_conveyance_form' ELSE 'fuel_receipt' END"


@query("P28_amount_of_type", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN l_tax WHEN 1 THEN l_discount WHEN 2 THEN l_extendedprice ELSE l_quantity END AS amount FROM lineitem")
def amount_of_type(spark, d):
    return table(spark, d, "lineitem").select(*_ID, S.amount_of_type(F.expr(_TYPE), F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.col("l_extendedprice")).alias("amount"))


@query("P31_values_equal", "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 4 <> 3 AS equal FROM lineitem")
def values_equal(spark, d):
    b = F.expr("CASE l_partkey % 4 WHEN 0 THEN CAST(l_partkey AS STRING) WHEN 1 THEN concat(CAST(l_partkey AS STRING), '.00') WHEN 2 THEN concat('0', CAST(l_partkey AS STRING)) ELSE 'x' END")
    return table(spark, d, "lineitem").select(*_ID, S.values_equal(F.col("l_partkey").cast("string"), b).alias("equal"))


@query("P32_direction", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 'none' WHEN l_discount > l_tax THEN 'increase' WHEN l_discount < l_tax THEN 'decrease' ELSE 'none' END AS direction FROM lineitem")
def direction(spark, d):
    before = F.when(F.col("l_partkey") % 5 == 0, "n/a").otherwise(F.col("l_tax").cast("string"))
    return table(spark, d, "lineitem").select(*_ID, S.direction(before, F.col("l_discount").cast("string")).alias("direction"))


_PATH = "CASE l_partkey % 6 WHEN 0 THEN 'amount' WHEN 1 THEN 'line_items[2].unit_price' WHEN 2 THEN 'travel_entries[0].kms' WHEN 3 THEN 'vendor_name' WHEN 4 THEN 'total[1]' ELSE 'line_items[0].quantity' END"


@query("P33_money_field", f"SELECT l_orderkey, l_linenumber, l_partkey, f IN {MONEY_FIELDS} AS money, f IN {MONEY_FIELDS + INFLATABLE_EXTRA} AS inflatable FROM (SELECT *, regexp_extract(regexp_replace({_PATH}, '\\[\\d+\\]', '', 'g'), '([^.]*)$', 1) AS f FROM lineitem)")
def money_field(spark, d):
    return table(spark, d, "lineitem").select(*_ID, S.money_field(F.expr(_PATH)).alias("money"), S.inflatable_field(F.expr(_PATH)).alias("inflatable"))


@query("P34_grade_rank", "SELECT c_custkey, CASE trim(c_mktsegment) WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 END::BIGINT AS rank FROM customer")
def grade_rank(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.grade_rank(F.concat(F.lit(" "), F.lower("c_mktsegment")), ["AUTOMOBILE", "BUILDING", "FURNITURE"]).alias("rank"))


_CITY = "CASE c_custkey % 5 WHEN 0 THEN ' Bombay ' WHEN 1 THEN 'PUNE' WHEN 2 THEN 'Nagpur' WHEN 3 THEN '' END"
_TIERS = {"1": ["mumbai", "delhi ncr"], "2": ["pune"]}


@query("P35_city_tier", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' END AS tier FROM customer")
def city_tier(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.city_tier(F.expr(_CITY), _TIERS).alias("tier"))


@query("P36_zone_of", "SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN 'A' END AS zone FROM customer")
def zone_of(spark, d):
    country = F.element_at(F.array(*[F.lit(x) for x in ("U.S.A.", " Holland ", "Scotland", "JAPAN", "Peru", None)]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", S.zone_of(country, ["usa", "united kingdom", "japan", "netherlands"]).alias("zone"))


@query("P38_category_of_type", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN 'phone_internet' WHEN 1 THEN 'travel_meals' WHEN 2 THEN 'local_transport' ELSE 'fuel' END AS category FROM lineitem")
def category_of_type(spark, d):
    return table(spark, d, "lineitem").select(*_ID, S.category_of_type(F.expr(_TYPE)).alias("category"))


@query("P39_match_text", "SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, '[*_`#]', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS digest FROM documents")
def match_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.match_text(F.col("text"))).alias("digest"))


@query("P41_call_cost", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round((l_partkey::DECIMAL(18,0) * 0.15 + l_suppkey::DECIMAL(18,0) * 0.6) / 1000000, 8) AS DECIMAL(20,8)) AS cost FROM lineitem")
def call_cost(spark, d):
    return table(spark, d, "lineitem").select(*_ID, S.call_cost(F.col("l_partkey"), F.col("l_suppkey"), F.lit("0.15"), F.lit("0.60")).alias("cost"))


@query("P42_fingerprint", "SELECT c_custkey, substr(sha256(concat(c_name, '|', c_mktsegment)), 1, 16) AS fingerprint FROM customer")
def fingerprint(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.fingerprint(F.col("c_name"), F.col("c_mktsegment")).alias("fingerprint"))


@query("P43_content_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def content_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("P44_approval_label", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Approval requested' ELSE 'P' END AS label FROM orders")
def approval_label(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", " Pending").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", S.approval_label(status).alias("label"))


@query("P46_year_month", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def year_month(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("month"))


@query("P47_week_start", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders")
def week_start(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_trunc("week", "o_orderdate").cast("date").alias("week"))


@query("P50_low_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount IS NOT NULL AND l_discount < 0.06 AS low FROM lineitem")
def low_confidence(spark, d):
    return table(spark, d, "lineitem").select(*_ID, (F.col("l_discount").isNotNull() & (F.col("l_discount") < 0.06)).alias("low"))
