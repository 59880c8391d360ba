"""Column functions on printed amounts, currencies, dates, identifiers and labels. All run inside a projection, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.tables import APPROVAL_LABELS, CATEGORY_OF_TYPE, CHARGE_NAME, CITY_ALIASES, COUNTRY_ALIASES, CURRENCIES, CURRENCY_MARKS, GSTIN, GSTIN_PLACEHOLDERS, INFLATABLE_EXTRA, MISSING, MONEY_FIELDS, SYMBOLS, UNIT_LABELS, VENDOR_NOISE

MONEY = "decimal(20,4)"


def lookup(table: dict, key: Column) -> Column:
    """table[key], null if absent."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None).cast("string")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _bare(raw: Column) -> Column:
    return strip(F.regexp_replace(strip(raw), r"(?i)Rs\.?|INR|₹|\$", ""))


def _signed(s: Column) -> tuple[Column, Column]:
    parens = s.startswith("(") & s.endswith(")")
    minus = s.startswith("-")
    body = F.when(parens, strip(F.substr(s, F.lit(2), F.length(s) - 2))).when(minus, strip(F.substr(s, F.lit(2)))).otherwise(s)
    return body, parens | minus


def _body(raw: Column) -> tuple[Column, Column]:
    """What is left of a printed amount without currency words and sign; whether it is negative."""
    return _signed(_bare(raw))


def _value(body: Column, negative: Column) -> Column:
    digits = F.regexp_replace(F.substring_index(body, ".", 1), ",", "")
    value = F.concat(F.when(digits == "", "0").otherwise(digits), F.regexp_extract(body, r"(\.[0-9]*)$", 1)).try_cast(MONEY)
    return F.when((body != "") & body.rlike(r"^[0-9,]*(\.[0-9]*)?$"), F.when(negative, -value).otherwise(value))


def parse_amount(raw: Column) -> Column:
    """A printed amount as a decimal; null if empty or unparseable. Commas only separate; parentheses or a leading minus negate."""
    return _value(*_body(raw))


def _bodies(raws: Column) -> Column:
    """_body of an array's elements. Inside a lambda nothing is shared between expressions, so each step has one of its own."""
    return F.transform(F.transform(raws, _bare), lambda s: F.struct(*[c.alias(n) for c, n in zip(_signed(s), ("body", "negative"), strict=True)]))


def parse_amounts(raws: Column) -> Column:
    """parse_amount of an array's elements, step by step as _bodies()."""
    return F.transform(_bodies(raws), lambda p: _value(p["body"], p["negative"]))


def _unparseable(body: Column) -> Column:
    return F.coalesce((body != "") & ~body.rlike(r"^[0-9,]*(\.[0-9]*)?$"), F.lit(False))


def amount_unparseable(raw: Column) -> Column:
    body, _ = _body(raw)
    return _unparseable(body)


def amounts_read(raws: Column) -> Column:
    """Of an array's elements: value as parse_amount() gives it, and unparseable as amount_unparseable()."""
    return F.transform(_bodies(raws), lambda p: F.struct(_value(p["body"], p["negative"]).alias("value"), _unparseable(p["body"]).alias("unparseable")))


def odd_grouping(raw: Column) -> Column:
    """Whether the commas match neither the international (3, 3, ...) nor the Indian grouping (..., 2, 3); the value is parsed anyway."""
    body, _ = _body(raw)
    groups = F.split(F.substring_index(body, ".", 1), ",")
    rest = F.slice(groups, 2, F.greatest(F.size(groups) - 1, F.lit(0)))
    three = F.forall(rest, lambda g: F.length(g) == 3)
    middle = F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))
    indian = (F.length(F.element_at(groups, -1)) == 3) & F.forall(middle, lambda g: F.length(g) == 2)
    return F.coalesce(body.rlike(r"^[0-9,]*(\.[0-9]*)?$") & (F.size(groups) > 1) & ~(three | indian), F.lit(False))


def normalize_currency(c: Column) -> Column:
    """ISO code of a known symbol or word; anything else unchanged."""
    return F.coalesce(lookup(CURRENCIES, F.lower(strip(c))), c)


def currency_candidates(text: Column) -> Column:
    """The distinct currencies whose marks stand in a text, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(code)) for p, code in CURRENCY_MARKS]))))


def detect_currency(text: Column) -> Column:
    found = currency_candidates(text)
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))


def resolve_currency(given: Column, text: Column, company: str = "INR") -> Column:
    found = currency_candidates(text)
    alone = F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))).when(F.size(found) == 0, F.lit(company))
    return F.when(given.isNotNull() & (given != ""), normalize_currency(given)).otherwise(alone)


def gstin_valid(value: Column) -> Column:
    """Absent and placeholder values are valid; others need the 15-character form."""
    absent = value.isNull() | F.lower(strip(value)).isin(*GSTIN_PLACEHOLDERS)
    return absent | F.upper(F.replace(value, F.lit(" "), F.lit(""))).rlike(GSTIN)


def parse_date(text: Column) -> Column:
    """A printed date, day first; null if no form fits or there is no such day. Two-digit years from 69 on are 19xx."""
    c = F.regexp_replace(F.regexp_replace(strip(text), r"\s+", " "), r"(\d)(st|nd|rd|th)\b", "$1")
    day = lambda pattern, form, of=c: F.when(of.rlike(f"^{pattern}$"), F.try_to_date(of, form))

    def short_year(pattern: str, form: str) -> Column:
        full = F.regexp_replace(c, r"(\d\d)$", "20$1")
        return F.when(c.rlike(f"^{pattern}$"), F.try_to_date(F.when(F.regexp_extract(c, r"(\d\d)$", 1) >= "69", F.regexp_replace(c, r"(\d\d)$", "19$1")).otherwise(full), form))

    d, month, long = r"\d{1,2}", "[A-Za-z]{3}", "[A-Za-z]{3,9}"
    forms = [day(rf"\d{{4}}{s}{d}{s}{d}", f"yyyy{t}M{t}d") for s, t in (("-", "-"), ("/", "/"))]
    forms += [day(rf"{d}{s}{d}{s}\d{{4}}", f"d{t}M{t}yyyy") for s, t in (("/", "/"), ("-", "-"), (r"\.", "."))]
    forms += [short_year(rf"{d}{s}{d}{s}\d{{2}}", f"d{t}M{t}yyyy") for s, t in (("/", "/"), ("-", "-"), (r"\.", "."))]
    forms += [day(rf"{d} {month} \d{{4}}", "d MMM yyyy"), day(rf"{d} {long} \d{{4}}", "d MMMM yyyy"), day(rf"{d}-{month}-\d{{4}}", "d-MMM-yyyy"), short_year(rf"{d}-{month}-\d{{2}}", "d-MMM-yyyy")]
    forms += [day(rf"{month} {d},? \d{{4}}", f"MMM d{s} yyyy", of) for s, of in (("", F.replace(c, F.lit(","), F.lit(""))),)]
    forms += [day(rf"{long} {d},? \d{{4}}", "MMMM d yyyy", F.replace(c, F.lit(","), F.lit("")))]
    forms.append(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_date(F.substring(c, 1, 10), "yyyy-M-d")))
    return F.coalesce(*forms)


def nights_between(a: Column, b: Column) -> Column:
    return F.when(F.datediff(b, a) >= 1, F.datediff(b, a))


def inclusive_days(a: Column, b: Column) -> Column:
    return F.when(F.datediff(b, a) + 1 >= 1, F.datediff(b, a) + 1)


def parse_count(text: Column) -> Column:
    """The leading whole number of a text ("4 pax", "4.0"), at least 1."""
    n = F.regexp_extract(text, r"^\s*(\d+)(?:\.0+)?\b", 1).try_cast("long")
    return F.when(n >= 1, n)


def money(c: Column) -> Column:
    return F.round(c.cast("decimal(30,10)"), 2).cast("decimal(14,2)")


def group_indian(digits: Column) -> Column:
    head = F.regexp_replace(F.substr(digits, F.lit(1), F.length(digits) - 3), r"(\d)(?=(\d\d)+$)", "$1,")
    return F.when(F.length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.right(digits, F.lit(3))))


def once(value: Column, use) -> Column:
    """use(value) with the value computed once a row, however often it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def format_money(amount: Column, currency: Column) -> Column:
    """Symbol or code, grouped digits, and decimals only where there are some; "-" for null. For amounts of at least 0."""
    symbol = F.coalesce(lookup(SYMBOLS, currency), F.concat(currency, F.lit(" ")), F.lit(""))
    thousands = lambda whole: F.when(F.length(whole) <= 3, whole).otherwise(F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1,"))

    def said(text: Column) -> Column:
        whole, cents = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
        return F.concat(symbol, F.when(currency == "INR", group_indian(whole)).otherwise(thousands(whole)), F.when(cents != "00", F.concat(F.lit("."), cents)).otherwise(""))

    return F.when(amount.isNull(), "-").otherwise(once(money(amount).cast("string"), said))


def format_comparison(amount: Column, limit: Column, unit: Column, currency: Column) -> Column:
    label = F.coalesce(lookup(UNIT_LABELS, unit), unit, F.lit(""))
    return F.when(amount.isNotNull() & limit.isNotNull(), F.concat(format_money(amount, currency), F.lit(" vs "), format_money(limit, currency), F.lit(" limit ("), label, F.lit(")")))


def normalize_vendor(vendor: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(vendor), "[^a-z0-9 ]", " "), rf"\b({'|'.join(VENDOR_NOISE)})\b", " ")
    return F.nullif(F.trim(F.regexp_replace(plain, " +", " ")), F.lit(""))


def numbers_in(text: Column) -> Column:
    """The distinct numbers written in a text, commas left out, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1)
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(30,4)")))))


def roundoff_evidence(text: Column, fields: Column) -> Column:
    pattern = r"(?i)round[\s\-]?off|rounding"
    return F.coalesce(text.rlike(pattern), F.lit(False)) | F.coalesce(F.exists(F.map_keys(fields), lambda k: k.rlike(pattern)), F.lit(False))


def tolerance(evidence: Column) -> Column:
    return F.when(evidence, F.lit("1.00")).otherwise(F.lit("0.01")).cast("decimal(4,2)")


def close(a: Column, b: Column, within: Column) -> Column:
    return F.abs(a - b) <= within


def printed_on(value: Column, text: Column) -> Column:
    """Whether a number stands in a text in one of its usual forms, with no digit next to it."""
    fixed = value.cast("decimal(20,2)").cast("string")
    whole = F.substring_index(fixed, ".", 1)
    grouped = F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1,")
    cents = F.substring_index(fixed, ".", -1)
    tail = F.when(cents == "00", r"(\.00)?").otherwise(F.concat(F.lit(r"\."), cents))
    pattern = F.concat(F.lit(r"(?<!\d)("), whole, F.lit("|"), grouped, F.lit(")"), tail, F.lit(r"(?!\d)"))
    return F.coalesce(F.regexp_like(text, pattern), F.lit(False))


def line_with(text: Column, label: Column) -> Column:
    """The first line that holds a label, case and all white space aside."""
    tight = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.contains(tight(x), tight(label))), F.lit(1))


def charge_like(name: Column) -> Column:
    return F.coalesce(strip(name).rlike(CHARGE_NAME), F.lit(False))


def first_amount(entries: Column, key_pattern: str) -> Column:
    """The first parseable amount of an array of (key, value) whose key matches."""
    values = F.transform(F.filter(entries, lambda e: e["key"].rlike(f"(?i){key_pattern}")), lambda e: e["value"])
    return F.try_element_at(F.array_compact(parse_amounts(values)), F.lit(1))


def trip_kms(entry: Column) -> Column:
    return F.coalesce(entry["kms"], entry["km"], entry["distance"])


def amount_of_type(document_type: Column, amount: Column, total: Column, grand_total: Column, total_claimed: Column) -> Column:
    return F.when(document_type == "telecom_bill", total).when(document_type == "restaurant_bill", grand_total).when(document_type == "local_conveyance_form", total_claimed).otherwise(amount)


def values_equal(a: Column, b: Column) -> Column:
    """Equal as they are, or as numbers; nulls are equal."""
    return a.eqNullSafe(b) | F.coalesce(a.try_cast(MONEY) == b.try_cast(MONEY), F.lit(False))


def direction(before: Column, after: Column) -> Column:
    a, b = before.try_cast(MONEY), after.try_cast(MONEY)
    return F.when(b > a, "increase").when(b < a, "decrease").otherwise("none")


def leaf(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\[\d+\]", ""), r"\."), -1)


def money_field(path: Column) -> Column:
    return leaf(path).isin(*MONEY_FIELDS)


def inflatable_field(path: Column) -> Column:
    return leaf(path).isin(*MONEY_FIELDS, *INFLATABLE_EXTRA)


def grade_rank(grade: Column, grades: list[str]) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(g) for g in grades]), F.upper(strip(grade))), F.lit(0))


def city_tier(city: Column, tiers: dict[str, list[str]]) -> Column:
    name = F.lower(strip(city))
    name = F.coalesce(lookup(CITY_ALIASES, name), name)
    listed = F.coalesce(lookup({c: t for t, cities in tiers.items() for c in cities}, name), F.lit("3"))
    return F.when(name != "", listed)


def zone_of(country: Column, zone_a: list[str]) -> Column:
    """A for a listed country, else null: the list is open, so nothing else is known to be B."""
    name = F.lower(strip(country))
    return F.when(F.coalesce(lookup(COUNTRY_ALIASES, name), name).isin(*zone_a), F.lit("A"))


def category_of_type(document_type: Column) -> Column:
    return lookup(CATEGORY_OF_TYPE, document_type)


def match_text(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(F.regexp_replace(text, r"[*_`#]", ""), r"\s+", " ")))


def call_cost(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    per = lambda n, p: n.cast("decimal(18,0)") * p.cast("decimal(10,4)") / F.lit(1_000_000).cast("decimal(8,0)")
    return F.round(per(prompt, price_in) + per(completion, price_out), 8).cast("decimal(20,8)")


def fingerprint(*columns: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, length)


def approval_label(status: Column) -> Column:
    """The label of a known status; any other status as it is, null for an empty one."""
    return F.when(status != "", F.coalesce(lookup(APPROVAL_LABELS, F.lower(strip(status))), status))


def missing_name(quantity: Column) -> Column:
    return lookup(MISSING, quantity)
