"""Literal cases of the column functions."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, value", [("1,20,100.00", "120100"), ("120,100.00", "120100"), ("Rs. 5", "5"), ("$ 1,450.50", "1450.5"), ("(12.5)", "-12.5"), ("-3", "-3"), ("12,3,456", "123456"), (".", "0"), ("RM 5", None), ("€5", None), ("", None), (None, None), ("1.2.3", None), ("INR", None)])
def test_parse_amount(spark, text, value):
    assert one(spark, S.parse_amount(F.lit(text).cast("string"))) == (None if value is None else Decimal(value))


def test_amounts_of_an_array_are_read_as_single_ones(spark):
    texts = ["1,20,100.00", "Rs. 5", "(12.5)", "-3", ".", "RM 5", "€5", "", None, "1.2.3", "INR"]
    one_ = [one(spark, F.struct(S.parse_amount(F.lit(t).cast("string")).alias("value"), S.amount_unparseable(F.lit(t).cast("string")).alias("unparseable"))) for t in texts]
    assert one(spark, S.amounts_read(F.array(*[F.lit(t).cast("string") for t in texts]))) == one_


@pytest.mark.parametrize("text, odd", [("1,20,100", False), ("120,100", False), ("12,3,456", True), ("1,2", True), ("12", False), ("1,234,567", False), ("12,34,567", False)])
def test_grouping(spark, text, odd):
    assert one(spark, S.odd_grouping(F.lit(text))) is odd


@pytest.mark.parametrize("text, day", [("2026-01-02", date(2026, 1, 2)), ("1/2/2026", date(2026, 2, 1)), ("03.04.75", date(1975, 4, 3)), ("03-04-68", date(2068, 4, 3)), ("2nd Jan 2026", date(2026, 1, 2)), ("January 5, 2026", date(2026, 1, 5)), ("5-Mar-26", date(2026, 3, 5)), ("2026-01-02T10:00", date(2026, 1, 2)), ("31/02/2026", None), ("soon", None), (None, None)])
def test_parse_date(spark, text, day):
    assert one(spark, S.parse_date(F.lit(text).cast("string"))) == day


@pytest.mark.parametrize("amount, code, shown", [("1450", "INR", "₹1,450"), ("100000", "INR", "₹1,00,000"), ("1450.5", "USD", "$1,450.50"), ("12", "CHF", "CHF 12"), ("1234567", None, "1,234,567"), (None, "INR", "-")])
def test_format_money(spark, amount, code, shown):
    assert one(spark, S.format_money(F.lit(amount).cast("decimal(14,2)"), F.lit(code).cast("string"))) == shown


def test_printed_on_needs_no_digit_beside(spark):
    printed = lambda v, t: one(spark, S.printed_on(F.lit(v).cast("decimal(12,2)"), F.lit(t)))
    assert printed("981", "paid 981.00 today") and printed("1234.5", "1,234.50") and not printed("981", "29810") and not printed("981", "9810")


def test_currency(spark):
    assert one(spark, S.resolve_currency(F.lit("$"), F.lit("EUR"))) == "USD"
    assert one(spark, S.resolve_currency(F.lit(None).cast("string"), F.lit("EUR 5 or $6"))) is None
    assert one(spark, S.resolve_currency(F.lit(None).cast("string"), F.lit("rs 5"))) == "INR"
    assert one(spark, S.normalize_currency(F.lit("RM"))) == "RM"


def test_lookups(spark):
    assert one(spark, S.city_tier(F.lit(" Bombay "), {"1": ["mumbai"]})) == "1" and one(spark, S.city_tier(F.lit("Nagpur"), {"1": ["mumbai"]})) == "3"
    assert one(spark, S.city_tier(F.lit(" "), {"1": ["mumbai"]})) is None and one(spark, S.zone_of(F.lit("France"), ["usa"])) is None
    assert one(spark, S.normalize_vendor(F.lit("The Cafe Pvt. Ltd."))) == "cafe" and one(spark, S.normalize_vendor(F.lit("THE"))) is None
    assert one(spark, S.approval_label(F.lit("Denied"))) == "Not approved" and one(spark, S.parse_count(F.lit("2.5"))) == 2
