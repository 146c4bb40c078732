import datetime as dt
import hashlib
import random
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginloom.functions import money, text
from marginloom.operators import cleaning


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "shown, cents",
    [
        ("₹4,891.30", 489130),
        ("(45.00)", 4500),
        ("-INR 12.5", -1250),
        ("--", 0),
        ("", 0),
        ("abc", 0),
        ("1.2.3", 120),
        ("5-3", 500),
        (".5", 50),
        ("12.345", 1235),
        ("99999999999999.99", 9999999999999999),
    ],
)
def test_amounts(spark, shown, cents):
    assert one(spark, money.cents_from_text(F.lit(shown))) == cents


def test_amount_beyond_bigint_is_null(spark):
    assert one(spark, money.cents_from_text(F.lit("9" * 20))) is None
    assert one(spark, money.cents_from_text(F.lit("9" * 60))) is None


@pytest.mark.parametrize(
    "shown, date",
    [
        ("01-Apr-26", dt.date(2026, 4, 1)),
        ("29-Feb-72", dt.date(1972, 2, 29)),
        ("01-Apr-68", dt.date(2068, 4, 1)),
        ("June 30, 2026", dt.date(2026, 6, 30)),
        ("June 5, 2026", dt.date(2026, 6, 5)),
        ("Jun 5, 2026", dt.date(2026, 6, 5)),
        ("2026-06-30", dt.date(2026, 6, 30)),
        ("2026-06-30T10:00:00Z", dt.date(2026, 6, 30)),
        ("6/30/2026", dt.date(2026, 6, 30)),
        ("30 June 2026", dt.date(2026, 6, 30)),
        (" 2026-06-30 ", dt.date(2026, 6, 30)),
        ("Apr 1 2026", dt.date(2026, 4, 1)),
        ("April 1, 2026 10:00", dt.date(2026, 4, 1)),
        ("04-01-2026", dt.date(2026, 4, 1)),
        ("Wed, Apr 1 2026 9:05:00 PM", dt.date(2026, 4, 1)),
        ("1-Apr-2026", dt.date(2026, 4, 1)),
        ("31-Abc-26", None),
        ("soon", None),
        ("", None),
    ],
)
def test_dates(spark, shown, date):
    assert one(spark, text.clean_date(F.lit(shown))) == date


@pytest.mark.parametrize(
    "title, number",
    [
        ("Payment for Order #4105054431", "4105054431"),
        ("order 4105054431", "4105054431"),
        ("Listing #89001677", None),
        ("Refund #89001677", "89001677"),
        ("reorder #123", None),
        ("Listing fee for Order #4105054431", "4105054431"),
    ],
)
def test_order_numbers(spark, title, number):
    assert one(spark, text.order_no_in(F.lit(title))) == number


def test_order_number_prefers_title(frame):
    df = frame([("Order #11111111", "Order #22222222"), ("Fee", "Order #22222222")], "title string, info string")
    assert [r.order_no for r in cleaning.extract_order_no(df).collect()] == ["11111111", "22222222"]


@pytest.mark.parametrize(
    "shown, digits",
    [("8.90E+11", "890000000000"), ("870000143212.0", "870000143212"), (" 0012 ", "0012"), ("PEAR", "PEAR"), ("", "")],
)
def test_waybills(spark, shown, digits):
    assert one(spark, text.clean_waybill(F.lit(shown))) == digits


def test_listing_id(frame):
    df = frame(
        [("Listing fee: Listing 1234567890", "", "ETSY"), ("Fee", "listing #99", "ETSY"), ("Fee", "listing #99", "ORDER")],
        "title string, info string, scope string",
    )
    assert [r.listing_id for r in cleaning.extract_listing_id(df).collect()] == ["1234567890", "99", None]


@pytest.mark.parametrize(
    "kind, title, info, scope, category",
    [
        ("Sale", "Payment for Order #4105054431", "", "SALE", "SALE"),
        ("Sales fee", "anything", "", "SALE", "SALE"),
        ("Tax", "Refund to buyer for sales tax", "Order #4105054431", "ORDER", "SALES_TAX"),
        ("Tax", "Refund to buyer for sales tax", "", "ETSY", "SALES_TAX"),
        ("Refund", "Partial refund", "Order #4105054431", "REFUND", "REFUND"),
        ("Fee", "Share & Save refund", "", "ORDER", "SHARE_AND_SAVE_REFUND"),
        ("Deposit", "Sent to your account", "", "ETSY", "DEPOSIT"),
        ("Fee", "Listing fee", "Order #4105054431", "ETSY", "LISTING_FEE"),
        ("Fee", "Auto-renew sold", "", "ETSY", "LISTING_FEE"),
        ("Marketing", "Etsy Ads", "", "ETSY", "ETSY_ADS"),
        ("Fee", "Transaction fee", "", "ETSY", "OTHER_STORE_EXPENSE"),
        ("Tax", "TCS", "Order #4105054431", "ORDER", "TCS"),
        ("Tax", "TDS", "Order #4105054431", "ORDER", "TDS"),
        ("Fee", "Transaction fee", "Order #4105054431", "ORDER", "TRANSACTION_FEE"),
        ("Fee", "Processing fee", "Order #4105054431", "ORDER", "PROCESSING_FEE"),
        ("Fee", "Tax paid by buyer", "Order #4105054431", "ORDER", "SALES_TAX"),
        ("Fee", "Regulatory operating fee", "Order #4105054431", "ORDER", "REGULATORY_FEE"),
        ("Fee", "Buyer fee", "Order #4105054431", "ORDER", "BUYER_FEE"),
        ("Marketing", "Offsite Ads", "Order #4105054431", "ORDER", "OFFSITE_ADS"),
        ("Fee", "Gift wrap", "Order #4105054431", "ORDER", "OTHER_ORDER_EXPENSE"),
    ],
)
def test_classification(frame, kind, title, info, scope, category):
    df = frame([(kind, title, info)], "type string, title string, info string")
    row = cleaning.classify_transactions(cleaning.extract_order_no(df)).first()
    assert (row.scope, row.category) == (scope, category)


def test_tax_component(frame):
    df = frame([(11800,), (0,), (10001,)], "amount_cents bigint")
    assert [r.tax_cents for r in cleaning.tax_component(df).collect()] == [1800, 0, 1526]


def test_material_rate(frame):
    df = frame([("cotton",), (" COTTON ",), ("Linen",), ("  ",)], "material string")
    assert [r.rate_cents for r in cleaning.material_rate(df).collect()] == [9000, 9000, 10000, None]


def test_item_suffix(frame):
    df = frame([("4104705089-2",), ("4104705089",)], "order_id string")
    assert {r.order_no for r in cleaning.strip_item_suffix(df).collect()} == {"4104705089"}


def test_occurrences_of_a_hot_group(frame):
    """A third of the rows are copies of one row; small chunks make many tasks write them."""
    rows = [("f1", "same")] * 500 + [("f1", f"r{i}") for i in range(900)] + [("f2", "same")] * 3 + [("f2", "r1")]
    df = frame(rows, "import_id string, fingerprint string").repartition(5)
    got = cleaning.number_occurrences(df, copies_per_task=7).collect()
    per_group = Counter((r.import_id, r.fingerprint) for r in got)
    assert per_group == Counter(rows)
    for (file, print_), n in per_group.items():
        assert sorted(r.occurrence_no for r in got if (r.import_id, r.fingerprint) == (file, print_)) == list(range(1, n + 1))
    row = next(r for r in got if r.fingerprint == "r1")
    assert row.transaction_hash == hashlib.sha256(b"r1|1").hexdigest()
    assert len({r.transaction_hash for r in got}) == 500 + 900


def test_counted_rows_are_shuffled_once(frame):
    """Only groups with too many copies are dealt out again; none here, so that shuffle stays empty."""
    df = frame([("a", f"{i % 40:064x}") for i in range(100)], "import_id string, fingerprint string")
    got = cleaning.number_occurrences(cleaning.packed(df), finish=cleaning.unpacked)
    assert Counter((r.fingerprint, r.occurrence_no) for r in got.collect()) == Counter((f"{i % 40:064x}", i // 40 + 1) for i in range(100))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above_dealing = plan.split("RepartitionByExpression")
    assert len(above_dealing) == 2 and "Union" in above_dealing[0] and "copies" in above_dealing[1].split("Aggregate")[0]


def test_columns_that_follow_may_be_added_after_the_count(frame):
    df = frame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None)], "import_id string, title string")
    whole = cleaning.number_occurrences(cleaning.fingerprint(df, ("title",)))
    later = cleaning.number_occurrences(df, finish=lambda rows: cleaning.fingerprint(rows, ("title",)))
    assert Counter(whole.collect()) == Counter(later.select(*whole.columns).collect()) and later.count() == 4


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=30))
def test_currency_text_round_trip(spark, amounts):
    df = spark.createDataFrame([(a,) for a in amounts], "c bigint")
    back = df.select("c", money.cents_from_text(money.money_text(F.col("c"))).alias("d")).collect()
    assert all(r.c == r.d for r in back)


def test_amount_patterns_run_once(spark):
    rows = spark.range(1).selectExpr("cast(id as string) amount").select(money.cents_from_text(F.col("amount")).alias("cents"))
    plan = rows._jdf.queryExecution().analyzed().expressions().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("regexp_replace(") == 1


@pytest.mark.parametrize(
    "shown, date",
    [
        ("MAY 3 1998", dt.date(1998, 5, 3)),
        ("Mar 3 1998", dt.date(1998, 3, 3)),
        ("Mon, 3 march 1998 10:30", dt.date(1998, 3, 3)),
        ("Marchy 3 1998", None),
        ("_Mar 3 1998", None),
        ("  ", None),
        (None, None),
    ],
)
def test_dates_by_their_first_character(spark, shown, date):
    assert one(spark, text.clean_date(F.lit(shown).cast("string"))) == date


def test_no_date_is_tried_as_a_whole_month_name(spark):
    """A short month's name costs no failed parse."""
    shapes = [shape for shape, pattern in text.DATE_SHAPES if pattern and "MMMM" in pattern]
    tried = [one(spark, F.lit(shown).rlike(shape)) for shape in shapes for shown in ("Mar 3, 1998", "Mar 3 1998", "3 Mar 1998")]
    assert not any(tried)


def test_usual_texts_are_read_without_patterns(spark):
    """Amounts that one cast can read, and what the patterns say of all others."""
    usual = {"INR 1234.50": 123450, "-INR 12.34": -1234, "₹1,234.50": 123450, "-₹7": -700, ".5": 50, "5.": 500, " 7 ": 700, "+7": 700}
    odd = ["INR", "-", "1e5", "1E2", "INR 1e5", "(45.00)", "45 USD", "٣٤", "1٣", "- 5", "+-5", "5-3", "1.2.3", "Infinity", "NaN", "1d", "0x1", "--", "1\n2", "\t8\n", "€9", "1" * 40]
    chance = random.Random(5)
    odd += ["".join(chance.choice("INR ₹,.-+05e\t") for _ in range(chance.randrange(1, 9))) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in [*usual, *odd]], "t string")
    quick = {r.t: r.c for r in frame.select("t", money._usual_cents(F.col("t")).alias("c")).collect()}
    assert {t: quick[t] for t in usual} == usual
    found = {r.t: r.c for r in frame.select("t", money.cents_from_text(F.col("t")).alias("c")).collect()}
    for text in [*usual, *odd]:
        number = re.match(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", re.sub(r"[^0-9.\-]+", "", text))
        cents = int((Decimal(number[0]) * 100).to_integral_value(ROUND_HALF_UP)) if number else 0
        assert found[text] == (cents if abs(cents) < 2**63 else None), text


def test_texts_that_cannot_hold_a_shape_meet_no_pattern(spark):
    """Every text that a pattern fits has the mark that is looked for before it."""
    dates = ["05-Jan-98", "January 5, 1998", "May 5, 1998", "Jan 5, 1998", "1998-1-5", "1998-01-05T10:00", "1/5/1998", "1998/1/5", "5 January 1998", "5 Jan 1998", "January 5 1998", "Jan 5 1998", "1-5-1998", "5-Jan-1998"]
    frame = spark.createDataFrame([(t,) for t in dates], "t string")
    fits = [F.col("t").rlike(shape).alias(f"s{i}") for i, (shape, _) in enumerate(text.DATE_SHAPES)]
    marks = [mark(F.col("t")).alias(f"m{i}") for i, mark in enumerate(text.DATE_MARKS)]
    rows = frame.select("t", *fits, *marks).collect()
    assert {i for r in rows for i in range(len(text.DATE_SHAPES)) if r[f"s{i}"]} == set(range(len(text.DATE_SHAPES)))
    assert all(r[f"m{i}"] for r in rows for i in range(len(text.DATE_SHAPES)) if r[f"s{i}"])
    assert frame.filter(text.clean_date(F.col("t")).isNull()).count() == 0
    numbers = [("ORDER 4105054431", "4105054431"), ("order #12345678", "12345678"), ("#12345678", "12345678"), ("Listing #12345678", None), ("reorder 12345678", None), (None, None)]
    found = spark.createDataFrame(numbers, "t string, n string").withColumn("found", text.order_no_in(F.col("t")))
    assert found.filter("not (n <=> found)").count() == 0
