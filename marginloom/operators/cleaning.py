"""Cleaning jobs over whole tables. All work is column expressions; only occurrence numbers shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.functions import classify, money, text

# Material rates in cents per unit; any other named material takes OTHER.
MATERIAL_RATES = {"COTTON": 9000, "OTHER": 10000}

FINGERPRINT_COLUMNS = (
    "transaction_date",
    "type",
    "title",
    "info",
    "currency",
    "amount_cents",
    "fees_cents",
    "net_cents",
    "tax_details",
)

# Copies one task writes at once for a group of identical rows.
COPIES_PER_TASK = 100_000


def clean_amounts(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add cents for amount texts; ``columns`` maps text column to new column."""
    return df.withColumns({new: money.cents_from_text(F.col(old)) for old, new in columns.items()})


def clean_dates(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.withColumns({new: text.clean_date(F.col(old)) for old, new in columns.items()})


def clean_waybills(df: DataFrame, column: str = "waybill") -> DataFrame:
    return df.withColumn(column, text.clean_waybill(F.col(column)))


def strip_item_suffix(df: DataFrame, column: str = "order_id", new: str = "order_no") -> DataFrame:
    return df.withColumn(new, text.order_of_item(F.col(column)))


def extract_order_no(df: DataFrame) -> DataFrame:
    """Add ``order_no`` from the title, else from the info text."""
    found = F.coalesce(text.order_no_in(F.col("title")), text.order_no_in(F.col("info")))
    return df.withColumn("order_no", found)


def classify_transactions(df: DataFrame) -> DataFrame:
    """Add ``scope`` and ``category``; needs type, title, info and order_no."""
    kind, heading = F.lower("type"), F.lower("title")
    return (
        df.withColumns(
            {
                "kind": kind,
                "heading": heading,
                "line": F.concat_ws(" ", kind, heading, F.lower("info")),
                "has_order": F.coalesce(F.col("order_no"), F.lit("")) != "",
            }
        )
        .withColumn("rule", classify.deciding_rule())
        .withColumns({"scope": classify.scope_of(F.col("rule")), "category": classify.category_of(F.col("rule"))})
        .drop("kind", "heading", "line", "has_order", "rule")
    )


def extract_listing_id(df: DataFrame) -> DataFrame:
    """Add ``listing_id`` for store-scope rows and rows whose title speaks of a listing."""
    found = F.coalesce(text.listing_id_in(F.col("title")), text.listing_id_in(F.col("info")))
    wanted = (F.col("scope") == classify.STORE) | F.contains(F.lower("title"), F.lit("listing"))
    return df.withColumn("listing_id", F.when(wanted, found))


def tax_component(df: DataFrame, amount: str = "amount_cents", new: str = "tax_cents") -> DataFrame:
    return df.withColumn(new, money.tax_component(F.col(amount)))


def rate_of(material: Column, rates: Mapping[str, int] = MATERIAL_RATES) -> Column:
    """Rate in cents per unit from a literal map, so no join; blank material has none."""
    named = [F.lit(v) for k, r in rates.items() if k != "OTHER" for v in (k, r)]
    key = F.upper(F.trim(material))
    known = F.create_map(*named)[key]
    return F.when(key != "", F.coalesce(known, F.lit(rates["OTHER"])).cast("bigint"))


def material_rate(df: DataFrame, rates: Mapping[str, int] = MATERIAL_RATES) -> DataFrame:
    return df.withColumn("rate_cents", rate_of(F.col("material"), rates))


def fingerprint(df: DataFrame, columns: tuple[str, ...] = FINGERPRINT_COLUMNS) -> DataFrame:
    """Add ``fingerprint``, a SHA-256 over the normalised fields joined by a bar."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn("fingerprint", F.sha2(F.concat_ws("|", *parts), 256))


def _as_counted(rows: DataFrame) -> DataFrame:
    return rows


def number_occurrences(
    df: DataFrame, copies_per_task: int = COPIES_PER_TASK, finish: Callable[[DataFrame], DataFrame] = _as_counted
) -> DataFrame:
    """Number identical rows within a file and give each its own ``transaction_hash``.

    Identical rows are interchangeable, so they are counted first (copies collapse before
    the shuffle) and written out again afterwards, ``copies_per_task`` at a time: the parts
    of a group with more copies go to different tasks. Only such groups are dealt out once
    more for that, one row per part; all others are written out where they were counted.
    ``finish`` adds columns that follow from the others, after the shuffle; ``fingerprint``
    may be one of them.
    """
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    per_task = F.lit(copies_per_task).cast("bigint")
    few = finish(groups.filter(F.col("copies") <= per_task)).withColumn("part", F.lit(0).cast("bigint"))
    last = F.floor((F.col("copies") - 1) / per_task)
    parts = groups.filter(F.col("copies") > per_task).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    dealt = few.unionByName(finish(parts).repartition("fingerprint", "part"))
    begin = F.col("part") * per_task
    copies = F.sequence(begin + 1, F.least(begin + per_task, F.col("copies")))
    numbered = dealt.withColumn("occurrence_no", F.explode(copies)).drop("copies", "part")
    return numbered.withColumn("transaction_hash", row_hash())


def row_hash() -> Column:
    """The hash of a numbered row."""
    return F.sha2(F.concat_ws("|", F.col("fingerprint"), F.col("occurrence_no").cast("string")), 256)


def packed(df: DataFrame, column: str = "fingerprint") -> DataFrame:
    """A SHA-256 column as 32 bytes, half of its text, for a shuffle."""
    return df.withColumn(column, F.unhex(column))


def unpacked(df: DataFrame, column: str = "fingerprint") -> DataFrame:
    return df.withColumn(column, F.lower(F.hex(column)))


def typed_statement(rows: DataFrame) -> DataFrame:
    """Statement text rows with amounts in cents and a date."""
    return clean_dates(
        clean_amounts(rows, {"amount": "amount_cents", "fees": "fees_cents", "net": "net_cents"}),
        {"date": "transaction_date"},
    ).drop("amount", "fees", "net", "date")


def classified_statement(typed: DataFrame) -> DataFrame:
    """All that follows from the fields of a typed row: order number, scope, category, listing and fingerprint."""
    return fingerprint(extract_listing_id(classify_transactions(extract_order_no(typed))))


def clean_statement(rows: DataFrame) -> DataFrame:
    """Statement text rows to typed, classified and fingerprinted rows."""
    return classified_statement(typed_statement(rows))
