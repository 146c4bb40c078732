"""Validation gates and load counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.functions import text

# Years the inventory load leaves out, and the largest quantity of one row.
SKIPPED_YEARS = ("2022", "2023", "2024")
MAX_QUANTITY = 50

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ORDER_ID = r"^\d+(-\d+)?$"


def _iso_or_empty(column: str) -> Column:
    shown = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (shown == "") | shown.rlike(ISO_DATE)


def billing_row_ok() -> Column:
    return (
        (F.coalesce(F.col("waybill"), F.lit("")) != "")
        & _iso_or_empty("invoice_date")
        & _iso_or_empty("due_date")
        & F.col("amount_cents").isNotNull()
    )


def validate_billing(rows: DataFrame, file: str = "file") -> DataFrame:
    """Total and failed rows of each file; one bad row rejects the file."""
    counts = rows.groupBy(file).agg(
        F.count("*").alias("total_rows"), F.count_if(~billing_row_ok()).alias("failed_rows")
    )
    return counts.withColumn("accepted", F.col("failed_rows") == 0)


def skip_years(rows: DataFrame, years: Sequence[str] = SKIPPED_YEARS) -> DataFrame:
    return rows.filter(~in_years(years))


def in_years(years: Sequence[str]) -> Column:
    hit = F.lit(False)
    for year in years:
        hit = hit | F.contains(F.col("date"), F.lit(year))
    return hit


def check_inventory(
    rows: DataFrame, years: Sequence[str] = SKIPPED_YEARS, max_quantity: int = MAX_QUANTITY
) -> DataFrame:
    """Add ``quantity_e4`` (ten-thousandths) and ``reject_reason``, null for a valid row."""
    amount = text.leading_number(F.col("quantity"))
    rows = rows.withColumn("quantity_e4", amount)
    quantity_ok = F.coalesce(F.col("quantity_e4").between(0, max_quantity * 10000), F.lit(False))
    reason = (
        F.when(in_years(years), "skipped year")
        .when(F.col("date") == "", "no date")
        .when(~F.col("order_id").rlike(ORDER_ID), "bad order id")
        .when(F.trim("material") == "", "no material")
        .when(F.col("category") == "", "no category")
        .when(F.col("color") == "", "no color")
        .when(~quantity_ok, "bad quantity")
    )
    return rows.withColumn("reject_reason", reason)


def valid_inventory(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def inventory_rejects(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


def load_counts(checked: DataFrame) -> DataFrame:
    """Rows read, rows skipped and the new cursor; skipped rows move the cursor too."""
    return checked.agg(
        F.count("*").alias("read_rows"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("skipped_rows"),
        F.coalesce(F.max("row_index"), F.lit(0).cast("bigint")).alias("max_row_index"),
    )


def import_counts(flagged: DataFrame, file: str = "import_id") -> DataFrame:
    """New and duplicate rows of each import; needs ``category``, ``order_no`` and ``is_new``."""
    new = F.col("is_new")
    sale = F.col("category") == "SALE"
    listing = F.col("category") == "LISTING_FEE"
    counts = flagged.groupBy(file).agg(
        F.count("*").alias("total_rows"),
        F.count_if(new).alias("new_rows"),
        F.count_if(sale).alias("sale_rows"),
        F.count_if(sale & new).alias("new_sales"),
        F.count_if(~sale & new).alias("new_expenses"),
        F.count_if(listing).alias("listing_rows"),
        F.count_if(listing & new).alias("new_listing_rows"),
    )
    return counts.select(
        file,
        "total_rows",
        "new_rows",
        (F.col("total_rows") - F.col("new_rows")).alias("duplicate_rows"),
        "new_sales",
        (F.col("sale_rows") - F.col("new_sales")).alias("duplicate_sales"),
        "new_expenses",
        (F.col("total_rows") - F.col("sale_rows") - F.col("new_expenses")).alias("duplicate_expenses"),
        "new_listing_rows",
        (F.col("listing_rows") - F.col("new_listing_rows")).alias("duplicate_listing_rows"),
    )
