"""Per-order financials: every fact source becomes a sparse row, and one aggregate combines them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.functions import money
from marginloom.operators import inventory as material
from marginloom.operators import shipping

# Expense category behind each fee column.
FEE_CATEGORIES = {
    "tds": "TDS",
    "tcs": "TCS",
    "transaction_fee": "TRANSACTION_FEE",
    "processing_fee": "PROCESSING_FEE",
    "sales_tax": "SALES_TAX",
    "regulatory_fee": "REGULATORY_FEE",
    "buyer_fee": "BUYER_FEE",
    "offsite_ads": "OFFSITE_ADS",
}

NO_WAYBILL = "N/A"

MEASURES = [
    "sales",
    "refunds",
    "material_cost",
    "shipping_cost",
    "listing_expense",
    "store_ads_expense",
    "pool_expense",
    *FEE_CATEGORIES,
    "order_fees",
]

MONEY_COLUMNS = [*MEASURES, "shipping_duty", "shipping_transport", "marketplace_expense", "total_expense", "profit", "net_sales"]


@dataclass(frozen=True)
class Ledgers:
    """The tables the financials are computed from; amounts are in cents."""

    sales: DataFrame
    expenses: DataFrame
    inventory: DataFrame
    order_shipments: DataFrame
    shipping_allocations: DataFrame
    pool_allocations: DataFrame

    def only_orders(self, orders: DataFrame) -> Ledgers:
        """The ledgers cut to a few orders; ``orders`` must be small by construction, as after a limit."""
        few = F.broadcast(orders.select("order_no"))

        def cut(table: DataFrame) -> DataFrame:
            return table.join(few, "order_no", "left_semi")

        return Ledgers(
            cut(self.sales),
            cut(self.expenses),
            cut(self.inventory),
            cut(self.order_shipments),
            cut(self.shipping_allocations),
            cut(self.pool_allocations),
        )


def has_order() -> Column:
    return F.col("order_no").isNotNull() & (F.col("order_no") != "")


def is_order_fee() -> Column:
    return has_order() & (F.col("category") != "REFUND") & ~F.col("is_allocation")


def order_sales(sales: DataFrame) -> DataFrame:
    return sales.groupBy("order_no").agg(F.sum("gross_cents").alias("sales"))


def order_refunds(expenses: DataFrame) -> DataFrame:
    refunds = expenses.filter(F.col("category") == "REFUND")
    return refunds.groupBy("order_no").agg(F.sum(-F.col("net_cents")).alias("refunds"))


def order_expense_pivot(expenses: DataFrame) -> DataFrame:
    """Eight fee columns and their total with the uncategorised rest, per order."""
    cost = -F.col("net_cents")
    zero = F.lit(0).cast("bigint")
    fees = [
        F.sum(F.when(F.col("category") == category, cost).otherwise(zero)).alias(name)
        for name, category in FEE_CATEGORIES.items()
    ]
    return expenses.filter(is_order_fee()).groupBy("order_no").agg(*fees, F.sum(cost).alias("order_fees"))


def order_universe(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """Orders seen in sales or expenses with their first date."""
    sold = sales.select("order_no", "sale_date")
    charged = expenses.filter(has_order()).select("order_no", F.col("expense_date").alias("sale_date"))
    return sold.unionByName(charged).groupBy("order_no").agg(F.min("sale_date").alias("sale_date"))


def order_keys(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """Every order with its first date and refunds: what orders are filtered and sorted by."""
    sold = sales.select("order_no", "sale_date")
    charged = expenses.filter(has_order()).select(
        "order_no",
        F.col("expense_date").alias("sale_date"),
        F.when(F.col("category") == "REFUND", -F.col("net_cents")).alias("refunds"),
    )
    facts = sold.unionByName(charged, allowMissingColumns=True)
    refunds = F.coalesce(F.sum("refunds"), F.lit(0).cast("bigint"))
    return facts.groupBy("order_no").agg(F.min("sale_date").alias("sale_date"), refunds.alias("refunds"))


def order_facts(t: Ledgers) -> DataFrame:
    """All fact sources as rows of order number, date and measures; absent measures are null."""
    listed = F.lit(1).alias("listed")
    cost = -F.col("net_cents")
    fee = [
        F.when((F.col("category") == category) & ~F.col("is_allocation"), cost).alias(name)
        for name, category in FEE_CATEGORIES.items()
    ]
    kind, amount = F.col("category"), F.col("amount_cents")
    sources = [
        t.sales.select("order_no", F.col("sale_date"), listed, F.col("gross_cents").alias("sales")),
        t.expenses.filter(has_order()).select(
            "order_no",
            F.col("expense_date").alias("sale_date"),
            listed,
            F.when(kind == "REFUND", cost).alias("refunds"),
            *fee,
            F.when(is_order_fee(), cost).alias("order_fees"),
        ),
        t.inventory.select("order_no", material.material_units().alias("material_cost")),
        t.shipping_allocations.select("order_no", F.col("allocated_cents").alias("shipping_cost")),
        t.pool_allocations.select(
            "order_no",
            F.when(kind == "LISTING_FEE", amount).alias("listing_expense"),
            F.when(kind == "ETSY_ADS", amount).alias("store_ads_expense"),
            amount.alias("pool_expense"),
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def order_financials(t: Ledgers, with_waybills: bool = True) -> DataFrame:
    """Sales, costs, profit and margin of every order in the sales or expense ledger, in cents.

    All facts meet in one aggregate by order, partially combined before its shuffle; long
    sums keep it a hash aggregate. The waybill list needs an object aggregate and joins
    on the same key, only if it is wanted.
    """
    combined = (
        order_facts(t)
        .groupBy("order_no")
        .agg(
            F.min("sale_date").alias("sale_date"),
            F.max("listed").alias("listed"),
            *[F.sum(m).alias(m) for m in MEASURES],
        )
        .filter(F.col("listed") == 1)
        .drop("listed")
    )
    result = with_totals(combined)
    if with_waybills:
        lists = shipping.waybill_lists(t.order_shipments)
        result = result.join(lists, "order_no", "left").fillna(NO_WAYBILL, ["waybills"])
    return result


def with_totals(sums: DataFrame) -> DataFrame:
    """Costs, profit and margin from the sums of each order's facts; material cost comes in as units."""
    zero = F.lit(0).cast("bigint")
    filled = sums.withColumns({m: F.coalesce(F.col(m), zero) for m in MEASURES})
    filled = filled.withColumn("material_cost", material.units_to_cents(F.col("material_cost")))
    expense = F.col("material_cost") + F.col("shipping_cost") + F.col("order_fees") + F.col("pool_expense")
    net = F.col("sales") - F.col("refunds")
    return filled.withColumns(
        {
            "shipping_duty": zero,
            "shipping_transport": zero,
            "marketplace_expense": F.col("order_fees") + F.col("pool_expense"),
            "total_expense": expense,
            "net_sales": net,
            "profit": net - expense,
            "margin": money.percent(net - expense, net),
        }
    )


def sale_month() -> Column:
    """The month an order's results are stored under, 0 without a date."""
    return F.coalesce(F.date_format("sale_date", "yyyyMM").cast("int"), F.lit(0))


def months_between(first: str, last: str) -> tuple[int, int]:
    """The first and last stored month of a date range."""
    low, high = (int(d[:4]) * 100 + int(d[5:7]) for d in (first, last))
    return low, high


def write_financials(financials: DataFrame, path: str) -> None:
    """Store per-order results by sale month, so date-ranged reports read only their months."""
    by_month = financials.withColumn("sale_month", sale_month()).hint("rebalance", "sale_month")
    by_month.write.mode("overwrite").partitionBy("sale_month").parquet(path)


def read_financials(spark, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored results of the months that touch the date range; other folders are not read. Without dates, all."""
    stored = spark.read.parquet(path)
    if first and last:
        stored = stored.filter(F.col("sale_month").between(*months_between(first, last)))
    return stored.drop("sale_month")
