"""Store-level expense pools and their allocation to the orders of an import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.plans.skew import join_groups


def pool_totals(store_expenses: DataFrame) -> DataFrame:
    """Pool per import and category: the absolute net total. Deposits and zero pools are left out."""
    pools = (
        store_expenses.filter(F.col("category") != "DEPOSIT")
        .groupBy("import_id", "category")
        .agg(
            F.sum("net_cents").alias("net_cents"),
            F.min("expense_date").alias("first_date"),
            F.max("expense_date").alias("last_date"),
        )
    )
    return pools.withColumn("pool_cents", F.abs("net_cents")).filter(F.col("pool_cents") != 0)


def eligible_orders(new_sales: DataFrame, prior_allocations: DataFrame) -> DataFrame:
    """Orders with a new sale that never received an allocation, per import."""
    sold = new_sales.select("import_id", "order_no").distinct()
    return sold.join(prior_allocations.select("order_no").distinct(), "order_no", "left_anti")


def allocation_turns(candidates: DataFrame, pools: DataFrame) -> DataFrame:
    """The import in which each candidate order is allocated: its first one that has a pool.

    Imports are taken in the order of their ids. An order that was allocated in one import
    is not eligible in a later one, which makes its turn a plain minimum.
    """
    sizes = candidates.groupBy("import_id").agg(F.count("*").alias("candidates"))
    funded = sizes.join(pools.select("import_id").distinct(), "import_id")
    kept = join_groups(candidates, funded, "import_id", "candidates", F.col("order_no"))
    return kept.groupBy("order_no").agg(F.min("import_id").alias("import_id"))


def _batch_id(category: Column) -> Column:
    return F.concat_ws("_", F.lit("batch"), F.col("import_id").cast("string"), category)


def allocate_pool(candidates: DataFrame, pools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches and allocations of every pool over its import's orders, to the cent.

    Each order takes the share rounded down to cents, the highest order number also the
    remainder. The order count and highest order come from an aggregate, so an import with
    any number of orders needs no window.
    """
    return shares_of(allocation_turns(candidates, pools), pools)


def shares_of(turns: DataFrame, pools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batches and allocations of ``allocate_pool`` from every order's turn; both read the turns."""
    sizes = turns.groupBy("import_id").agg(F.count("*").alias("orders"), F.max("order_no").alias("last_order"))
    batches = pools.join(sizes, "import_id").withColumn("batch_id", _batch_id(F.col("category")))
    # One record per import keeps the join free of repeats; an import has a handful of categories.
    grouped = (
        pools.groupBy("import_id")
        .agg(F.collect_list(F.struct("category", "pool_cents")).alias("pools"))
        .join(sizes, "import_id")
    )
    shared = join_groups(turns, grouped, "import_id", "orders", F.col("order_no")).withColumn("pool", F.explode("pools"))
    batch = _batch_id(F.col("pool.category"))
    share = F.floor(F.col("pool.pool_cents") / F.col("orders"))
    rest = F.col("pool.pool_cents") - share * (F.col("orders") - 1)
    allocations = shared.select(
        F.concat_ws("_", batch, F.col("order_no")).alias("allocation_id"),
        batch.alias("batch_id"),
        "order_no",
        F.col("pool.category").alias("category"),
        F.when(F.col("order_no") == F.col("last_order"), rest).otherwise(share).alias("amount_cents"),
    )
    return batches.select("batch_id", "import_id", "category", "pool_cents", "orders"), allocations


def allocated_by_category(allocations: DataFrame, batches: DataFrame) -> DataFrame:
    """Allocations with the expense category taken from their batch."""
    kinds = batches.select("batch_id", "category", "orders")
    shares = allocations.select("batch_id", "order_no", "amount_cents")
    return join_groups(shares, kinds, "batch_id", "orders", F.col("order_no")).drop("batch_id", "orders")


def order_pool_pivot(allocations: DataFrame, batches: DataFrame) -> DataFrame:
    """Listing and store-ads share per order; the total holds the other pools too."""
    amount, category = F.col("amount_cents"), F.col("category")
    zero = F.lit(0).cast("bigint")
    return (
        allocated_by_category(allocations, batches)
        .groupBy("order_no")
        .agg(
            F.sum(F.when(category == "LISTING_FEE", amount).otherwise(zero)).alias("listing_expense"),
            F.sum(F.when(category == "ETSY_ADS", amount).otherwise(zero)).alias("store_ads_expense"),
            F.sum(amount).alias("pool_expense"),
        )
    )


def unallocated_pools(pools: DataFrame, batches: DataFrame) -> DataFrame:
    """Pools whose import had no eligible order; their cost reaches no order."""
    return pools.join(batches.select("import_id", "category"), ["import_id", "category"], "left_anti")
