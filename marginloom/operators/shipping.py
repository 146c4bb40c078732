"""Carrier cost per waybill, its allocation to orders, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginloom.functions import money
from marginloom.plans.skew import join_groups

# Scale of an unrounded tax share: hundred-millionths of a currency unit.
SHARE_SCALE = 100_000_000


def _has_waybill() -> Column:
    return F.col("waybill").isNotNull() & (F.col("waybill") != "")


def waybill_cost(billing: DataFrame) -> DataFrame:
    """Cost of each waybill over all its billing lines."""
    billed = billing.filter(_has_waybill())
    return billed.groupBy("waybill").agg(F.sum(F.coalesce("amount_cents", F.lit(0))).alias("cost_cents"))


def waybill_cost_latest(billing: DataFrame) -> DataFrame:
    """Cost of each waybill from its last billing line (by invoice date, then billing id, then amount)."""
    billed = billing.filter(_has_waybill())
    last = F.max(F.struct("invoice_date", "billing_id", "amount_cents"))["amount_cents"]
    return billed.groupBy("waybill").agg(F.coalesce(last, F.lit(0).cast("bigint")).alias("cost_cents"))


def linked_waybills(links: DataFrame) -> DataFrame:
    """One record per waybill: its orders counted and the highest order number."""
    known = links.filter(_has_waybill())
    return known.groupBy("waybill").agg(F.count("*").alias("orders"), F.max("order_no").alias("last_order"))


def waybills_matched(costs: DataFrame, links: DataFrame) -> DataFrame:
    """Billed waybills with at least one linked order. Links collapse per waybill before the join."""
    return costs.join(linked_waybills(links), "waybill")


def waybills_unmatched(costs: DataFrame, links: DataFrame) -> DataFrame:
    return costs.join(links.select("waybill").distinct(), "waybill", "left_anti")


def match_counts(costs: DataFrame, links: DataFrame) -> DataFrame:
    """One row: billed, matched and unmatched waybills, and whether an allocation may be written."""
    flagged = costs.join(linked_waybills(links), "waybill", "left")
    counts = flagged.agg(
        F.count("*").alias("billed"),
        F.count("orders").alias("matched"),
        F.count_if(F.col("orders").isNull()).alias("unmatched"),
    )
    return counts.withColumn("may_write", (F.col("billed") == 0) | (F.col("matched") > 0))


def match_changes(billing: DataFrame, billed_before: Column, links: DataFrame, linked_before: Column) -> DataFrame:
    """How the counts of billed and matched waybills have moved, from all bills and links of the waybills that changed.

    The conditions tell which bills and links were counted before.
    """
    no = F.lit(False)

    def marks(rows: DataFrame, kind: str, before: Column) -> DataFrame:
        other = "linked" if kind == "billed" else "billed"
        states = [F.lit(True).alias(kind), before.alias(f"was_{kind}"), no.alias(other), no.alias(f"was_{other}")]
        return rows.filter(_has_waybill()).select("waybill", *states)

    rows = marks(billing, "billed", billed_before).unionByName(marks(links, "linked", linked_before))
    states = ("billed", "was_billed", "linked", "was_linked")
    flags = rows.groupBy("waybill").agg(*[F.bool_or(c).alias(c) for c in states])
    was_matched = F.col("was_billed") & F.col("was_linked")
    return flags.agg(
        (F.count_if(F.col("billed")) - F.count_if(F.col("was_billed"))).alias("billed"),
        (F.count_if(F.col("billed") & F.col("linked")) - F.count_if(was_matched)).alias("matched"),
    )


def _split(costs: DataFrame, links: DataFrame) -> DataFrame:
    """Every link with its waybill's cost, order count and highest order."""
    pairs = links.filter(_has_waybill()).select("order_no", "waybill")
    # The broadcast marks need the order count alone, yet ask for both, so that one aggregate serves both uses.
    linked = costs.join(linked_waybills(links).filter(F.col("last_order").isNotNull()), "waybill")
    return join_groups(pairs, linked, "waybill", "orders", F.col("order_no"))


def _cost_share(cost: Column, orders: Column) -> Column:
    return F.floor(cost / orders + 0.5)


def allocate_shipping(costs: DataFrame, links: DataFrame) -> DataFrame:
    """Split each waybill's cost over its orders to the cent.

    Every order takes the rounded equal share, the highest order number what is left.
    The split needs only the waybill's order count and highest order, so no waybill's
    orders ever meet in one task.
    """
    split = _split(costs, links)
    share = _cost_share(F.col("cost_cents"), F.col("orders"))
    rest = F.col("cost_cents") - share * (F.col("orders") - 1)
    allocated = F.when(F.col("order_no") == F.col("last_order"), rest).otherwise(share)
    return split.select("order_no", "waybill", allocated.alias("allocated_cents"))


def allocate_shipping_tax(costs: DataFrame, links: DataFrame) -> DataFrame:
    """Shipping cost per order as equal, unrounded shares of the tax inside each waybill's cost."""
    split = _split(costs, links)
    share = money.currency(F.col("cost_cents")) * money.TAX_RATE / money.TAX_BASE / F.col("orders")
    scaled = split.select("order_no", F.floor(share * SHARE_SCALE + 0.5).alias("share"))
    costs_by_order = scaled.groupBy("order_no").agg(F.sum("share").alias("share"))
    linked = links.groupBy("order_no").agg(F.count("*").alias("waybill_count"))
    return linked.join(costs_by_order, "order_no", "left").select(
        "order_no", (F.col("share") / SHARE_SCALE).alias("shipping_cost"), "waybill_count"
    )


def waybill_lists(links: DataFrame) -> DataFrame:
    """Sorted waybills of each order as one text cell."""
    listed = links.groupBy("order_no").agg(F.collect_set("waybill").alias("waybills"))
    return listed.withColumn("waybills", F.array_join(F.array_sort("waybills"), ", "))


def order_shipping_cost(links: DataFrame, allocations: DataFrame) -> DataFrame:
    """Allocated cost, waybill list and link count per order; a link without a bill keeps the cost null."""
    linked = links.select("order_no", "waybill").join(allocations, ["order_no", "waybill"], "left")
    return (
        linked.groupBy("order_no")
        .agg(
            F.sum("allocated_cents").alias("shipping_cost"),
            F.collect_set("waybill").alias("waybills"),
            F.count("*").alias("links"),
        )
        .select(
            "order_no",
            "shipping_cost",
            F.array_join(F.array_sort("waybills"), ", ").alias("waybills"),
            F.size("waybills").cast("bigint").alias("waybill_count"),
            "links",
        )
    )


def allocation_check(costs: DataFrame, allocations: DataFrame) -> DataFrame:
    """Allocated against billed cost of each allocated waybill, within one cent."""
    sums = allocations.groupBy("waybill").agg(F.sum("allocated_cents").alias("allocated_cents"))
    checked = costs.join(sums, "waybill")
    difference = F.abs(F.col("allocated_cents") - F.col("cost_cents"))
    return checked.withColumns({"difference_cents": difference, "reconciled": difference <= 1})
