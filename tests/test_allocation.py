import functools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginloom.operators import pools, shipping
from marginloom.plans import skew

LINKS = "order_no string, waybill string"
COSTS = "waybill string, cost_cents bigint"


def cents(df):
    return {(r.order_no, r.waybill): r.allocated_cents for r in df.collect()}


@pytest.mark.parametrize(
    "cost, orders, shares",
    [
        (60000, 3, [20000, 20000, 20000]),
        (100000, 3, [33333, 33333, 33334]),
        (2, 3, [1, 1, 0]),
        (-100, 3, [-33, -33, -34]),
        (0, 2, [0, 0]),
        (5, 2, [3, 2]),
    ],
)
def test_shipping_split(frame, cost, orders, shares):
    links = frame([(str(i), "w") for i in range(orders)], LINKS)
    got = cents(shipping.allocate_shipping(frame([("w", cost)], COSTS), links))
    assert [got[(str(i), "w")] for i in range(orders)] == shares


def test_order_with_own_and_shared_waybill(frame):
    links = frame([("a", "w1"), ("a", "w2"), ("b", "w2"), ("c", "w2"), ("c", "w3")], LINKS)
    costs = frame([("w1", 30000), ("w2", 60000), ("w9", 5)], COSTS)
    allocated = shipping.allocate_shipping(costs, links)
    rows = {r.order_no: r for r in shipping.order_shipping_cost(links, allocated).collect()}
    assert (rows["a"].shipping_cost, rows["a"].waybills, rows["a"].waybill_count) == (50000, "w1, w2", 2)
    assert (rows["c"].shipping_cost, rows["c"].waybills, rows["c"].links) == (20000, "w2, w3", 2)
    assert {r.waybill for r in shipping.waybills_unmatched(costs, links).collect()} == {"w9"}
    counts = shipping.match_counts(costs, links).first()
    assert (counts.billed, counts.matched, counts.unmatched, counts.may_write) == (3, 2, 1, True)


def test_link_without_bill_keeps_null(frame):
    links = frame([("a", "w1")], LINKS)
    nothing = shipping.allocate_shipping(frame([], COSTS), links)
    row = shipping.order_shipping_cost(links, nothing).first()
    assert (row.shipping_cost, row.waybills) == (None, "w1")
    assert shipping.match_counts(frame([("x", 1)], COSTS), links).first().may_write is False


@pytest.mark.parametrize("rows_per_task", [1, 100, 1_000_000])
def test_hot_waybill_against_brute_force(frame, monkeypatch, rows_per_task):
    """One waybill owns a third of the links; however small the parts, the result is whole."""
    monkeypatch.setattr(shipping, "join_groups", functools.partial(skew.join_groups, rows_per_task=rows_per_task))
    rng = random.Random(7)
    pairs = {(f"{i:05d}", "hot") for i in range(1000)}
    pairs |= {(f"{rng.randrange(3000):05d}", f"w{rng.randrange(400)}") for _ in range(2000)}
    costs = {f"w{i}": rng.randrange(-500, 100000) for i in range(350)} | {"hot": 1234567}
    expected = {}
    by_waybill = defaultdict(list)
    for order, waybill in pairs:
        by_waybill[waybill].append(order)
    for waybill, orders in by_waybill.items():
        if waybill in costs:
            orders.sort()
            share = (2 * costs[waybill] + len(orders)) // (2 * len(orders))
            for order in orders[:-1]:
                expected[(order, waybill)] = share
            expected[(orders[-1], waybill)] = costs[waybill] - share * (len(orders) - 1)
    links, cost_table = frame(sorted(pairs), LINKS), frame(list(costs.items()), COSTS)
    allocated = shipping.allocate_shipping(cost_table, links)
    assert cents(allocated) == expected
    check = shipping.allocation_check(cost_table, allocated).collect()
    assert all(r.reconciled and r.difference_cents == 0 for r in check)


def test_heavy_rows_are_spread(frame, spark):
    """Groups are cut by their own size: however many are large, none keeps its rows together."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = frame([("hot", f"{i}") for i in range(4000)], "k string, v string")
        many = spark.range(1500 * 30).selectExpr("concat('m', id % 1500) k", "cast(id as string) v")
        small = frame([(f"k{i}", f"{i}") for i in range(50)], "k string, v string")
        rows = rows.unionByName(many).unionByName(small)
        groups = rows.groupBy("k").agg(F.count("*").alias("n"))
        joined = skew.join_groups(rows, groups, "k", "n", F.col("v"), rows_per_task=10)
        assert joined.count() == 4000 + 45_000 + 50
        placed = joined.withColumn("task", F.spark_partition_id())
        parts = placed.groupBy("k").agg(F.countDistinct("task").alias("tasks"))
        tasks = {r.k: r.tasks for r in parts.collect()}
        assert tasks["hot"] == 8 and min(t for k, t in tasks.items() if k[0] == "m") >= 1
        assert sum(t >= 2 for k, t in tasks.items() if k[0] == "m") > 1200
        assert all(tasks[f"k{i}"] == 1 for i in range(50))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_aggregate_of_the_links(frame):
    """The size marks and the groups come from one aggregate, whose exchange is reused."""
    links, costs = frame([("a", "w"), ("b", "w")], LINKS), frame([("w", 23600)], COSTS)
    allocated = shipping.allocate_shipping(costs, links)
    allocated.collect()
    plan = allocated._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.count("partial_max(order_no") == 1


def test_tax_variant(frame):
    links = frame([("a", "w"), ("b", "w"), ("b", "x")], LINKS)
    rows = {r.order_no: r for r in shipping.allocate_shipping_tax(frame([("w", 23600)], COSTS), links).collect()}
    assert rows["a"].shipping_cost == pytest.approx(18.0, abs=1e-7)
    assert (rows["b"].shipping_cost, rows["b"].waybill_count) == (pytest.approx(18.0, abs=1e-7), 2)


def test_waybill_cost_sum_and_latest(frame):
    billing = frame(
        [("w", 100, "2026-01-02", 1), ("w", 300, "2026-01-01", 9), ("", 5, "2026-01-01", 2)],
        "waybill string, amount_cents bigint, invoice_date string, billing_id int",
    )
    assert [tuple(r) for r in shipping.waybill_cost(billing).collect()] == [("w", 400)]
    assert [tuple(r) for r in shipping.waybill_cost_latest(billing).collect()] == [("w", 100)]


SALES = "import_id bigint, order_no string"
EXPENSES = "import_id bigint, category string, net_cents bigint, expense_date date"


def sequential_pools(sales, pool, allocated):
    """Imports one after the other, each sharing its pools among its orders not allocated before."""
    result = {}
    for import_id in sorted({i for i, _ in sales} | {i for i, _ in pool}):
        orders = sorted({o for i, o in sales if i == import_id} - allocated)
        mine = {c: abs(a) for (i, c), a in pool.items() if i == import_id and a != 0}
        if not orders or not mine:
            continue
        for category, amount in mine.items():
            share = amount // len(orders)
            for order in orders:
                result[(import_id, category, order)] = share
            result[(import_id, category, orders[-1])] += amount - share * len(orders)
        allocated |= set(orders)
    return result


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pools_against_sequential_imports(frame, seed):
    rng = random.Random(seed)
    sales = {(rng.randrange(8), f"{rng.randrange(60):03d}") for _ in range(150)} | {(3, f"{i:03d}") for i in range(100)}
    pool = {(i, c): rng.choice([0, -rng.randrange(1, 9999), 777]) for i in range(9) for c in ("LISTING_FEE", "ETSY_ADS", "OTHER")}
    before = {f"{i:03d}" for i in range(0, 60, 7)}
    expenses = [(i, c, a, None) for (i, c), a in pool.items()] + [(i, "DEPOSIT", -5, None) for i in range(9)]
    totals = pools.pool_totals(frame(expenses, EXPENSES))
    prior = frame([(o,) for o in before], "order_no string")
    candidates = pools.eligible_orders(frame(sorted(sales), SALES), prior)
    batches, allocations = pools.allocate_pool(candidates, totals)
    expected = sequential_pools(sales, pool, set(before))
    got = {(r.batch_id, r.order_no): r.amount_cents for r in allocations.collect()}
    assert got == {(f"batch_{i}_{c}", o): a for (i, c, o), a in expected.items()}
    sums = allocations.groupBy("batch_id").agg(F.sum("amount_cents").alias("s")).join(batches, "batch_id").collect()
    assert sums and all(r.s == r.pool_cents for r in sums)
    left = {(r.import_id, r.category) for r in pools.unallocated_pools(totals, batches).collect()}
    used = {(i, c) for i, c, _ in expected}
    assert left == {k for k, a in pool.items() if a != 0} - used


def test_pool_pivot_totals_hold_other_pools(frame):
    kinds = [("b1", "LISTING_FEE", 1), ("b2", "ETSY_ADS", 1), ("b3", "SALES_TAX", 1)]
    batches = frame(kinds, "batch_id string, category string, orders bigint")
    shares = frame([("b1", "o", 10), ("b2", "o", 20), ("b3", "o", 5)], "batch_id string, order_no string, amount_cents bigint")
    row = pools.order_pool_pivot(shares, batches).first()
    assert (row.listing_expense, row.store_ads_expense, row.pool_expense) == (10, 20, 35)
