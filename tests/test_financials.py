import datetime as dt
import random

import pytest

from marginloom.operators import activity, inventory, ledger, quality, reports
from marginloom.plans import financials, search_lists
from marginloom.plans.financials import Ledgers
from marginloom.session import shared_folder
from marginloom.sources import sinks

D = dt.date


@pytest.fixture
def ledgers(frame):
    sales = [("s1", "A1", D(2026, 6, 3), 10000), ("s2", "A1", D(2026, 6, 1), 5000), ("s3", "B%2", D(2026, 5, 20), 2000)]
    expenses = [
        ("e1", "A1", D(2026, 5, 31), "TDS", -100, False),
        ("e2", "A1", D(2026, 6, 9), "REFUND", -4000, False),
        ("e3", "A1", D(2026, 6, 9), "TCS", -999, True),
        ("e4", "A1", D(2026, 6, 9), "OTHER_ORDER_EXPENSE", -50, False),
        ("e5", None, D(2026, 6, 9), "LISTING_FEE", -70, False),
        ("e6", "", D(2026, 6, 9), "LISTING_FEE", -70, False),
        ("e7", "B%2", D(2026, 6, 9), "REFUND", -2000, False),
        ("e8", "C3", D(2026, 6, 30), "OFFSITE_ADS", -300, False),
        ("e9", "C3", D(2026, 6, 30), "SHARE_AND_SAVE_REFUND", 20, False),
    ]
    return Ledgers(
        sales=frame(sales, "transaction_hash string, order_no string, sale_date date, gross_cents bigint"),
        expenses=frame(
            expenses,
            "transaction_hash string, order_no string, expense_date date, category string, net_cents bigint,"
            " is_allocation boolean",
        ),
        inventory=frame(
            [("A1", "cotton", 31000), ("A1", "Linen", 1), ("ONLY-INVENTORY", "Linen", 10000)],
            "order_no string, material string, quantity_e4 bigint",
        ),
        order_shipments=frame(
            [("A1", "w2"), ("A1", "w1"), ("C3", "w1"), ("ONLY-SHIPPED", "w1")], "order_no string, waybill string"
        ),
        shipping_allocations=frame(
            [("A1", "w1", 700), ("C3", "w1", 800)], "order_no string, waybill string, allocated_cents bigint"
        ),
        pool_allocations=frame(
            [("A1", "LISTING_FEE", 11), ("A1", "ETSY_ADS", 22), ("A1", "SALES_TAX", 5)],
            "order_no string, category string, amount_cents bigint",
        ),
    )


def test_order_financials(ledgers):
    rows = {r.order_no: r for r in financials.order_financials(ledgers).collect()}
    assert set(rows) == {"A1", "B%2", "C3"}
    a = rows["A1"]
    assert (a.sale_date, a.sales, a.refunds, a.net_sales) == (D(2026, 5, 31), 15000, 4000, 11000)
    assert (a.tds, a.tcs, a.order_fees, a.pool_expense) == (100, 0, 150, 38)
    assert (a.listing_expense, a.store_ads_expense) == (11, 22)
    assert a.material_cost == 27900 + 1
    assert (a.shipping_cost, a.waybills) == (700, "w1, w2")
    assert a.total_expense == 27901 + 700 + 150 + 38
    assert a.profit == 11000 - a.total_expense
    assert a.margin == pytest.approx(a.profit / 11000 * 100)
    assert (rows["B%2"].net_sales, rows["B%2"].margin, rows["B%2"].waybills) == (0, 0.0, "N/A")
    assert (rows["C3"].order_fees, rows["C3"].profit) == (280, -1080)


def test_views_agree_with_the_combined_plan(ledgers):
    combined = {r.order_no: r for r in financials.order_financials(ledgers, with_waybills=False).collect()}
    for view, columns in [
        (financials.order_sales(ledgers.sales), ["sales"]),
        (financials.order_refunds(ledgers.expenses), ["refunds"]),
        (financials.order_expense_pivot(ledgers.expenses), ["tds", "offsite_ads", "order_fees"]),
        (financials.order_universe(ledgers.sales, ledgers.expenses), ["sale_date"]),
    ]:
        for row in view.collect():
            for c in columns:
                assert row[c] == combined[row.order_no][c]
    assert {r.order_no for r in financials.order_universe(ledgers.sales, ledgers.expenses).collect()} == set(combined)


def test_one_shuffle_on_orders(ledgers):
    plan = financials.order_financials(ledgers, with_waybills=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(order_no") == 1
    assert "Join" not in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_kpi_and_previous_period(ledgers, spark):
    fin = financials.order_financials(ledgers, with_waybills=False)
    first, last = reports.previous_period("2026-06-01", "2026-06-30")
    assert tuple(spark.range(1).select(first, last).first()) == (D(2026, 5, 2), D(2026, 5, 31))
    k = reports.kpi_summary(fin, "2026-06-01", "2026-06-30").first()
    assert (k.total_sales, k.total_expenses, k.net_profit, k.profit_margin) == (0.0, 10.8, -10.8, 0.0)
    rows = {r.kpi: r for r in reports.kpi_compare(fin, "2026-06-01", "2026-06-30").collect()}
    assert (rows["total_sales"].value, rows["total_sales"].previous_value) == (0.0, 110.0)
    assert (rows["total_sales"].change_percentage, rows["total_sales"].trend) == (100.0, "down")
    assert rows["profit_margin"].is_percentage_point and rows["profit_margin"].trend == "up"
    none = reports.kpi_compare(fin, "2000-01-01", "2000-01-31").collect()
    assert all(r.change_percentage is None and r.trend == "neutral" for r in none)


def test_breakdown_and_reconcile(ledgers):
    fin = financials.order_financials(ledgers, with_waybills=False)
    rows = reports.expense_breakdown(fin, "2026-01-01", "2026-12-31").collect()
    assert [r.name for r in rows][0] == "Material Cost" and len(rows) == 6
    check = reports.reconcile(fin, "2026-01-01", "2026-12-31").first()
    assert check.success and check.kpi_expenses == pytest.approx(sum(r.value for r in rows))
    empty = reports.expense_breakdown(fin, "2000-01-01", "2000-12-31").collect()
    assert [(r.value, r.percentage) for r in empty] == [(0.0, 0.0)] * 6


def test_pages_status_and_search(ledgers):
    fin = financials.order_financials(ledgers)
    page = reports.orders_page(fin, "2026-01-01", "2026-12-31", page=2, page_size=2).collect()
    assert page == reports.orders_page(ledgers, "2026-01-01", "2026-12-31", page=2, page_size=2).collect()
    assert [(r.order_no, r.total_records, r.total_pages) for r in page] == [("B%2", 3, 2)]
    assert (page[0].refund_status, page[0].status) == ("Refunded", "Neutral")
    refunded = reports.orders_page(ledgers, "2026-01-01", "2026-12-31", refunded_only=True, page_size=1000).collect()
    assert {(r.order_no, r.refund_status) for r in refunded} == {("A1", "Partially Refunded"), ("B%2", "Refunded")}
    found = reports.orders_page(fin, "2026-01-01", "2026-12-31", query="%").collect()
    assert [r.order_no for r in found] == ["B%2"]

    def search(q):
        return [r.order_no for r in reports.search_orders(ledgers, q).collect()]

    assert search("w1") == ["A1", "C3"]
    assert search("#w1") == []
    assert search("#a1") == ["A1"]
    assert search("awb-W2") == ["A1"]
    assert search("w") == []
    assert search("B%") == ["B%2"]


def test_search_limit_is_a_prefix_of_all_matches(ledgers):
    every = [r.order_no for r in reports.matching_orders(ledgers, "w1").collect()]
    assert [r.order_no for r in reports.search_orders(ledgers, "w1", limit=1).collect()] == sorted(every)[:1]


def test_search_lists_find_what_the_ledgers_hold(spark, ledgers):
    path = shared_folder(spark, "lists")
    search_lists.write_search_lists(ledgers, path)
    for q in ("w1", "#w1", "#a1", "awb-W2", "B%", "b%2", "a", "#", "AWB-", "B%23", "nothing", "1", "AWB-w"):
        lists = search_lists.orders_in_lists(spark, path, q)
        assert sorted(lists.collect()) == sorted(reports.matching_orders(ledgers, q).collect()), q
    # a part of three characters or more reads one list
    plan = search_lists.orders_in_lists(spark, path, "#B%2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(gram," in plan


def test_search_lists_hold_a_shared_waybill_once(spark, frame, ledgers):
    orders = [f"N{i}" for i in range(30)]
    sales = frame([(o, o, D(2026, 6, 3), 100) for o in orders], "transaction_hash string, order_no string, sale_date date, gross_cents bigint")
    links = frame([(o, w) for o in orders for w in ("Q77", "q77")] + [("N1", "Q78"), ("gone", "Q77")], "order_no string, waybill string")
    t = Ledgers(sales, ledgers.expenses.limit(0), ledgers.inventory, links, ledgers.shipping_allocations, ledgers.pool_allocations)
    path = shared_folder(spark, "lists")
    search_lists.write_search_lists(t, path)
    lists = spark.read.parquet(f"{path}/lists").filter("kind = 'waybill'")
    assert sorted(r.value for r in lists.filter("gram = 'q77'").select("value").collect()) == ["q77"]
    for q, found in {"AWB-Q77": orders, "awb-q78": ["N1"], "78": ["N1"], "AWB-Q7": orders, "7": orders, "#N2": [o for o in orders if "N2" in o]}.items():
        assert sorted(r.order_no for r in search_lists.orders_in_lists(spark, path, q).collect()) == sorted(found), q


def test_search_lists_of_empty_ledgers(spark, ledgers):
    path = shared_folder(spark, "lists")
    none = ledgers.only_orders(ledgers.sales.select("order_no").limit(0))
    search_lists.write_search_lists(none, path)
    assert search_lists.orders_in_lists(spark, path, "w1").collect() == []


def test_order_detail(ledgers):
    fin = financials.order_financials(ledgers, with_waybills=False)
    row = reports.order_breakdown(fin, "A1").first()
    assert (row.tds, row.marketplace_expense) == (1.0, 1.88)
    lines = reports.order_transactions(ledgers.expenses, "A1").collect()
    assert [r.transaction_hash for r in lines] == ["e2", "e3", "e4", "e1"]


def test_key_reaches_the_scans(spark, ledgers):
    path = shared_folder(spark, "sales")
    ledgers.sales.write.parquet(path)
    stored = Ledgers(**{**ledgers.__dict__, "sales": spark.read.parquet(path)})
    plan = reports.order_breakdown(financials.order_financials(stored, False), "A1")
    assert "EqualTo(order_no,A1)" in plan._jdf.queryExecution().executedPlan().toString()


def test_report_columns_and_file(ledgers, spark):
    fin = financials.order_financials(ledgers)
    row = reports.order_report(fin).filter("`Order Number` = 'A1'").first()
    assert len(row) == 21
    assert (row["AWB Number"], row["Gross Sales"], row["Profit Margin"]) == ('="w1, w2"', "150.00", "-161.7")
    assert row["Other Etsy Expense"] == "0.50"
    path = shared_folder(spark, "report")
    sinks.export_report(fin, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path).collect()
    assert sorted(r["Order Number"] for r in back) == ["A1", "B%2", "C3"]
    raw = "".join(r.value for r in spark.read.text(path).collect())
    assert '"=""w1, w2"""' in raw


def test_stored_financials_prune_months(ledgers, spark):
    fin = financials.order_financials(ledgers, with_waybills=False)
    path = shared_folder(spark, "fin")
    financials.write_financials(fin, path)
    stored = financials.read_financials(spark, path, "2026-06-01", "2026-06-30")
    assert [r.order_no for r in stored.filter(reports.in_period("2026-06-01", "2026-06-30")).collect()] == ["C3"]
    assert "PartitionFilters: [isnotnull(sale_month" in stored._jdf.queryExecution().executedPlan().toString()
    a = reports.kpi_summary(stored, "2026-06-01", "2026-06-30").first()
    assert a == reports.kpi_summary(fin, "2026-06-01", "2026-06-30").first()


def test_monthly_performance(ledgers):
    fin = financials.order_financials(ledgers, with_waybills=False)
    rows = reports.monthly_performance(fin, "2026-01-01", "2026-12-31").collect()
    assert [(r.month, r.label) for r in rows] == [("2026-05", "May 2026"), ("2026-06", "Jun 2026")]
    assert rows[1].profit == -10.8 and rows[1].margin == 0.0


def test_hot_order(frame, ledgers):
    """One order holds most expense lines; the totals stay exact."""
    rng = random.Random(3)
    lines = [(f"h{i}", "HOT", D(2026, 1, 1), "TDS", -rng.randrange(1000), False) for i in range(3000)]
    more = frame(lines, "transaction_hash string, order_no string, expense_date date, category string, net_cents bigint, is_allocation boolean")
    t = Ledgers(**{**ledgers.__dict__, "expenses": ledgers.expenses.unionByName(more)})
    row = financials.order_financials(t, False).filter("order_no = 'HOT'").first()
    assert row.tds == -sum(l[4] for l in lines)


def test_ledger_operators(frame):
    target = frame([("a", 1), ("b", 2)], "k string, v int")
    rows = frame([("b", 9), ("c", 3), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, ledger.append_new(target, rows, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    put = ledger.upsert(target, rows.distinct(), ["k"])
    assert sorted(map(tuple, put.collect())) == [("a", 1), ("b", 9), ("c", 3)]
    log = frame([("a", 1, 0), ("a", 5, 2), ("b", 7, 1)], "k string, v int, batch int")
    assert sorted(map(tuple, ledger.latest_per_key(log, ["k"], "batch").collect())) == [("a", 5, 2), ("b", 7, 1)]


def test_inventory_checks_and_rollup(frame):
    rows = [
        (1, "4104705089-1", "Cotton", "Bag", "red", "3.1", "2026-01-01"),
        (2, "4104705089-2", "Cotton", "Bag", "red", "3.0 m", "2026-01-01"),
        (3, "4104705090-1", "Cotton", "Bag", "red", "2.5", "2026-01-01"),
        (4, "1", "Cotton", "Bag", "red", "2", "01 Jan 2023"),
        (5, "1", "Cotton", "Bag", "red", "2", ""),
        (6, "Allison", "Cotton", "Bag", "red", "2", "2026-01-01"),
        (7, "1", "  ", "Bag", "red", "2", "2026-01-01"),
        (8, "1", "Cotton", "", "red", "2", "2026-01-01"),
        (9, "1", "Cotton", "Bag", "", "2", "2026-01-01"),
        (10, "1", "Cotton", "Bag", "red", "50.01", "2026-01-01"),
        (11, "1", "Cotton", "Bag", "red", "-1", "2026-01-01"),
        (12, "1", "Cotton", "Bag", "red", "many", "2026-01-01"),
    ]
    df = frame(rows, "row_index bigint, order_id string, material string, category string, color string, quantity string, date string")
    checked = quality.check_inventory(df)
    reasons = {r.row_index: r.reject_reason for r in quality.inventory_rejects(checked).collect()}
    assert reasons == {
        4: "skipped year",
        5: "no date",
        6: "bad order id",
        7: "no material",
        8: "no category",
        9: "no color",
        10: "bad quantity",
        11: "bad quantity",
        12: "bad quantity",
    }
    rolled = inventory.inventory_rollup(quality.valid_inventory(checked))
    assert {r.order_no: r.quantity_e4 for r in rolled.collect()} == {"4104705089": 61000, "4104705090": 25000}
    assert tuple(quality.load_counts(checked).first()) == (12, 9, 12)
    assert quality.skip_years(df).count() == 11
    cost = {r.order_no: r.material_cost for r in inventory.order_material_cost(rolled).collect()}
    assert cost == {"4104705089": 54900, "4104705090": 22500}


def test_billing_check(frame):
    rows = frame(
        [("f", "w", "2026-01-01", "", 1), ("f", "", "", "", 1), ("g", "w", "", "2026-01-01", 0), ("h", "w", "1/1/26", "", 1)],
        "file string, waybill string, invoice_date string, due_date string, amount_cents bigint",
    )
    got = {r.file: (r.total_rows, r.failed_rows, r.accepted) for r in quality.validate_billing(rows).collect()}
    assert got == {"f": (2, 1, False), "g": (1, 0, True), "h": (1, 1, False)}


def test_statement_totals(frame):
    rows = frame(
        [
            (1, "SALE", 10000, 10000),
            (1, "REFUND", 0, -1000),
            (1, "LISTING_FEE", 0, -30),
            (1, "LISTING_FEE", 0, 10),
            (1, "ETSY_ADS", 0, -40),
            (1, "OFFSITE_ADS", 0, -5),
            (1, "TDS", 0, -7),
            (1, "SHARE_AND_SAVE_REFUND", 0, 2),
            (1, "DEPOSIT", 0, -9999),
        ],
        "import_id bigint, category string, amount_cents bigint, net_cents bigint",
    )
    r = ledger.statement_reconciliation(rows).first().asDict()
    assert {c: r[c] for c in ledger.RECONCILIATION_COLUMNS} == {
        "gross_sales": 10000,
        "refunds": 1000,
        "net_sales": 9000,
        "listing_charges": 30,
        "listing_credits": 10,
        "listing_fees": 20,
        "store_ads": 40,
        "store_pool": 60,
        "offsite_ads": 5,
        "order_fees": -2,
        "order_taxes": 7,
        "operating_expenses": 70,
        "statement_profit": 8930,
    }


def test_activity_and_status(frame):
    t = dt.datetime
    imports = frame([("COMPLETED", 5, t(2026, 1, 1)), ("FAILED", None, t(2026, 1, 3))], "status string, new_rows int, created_at timestamp")
    log = frame(
        [("fedex_billing", 7, t(2026, 1, 2)), ("fedex_billing", 3, t(2026, 1, 1)), ("etsy_statement", 1, t(2026, 1, 1))],
        "source string, last_row bigint, synced_at timestamp",
    )
    feed = [(r.source, r.status, r.rows_processed) for r in activity.activity_feed(imports, log, 10).collect()]
    assert feed == [("Etsy Statement", "FAILED", 0), ("FedEx Billing", "COMPLETED", 7), ("Etsy Statement", "COMPLETED", 5)]
    s = activity.sync_status(imports, log).first()
    assert (s.overall, s.statement_status, s.billing_status, s.inventory_status) == ("PENDING", "FAILED", "SYNCED", "NOT_SYNCED")
    s = activity.sync_status(imports.filter("status = 'COMPLETED'"), log).first()
    assert s.statement_status == "SYNCED"
    empty = activity.sync_status(imports.limit(0), log.limit(0)).first()
    assert (empty.overall, empty.statement_status) == ("PENDING", "NOT_SYNCED")
