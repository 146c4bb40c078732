"""The registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.functions import money
from marginloom.operators import (
    activity,
    cleaning,
    inventory,
    ledger,
    pools,
    quality,
    reports,
    shipping,
)
from marginloom.plans import financials, search_lists
from marginloom.session import shared_folder
from marginloom.sources import billing, delimited, files, sheets, shipments, sinks, statements
from marginloom.streaming import incremental, refresh
from marginloom.workload import landing
from marginloom.workload.tables import Workload

FIRST, LAST = "1998-01-01", "1998-06-30"
BEFORE = "1997-07-04"  # start of the period of equal length before
ORDER = "1000000042"
SEARCH = "00042"
WAYBILL_SEARCH = "AWB-0001239"
CURSOR = 5000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Callable[[Workload], DataFrame]] = {}


def query(build: Callable[[Workload], DataFrame]) -> Callable[[Workload], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def registered() -> dict[str, Query]:
    def run(build: Callable[[Workload], DataFrame]) -> Query:
        return lambda spark, folder: build(Workload(spark, folder))

    return {name: run(build) for name, build in QUERIES.items()}


def _fin(w: Workload, with_waybills: bool = False) -> DataFrame:
    return financials.order_financials(w.ledgers, with_waybills)


# Folders that a session has built from a folder of given tables: several queries read them.
BUILT: dict[tuple[str, str, str], str] = {}


def built_once(build: Callable[[Workload], str]) -> Callable[[Workload], str]:
    def run(w: Workload) -> str:
        key = (w.spark.sparkContext.applicationId, w.folder, build.__name__)
        if key not in BUILT:
            BUILT[key] = build(w)
        return BUILT[key]

    return run


@built_once
def _financial_store(w: Workload) -> str:
    path = shared_folder(w.spark, "financials")
    financials.write_financials(_fin(w, with_waybills=True), path)
    return path


def _stored(w: Workload, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored financials of the months from ``first`` to ``last``; the first report of a session writes them."""
    return financials.read_financials(w.spark, _financial_store(w), first, last)


def _import_of(file: str = "file"):
    return F.regexp_extract(file, r"import_id=(\d+)", 1).cast("bigint").alias("import_id")


# Sources and sinks


@query
def statement_load(w):
    rows = statements.load_statement(w.spark, landing.land_statements(w))
    return rows.select(_import_of(), *statements.STATEMENT_HEADERS)


@query
def billing_load(w):
    rows = billing.load_billing(w.spark, landing.land_billing(w))
    shown = rows.select(_import_of(), "invoice_type", "invoice_date", "due_date", "waybill", "amount_cents")
    return shown.withColumn("amount", money.currency(F.col("amount_cents"))).drop("amount_cents")


@query
def sheet_rows_after(w):
    return sheets.load_sheet_rows(w.spark, landing.land_sheet(w), CURSOR)


@query
def shipment_links(w):
    return shipments.load_shipment_links(w.spark, landing.land_links(w))


@query
def order_report(w):
    return reports.order_report(_fin(w, with_waybills=True))


@query
def append_new_rows(w):
    columns = ["transaction_hash", "order_no", "gross_cents"]
    target = w.sales.filter("import_id < 199801").select(*columns)
    return ledger.append_new(target, w.sales.filter("import_id >= 199706").select(*columns), ["transaction_hash"])


@query
def upsert_inventory(w):
    valid = quality.valid_inventory(quality.check_inventory(_sheet(w)))
    return _quantities(ledger.upsert(w.inventory, inventory.inventory_rollup(valid), inventory.INVENTORY_KEY))


@query
def replace_table(w):
    """Allocations by the last bill only, replaced by those of all bills."""
    path = shared_folder(w.spark, "allocations")
    latest = shipping.waybill_cost_latest(w.carrier_billing)
    sinks.replace_table(shipping.allocate_shipping(latest, w.order_shipments), path)
    sinks.replace_table(w.shipping_allocations, path)
    return _money(sinks.current_table(w.spark, path), "allocated_cents")


# Cleaning jobs


def _lines(w):
    return w.statement_lines.select("import_id", "type", "title", "info", "date", "amount", "fees", "net")


def _sheet(w):
    return w.sheet_rows.select("row_index", "order_id", "material", "category", "color", "quantity", "date")


def _money(df, *columns):
    """Cent columns as currency, without the suffix."""
    for c in columns:
        df = df.withColumn(c.removesuffix("_cents"), money.currency(F.col(c)))
        if c.endswith("_cents"):
            df = df.drop(c)
    return df


def _quantities(df):
    return df.withColumn("quantity", F.col("quantity_e4") / F.lit(10000)).drop("quantity_e4")


@query
def clean_amounts(w):
    cleaned = cleaning.clean_amounts(_lines(w), {"amount": "amount_cents", "net": "net_cents"})
    texts = cleaned.select("import_id", F.col("amount").alias("amount_text"), F.col("net").alias("net_text"), "amount_cents", "net_cents")
    return _money(texts, "amount_cents", "net_cents")


@query
def clean_dates(w):
    return cleaning.clean_dates(_lines(w), {"date": "clean_date"}).select("import_id", "date", "clean_date")


@query
def extract_order_no(w):
    return cleaning.extract_order_no(_lines(w)).select("import_id", "title", "info", "order_no")


def _classified(w):
    return cleaning.classify_transactions(cleaning.extract_order_no(_lines(w)))


@query
def extract_listing_id(w):
    return cleaning.extract_listing_id(_classified(w)).select("import_id", "title", "info", "listing_id")


@query
def classify_transactions(w):
    return _classified(w).select("import_id", "type", "title", "info", "scope", "category")


@query
def clean_waybills(w):
    raw = w.billing_lines.select(F.col("waybill_text"), F.col("waybill_text").alias("waybill"))
    return cleaning.clean_waybills(raw)


@query
def tax_component(w):
    taxed = cleaning.tax_component(w.carrier_billing).select("billing_id", "waybill", "amount_cents", "tax_cents")
    return _money(taxed, "amount_cents", "tax_cents")


@query
def material_rate(w):
    rated = cleaning.material_rate(_sheet(w)).select("row_index", "material", "rate_cents")
    return _money(rated, "rate_cents")


def _typed(w):
    blank = {c: F.when(F.col(c) == "--", "").otherwise(F.col(c)) for c in ("info", "amount", "fees", "net", "tax_details")}
    lines = w.statement_lines.select("import_id", *statements.STATEMENT_HEADERS).withColumns(blank)
    return cleaning.clean_statement(lines)


def _numbered(w, *columns):
    return cleaning.number_occurrences(cleaning.packed(_typed(w).select(*columns)), finish=cleaning.unpacked)


@built_once
def _staged_rows(w):
    path = shared_folder(w.spark, "staged")
    cleaning.packed(_typed(w)).write.parquet(path)
    return path


def _staged(w):
    """Clean rows written and read back, as the loads do: a filter on them then tests columns, not the cleaning rules.

    The fingerprint, which is the transaction hash here, is written once and as bytes.
    """
    rows = cleaning.unpacked(w.spark.read.parquet(_staged_rows(w)))
    return rows.withColumn("transaction_hash", F.col("fingerprint"))


@query
def fingerprint_rows(w):
    return _typed(w).select("import_id", "fingerprint")


@query
def occurrence_numbers(w):
    numbered = _numbered(w, "import_id", "fingerprint")
    return numbered.select("import_id", "fingerprint", "occurrence_no", "transaction_hash")


# Validation


@query
def billing_file_check(w):
    rows = w.billing_lines.select("import_id", "invoice_type", "invoice_date", "due_date", F.col("waybill_text").alias("waybill"), "amount")
    return quality.validate_billing(billing.clean_billing(rows), "import_id")


@query
def inventory_rejects(w):
    rejected = quality.inventory_rejects(quality.check_inventory(_sheet(w)))
    return rejected.select("row_index", "order_id", "material", "quantity", "date", "reject_reason")


@query
def inventory_load_counts(w):
    return quality.load_counts(quality.check_inventory(_sheet(w)))


@query
def unseen_files(w):
    digests = files.file_digests(w.spark, landing.land_statements(w))
    month = F.floor(_import_of() / 10) % 100
    status = F.when(month % 2 == 0, "COMPLETED").when(month == 5, "FAILED")
    imports = digests.withColumn("status", status).filter("status is not null")
    return files.unseen_files(digests, imports).select(_import_of()).distinct()


@query
def import_counts(w):
    """Every statement against a ledger of the first downloads."""
    numbered = cleaning.packed(_numbered(w, "import_id", "fingerprint", "category", "order_no"), "transaction_hash")
    ledger_rows = numbered.filter("import_id % 10 = 0").select("transaction_hash").distinct()
    known = numbered.join(ledger_rows.withColumn("known", F.lit(True)), "transaction_hash", "left")
    return quality.import_counts(known.withColumn("is_new", F.col("known").isNull()))


# Aggregations


@query
def order_sales(w):
    return _money(financials.order_sales(w.sales), "sales")


@query
def order_refunds(w):
    return _money(financials.order_refunds(w.expenses), "refunds")


@query
def order_expense_pivot(w):
    return _money(financials.order_expense_pivot(w.expenses), *financials.FEE_CATEGORIES, "order_fees")


@query
def order_shipping_cost(w):
    return _money(shipping.order_shipping_cost(w.order_shipments, w.shipping_allocations), "shipping_cost")


@query
def order_pool_pivot(w):
    batches, allocations = w.pool_tables
    pivot = pools.order_pool_pivot(allocations, batches)
    return _money(pivot, "listing_expense", "store_ads_expense", "pool_expense")


@query
def inventory_rollup(w):
    valid = quality.valid_inventory(quality.check_inventory(_sheet(w)))
    return _quantities(inventory.inventory_rollup(valid))


@query
def order_material_cost(w):
    return _money(inventory.order_material_cost(w.inventory), "material_cost")


@query
def order_universe(w):
    return financials.order_universe(w.sales, w.expenses)


@query
def statement_reconciliation(w):
    return _money(ledger.statement_reconciliation(w.statement_lines), *ledger.RECONCILIATION_COLUMNS)


@query
def waybill_cost(w):
    return _money(w.waybill_costs, "cost_cents")


@query
def waybill_cost_latest(w):
    return _money(shipping.waybill_cost_latest(w.carrier_billing), "cost_cents")


@query
def pool_totals(w):
    return _money(w.pools, "net_cents", "pool_cents")


# Joins


@query
def order_financials(w):
    return money.in_currency(_fin(w, with_waybills=True), *financials.MONEY_COLUMNS)


@query
def waybills_matched(w):
    return _money(shipping.waybills_matched(w.waybill_costs, w.order_shipments), "cost_cents")


@query
def waybills_unmatched(w):
    return _money(shipping.waybills_unmatched(w.waybill_costs, w.order_shipments), "cost_cents")


@query
def waybill_match_counts(w):
    return shipping.match_counts(w.waybill_costs, w.order_shipments)


@query
def eligible_orders(w):
    """Orders sold in any statement, second downloads included, that no pool before 1997 has reached."""
    sold = ledger.sales_of(_staged(w).filter(ledger.is_sale()))
    batches, allocations = w.pool_tables
    prior = allocations.join(batches.filter("import_id < 199701"), "batch_id", "left_semi")
    return pools.eligible_orders(sold, prior)


@built_once
def _search_lists(w):
    path = shared_folder(w.spark, "search-lists")
    search_lists.write_search_lists(w.ledgers, path)
    return path


def _search(w, text):
    matching = search_lists.orders_in_lists(w.spark, _search_lists(w), text)
    return reports.search_orders(w.ledgers, text, stored=_stored(w), matching=matching)


@query
def search_orders(w):
    return _search(w, SEARCH)


@query
def search_orders_by_waybill(w):
    return _search(w, WAYBILL_SEARCH)


# Allocation


@query
def allocate_pool(w):
    return _money(w.pool_tables[1].drop("category"), "amount_cents")


@query
def pool_batches(w):
    return _money(w.pool_tables[0], "pool_cents")


@query
def unallocated_pools(w):
    return _money(pools.unallocated_pools(w.pools, w.pool_tables[0]), "net_cents", "pool_cents")


@query
def allocate_shipping(w):
    return _money(w.shipping_allocations, "allocated_cents")


@query
def allocate_shipping_tax(w):
    return shipping.allocate_shipping_tax(w.waybill_costs, w.order_shipments)


@query
def allocation_check(w):
    checked = shipping.allocation_check(w.waybill_costs, w.shipping_allocations)
    return _money(checked, "cost_cents", "allocated_cents", "difference_cents")


# Reports


@query
def kpi_summary(w):
    return reports.kpi_summary(_stored(w, FIRST, LAST), FIRST, LAST)


@query
def kpi_compare(w):
    return reports.kpi_compare(_stored(w, BEFORE, LAST), FIRST, LAST)


@query
def monthly_performance(w):
    return reports.monthly_performance(_stored(w, FIRST, "1999-12-31"), FIRST, "1999-12-31")


@query
def expense_breakdown(w):
    return reports.expense_breakdown(_stored(w, FIRST, LAST), FIRST, LAST)


@query
def order_breakdown(w):
    return reports.order_breakdown(_stored(w), ORDER)


@query
def orders_page(w):
    return reports.orders_page(_stored(w, FIRST, LAST), FIRST, LAST, query="1", refunded_only=True, page=2, page_size=25)


@query
def order_status(w):
    shown = reports.order_status(_fin(w)).select("order_no", "sales", "refunds", "profit", "status", "refund_status")
    return _money(shown, "sales", "refunds", "profit")


@query
def order_transactions(w):
    expenses = ledger.expenses_of(_staged(w))
    lines = reports.order_transactions(expenses, ORDER)
    shown = lines.select("expense_date", "category", "title", "info", "currency", "amount_cents", "net_cents", "listing_id", "is_allocation", "import_id")
    return _money(shown, "amount_cents", "net_cents")


@query
def reconcile(w):
    return reports.reconcile(_stored(w), "1990-01-01", "2100-01-01")


@query
def activity_feed(w):
    return activity.activity_feed(w.imports, w.sync_log, limit=20, offset=1)


@query
def sync_status(w):
    return activity.sync_status(w.imports, w.sync_log)


@query
def sync_state(w):
    return activity.sync_state(w.sync_log)


# Incremental loads


@built_once
def _statement_store(w):
    """A store fed by two loads: the files of the first years and unreadable ones, then all others."""
    landed, store = shared_folder(w.spark, "landing"), shared_folder(w.spark, "statement-store")
    landing.write_layouts(w.poison_lines, landing.STATEMENT_LAYOUTS, landed)
    for part in ("import_id < 1998000", "import_id >= 1998000"):
        lines = w.statement_lines.filter(part)
        landing.write_layouts(lines, landing.STATEMENT_LAYOUTS, landed)
        incremental.ingest_statements(w.spark, landed, store)
    return store


@query
def ingest_statements(w):
    store = _statement_store(w)
    rows = incremental.committed(w.spark, store, "transactions", incremental.TRANSACTIONS)
    columns = ["import_id", "scope", "category", "order_no", "transaction_date", "occurrence_no", "amount_cents", "net_cents"]
    return _money(rows.select(*columns), "amount_cents", "net_cents")


@query
def ingest_pool_allocations(w):
    store = _statement_store(w)
    rows = incremental.committed(w.spark, store, "pool_allocations", incremental.POOL_ALLOCATIONS)
    return _money(rows.drop("batch_id", "category"), "amount_cents")


@query
def ingest_audit(w):
    store = _statement_store(w)
    rows = incremental.committed(w.spark, store, "imports", incremental.IMPORTS)
    return rows.select("import_id", "status", "error", "total_rows", "failed_rows", "unparsed_dates", "new_rows", "duplicate_rows", "new_sales", "new_expenses")


@built_once
def _stopped_store(w):
    """A store with a finished load, unreadable files among it, and a load that has begun and gone no further."""
    landed, later, store = (shared_folder(w.spark, name) for name in ("landing", "later", "stopped-store"))
    columns = ["import_id", "type", "title", "info", "date", "amount", "fees", "net", "currency", "tax_details"]
    lines = w.statement_lines.filter("category = 'REFUND'").select(*columns)
    early = w.poison_lines.select(*columns).unionByName(lines.filter("import_id < 1998000"))
    landing.write_layouts(early, landing.STATEMENT_LAYOUTS, landed)
    incremental.ingest_statements(w.spark, landed, store)
    landing.write_layouts(lines.filter("import_id >= 1998000"), landing.STATEMENT_LAYOUTS, later)
    incremental.begin_load(delimited.read_lines(w.spark, later), store, 1)
    return store


@query
def import_audit(w):
    audit = incremental.import_audit(w.spark, _stopped_store(w))
    return audit.select("import_id", "status", "error", "total_rows", "new_rows")


@query
def ingest_sync_status(w):
    """The load's own audit and log; the times are when it ran."""
    store = _statement_store(w)
    imports = incremental.committed(w.spark, store, "imports", incremental.IMPORTS)
    state = activity.sync_status(imports.orderBy("import_id"), incremental.sync_log(w.spark, store))
    return state.select("overall", F.col("statement_at").isNotNull().alias("loaded"), "billing_status", "inventory_status")


@built_once
def _billing_store(w):
    """A store fed by two loads of bills; links come after each: none that match, then half, then all."""
    landed, store = shared_folder(w.spark, "landing"), shared_folder(w.spark, "billing-store")
    links = w.order_shipments
    parts = [("import_id < 199800", [links.selectExpr("order_no", "'X' || waybill waybill")]), ("import_id >= 199800", [links.filter("order_no < '1000000500'"), links])]
    for part, offered in parts:
        landing.write_layouts(w.billing_lines.filter(part), landing.BILLING_LAYOUTS, landed)
        incremental.ingest_billing(w.spark, landed, store)
        for some in offered:
            incremental.sync_mappings(w.spark, store, some)
    return store


@query
def sync_mappings(w):
    log = w.spark.read.parquet(f"{_billing_store(w)}/mapping_log")
    return log.select("batch_id", "new_links", "billed", "matched", "unmatched", "written")


@query
def current_allocations(w):
    return _money(incremental.current_allocations(w.spark, _billing_store(w)), "allocated_cents")


@query
def ingest_billing(w):
    rows = incremental.committed(w.spark, _billing_store(w), "billing", incremental.BILLING_ROWS)
    return _money(shipping.waybill_cost(rows), "cost_cents")


@built_once
def _inventory_store(w):
    """A store fed by two loads of sheet rows."""
    landed, store = shared_folder(w.spark, "landing"), shared_folder(w.spark, "inventory-store")
    for part in ("row_index % 10 < 4", "row_index % 10 >= 4"):
        landing.sheet_cells(w).filter(part).write.mode("append").parquet(landed)
        incremental.sync_inventory(w.spark, landed, store)
    return store


@query
def sync_inventory(w):
    return _quantities(incremental.current_inventory(w.spark, _inventory_store(w)))


def _stores(w):
    return refresh.Stores(_statement_store(w), _billing_store(w), _inventory_store(w))


@built_once
def _first_refresh(w):
    """Financials refreshed after the first load of each store and the second mapping step."""
    path = shared_folder(w.spark, "refreshed")
    for billing_step in (0, 1):
        refresh.refresh_financials(w.spark, _stores(w), path, {"statements": 0, "billing": billing_step, "inventory": 0})
    return path


@built_once
def _second_refresh(w):
    """The same, after all loads."""
    path = _first_refresh(w)
    refresh.refresh_financials(w.spark, _stores(w), path)
    return path


@query
def refreshed_financials(w):
    return money.in_currency(refresh.stored_financials(w.spark, _second_refresh(w)), *financials.MONEY_COLUMNS)


@query
def refreshed_monthly_performance(w):
    """A report on the months it shows, from the refreshed results."""
    stored = refresh.stored_financials(w.spark, _second_refresh(w), FIRST, "1999-12-31")
    return reports.monthly_performance(stored, FIRST, "1999-12-31")


@query
def dedupe_stream(w):
    landed, store = shared_folder(w.spark, "landing"), shared_folder(w.spark, "dedupe-store")
    schema = "transaction_hash string, order_no string, gross_cents bigint"
    rows = w.sales.select("transaction_hash", "order_no", "gross_cents", "import_id")
    for part in ("import_id < 199801", "import_id >= 199706"):
        rows.filter(part).drop("import_id").write.mode("append").parquet(landed)
        stream = w.spark.readStream.schema(schema).parquet(landed)
        incremental.dedupe_stream(stream, store, schema, "transaction_hash")
    return _money(incremental.committed(w.spark, store, "rows", schema).drop("batch_id"), "gross_cents")


@query
def dedupe_stream_horizon(w):
    """The same loads with two years of keys in the state store; every repeated row lies within them."""
    landed, store = shared_folder(w.spark, "landing"), shared_folder(w.spark, "horizon-store")
    schema = "transaction_hash string, order_no string, gross_cents bigint, sold_at timestamp"
    rows = w.sales.select("transaction_hash", "order_no", "gross_cents", F.col("sale_date").cast("timestamp").alias("sold_at"), "import_id")
    for part in ("import_id < 199801", "import_id >= 199706"):
        rows.filter(part).drop("import_id").write.mode("append").parquet(landed)
        stream = w.spark.readStream.schema(schema).parquet(landed)
        incremental.dedupe_stream_horizon(stream, store, schema, "transaction_hash", "sold_at", "730 days")
    return _money(incremental.committed(w.spark, store, "rows", schema).drop("batch_id", "sold_at"), "gross_cents")
