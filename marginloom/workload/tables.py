"""Domain tables derived from the given tables, in SQL that Spark and DuckDB both read.

This is input data, not logic under test: both engines must start from the same rows.
Names in braces are the given tables or other derived tables. Months are whole numbers
such as 199801; a statement's import id is the month times ten, plus one for its second
download.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from marginloom.operators import pools, shipping
from marginloom.plans.financials import Ledgers
from marginloom.session import tune

GIVEN = ("orders", "lineitem", "part", "events")

MONTHS = "January,February,March,April,May,June,July,August,September,October,November,December"


def _amount(cents: str, key: str) -> str:
    """Amount text: INR 1234.50, or with a sign and separators for every fourth key."""
    whole = f"cast(cast(floor({cents} / 100) as bigint) as string)"
    rest = f"lpad(cast({cents} % 100 as string), 2, '0')"
    thousands = f"cast(cast(floor({cents} / 100000) as bigint) as string)"
    units = f"lpad(cast(cast(floor({cents} / 100) as bigint) % 1000 as string), 3, '0')"
    return (
        f"case when {key} % 4 = 0 and {cents} >= 100000 and {cents} < 100000000"
        f" then '₹' || {thousands} || ',' || {units} || '.' || {rest}"
        f" else 'INR ' || {whole} || '.' || {rest} end"
    )


def _date(date: str, key: str) -> str:
    """Date text in one of six shapes, one of them with a time."""
    name = f"split_part('{MONTHS}', ',', cast(month({date}) as int))"
    day = f"lpad(cast(day({date}) as string), 2, '0')"
    month = f"lpad(cast(month({date}) as string), 2, '0')"
    year = f"cast(year({date}) as string)"
    return (
        f"case {key} % 6 when 0 then {name} || ' ' || {day} || ', ' || {year}"
        f" when 1 then {day} || '-' || substring({name}, 1, 3) || '-' || substring({year}, 3, 2)"
        f" when 2 then substring({name}, 1, 3) || ' ' || cast(day({date}) as string) || ' ' || {year}"
        f" when 3 then {name} || ' ' || cast(day({date}) as string) || ', ' || {year} || ' 10:30'"
        f" when 4 then {month} || '-' || {day} || '-' || {year}"
        f" else cast({date} as string) end"
    )


TABLES = {
    "sales": """
        select 'S' || cast(o_orderkey as string) as transaction_hash,
               cast(1000000000 + o_orderkey as string) as order_no,
               cast(o_orderdate as date) as sale_date,
               cast(floor(o_totalprice * 100 + 0.5) as bigint) as gross_cents,
               cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as import_id
        from {orders} where o_orderstatus <> 'P'""",
    "fees": """
        select l_orderkey, l_partkey, l_suppkey, l_linenumber,
               cast(l_shipdate as date) as expense_date,
               cast(year(l_shipdate) * 100 + month(l_shipdate) as bigint) as month_no,
               cast(floor(l_extendedprice * l_tax * 100 + 0.5) as bigint) as fee_cents,
               case l_linenumber
                 when 1 then 'TRANSACTION_FEE'
                 when 2 then case l_suppkey % 10
                   when 0 then 'REGULATORY_FEE' when 1 then 'BUYER_FEE' when 2 then 'SALES_TAX'
                   when 3 then 'SHARE_AND_SAVE_REFUND' when 4 then 'SALES_TAX'
                   when 5 then 'OTHER_ORDER_EXPENSE' else 'PROCESSING_FEE' end
                 when 3 then 'TDS' when 4 then 'TCS' when 5 then 'OFFSITE_ADS' when 6 then 'LISTING_FEE'
                 else case l_returnflag when 'R' then 'REFUND' when 'A' then 'ETSY_ADS'
                   else case when l_suppkey % 10 < 3 then 'DEPOSIT' else 'OTHER_STORE_EXPENSE' end end
               end as category,
               'E' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-'
                 || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-'
                 || cast(cast(floor(l_extendedprice * 100 + 0.5) as bigint) as string) as transaction_hash
        from {lineitem}""",
    "expenses": """
        select transaction_hash,
               case when category in ('LISTING_FEE', 'ETSY_ADS', 'DEPOSIT', 'OTHER_STORE_EXPENSE') then null
                    else cast(1000000000 + l_orderkey as string) end as order_no,
               expense_date, category,
               case when category in ('LISTING_FEE', 'ETSY_ADS', 'DEPOSIT', 'OTHER_STORE_EXPENSE') then 'ETSY'
                    when category = 'REFUND' then 'REFUND' else 'ORDER' end as scope,
               case when category = 'SHARE_AND_SAVE_REFUND' or (category = 'LISTING_FEE' and l_partkey % 11 = 0)
                    then fee_cents else -fee_cents end as net_cents,
               false as is_allocation,
               month_no as import_id
        from {fees}""",
    "inventory": """
        select cast(1000000000 + l_orderkey as string) as order_no,
               case when p_type = 'STANDARD' then 'Cotton' else p_type end as material,
               p_brand as category, split_part(p_name, ' ', 1) as color,
               cast(sum(cast(floor(l_quantity * 10000 + 0.5) as bigint) + l_partkey % 7777) as bigint) as quantity_e4
        from {lineitem} join {part} on l_partkey = p_partkey
        where l_returnflag <> 'A' group by 1, 2, 3, 4""",
    "carrier_billing": """
        select l_orderkey * 10 + l_linenumber as billing_id, l_partkey,
               case when l_suppkey % 2 = 0 then 'Transportation' else 'Duty/Tax' end as invoice_type,
               cast(l_shipdate as date) as invoice_date,
               cast(870000000000 + l_suppkey * 100000 + year(l_shipdate) * 12 + month(l_shipdate) as string) as waybill,
               cast(floor(l_extendedprice + 0.5) as bigint) as amount_cents,
               cast(year(l_shipdate) * 100 + month(l_shipdate) as bigint) as import_id
        from {lineitem}""",
    "order_shipments": """
        select distinct cast(1000000000 + l_orderkey as string) as order_no,
               cast(870000000000 + l_suppkey * 100000 + year(l_shipdate) * 12 + month(l_shipdate) as string) as waybill
        from {lineitem} where l_linestatus = 'F'""",
    "statement_base": f"""
        select 'Sale' as type,
               'Payment for Order #' || order_no as title, '--' as info,
               {_date('sale_date', 'gross_cents')} as date,
               {_amount('gross_cents', 'gross_cents')} as amount, '--' as fees,
               {_amount('gross_cents', 'gross_cents')} as net,
               'INR' as currency, '' as tax_details,
               order_no, 'SALE' as category, sale_date as transaction_date,
               gross_cents as amount_cents, cast(0 as bigint) as fees_cents, gross_cents as net_cents,
               import_id as month_no, gross_cents % 13 as again, cast(0 as bigint) as twin
        from {{sales}}
        union all
        select case category when 'REFUND' then 'Refund' when 'DEPOSIT' then 'Deposit'
                 when 'TDS' then 'Tax' when 'TCS' then 'Tax' when 'SALES_TAX' then 'Tax'
                 when 'OFFSITE_ADS' then 'Marketing' when 'ETSY_ADS' then 'Marketing' else 'Fee' end,
               case category when 'TRANSACTION_FEE' then 'Transaction fee: item ' || cast(l_partkey as string)
                 when 'PROCESSING_FEE' then 'Processing fee' when 'REGULATORY_FEE' then 'Regulatory operating fee'
                 when 'BUYER_FEE' then 'Retail delivery fee'
                 when 'SALES_TAX' then case when l_suppkey % 10 = 2 then 'Sales tax paid by buyer'
                                       else 'Refund to buyer for sales tax' end
                 when 'SHARE_AND_SAVE_REFUND' then 'Share & Save refund'
                 when 'OTHER_ORDER_EXPENSE' then case when month_no % 3 = 0
                   then 'Gift wrap' || chr(10) || 'charge, "large"' else 'Gift wrap charge, "large"' end
                 when 'TDS' then 'Tax deducted at source (TDS)' when 'TCS' then 'Tax collected at source (TCS)'
                 when 'OFFSITE_ADS' then 'Offsite Ads fee'
                 when 'LISTING_FEE' then 'Listing fee: Listing ' || cast(1200000000 + l_partkey as string)
                 when 'REFUND' then 'Refund for order' when 'ETSY_ADS' then 'Etsy Ads'
                 when 'DEPOSIT' then 'Sent to your bank account' else 'Subscription' end,
               case when category in ('LISTING_FEE', 'ETSY_ADS', 'DEPOSIT', 'OTHER_STORE_EXPENSE') then '--'
                    when category = 'BUYER_FEE' and month_no % 3 = 1
                    then 'Order #' || cast(1000000000 + l_orderkey as string) || chr(10) || 'by courier'
                    else 'Order #' || cast(1000000000 + l_orderkey as string) end,
               {_date('expense_date', 'l_partkey')},
               '--',
               case when category = 'SHARE_AND_SAVE_REFUND' or (category = 'LISTING_FEE' and l_partkey % 11 = 0)
                    then '' else '-' end || {_amount('fee_cents', 'l_partkey')},
               case when category = 'SHARE_AND_SAVE_REFUND' or (category = 'LISTING_FEE' and l_partkey % 11 = 0)
                    then '' else '-' end || {_amount('fee_cents', 'l_partkey')},
               'INR', case when l_linenumber = 4 then 'GST' else '--' end,
               case when category in ('LISTING_FEE', 'ETSY_ADS', 'DEPOSIT', 'OTHER_STORE_EXPENSE') then null
                    else cast(1000000000 + l_orderkey as string) end,
               category, expense_date, cast(0 as bigint),
               case when category = 'SHARE_AND_SAVE_REFUND' or (category = 'LISTING_FEE' and l_partkey % 11 = 0)
                    then fee_cents else -fee_cents end,
               case when category = 'SHARE_AND_SAVE_REFUND' or (category = 'LISTING_FEE' and l_partkey % 11 = 0)
                    then fee_cents else -fee_cents end,
               month_no, l_partkey % 13, case when l_suppkey % 17 = 0 then cast(1 as bigint) else cast(0 as bigint) end
        from {{fees}}""",
    "statement_lines": """
        select *, month_no * 10 as import_id from {statement_base}
        union all select *, month_no * 10 as import_id from {statement_base} where twin = 1
        union all select *, month_no * 10 + 1 as import_id from {statement_base} where again = 0""",
    "poison_lines": """
        select type, title, info, date, '99999999999999999999.00' as amount, fees, net, currency, tax_details,
               month_no * 10 + 2 as import_id
        from {statement_base} where category = 'REFUND'""",
    "billing_lines": f"""
        select case when import_id % 4 = 1 and l_partkey % 9 = 0 then invoice_type || chr(10) || '"net", inland'
                    else invoice_type end as invoice_type,
               {_date('invoice_date', 'l_partkey')} as invoice_date,
               case when l_partkey % 2 = 0 then cast(invoice_date as string) else '' end as due_date,
               case when import_id % 100 = 7 and l_partkey % 97 = 0 then ''
                    when l_partkey % 3 = 0 then waybill || '.0'
                    when l_partkey % 50 = 1 then substring(waybill, 1, 1) || '.' || substring(waybill, 2, 11) || 'E+11'
                    else waybill end as waybill_text,
               {_amount('amount_cents', 'l_partkey')} as amount,
               waybill, invoice_date as invoice_day, amount_cents, import_id
        from {{carrier_billing}}""",
    "sheet_rows": """
        select l_orderkey * 10 + l_linenumber as row_index,
               cast(1000000000 + l_orderkey as string) || '-'
                 || case when l_linenumber > 5 then 'x' else cast(l_linenumber as string) end as order_id,
               case p_type when 'PROMO' then '' when 'STANDARD' then 'Cotton' else p_type end as material,
               p_brand as category, split_part(p_name, ' ', 1) as color,
               cast(cast(floor(floor(l_quantity * 11 + 0.5) / 10) as bigint) as string) || '.'
                 || cast(cast(floor(l_quantity * 11 + 0.5) as bigint) % 10 as string) as quantity,
               cast(year(l_shipdate) + 25 as string) || '-01-01' as date
        from {lineitem} join {part} on l_partkey = p_partkey""",
    "imports": """
        select import_id, case when import_id % 100 = 5 then 'FAILED' else 'COMPLETED' end as status,
               count(*) as new_rows, max(o_orderdate) as created_at
        from (select o_orderdate, cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as import_id
              from {orders}) m group by 1, 2""",
    "sync_log": """
        select case event_type when 'view' then 'etsy_statement' when 'click' then 'fedex_billing'
                 when 'purchase' then 'google_sheets_inventory' else 'other' end as source,
               event_id as last_row, ts as synced_at
        from {events}""",
}


def needs(name: str) -> list[str]:
    return re.findall(r"{(\w+)}", TABLES[name])


class Workload:
    """The domain tables as DataFrames over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder
        self._tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in GIVEN):
            raise AttributeError(name)
        if name not in self._tables:
            if name in GIVEN:
                table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                table = self.spark.sql(TABLES[name], **{n: getattr(self, n) for n in needs(name)})
            self._tables[name] = table
        return self._tables[name]

    @cached_property
    def waybill_costs(self) -> DataFrame:
        return shipping.waybill_cost(self.carrier_billing)

    @cached_property
    def shipping_allocations(self) -> DataFrame:
        return shipping.allocate_shipping(self.waybill_costs, self.order_shipments)

    @cached_property
    def pools(self) -> DataFrame:
        return pools.pool_totals(self.expenses.filter("scope = 'ETSY'"))

    @cached_property
    def pool_tables(self) -> tuple[DataFrame, DataFrame]:
        """Batches and allocations, with every sale counted as new and no earlier allocation."""
        candidates = self.sales.select("import_id", "order_no").distinct()
        return pools.allocate_pool(candidates, self.pools)

    @cached_property
    def ledgers(self) -> Ledgers:
        return Ledgers(
            self.sales,
            self.expenses,
            self.inventory,
            self.order_shipments,
            self.shipping_allocations,
            self.pool_tables[1],
        )
