"""Landing files written from the domain tables: statements, billing, sheet rows and link documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginloom.session import shared_folder
from marginloom.workload.tables import Workload

STATEMENT_LAYOUTS = [
    {
        "Date": "date",
        "Type": "type",
        "Title": "title",
        "Info": "info",
        "Currency": "currency",
        "Amount": "amount",
        "Fees & Taxes": "fees",
        "Net": "net",
        "Tax Details": "tax_details",
    },
    {
        "Kind": "type",
        " Description ": "title",
        "Notes": "info",
        "Posted Date": "date",
        "Fee": "fees",
        "Gross Amount": "amount",
        "Net (INR)": "net",
        "Tax": "tax_details",
    },
]

BILLING_LAYOUTS = [
    {
        "Invoice Type": "invoice_type",
        "Invoice Date": "invoice_date",
        "Due Date": "due_date",
        "Air Waybill Number": "waybill_text",
        "Air Waybill Total Amount": "amount",
    },
    {"Tracking ID": "waybill_text", "Amount Due": "amount", "Date": "invoice_date", "Due Date": "due_date", "Invoice": "invoice_type"},
]


def write_layouts(lines: DataFrame, layouts: list[dict[str, str]], path: str) -> str:
    """Compressed CSV files below one folder per import, whose header depends on the import.

    As plain text they would take several times the space of the given tables.
    """
    for number, layout in enumerate(layouts):
        part = lines.filter(F.col("import_id") % len(layouts) == number)
        named = part.select("import_id", *[F.col(c).alias(header) for header, c in layout.items()])
        writer = named.hint("rebalance", "import_id").write.mode("append").partitionBy("import_id")
        writer.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return path


def land_statements(w: Workload) -> str:
    return write_layouts(w.statement_lines, STATEMENT_LAYOUTS, shared_folder(w.spark, "statements"))


def land_billing(w: Workload) -> str:
    return write_layouts(w.billing_lines, BILLING_LAYOUTS, shared_folder(w.spark, "billing"))


def sheet_cells(w: Workload) -> DataFrame:
    return w.sheet_rows.select(
        F.col("row_index").cast("bigint").alias("row_index"),
        F.lit("").alias("A"),
        F.col("order_id").alias("B"),
        F.lit("").alias("C"),
        F.col("material").alias("D"),
        F.col("category").alias("E"),
        F.col("color").alias("F"),
        F.col("quantity").alias("G"),
        F.col("date").alias("H"),
    )


def land_sheet(w: Workload) -> str:
    path = shared_folder(w.spark, "sheet")
    sheet_cells(w).write.parquet(path)
    return path


def link_documents(w: Workload) -> DataFrame:
    """Documents of a thousand order numbers each; the two maps overlap in a third of the links."""
    links = w.order_shipments.withColumns(
        {
            "document": F.floor(F.col("order_no").cast("bigint") / 1000),
            "part": F.col("order_no").cast("bigint") % 3,
        }
    )

    def one_way(rows: DataFrame, key: str, item: str, name: str) -> DataFrame:
        lists = rows.groupBy("document", key).agg(F.collect_list(item).alias("items"))
        entries = F.map_from_entries(F.collect_list(F.struct(key, "items")))
        return lists.groupBy("document").agg(entries.alias(name))

    by_order = one_way(links.filter("part <> 0"), "order_no", "waybill", "ordersToAWBMappingObj")
    by_waybill = one_way(links.filter("part <> 1"), "waybill", "order_no", "awbToOrderMappingObj")
    both = by_order.join(by_waybill, "document", "full")
    return both.select(F.struct("ordersToAWBMappingObj", "awbToOrderMappingObj").alias("data"))


def land_links(w: Workload) -> str:
    path = shared_folder(w.spark, "links")
    link_documents(w).write.json(path)
    return path
