"""Order-to-waybill links from JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Map values stay text here, so one that is no array can be told apart and ignored.
DOCUMENT_SCHEMA = "data struct<ordersToAWBMappingObj: map<string, string>, awbToOrderMappingObj: map<string, string>>"


def _entries(documents: DataFrame, mapping: str, key: str, item: str) -> DataFrame:
    pairs = documents.select(F.explode(f"data.{mapping}").alias(key, "items"))
    items = F.explode(F.from_json("items", "array<string>"))
    return pairs.filter(F.col("items").startswith("[")).select(F.col(key), items.alias(item))


def links_of(documents: DataFrame) -> DataFrame:
    """Distinct (order_no, waybill) pairs of both directions; blank waybills are dropped."""
    by_order = _entries(documents, "ordersToAWBMappingObj", "order_no", "waybill")
    by_waybill = _entries(documents, "awbToOrderMappingObj", "waybill", "order_no")

    def clean(df: DataFrame) -> DataFrame:
        waybill: Column = F.regexp_replace(F.trim("waybill"), r"\.0$", "")
        return df.select(F.trim("order_no").alias("order_no"), waybill.alias("waybill"))

    links = clean(by_order).unionByName(clean(by_waybill))
    return links.filter(F.col("waybill") != "").filter(F.col("order_no").isNotNull()).distinct()


def load_shipment_links(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Links of all documents below ``path``, one document per line (or per file with ``multi_line``)."""
    reader = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", str(multi_line).lower())
    return links_of(reader.json(path))
