"""Inverted lists that find order numbers and waybills by any part of their text.

Every position of a text gives its three characters from there on (past the end: a filler), and
the list of these characters holds the text. A search takes the part's rarest three characters,
reads that one list, and checks the whole part against the texts in it; so hits are exact, and
nothing is read but the list and the owners, the orders that each text leads to. Lists lie in
folders by their first two characters, which serves parts of two characters as well; shorter
ones read all folders. The texts are shuffled, their parts are not: every task writes the lists
of its own texts, so a long list lies in many files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.operators.reports import search_sides
from marginloom.plans.financials import Ledgers, has_order

LISTS = "kind string, gram string, value string, folder int"
OWNERS = "kind string, value string, order_no string"
COUNTS = "kind string, gram string, texts bigint"
WIDTH = 3
FOLDERS = 64
FILLER = "\0"


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, WIDTH - 1)), F.lit(FOLDERS)).cast("int")


def _owned(rows: DataFrame, kind: str, text: str) -> DataFrame:
    """The texts and the orders they lead to; ``value`` is the text in lower case."""
    return rows.filter(F.col(text).isNotNull()).select(F.lit(kind).alias("kind"), F.lower(text).alias("value"), "order_no")


def _listed(values: DataFrame) -> DataFrame:
    """One row for each text and each of its three-character parts."""
    padded = F.concat(F.col("value"), F.lit(FILLER * (WIDTH - 1)))
    starts = F.sequence(F.lit(1), F.greatest(F.length("value"), F.lit(1)))
    parts = F.array_distinct(F.transform(starts, lambda i: padded.substr(i, F.lit(WIDTH))))
    return values.select("kind", F.explode(parts).alias("gram"), "value")


def write_search_lists(t: Ledgers, path: str) -> None:
    """Write the lists of all orders with a sale or an expense, and of the waybills linked to them.

    Write to a new folder after loads; readers of the old one are not disturbed.
    """
    orders = t.sales.select("order_no").unionByName(t.expenses.filter(has_order()).select("order_no")).distinct()
    links = t.order_shipments.select("order_no", "waybill").distinct().join(orders, "order_no", "left_semi")
    spark = t.sales.sparkSession
    _owned(orders, "order", "order_no").unionByName(_owned(links, "waybill", "waybill")).write.parquet(f"{path}/owners")
    values = spark.read.schema(OWNERS).parquet(f"{path}/owners").select("kind", "value").distinct()
    rows = _listed(values).withColumn("folder", _folder(F.col("gram")))
    rows.sortWithinPartitions("folder", "kind", "gram").write.partitionBy("folder").parquet(f"{path}/lists")
    written = spark.read.schema(LISTS).parquet(f"{path}/lists")
    written.groupBy("kind", "gram").agg(F.count("*").alias("texts")).sort("kind", "gram").write.parquet(f"{path}/counts")


def _hits(spark: SparkSession, path: str, kind: str, part: str) -> DataFrame:
    part = part.lower()
    lists = spark.read.schema(LISTS).parquet(f"{path}/lists").filter(F.col("kind") == kind)
    if len(part) >= WIDTH:
        grams = {part[i : i + WIDTH] for i in range(len(part) - WIDTH + 1)}
        counts = spark.read.schema(COUNTS).parquet(f"{path}/counts")
        found = counts.filter((F.col("kind") == kind) & F.col("gram").isin(sorted(grams))).collect()
        # a part with characters that no text holds together has no hits
        rarest = min(found, key=lambda r: (r.texts, r.gram)).gram if len(found) == len(grams) else None
        lists = lists.filter((F.col("folder") == _folder(F.lit(rarest))) & (F.col("gram") == rarest)) if rarest else lists.filter(F.lit(False))
    elif len(part) == WIDTH - 1:
        lists = lists.filter((F.col("folder") == _folder(F.lit(part))) & F.startswith("gram", F.lit(part)))
    hits = lists.filter(F.contains("value", F.lit(part))).select("value")
    owners = spark.read.schema(OWNERS).parquet(f"{path}/owners").filter(F.col("kind") == kind)
    return owners.join(hits, "value", "left_semi").select("order_no")


def orders_in_lists(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The orders that ``reports.matching_orders`` finds in the ledgers, from the lists at ``path``."""
    by_order, by_waybill = search_sides(query)
    sides = [(kind, part) for kind, part in (("order", by_order), ("waybill", by_waybill)) if part is not None]
    return reduce(DataFrame.unionByName, [_hits(spark, path, kind, part) for kind, part in sides]).distinct()
