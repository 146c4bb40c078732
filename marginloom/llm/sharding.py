"""Random shards by a two-pass external shuffle.

A record's shard follows from its doc_id and the number of shards alone: every shard draws
a seeded hash for the id and the highest draw wins, so one more shard takes rows only into
itself. Pass one scatters each shard's records uniformly over buckets that fit in memory
and writes them with their bucket. Pass two brings each bucket together, shuffles it with
Spark's Fisher-Yates ``shuffle`` and numbers its rows behind those of the shard's earlier
buckets. Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginloom.llm.common import stored

SHARDS = 24
SEED = 20_260_101
BUCKET_BYTES = 16 << 20

ADDED = ["size", "shard", "grown_shard", "bucket", "slot", "spread"]


def _draws(doc_id: Column, shards: int, seed: int) -> Column:
    return F.array(*[F.xxhash64(F.lit(seed), F.lit(s), doc_id) for s in range(shards)])


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest draw, from 0."""
    draws = _draws(doc_id, shards, seed)
    return (F.array_position(draws, F.array_max(draws)) - 1).cast("int")


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with size, shard, grown_shard (with one more shard), bucket (of all shards) and slot (from 0, without gaps).

    ``docs`` has doc_id and text; size is the text's UTF-8 bytes plus 8, so a null text has
    8. Rows that share a doc_id share a shard, as do rows without one; they are told apart
    when scattered into buckets, so a very frequent id is spread over many buckets. Columns
    of ``docs`` named as the added ones are replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    known = docs.select(*kept).withColumns(
        {
            "size": record_bytes(F.col("text")),
            "shard": shard_of(F.col("doc_id"), shards, seed),
            "grown_shard": shard_of(F.col("doc_id"), shards + 1, seed),
        }
    )
    # A frequent id may weigh down one shard, which then gets more buckets.
    weights = known.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    per_shard = {r.shard: max(1, -(-r.bytes // bucket_bytes)) for r in weights}
    buckets = [per_shard.get(s, 1) for s in range(shards)]
    firsts = [sum(buckets[:s]) for s in range(shards)]
    counts, first = (F.get(F.array(*[F.lit(n) for n in numbers]), F.col("shard")) for numbers in (buckets, firsts))
    spread = F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.monotonically_increasing_id())
    # Written before anything depends on it, so a repeated task cannot deal its rows another way.
    scattered = stored(known.withColumn("spread", spread).withColumn("bucket", (first + F.pmod("spread", counts)).cast("int")), "scattered")

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))

    record = F.struct(*kept, "size", "grown_shard")
    gathered = (
        scattered.repartitionById(sum(buckets), "bucket")  # one bucket to a task
        .sortWithinPartitions("bucket", "spread")
        .groupBy("shard", "bucket")
        .agg(F.collect_list(record).alias("records"))
    )
    # One record a bucket; unless it is sent to the tasks, a join on large tables shuffles all records once more.
    placed = gathered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "shard", "bucket", "offset", F.posexplode(F.shuffle("records", seed)).alias("place", "record")
    )
    return placed.select(
        *[F.col("record")[c].alias(c) for c in (*kept, "size", "grown_shard")],
        "shard",
        "bucket",
        (F.col("offset") + F.col("place")).cast("bigint").alias("slot"),
    )


def write_shards(rows: DataFrame, path: str) -> None:
    """Write the rows of ``shuffled`` as one folder per shard, each file a bucket or several in slot order."""
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = shuffled(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
