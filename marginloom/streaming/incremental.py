"""Scheduled loads: each call takes what has landed since the last one and stops.

The checkpoint is the cursor. A load writes its rows under its batch id and its log entry
last; a repeated batch overwrites its own folders, and readers ignore batches the log does
not know, so a load is visible whole or not at all. Intermediate rows are written to the
store, which lies in a folder all executors share, and read back from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.operators import cleaning, inventory, ledger, pools, quality, shipping
from marginloom.operators.activity import BILLING, INVENTORY, STATEMENT
from marginloom.sources import billing, delimited, sheets, statements
from marginloom.sources.files import digests_of, unseen_files
from marginloom.sources.sinks import create_table, read_batch, read_batches, remove_batch, write_batch
from marginloom.sources.versions import Versions, VersionTaken
from marginloom.streaming.keys import create_index, index_batch, rows_holding

LOG = "source string, last_row bigint, synced_at timestamp"
FILES = (
    "file string, file_hash string, file_bytes bigint, total_rows bigint, failed_rows bigint, unparsed_dates bigint,"
    " status string, error string"
)
NEW_FILES = "file string, file_hash string, file_bytes bigint, open_quote boolean"
LINES = "value string, file string, block bigint, line_id bigint, task int"
SPLITS = "file string, block bigint, task int, last_task int"
PARSED = (
    "type string, title string, info string, currency string, tax_details string, amount_cents bigint, fees_cents bigint,"
    " net_cents bigint, transaction_date date, undated boolean, file string"
)
ATTEMPTS = "import_id bigint, file string, status string, error string, step string, started_at timestamp, beat_at timestamp"
TRANSACTIONS = (
    "import_id bigint, type string, title string, info string, currency string, tax_details string,"
    " amount_cents bigint, fees_cents bigint, net_cents bigint, transaction_date date, order_no string,"
    " scope string, category string, listing_id string, fingerprint string, occurrence_no bigint,"
    " transaction_hash string"
)
POOLS = "import_id bigint, category string, net_cents bigint, first_date date, last_date date, pool_cents bigint"
TURNS = "order_no string, import_id bigint"
POOL_BATCHES = "pool_batch string, import_id bigint, category string, pool_cents bigint, orders bigint"
POOL_ALLOCATIONS = "allocation_id string, pool_batch string, order_no string, category string, amount_cents bigint"
IMPORTS = (
    "import_id bigint, total_rows bigint, new_rows bigint, duplicate_rows bigint, new_sales bigint,"
    " duplicate_sales bigint, new_expenses bigint, duplicate_expenses bigint, new_listing_rows bigint,"
    " duplicate_listing_rows bigint, file string, file_bytes bigint, failed_rows bigint, unparsed_dates bigint,"
    " status string, error string, created_at timestamp"
)
BILLING_ROWS = (
    "invoice_type string, invoice_date date, due_date date, waybill string, amount_cents bigint, file string, line_id bigint"
)
LINKS = "order_no string, waybill string"
SHARES = "order_no string, waybill string, allocated_cents bigint"
MAPPINGS = "billing_batch bigint, new_links bigint, billed bigint, matched bigint, unmatched bigint, written boolean, synced_at timestamp"
# Loads of the inventory log that one fold takes together.
FOLDED_BATCHES = 8
INVENTORY_CHANGES = "order_no string, material string, category string, color string, quantity_e4 bigint"


def _run(stream: DataFrame, load: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def _log(spark: SparkSession, store: str, source: str, rows: DataFrame, batch_id: int) -> None:
    """The entry that makes a batch visible; ``rows`` is one row with ``last_row``."""
    entry = rows.select(
        F.lit(source).alias("source"), F.col("last_row").cast("bigint"), F.current_timestamp().alias("synced_at")
    )
    write_batch(entry, f"{store}/sync_log", batch_id)


def committed(spark: SparkSession, store: str, table: str, schema: str, log: str = "sync_log") -> DataFrame:
    """The rows of all logged batches."""
    logged = spark.read.parquet(f"{store}/{log}").select("batch_id").distinct()
    return read_batches(spark, f"{store}/{table}", schema).join(logged, "batch_id", "left_semi")


def logged_batches(spark: SparkSession, store: str, log: str = "sync_log", before: int | None = None) -> DataFrame:
    """The ids of all logged batches, or of those before one."""
    entries = spark.read.parquet(f"{store}/{log}").select("batch_id").filter("batch_id >= 0").distinct()
    return entries if before is None else entries.filter(F.col("batch_id") < before)


def sync_log(spark: SparkSession, *stores: str) -> DataFrame:
    logs = [read_batches(spark, f"{store}/sync_log", LOG).drop("batch_id") for store in stores]
    union = logs[0]
    for log in logs[1:]:
        union = union.unionByName(log)
    return union


def _new_files(batch: DataFrame, store: str, batch_id: int) -> DataFrame:
    """The batch's files that no earlier load has completed, as NEW_FILES."""
    seen = read_batches(batch.sparkSession, f"{store}/files", FILES, before=batch_id)
    return unseen_files(digests_of(batch), seen).select("file", "file_hash", "file_bytes", "open_quote")


class _Attempt:
    """The audit entry of a load that is not finished: PROCESSING, with the time of its last step.

    A load that is tried again has the same batch and import ids and takes the entry over.
    """

    def __init__(self, fresh: DataFrame, store: str, batch_id: int, import_id: Callable[[Column], Column]):
        self.path, self.batch_id = f"{store}/attempts", batch_id
        self.files = fresh.select(import_id(F.col("file")).alias("import_id"), "file")
        self.started = fresh.sparkSession.range(1).select(F.current_timestamp()).first()[0]

    def at(self, step: str, status: str = "PROCESSING", error: str | None = None) -> None:
        told = [F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), F.lit(step).alias("step")]
        times = [F.lit(self.started).alias("started_at"), F.current_timestamp().alias("beat_at")]
        write_batch(self.files.select("import_id", "file", *told, *times), self.path, self.batch_id)


def _file_key(file: Column) -> Column:
    """The id in a folder named ``import_id=...``, else a hash of the path."""
    return F.coalesce(F.regexp_extract(file, r"import_id=(\d+)", 1).try_cast("bigint"), F.xxhash64(file))


def begin_load(batch: DataFrame, store: str, batch_id: int, import_id: Callable[[Column], Column] = _file_key) -> tuple[DataFrame, _Attempt]:
    """Find the new files of a batch and enter them as PROCESSING; nothing else is done yet."""
    write_batch(_new_files(batch, store, batch_id), f"{store}/new_files", batch_id)
    fresh = read_batch(batch.sparkSession, f"{store}/new_files", NEW_FILES, batch_id)
    attempt = _Attempt(fresh, store, batch_id, import_id)
    attempt.at("parse")
    return fresh, attempt


def ingest_statements(
    spark: SparkSession, landing: str, store: str, import_id: Callable[[Column], Column] = _file_key
) -> None:
    """Load new statement files: clean, number, drop known rows, allocate the store pools, write the audit.

    A file with an amount too large to hold is FAILED with the reason and adds no rows; the
    others load. ``import_id`` turns a file path into the id of its statement.
    """
    tables = {
        "files": FILES,
        "new_files": NEW_FILES,
        "attempts": ATTEMPTS,
        "parsed": PARSED,
        "staged": TRANSACTIONS,
        "transactions": TRANSACTIONS,
        "pools": POOLS,
        "turns": TURNS,
        "pool_batches": POOL_BATCHES,
        "pool_allocations": POOL_ALLOCATIONS,
        "imports": IMPORTS,
        "sync_log": LOG,
    }
    for name, schema in tables.items():
        create_table(spark, f"{store}/{name}", schema)
    create_index(spark, f"{store}/transactions")

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh, attempt = begin_load(batch, store, batch_id, import_id)
        try:
            work(session, batch, fresh, attempt, batch_id)
        except Exception as error:
            attempt.at("stopped", "FAILED", f"{type(error).__name__}: {error}"[:500])
            raise

    def work(session: SparkSession, batch: DataFrame, fresh: DataFrame, attempt: _Attempt, batch_id: int) -> None:
        lines = _landed(session, batch, fresh, store, batch_id)
        rows = statements.statement_rows(lines, fresh.count()).filter(statements.has_content())
        write_batch(_typed(rows.drop("block", "line_id")), f"{store}/parsed", batch_id)
        rows = read_batch(session, f"{store}/parsed", PARSED, batch_id)
        write_batch(_checked_files(fresh, rows), f"{store}/files", batch_id)
        files = read_batch(session, f"{store}/files", FILES, batch_id)

        attempt.at("clean")
        taken = files.filter(F.col("status") == "COMPLETED").select("file")
        rows = rows.join(taken, "file", "left_semi").withColumn("import_id", import_id(F.col("file"))).drop("file", "undated")
        numbered = cleaning.number_occurrences(rows, finish=cleaning.classified_statement)
        write_batch(numbered, f"{store}/staged", batch_id)
        staged = read_batch(session, f"{store}/staged", TRANSACTIONS, batch_id)

        attempt.at("append")
        new = _unknown(staged, f"{store}/transactions", logged_batches(session, store, before=batch_id))
        write_batch(new, f"{store}/transactions", batch_id)
        new = read_batch(session, f"{store}/transactions", TRANSACTIONS, batch_id)
        index_batch(new, f"{store}/transactions", "transaction_hash", batch_id)

        attempt.at("allocate")
        store_rows = ledger.expenses_of(new.filter(F.col("scope") == "ETSY"))
        earlier = read_batches(session, f"{store}/pool_allocations", POOL_ALLOCATIONS, before=batch_id)
        candidates = pools.eligible_orders(ledger.sales_of(new.filter(ledger.is_sale())), earlier)
        write_batch(pools.pool_totals(store_rows), f"{store}/pools", batch_id)
        totals = read_batch(session, f"{store}/pools", POOLS, batch_id)
        write_batch(pools.allocation_turns(candidates, totals), f"{store}/turns", batch_id)
        batches, allocations = pools.shares_of(read_batch(session, f"{store}/turns", TURNS, batch_id), totals)
        write_batch(batches.withColumnRenamed("batch_id", "pool_batch"), f"{store}/pool_batches", batch_id)
        write_batch(allocations.withColumnRenamed("batch_id", "pool_batch"), f"{store}/pool_allocations", batch_id)

        kept = cleaning.packed(new.select("transaction_hash", "import_id", F.lit(True).alias("is_new")), "transaction_hash")
        flagged = cleaning.packed(staged, "transaction_hash").join(kept, ["transaction_hash", "import_id"], "left").fillna(False, ["is_new"])
        write_batch(_audit(files, quality.import_counts(flagged), import_id), f"{store}/imports", batch_id)
        _log(session, store, STATEMENT, staged.agg(F.count("*").alias("last_row")), batch_id)
        for scratch in ("lines", "splits", "parsed", "staged", "pools", "turns"):
            remove_batch(session, f"{store}/{scratch}", batch_id)

    lines = delimited.stream_lines(spark.readStream, landing)
    _run(lines, load, f"{store}/_checkpoint")


def _landed(session: SparkSession, batch: DataFrame, fresh: DataFrame, store: str, batch_id: int) -> DataFrame:
    """The lines of the new files, taken over into the store: landed files are read for their digest and here, no more.

    Of a split that two tasks have read, the lines of one are used (see ``digests_of``); which, is written too,
    as the reader of the lines goes over them several times.
    """
    told = batch.withColumns({"line_id": F.monotonically_increasing_id(), "task": F.spark_partition_id()})
    write_batch(told.join(fresh, "file", "left_semi").select("value", "file", "block", "line_id", "task"), f"{store}/lines", batch_id)
    lines = read_batch(session, f"{store}/lines", LINES, batch_id)
    write_batch(lines.groupBy("file", "block").agg(F.min("task").alias("task"), F.max("task").alias("last_task")), f"{store}/splits", batch_id)
    once = read_batch(session, f"{store}/splits", SPLITS, batch_id)
    if not once.filter("task < last_task").isEmpty():
        lines = lines.join(once, ["file", "block", "task"], "left_semi")
    return lines.drop("task")


def import_audit(spark: SparkSession, store: str, silent_minutes: int = 30) -> DataFrame:
    """All imports with their state: import_id, file, status, error, total_rows, new_rows.

    A load that has begun and not ended is PROCESSING; one that has not moved on for
    ``silent_minutes`` is FAILED, as is one that was stopped by an error. Its next try keeps
    the import's id. Finished imports are COMPLETED or FAILED.
    """
    columns = ["import_id", "file", "status", "error", "total_rows", "new_rows"]
    done = committed(spark, store, "imports", IMPORTS).select(*columns)
    logged = spark.read.parquet(f"{store}/sync_log").select("batch_id").distinct()
    open_ = read_batches(spark, f"{store}/attempts", ATTEMPTS).filter("batch_id >= 0").join(logged, "batch_id", "left_anti")
    silent = (F.col("status") == "PROCESSING") & (F.col("beat_at") < F.current_timestamp() - F.make_interval(mins=F.lit(silent_minutes)))
    states = {
        "error": F.when(silent, F.concat(F.lit("silent since the step "), F.col("step"))).otherwise(F.col("error")),
        "status": F.when(silent, "FAILED").otherwise(F.col("status")),
    }
    zero = F.lit(0).cast("bigint")
    running = open_.withColumns(states).groupBy("import_id").agg(
        F.min("file").alias("file"), F.max("status").alias("status"), F.max("error").alias("error"), F.min(zero).alias("total_rows"), F.min(zero).alias("new_rows")
    )
    return done.unionByName(running.select(*columns))


def _typed(rows: DataFrame) -> DataFrame:
    """Parsed rows with amounts in cents and a date, read once for the check of the files and the load; ``undated`` if a date is not understood."""
    typed = cleaning.typed_statement(rows.withColumn("dated", F.col("date") != ""))
    return typed.withColumn("undated", F.col("dated") & F.col("transaction_date").isNull()).drop("dated")


def _checked_files(fresh: DataFrame, rows: DataFrame) -> DataFrame:
    """The new files with their row counts, status and error; a file with an open quote is refused."""
    amounts = [F.col(c).isNull() for c in ("amount_cents", "fees_cents", "net_cents")]
    counts = rows.groupBy("file").agg(
        F.count("*").alias("total_rows"),
        F.count_if(amounts[0] | amounts[1] | amounts[2]).alias("failed_rows"),
        F.count_if(F.col("undated")).alias("unparsed_dates"),
    )
    checked = fresh.join(counts, "file", "left").fillna(0, ["total_rows", "failed_rows", "unparsed_dates"])
    failed = F.col("failed_rows") > 0
    states = {
        "status": F.when(failed | F.col("open_quote"), "FAILED").otherwise("COMPLETED"),
        "error": F.when(F.col("open_quote"), "a quote is not closed").when(
            failed, F.concat(F.col("failed_rows").cast("string"), F.lit(" rows with an unreadable amount"))
        ),
    }
    return checked.withColumns(states).drop("open_quote")


def _audit(files: DataFrame, counts: DataFrame, import_id: Callable[[Column], Column]) -> DataFrame:
    """One audit row per import; an import of several files fails if one of them does."""
    per_import = files.groupBy(import_id(F.col("file")).alias("import_id")).agg(
        F.min("file").alias("file"),
        F.sum("file_bytes").alias("file_bytes"),
        F.sum("total_rows").alias("file_rows"),
        F.sum("failed_rows").alias("failed_rows"),
        F.sum("unparsed_dates").alias("unparsed_dates"),
        F.max("status").alias("status"),
        F.max("error").alias("error"),
    )
    numbers = [c for c in counts.columns if c != "import_id"]
    rows = per_import.join(counts, "import_id", "left").fillna(0, numbers)
    rows = rows.withColumns({"total_rows": F.col("file_rows"), "created_at": F.current_timestamp()})
    return rows.drop("file_rows")


def _unknown(staged: DataFrame, path: str, batches: DataFrame) -> DataFrame:
    """Staged rows the ledger at ``path`` lacks, each owned by one import.

    Of the ledger's ``batches`` only those that may hold a staged hash are opened. Equal hashes
    imply equal dates, so of these only rows in the staged date range are compared; the range is
    one row and prunes by file statistics. The shuffle takes the packed fingerprint and the
    number, from which the hash follows.
    """
    wanted = staged.filter(ledger.is_sale() | (F.col("category") != "SALE"))
    span = wanted.agg(F.min("transaction_date"), F.max("transaction_date")).first()
    date = F.col("transaction_date")
    known = rows_holding(wanted, path, TRANSACTIONS, "transaction_hash", batches)
    near = known.filter(date.between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")) | date.isNull())
    key = ["fingerprint", "occurrence_no"]
    # rows with a common key are rare: sorting them before the shuffle, to combine them there, would bring nothing
    first = ledger.first_import(cleaning.packed(wanted.drop("transaction_hash")).repartition(*key), key)
    new = cleaning.unpacked(first.join(cleaning.packed(near.select(*key)), key, "left_anti"))
    return new.withColumn("transaction_hash", cleaning.row_hash())


def ingest_billing(spark: SparkSession, landing: str, store: str) -> None:
    """Load new billing files and refuse those with a bad row. Allocations are the work of ``sync_mappings``."""
    tables = {"files": FILES, "new_files": NEW_FILES, "staged": BILLING_ROWS, "billing": BILLING_ROWS, "sync_log": LOG}
    for name, schema in tables.items():
        create_table(spark, f"{store}/{name}", schema)
    create_index(spark, f"{store}/billing")

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        write_batch(_new_files(batch, store, batch_id), f"{store}/new_files", batch_id)
        fresh = read_batch(session, f"{store}/new_files", NEW_FILES, batch_id)
        lines = _landed(session, batch, fresh, store, batch_id)
        write_batch(billing.clean_billing(billing.billing_rows(lines, fresh.count())).drop("block"), f"{store}/staged", batch_id)
        staged = read_batch(session, f"{store}/staged", BILLING_ROWS, batch_id)

        checks = quality.validate_billing(staged)
        accepted = F.col("accepted") & ~F.col("open_quote")
        status = F.when(accepted, "COMPLETED").otherwise("REJECTED")
        bad = F.concat(F.col("failed_rows").cast("string"), F.lit(" bad rows"))
        error = F.when(F.col("open_quote"), "a quote is not closed").when(~accepted, bad)
        checked = fresh.join(checks, "file").withColumns({"status": status, "error": error, "unparsed_dates": F.lit(0).cast("bigint")})
        checked = checked.drop("accepted", "open_quote")
        write_batch(checked, f"{store}/files", batch_id)
        files = read_batch(session, f"{store}/files", FILES, batch_id).filter(F.col("status") == "COMPLETED")
        write_batch(staged.join(files, "file", "left_semi"), f"{store}/billing", batch_id)
        billed = read_batch(session, f"{store}/billing", BILLING_ROWS, batch_id)
        index_batch(billed, f"{store}/billing", "waybill", batch_id)
        earlier = read_batches(session, f"{store}/sync_log", LOG, before=batch_id).agg(F.max("last_row")).first()[0] or 0
        _log(session, store, BILLING, billed.agg((F.count("*") + F.lit(earlier)).alias("last_row")), batch_id)
        for scratch in ("lines", "splits", "staged"):
            remove_batch(session, f"{store}/{scratch}", batch_id)

    lines = delimited.stream_lines(spark.readStream, landing)
    _run(lines, load, f"{store}/_checkpoint")


def sync_mappings(spark: SparkSession, store: str, links: DataFrame) -> DataFrame:
    """Append the links the store lacks and allocate the waybills that changed; returns the step's log row.

    A waybill has changed if it was billed in a load since the last step or has a new link.
    Only batches of bills and links that may hold a changed waybill are opened, and the counts
    of the last step are moved by what these waybills have become. If there are bills and none
    of all billed waybills has a link, nothing is allocated, and the bills wait for the next
    step. The log entry comes last: a step that fails is repeated under the same number and
    overwrites its own folders.
    """
    for name, schema in {"offered": LINKS, "links": LINKS, "touched": "waybill string", "shares": SHARES, "mapping_log": MAPPINGS}.items():
        create_table(spark, f"{store}/{name}", schema)
    for name in ("links", "shares"):
        create_index(spark, f"{store}/{name}")
    counted = F.struct("batch_id", "billing_batch", "billed", "matched")
    log = read_batches(spark, f"{store}/mapping_log", MAPPINGS)
    done = log.agg(F.max(counted).alias("last"), F.max(F.when(F.col("written"), F.col("billing_batch"))).alias("billing")).first()
    step, seen, billed, matched = (0, -1, 0, 0) if done.last is None else (done.last.batch_id + 1, *done.last[1:])
    since = -1 if done.billing is None else done.billing
    loads, steps = logged_batches(spark, store), logged_batches(spark, store, "mapping_log", step)

    offered = links.select("order_no", "waybill").filter("order_no <> '' and waybill <> ''")
    write_batch(offered.distinct(), f"{store}/offered", step)
    offered = read_batch(spark, f"{store}/offered", LINKS, step)
    known = rows_holding(offered, f"{store}/links", LINKS, "waybill", steps)
    # the offered links are distinct already: grouping them once more would shuffle them all
    write_batch(offered.join(known.select("order_no", "waybill"), ["order_no", "waybill"], "left_anti"), f"{store}/links", step)
    new = read_batch(spark, f"{store}/links", LINKS, step)
    index_batch(new, f"{store}/links", "waybill", step)

    # links of a step that could not write were never allocated; their bills are newer than `since`
    recent = committed(spark, store, "billing", BILLING_ROWS).filter(F.col("batch_id") > since).select("waybill")
    write_batch(recent.unionByName(new.select("waybill")).filter("waybill <> ''").distinct(), f"{store}/touched", step)
    touched = read_batch(spark, f"{store}/touched", "waybill string", step)
    with_this = steps.unionByName(spark.range(step, step + 1).toDF("batch_id"))
    bills = rows_holding(touched, f"{store}/billing", BILLING_ROWS, "waybill", loads).join(touched, "waybill", "left_semi")
    linked = rows_holding(touched, f"{store}/links", LINKS, "waybill", with_this).join(touched, "waybill", "left_semi")

    moved = shipping.match_changes(bills, F.col("batch_id") <= seen, linked, F.col("batch_id") < step).first()
    billed, matched = billed + moved.billed, matched + moved.matched
    may_write = billed == 0 or matched > 0
    if may_write:
        own = shipping.allocate_shipping(shipping.waybill_cost(bills), linked.drop("batch_id"))
        write_batch(own, f"{store}/shares", step)
        index_batch(read_batch(spark, f"{store}/shares", SHARES, step), f"{store}/shares", "waybill", step)
    newest = loads.agg(F.max("batch_id")).first()[0]
    numbers = {"billed": billed, "matched": matched, "unmatched": billed - matched}
    entry = new.agg(F.count("*").alias("new_links")).select(
        F.lit(-1 if newest is None else newest).cast("bigint").alias("billing_batch"),
        "new_links",
        *[F.lit(n).cast("bigint").alias(c) for c, n in numbers.items()],
        F.lit(may_write).alias("written"),
        F.current_timestamp().alias("synced_at"),
    )
    write_batch(entry, f"{store}/mapping_log", step)
    for scratch in ("offered", "touched"):
        remove_batch(spark, f"{store}/{scratch}", step)
    return read_batch(spark, f"{store}/mapping_log", MAPPINGS, step)


def current_allocations(spark: SparkSession, store: str) -> DataFrame:
    """The shipping cost of every linked and billed waybill's orders, as of its last allocation."""
    shares = committed(spark, store, "shares", SHARES, "mapping_log")
    newest = shares.groupBy("waybill").agg(F.max("batch_id").alias("batch_id"))
    return shares.join(newest, ["waybill", "batch_id"]).select("order_no", "waybill", "allocated_cents")


def sync_inventory(spark: SparkSession, landing: str, store: str) -> None:
    """Load new sheet rows; a key seen again takes the quantity of the later load."""
    for name, schema in {"changes": INVENTORY_CHANGES, "sync_log": LOG}.items():
        create_table(spark, f"{store}/{name}", schema)

    def load(batch: DataFrame, batch_id: int) -> None:
        checked = quality.check_inventory(sheets.sheet_fields(batch))
        rolled = inventory.inventory_rollup(quality.valid_inventory(checked))
        write_batch(rolled, f"{store}/changes", batch_id)
        counts = quality.load_counts(checked).withColumnRenamed("max_row_index", "last_row")
        _log(batch.sparkSession, store, INVENTORY, counts, batch_id)

    stream = spark.readStream.schema(sheets.SHEET_SCHEMA).parquet(landing)
    _run(stream, load, f"{store}/_checkpoint")
    fold_inventory(spark, store)


def current_inventory(spark: SparkSession, store: str) -> DataFrame:
    """The inventory after all loads: the folded base and the change batches after it; older ones are not read."""
    _, base = Versions(spark, f"{store}/base").newest()
    schema = f"{INVENTORY_CHANGES}, batch_id bigint"
    newer = committed(spark, store, "changes", INVENTORY_CHANGES).filter(F.col("batch_id") > base.get("upto", -1))
    rows = newer.select(*[f.split()[0] for f in schema.split(", ")])
    if base:
        folded = spark.read.schema(INVENTORY_CHANGES).parquet(f"{store}/base/{base['folder']}")
        rows = rows.unionByName(folded.withColumn("batch_id", F.lit(base["upto"]).cast("bigint")))
    return ledger.latest_per_key(rows, inventory.INVENTORY_KEY, "batch_id").drop("batch_id")


def fold_inventory(spark: SparkSession, store: str, batches: int = FOLDED_BATCHES) -> bool:
    """Fold the change log into a new base if ``batches`` loads have ended since the last one.

    A read then takes the base and fewer than ``batches`` change batches, however many loads
    there were. The base becomes current by its pointer; if another run folds at the same
    time, the first to end counts.
    """
    versions = Versions(spark, f"{store}/base")
    number, base = versions.newest()
    newest = spark.read.parquet(f"{store}/sync_log").agg(F.max("batch_id")).first()[0]
    if newest - base.get("upto", -1) < batches:
        return False
    folder = f"data-{uuid.uuid4().hex}"
    # a load that ends meanwhile is newer than the base and is read beside it
    current_inventory(spark, store).write.parquet(f"{store}/base/{folder}")
    try:
        versions.put(number + 1, {"folder": folder, "upto": newest})
    except VersionTaken:
        return False
    return True


def dedupe_stream(stream: DataFrame, store: str, schema: str, key: str) -> None:
    """Append stream rows whose key no earlier load has stored.

    The comparison with the ledger is exact and keeps no state, so there is no horizon
    after which a repeated row would slip through. Only earlier loads that may hold one of the
    keys are opened (``streaming.keys``).
    """
    spark = stream.sparkSession
    for name in ("staged", "rows"):
        create_table(spark, f"{store}/{name}", schema)
    create_index(spark, f"{store}/rows")
    create_table(spark, f"{store}/sync_log", LOG)

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        write_batch(batch.dropDuplicates([key]), f"{store}/staged", batch_id)
        staged = read_batch(session, f"{store}/staged", schema, batch_id)
        known = rows_holding(staged, f"{store}/rows", schema, key, logged_batches(session, store, before=batch_id))
        write_batch(ledger.new_rows(known, staged, [key]), f"{store}/rows", batch_id)
        written = read_batch(session, f"{store}/rows", schema, batch_id)
        index_batch(written, f"{store}/rows", key, batch_id)
        _log(session, store, "dedupe", written.agg(F.count("*").alias("last_row")), batch_id)
        remove_batch(session, f"{store}/staged", batch_id)

    _run(stream, load, f"{store}/_checkpoint")


def dedupe_stream_horizon(stream: DataFrame, store: str, schema: str, key: str, time: str, horizon: str) -> int:
    """Append stream rows whose key has not been seen within ``horizon`` of event time; returns the rows that came too late.

    The keys of the horizon lie in the state store, so a load compares with them alone and
    not with the ledger, and state is dropped as the watermark passes. A row older than the
    newest by more than the horizon is late: it is counted and not stored. ``dedupe_stream``
    has no such limit, at the price of reading the ledger's keys.
    """
    spark = stream.sparkSession
    create_table(spark, f"{store}/rows", schema)
    create_table(spark, f"{store}/sync_log", LOG)

    def load(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{store}/rows", batch_id)
        written = read_batch(batch.sparkSession, f"{store}/rows", schema, batch_id)
        _log(batch.sparkSession, store, "dedupe", written.agg(F.count("*").alias("last_row")), batch_id)

    first_seen = stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])
    writer = first_seen.writeStream.foreachBatch(load).option("checkpointLocation", f"{store}/_checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(int(state.numRowsDroppedByWatermark) for progress in query.recentProgress for state in progress.stateOperators)
