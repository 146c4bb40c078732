import datetime

import pytest
from pyspark.sql import functions as F

from marginloom.operators import activity, shipping
from marginloom.session import shared_folder
from marginloom.sources import sheets
from marginloom.streaming import incremental as inc
from marginloom.streaming import keys

HEADER = "Date,Type,Title,Info,Currency,Amount,Fees & Taxes,Net,Tax Details\n"


def sale(order, amount, day="01"):
    return f'"June {day}, 2026",Sale,Payment for Order #{order},--,INR,{amount},--,{amount},--\n'


def fee(title, net, info="--", kind="Fee"):
    return f'"June 30, 2026",{kind},{title},{info},INR,--,{net},{net},--\n'


def put(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEADER + body)


@pytest.fixture
def statements(spark, tmp_path):
    landing, store = tmp_path / "landing", shared_folder(spark, "statements")
    landing.mkdir()

    def load():
        inc.ingest_statements(spark, str(landing), store)
        return {
            name: inc.committed(spark, store, name, schema).collect()
            for name, schema in [
                ("transactions", inc.TRANSACTIONS),
                ("pool_allocations", inc.POOL_ALLOCATIONS),
                ("pool_batches", inc.POOL_BATCHES),
                ("imports", inc.IMPORTS),
            ]
        }

    return landing, load


def test_statement_loads(statements):
    landing, load = statements
    first = (
        sale("4105054431", "10.00") * 2
        + sale("4105054432", "20.00")
        + fee("Listing fee: Listing 1200000001", "-1.00")
        + fee("Etsy Ads", "-0.05", kind="Marketing")
        + fee("Transaction fee", "-0.30", "Order #4105054431")
        + '"June 30, 2026",Sale,No number here,--,INR,5,--,5,--\n'
    )
    put(landing, "june.csv", first)
    got = load()
    assert len(got["transactions"]) == 6
    assert sorted(r.occurrence_no for r in got["transactions"] if r.order_no == "4105054431" and r.category == "SALE") == [1, 2]
    shares = {(r.pool_batch.split("_", 2)[2], r.order_no): r.amount_cents for r in got["pool_allocations"]}
    assert shares == {
        ("LISTING_FEE", "4105054431"): 50,
        ("LISTING_FEE", "4105054432"): 50,
        ("ETSY_ADS", "4105054431"): 2,
        ("ETSY_ADS", "4105054432"): 3,
    }
    audit = got["imports"][0]
    assert (audit.total_rows, audit.new_rows, audit.new_sales, audit.duplicate_sales, audit.new_expenses) == (7, 6, 3, 1, 3)

    # Nothing new: no batch, nothing changes.
    assert load() == got

    # The same content under another name is not loaded again.
    put(landing, "copy.csv", first)
    again = load()
    assert {k: len(v) for k, v in again.items()} == {k: len(v) for k, v in got.items()}

    # An overlapping statement adds only its unknown rows; allocated orders take no second share.
    put(landing, "july.csv", sale("4105054431", "10.00") * 3 + sale("4105054433", "7.00") + fee("Etsy Ads", "-0.05", kind="Marketing") * 2)
    later = load()
    assert len(later["transactions"]) == 6 + 3
    new = [r for r in later["pool_allocations"] if r not in again["pool_allocations"]]
    assert {(r.order_no, r.amount_cents) for r in new} == {("4105054433", 5)}


def test_order_of_files_does_not_change_the_ledger(spark, tmp_path):
    bodies = [sale("4105054431", "10.00") * 2, sale("4105054431", "10.00") * 3 + fee("Etsy Ads", "-1") * 2]
    ledgers = []
    for order in ([0, 1], [1, 0]):
        landing, store = tmp_path / f"in{order[0]}", shared_folder(spark, "order")
        for i in order:
            put(landing, f"f{i}.csv", bodies[i])
            inc.ingest_statements(spark, str(landing), store)
        rows = inc.committed(spark, store, "transactions", inc.TRANSACTIONS).collect()
        ledgers.append(sorted(r.transaction_hash for r in rows))
    assert ledgers[0] == ledgers[1] and len(ledgers[0]) == 5


def test_unlogged_batch_is_invisible_and_retried(spark, tmp_path, monkeypatch):
    landing, store = tmp_path / "landing", shared_folder(spark, "retry")
    put(landing, "a.csv", sale("4105054431", "10.00"))
    inc.ingest_statements(spark, str(landing), store)
    put(landing, "b.csv", sale("4105054432", "20.00"))
    with monkeypatch.context() as m:
        m.setattr(inc, "_log", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            inc.ingest_statements(spark, str(landing), store)
    assert inc.committed(spark, store, "transactions", inc.TRANSACTIONS).count() == 1
    inc.ingest_statements(spark, str(landing), store)
    rows = inc.committed(spark, store, "transactions", inc.TRANSACTIONS).collect()
    assert sorted(r.order_no for r in rows) == ["4105054431", "4105054432"]


def test_unreadable_file_does_not_stop_the_others(statements, spark, tmp_path):
    landing, load = statements
    put(landing, "good.csv", sale("4105054431", "10.00") + sale("4105054432", "5", day="99"))
    put(landing, "bad.csv", sale("4105054433", "99999999999999999999.00") + sale("4105054434", "1"))
    got = load()
    assert {r.order_no for r in got["transactions"]} == {"4105054431", "4105054432"}
    audit = {r.file.rsplit("/", 1)[-1]: r for r in got["imports"]}
    assert (audit["good.csv"].status, audit["good.csv"].unparsed_dates, audit["good.csv"].new_sales) == ("COMPLETED", 1, 2)
    bad = audit["bad.csv"]
    assert (bad.status, bad.failed_rows, bad.total_rows, bad.new_rows, bad.error) == ("FAILED", 1, 2, 0, "1 rows with an unreadable amount")
    assert bad.file_bytes == (landing / "bad.csv").stat().st_size
    # the mended file loads, and a failed one is tried again when it lands again
    put(landing, "mended.csv", sale("4105054433", "9.00"))
    put(landing, "bad again.csv", sale("4105054433", "99999999999999999999.00") + sale("4105054434", "1"))
    got = load()
    assert "4105054433" in {r.order_no for r in got["transactions"]}
    assert sorted(r.status for r in got["imports"]) == ["COMPLETED", "COMPLETED", "FAILED", "FAILED"]


def test_quoted_line_break_in_a_load(statements):
    landing, load = statements
    put(landing, "a.csv", '"June 01, 2026",Sale,"Payment for Order #4105054431\nsecond line",--,INR,10.00,--,10.00,--\n')
    (row,) = load()["transactions"]
    assert (row.order_no, row.amount_cents, row.title) == ("4105054431", 1000, "Payment for Order #4105054431\nsecond line")


def test_only_logged_batches_are_visible(spark):
    store = shared_folder(spark, "gaps")
    for table, batches in {"rows": (0, 1, 2), "sync_log": (0, 2)}.items():
        for batch in batches:
            inc.write_batch(spark.range(1), f"{store}/{table}", batch)
    rows = inc.committed(spark, store, "rows", "id bigint").collect()
    assert sorted(r.batch_id for r in rows) == [0, 2]


def test_billing_and_mappings(spark, tmp_path, frame):
    landing, store = tmp_path / "billing", shared_folder(spark, "billing")
    landing.mkdir()
    head = "Invoice Type,Invoice Date,Due Date,AWB,Total Amount\n"

    def sync(*links):
        row = inc.sync_mappings(spark, store, frame(list(links), "order_no string, waybill string")).first()
        shares = {(r.order_no, r.allocated_cents) for r in inc.current_allocations(spark, store).collect()}
        return (row.new_links, row.billed, row.matched, row.written), shares

    (landing / "good.csv").write_text(head + "Duty,01-Apr-26,,100,10.01\n")
    (landing / "bad.csv").write_text(head + "Duty,01-Apr-26,,200,5\nDuty,01-Apr-26,,,5\n")
    inc.ingest_billing(spark, str(landing), store)
    rows = inc.committed(spark, store, "billing", inc.BILLING_ROWS).collect()
    assert [(r.waybill, r.amount_cents) for r in rows] == [("100", 1001)]

    # links that match nothing leave the bills visible and unallocated, and are kept
    assert sync(("o9", "900")) == ((1, 1, 0, False), set())
    assert sync(("o1", "100"), ("o2", "100"), ("o9", "900")) == ((2, 1, 1, True), {("o1", 501), ("o2", 500)})

    (landing / "copy.csv").write_text(head + "Duty,01-Apr-26,,100,10.01\n")
    (landing / "fixed.csv").write_text(head + "Duty,01-Apr-26,,200,5\nDuty,01-Apr-26,,900,3\n")
    inc.ingest_billing(spark, str(landing), store)
    assert sync(("o3", "200")) == ((1, 3, 3, True), {("o1", 501), ("o2", 500), ("o3", 500), ("o9", 300)})
    # a new link changes its waybill's shares only
    assert sync(("o4", "200"))[1] == {("o1", 501), ("o2", 500), ("o3", 250), ("o4", 250), ("o9", 300)}
    written = spark.read.parquet(f"{store}/shares").filter("batch_id = 3").collect()
    assert {r.waybill for r in written} == {"200"}
    state = activity.sync_state(inc.sync_log(spark, store)).first()
    assert (state.source, state.last_row) == ("fedex_billing", 3)


def test_inventory_sync(spark, tmp_path):
    landing, store = str(tmp_path / "sheet"), shared_folder(spark, "inventory")

    def land(*rows):
        cells = [(i, "", order, "", "Cotton", "Bag", "red", q, "2026-01-01") for i, order, q in rows]
        spark.createDataFrame(cells, sheets.SHEET_SCHEMA).write.mode("append").parquet(landing)
        inc.sync_inventory(spark, landing, store)
        return {r.order_no: r.quantity_e4 for r in inc.current_inventory(spark, store).collect()}

    assert land((2, "10-1", "1.5"), (3, "10-2", "1"), (4, "11", "2"), (5, "x", "2")) == {"10": 25000, "11": 20000}
    assert land((6, "10-1", "4"), (7, "12", "1")) == {"10": 40000, "11": 20000, "12": 10000}
    assert land((8, "bad", "1")) == {"10": 40000, "11": 20000, "12": 10000}
    log = inc.sync_log(spark, store)
    assert activity.sync_state(log).first().last_row == 8
    assert log.agg(F.count("*")).first()[0] == 3


def test_dedupe_stream(spark, tmp_path):
    landing, store = str(tmp_path / "rows"), shared_folder(spark, "dedupe")
    for ids in ([1, 2, 2], [2, 3], [1]):
        spark.createDataFrame([(i,) for i in ids], "id bigint").write.mode("append").parquet(landing)
        inc.dedupe_stream(spark.readStream.schema("id bigint").parquet(landing), store, "id bigint", "id")
    rows = inc.committed(spark, store, "rows", "id bigint").collect()
    assert sorted(r.id for r in rows) == [1, 2, 3]


def test_open_quote_fails_its_file_only(statements):
    landing, load = statements
    put(landing, "st[1].csv", sale("4105054431", "10.00") + '"June 01, 2026",Sale,"Payment for Order #4105054432\nmore",--,INR,1,--,1,--\n')
    put(landing, "open.csv", sale("4105054433", "10.00") + 'Fee,"never closed,1\n')
    got = load()
    assert {r.order_no for r in got["transactions"]} == {"4105054431", "4105054432"}
    assert {(r.status, r.error) for r in got["imports"]} == {("COMPLETED", None), ("FAILED", "a quote is not closed")}


def test_audit_follows_a_load(spark, tmp_path, monkeypatch):
    landing, store = tmp_path / "landing", shared_folder(spark, "audit")
    states = lambda **k: {r.file.rsplit("/", 1)[-1]: (r.status, r.error, r.new_rows) for r in inc.import_audit(spark, store, **k).collect()}
    put(landing, "a.csv", sale("4105054431", "10.00"))
    inc.ingest_statements(spark, str(landing), store)
    assert states() == {"a.csv": ("COMPLETED", None, 1)}

    # stopped by an error: FAILED with the reason
    put(landing, "b.csv", sale("4105054432", "20.00"))
    seen = []
    with monkeypatch.context() as m:
        def lost(*_):
            seen.append(states()["b.csv"])
            raise RuntimeError("lost")

        m.setattr(inc, "_unknown", lost)
        with pytest.raises(Exception, match="lost"):
            inc.ingest_statements(spark, str(landing), store)
    assert seen == [("PROCESSING", None, 0)] and states()["b.csv"] == ("FAILED", "RuntimeError: lost", 0)

    # gone without a word: PROCESSING until it has been silent for long
    lines = inc.delimited.read_lines(spark, str(landing))
    inc.begin_load(lines, store, 1)
    assert states()["b.csv"] == ("PROCESSING", None, 0)
    assert states(silent_minutes=0)["b.csv"] == ("FAILED", "silent since the step parse", 0)
    before = {r.file: r.import_id for r in inc.import_audit(spark, store).collect()}

    # the next run takes the load over under the same id
    inc.ingest_statements(spark, str(landing), store)
    assert states() == {"a.csv": ("COMPLETED", None, 1), "b.csv": ("COMPLETED", None, 1)}
    assert {r.file: r.import_id for r in inc.import_audit(spark, store).collect()} == before


def test_dedupe_within_a_horizon(spark, tmp_path):
    landing, store = str(tmp_path / "rows"), shared_folder(spark, "horizon")
    schema = "id bigint, at timestamp"
    late = []
    for rows in ([(1, 1), (2, 20), (2, 20)], [(2, 21), (3, 22), (4, 1)], [(1, 23), (5, 40)]):
        told = [(i, datetime.datetime(2026, 1, 1) + datetime.timedelta(days=day)) for i, day in rows]
        spark.createDataFrame(told, schema).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        late.append(inc.dedupe_stream_horizon(stream, store, schema, "id", "at", "10 days"))
    rows = inc.committed(spark, store, "rows", schema).collect()
    # 4 is older than the horizon; 1 is new again after it
    assert sorted((r.id, (r["at"] - datetime.datetime(2026, 1, 1)).days) for r in rows) == [(1, 1), (1, 23), (2, 20), (3, 22), (5, 40)]
    assert late == [0, 1, 0]


def test_inventory_reads_stay_bounded(spark):
    """However many loads there were, a read takes the base and fewer than a fold's batches."""
    store, want = shared_folder(spark, "folded"), {}
    for batch in range(11):
        rows = [(str(batch), "Cotton", "Bag", "red", batch), ("same", "Cotton", "Bag", "red", 100 + batch)]
        want |= {str(batch): batch, "same": 100 + batch}
        inc.write_batch(spark.createDataFrame(rows, inc.INVENTORY_CHANGES), f"{store}/changes", batch)
        inc.write_batch(spark.createDataFrame([("s", 1, datetime.datetime(2026, 1, 1))], inc.LOG), f"{store}/sync_log", batch)
        assert inc.fold_inventory(spark, store, batches=4) == (batch % 4 == 3)
        current = inc.current_inventory(spark, store)
        assert {r.order_no: r.quantity_e4 for r in current.collect()} == want
    # batches 0 to 7 are folded: what they wrote is not read any more
    for batch in range(8):
        spark.createDataFrame([("no",)], "x string").write.mode("overwrite").text(f"{store}/changes/batch_id={batch}")
    assert {r.order_no: r.quantity_e4 for r in inc.current_inventory(spark, store).collect()} == want


def opened_batches(monkeypatch):
    """Records, by table, the earlier batches that the loads open."""
    seen = {}
    plain = keys.rows_of_batches

    def watched(spark, path, schema, batches):
        seen.setdefault(path.rsplit("/", 1)[-1], []).append(batches)
        return plain(spark, path, schema, batches)

    monkeypatch.setattr(keys, "rows_of_batches", watched)
    return seen


def test_dedupe_opens_only_loads_that_may_hold_its_keys(spark, tmp_path, monkeypatch):
    landing, store = str(tmp_path / "rows"), shared_folder(spark, "dedupe")
    seen = opened_batches(monkeypatch)
    loads = [["a1", "m5", "z9"], ["b1", "n5", "y9"], ["c1", "o5", "x9"], ["d1", "n5", "w9", "w9"], ["zz"], [None, "c1"], [None]]
    for load in loads:
        spark.createDataFrame([(k,) for k in load], "k string").write.mode("append").parquet(landing)
        inc.dedupe_stream(spark.readStream.schema("k string").parquet(landing), store, "k string", "k")
    # the fourth load repeats a key of the second, the sixth one of the third; all other loads open nothing
    assert seen["rows"] == [[], [], [], [1], [], [2], []]
    rows = [r.k for r in inc.committed(spark, store, "rows", "k string").collect()]
    assert sorted(k for k in rows if k) == sorted({k for load in loads for k in load if k}) and rows.count(None) == 2


def test_batches_without_an_index_are_opened(spark, frame):
    path = shared_folder(spark, "old") + "/rows"
    keys.create_index(spark, path)
    for batch, key in enumerate("abc"):
        rows = frame([(key,)], "k string")
        inc.write_batch(rows, path, batch)
        if batch:
            keys.index_batch(rows, path, "k", batch)
    batches = spark.range(3).toDF("batch_id")
    assert keys.batches_holding(frame([("c",), ("x",)], "k string"), path, "k", batches) == [0, 2]
    assert keys.batches_holding(frame([], "k string"), path, "k", batches) == [0]


def test_statement_load_opens_only_loads_that_may_hold_its_rows(statements, monkeypatch):
    landing, load = statements
    seen = opened_batches(monkeypatch)
    for name, body in {"a": sale("4105054431", "1"), "b": sale("4105054432", "2"), "c": sale("4105054433", "3") + sale("4105054432", "2")}.items():
        put(landing, f"{name}.csv", body)
        got = load()
    assert seen["transactions"] == [[], [], [1]]
    assert sorted(r.order_no for r in got["transactions"]) == ["4105054431", "4105054432", "4105054433"]


def test_mapping_counts_follow_the_changed_waybills(spark, tmp_path, frame, monkeypatch):
    """Counts are moved by the changed waybills, and only loads that billed one of them are opened."""
    landing, store = tmp_path / "billing", shared_folder(spark, "billing")
    landing.mkdir()
    head = "Invoice Type,Invoice Date,Due Date,AWB,Total Amount\n"
    steps = [  # bills, links, (billed, matched, written), opened loads
        (["100", "101", "100"], [("o1", "999")], (2, 0, False), [0]),
        (["200"], [("o1", "100"), ("o2", "100"), ("o1", "999")], (3, 1, True), [0, 1]),
        ([], [("o4", "101"), ("o4", "101")], (3, 2, True), [0]),
        (["300", "999"], [], (5, 3, True), [2]),
    ]
    seen = opened_batches(monkeypatch)
    for i, (bills, links, counts, opened) in enumerate(steps):
        if bills:
            (landing / f"{i}.csv").write_text(head + "".join(f"Duty,01-Apr-26,,{w},1.0{i}\n" for w in bills))
            inc.ingest_billing(spark, str(landing), store)
        row = inc.sync_mappings(spark, store, frame(links, "order_no string, waybill string")).first()
        assert (row.billed, row.matched, row.written, row.unmatched) == (*counts, counts[0] - counts[1])
        assert seen["billing"][-1] == opened
    shares = {tuple(r) for r in inc.current_allocations(spark, store).collect()}
    assert shares == {("o1", "100", 100), ("o2", "100", 100), ("o4", "101", 100), ("o1", "999", 103)}


def test_offered_links_are_grouped_once(spark, tmp_path, monkeypatch):
    """They are written distinct, so appending them to the links groups nothing again."""
    plans, write = [], inc.write_batch

    def told(rows, path, batch_id):
        if path.endswith("/links"):
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        write(rows, path, batch_id)

    monkeypatch.setattr(inc, "write_batch", told)
    store = str(tmp_path / "store")
    inc.create_table(spark, f"{store}/billing", inc.BILLING_ROWS)
    inc.create_index(spark, f"{store}/billing")
    inc.create_table(spark, f"{store}/sync_log", inc.LOG)
    links = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "a"), ("", "b"), ("3", None)], "order_no string, waybill string")
    for _ in range(2):
        inc.sync_mappings(spark, store, links)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{store}/links").select("order_no", "waybill").collect()) == [("1", "a"), ("2", "a")]
    assert len(plans) == 2 and not any("Aggregate" in plan for plan in plans)


def plans_of(monkeypatch):
    """The optimized plan of each table's last write."""
    plans, write = {}, inc.write_batch

    def told(rows, path, batch_id):
        plans[path.rsplit("/", 1)[1]] = rows._jdf.queryExecution().optimizedPlan().toString()
        write(rows, path, batch_id)

    monkeypatch.setattr(inc, "write_batch", told)
    return plans


def test_statement_texts_are_typed_once(statements, monkeypatch):
    """Amounts and dates are read with the parse; the check of the files and the load take them from there."""
    landing, load = statements
    plans = plans_of(monkeypatch)
    body = sale("4105054431", "10.00") + sale("4105054432", "1.00").replace("June 01, 2026", "no day") + fee("Etsy Ads", "x", kind="Marketing")
    put(landing, "a.csv", body)
    put(landing, "b.csv", sale("4105054433", "99999999999999999999"))
    got = load()
    assert {(r.total_rows, r.failed_rows, r.unparsed_dates, r.status) for r in got["imports"]} == {(3, 0, 1, "COMPLETED"), (1, 1, 0, "FAILED")}
    assert sorted((r.order_no, r.amount_cents) for r in got["transactions"] if r.order_no) == [("4105054431", 1000), ("4105054432", 100)]
    assert "0-9." in plans["parsed"] and "0-9." not in plans["files"] + plans["staged"]


def test_pools_are_shared_from_turns_that_are_found_once(statements, monkeypatch):
    landing, load = statements
    plans = plans_of(monkeypatch)
    put(landing, "a.csv", sale("4105054431", "10.00") + sale("4105054432", "20.00") + fee("Etsy Ads", "-0.05", kind="Marketing"))
    got = load()
    assert sorted(r.amount_cents for r in got["pool_allocations"]) == [2, 3]
    assert all("fingerprint" not in plans[t] and "scope" not in plans[t] for t in ("pool_batches", "pool_allocations"))


def test_new_rows_are_shuffled_before_they_are_sorted(statements, monkeypatch):
    landing, load = statements
    plans = plans_of(monkeypatch)
    put(landing, "a.csv", sale("4105054431", "10.00") * 2)
    put(landing, "b.csv", sale("4105054431", "10.00") * 3)
    got = load()
    assert len(got["transactions"]) == 3
    assert "RepartitionByExpression [fingerprint" in plans["transactions"]


def test_lines_are_matched_with_splits_only_if_one_was_read_twice(statements, monkeypatch):
    landing, load = statements
    plans = plans_of(monkeypatch)
    put(landing, "a.csv", sale("4105054431", "10.00"))
    load()
    assert "last_task" not in plans["parsed"]
