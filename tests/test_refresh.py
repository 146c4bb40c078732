"""Stored financials that follow the loads, against computing them anew from all that was loaded."""

import datetime

import pytest

from marginloom.operators import ledger
from marginloom.plans.financials import MONEY_COLUMNS, Ledgers, order_financials
from marginloom.session import shared_folder
from marginloom.sources import sinks
from marginloom.sources.versions import Versions, VersionTaken
from marginloom.streaming import incremental as inc
from marginloom.streaming import refresh

DAY = datetime.date


class Loads:
    """Batches written as the loads write them."""

    def __init__(self, spark):
        self.spark = spark
        self.stores = refresh.Stores(*[shared_folder(spark, s) for s in ("statements", "billing", "inventory")])
        self.path = shared_folder(spark, "financials")

    def _put(self, store, table, schema, rows, batch):
        sinks.write_batch(self.spark.createDataFrame(rows, schema), f"{store}/{table}", batch)

    def statement(self, batch, sales=(), fees=(), pools=()):
        """sales (order, day, cents), fees (order, day, category, cents), pools (order, category, cents)"""
        rows = [(o, d, "SALE", "SALE", c, 0, c) for o, d, c in sales]
        rows += [(o, d, k, "ETSY" if o is None else "ORDER", 0, -c, -c) for o, d, k, c in fees]
        columns = [f.split()[0] for f in inc.TRANSACTIONS.split(", ")]
        full = [
            {"import_id": batch, "order_no": o, "transaction_date": d, "category": k, "scope": s, "amount_cents": a, "fees_cents": f, "net_cents": n, "transaction_hash": f"{batch}-{i}"}
            for i, (o, d, k, s, a, f, n) in enumerate(rows)
        ]
        self._put(self.stores.statements, "transactions", inc.TRANSACTIONS, [tuple(r.get(c) for c in columns) for r in full], batch)
        self._put(self.stores.statements, "pool_allocations", inc.POOL_ALLOCATIONS, [(f"{batch}{k}{o}", f"{batch}{k}", o, k, c) for o, k, c in pools], batch)
        self._put(self.stores.statements, "sync_log", inc.LOG, [("etsy_statement", 1, datetime.datetime(2026, 1, 1))], batch)

    def mapping(self, step, links=(), shares=()):
        self._put(self.stores.billing, "links", inc.LINKS, list(links), step)
        self._put(self.stores.billing, "shares", inc.SHARES, list(shares), step)
        self._put(self.stores.billing, "mapping_log", inc.MAPPINGS, [(step, 1, 1, 1, 0, True, datetime.datetime(2026, 1, 1))], step)

    def sheet(self, batch, rows):
        self._put(self.stores.inventory, "changes", inc.INVENTORY_CHANGES, [(o, m, "Bag", "red", q) for o, m, q in rows], batch)
        self._put(self.stores.inventory, "sync_log", inc.LOG, [("sheet", 1, datetime.datetime(2026, 1, 1))], batch)

    def refresh(self, upto=None):
        return refresh.refresh_financials(self.spark, self.stores, self.path, upto)

    def stored(self, *period):
        return refresh.stored_financials(self.spark, self.path, *period)

    def rebuilt(self):
        """All ledgers as they are now, and the financials computed from them."""
        s, spark = self.stores, self.spark

        def every(store, table, schema, log="sync_log"):
            return inc.committed(spark, store, table, schema, log) if refresh.exists(spark, f"{store}/{table}") else spark.createDataFrame([], f"{schema}, batch_id bigint")

        rows = every(s.statements, "transactions", inc.TRANSACTIONS)
        shares = inc.current_allocations(spark, s.billing) if refresh.exists(spark, f"{s.billing}/shares") else spark.createDataFrame([], inc.SHARES)
        stock = inc.current_inventory(spark, s.inventory) if refresh.exists(spark, f"{s.inventory}/changes") else spark.createDataFrame([], inc.INVENTORY_CHANGES)
        links = every(s.billing, "links", inc.LINKS, "mapping_log")
        pools = every(s.statements, "pool_allocations", inc.POOL_ALLOCATIONS)
        return order_financials(Ledgers(ledger.sales_of(rows.filter(ledger.is_sale())), ledger.expenses_of(rows), stock, links, shares, pools))

    def check(self):
        columns = ["order_no", "sale_date", *MONEY_COLUMNS, "margin", "waybills"]
        got, want = ({tuple(r) for r in df.select(*columns).collect()} for df in (self.stored(), self.rebuilt()))
        assert got == want
        return {r[0]: r for r in got}


@pytest.fixture
def loads(spark):
    return Loads(spark)


def test_every_refresh_equals_a_rebuild(loads):
    loads.statement(0, sales=[("101", DAY(2026, 1, 5), 1000), ("102", DAY(2026, 2, 1), 2000)], fees=[("101", DAY(2026, 1, 6), "TDS", 10), (None, DAY(2026, 1, 9), "ETSY_ADS", 70)], pools=[("101", "ETSY_ADS", 35), ("102", "ETSY_ADS", 35)])
    assert loads.refresh() == [] and len(loads.check()) == 2
    assert loads.refresh() == []  # nothing new

    # inventory and links of orders not sold yet, and of one that is
    loads.sheet(0, [("102", "Cotton", 15000), ("103", "Cotton", 3333), ("103", "Wool", 10)])
    loads.mapping(0, links=[("102", "w1"), ("103", "w1"), ("104", "w2")], shares=[("102", "w1", 50), ("103", "w1", 51)])
    assert loads.refresh() == [202602]
    assert set(loads.check()) == {"101", "102"}

    # 103 is sold; 101 gets an earlier line, so it moves to another month; a refund
    loads.statement(1, sales=[("103", DAY(2026, 2, 3), 700)], fees=[("101", DAY(2025, 12, 30), "REFUND", 400)])
    assert loads.refresh() == [0, 202601]
    found = loads.check()
    assert found["101"][1] == DAY(2025, 12, 30) and found["103"][-1] == "w1"
    assert loads.stored("2026-01-01", "2026-01-31").count() == 0

    # w1 is allocated anew, a quantity is replaced, and a line without a date
    loads.mapping(1, links=[("101", "w1"), ("103", "w3")], shares=[("102", "w1", 30), ("103", "w1", 30), ("101", "w1", 41)])
    loads.sheet(1, [("103", "Cotton", 20000)])
    loads.statement(2, fees=[("105", None, "TCS", 5), ("106", DAY(2026, 3, 1), "BUYER_FEE", 6)])
    loads.refresh()
    found = loads.check()
    assert found["103"][-1] == "w1, w3" and len(found) == 5


def test_catching_up_in_steps(loads):
    for batch in range(3):
        loads.statement(batch, sales=[(f"{batch}{i}", DAY(2026, 1 + batch, 1 + i), 100 * i) for i in range(5)])
        loads.sheet(batch, [("11", "Cotton", batch * 10)])
    loads.refresh({"statements": 0, "billing": -1, "inventory": 1})
    assert loads.stored().count() == 5
    loads.refresh()
    loads.check()


def test_untouched_months_are_not_read(loads, spark):
    """The files of other months hold nothing readable any more, and a refresh does not mind."""
    for month in range(1, 5):
        loads.statement(month, sales=[(f"{month}{i:03d}", DAY(2026, month, 1 + i), 100) for i in range(20)])
    assert loads.refresh() == []
    _, state = Versions(spark, loads.path).newest()
    for month in ("202601", "202603"):
        for folder in state["months"][month]:
            spark.createDataFrame([("no",)], "x string").write.mode("overwrite").text(f"{loads.path}/{folder['folder']}")
    loads.statement(9, sales=[("2005", DAY(2026, 2, 20), 5)], fees=[("2001", DAY(2026, 6, 1), "TDS", 1)])
    assert loads.refresh() == [202602]
    loads.statement(10, fees=[("4001", DAY(2026, 6, 1), "TDS", 1), ("5000", DAY(2026, 6, 1), "TDS", 1)])
    assert loads.refresh() == [202604]
    after = Versions(spark, loads.path).newest()[1]["months"]
    assert after["202601"] == state["months"]["202601"] and after["202602"] != state["months"]["202602"]
    assert {r.order_no: r.sales for r in loads.stored("2026-02-01", "2026-02-28").collect()}["2005"] == 105


def test_new_orders_are_put_beside_a_month(loads, spark):
    for batch in range(refresh.MAX_FOLDERS + 1):
        loads.statement(batch, sales=[(f"9{batch:02d}", DAY(2026, 1, 1 + batch), 100)])
        assert loads.refresh() == ([202601] if batch == refresh.MAX_FOLDERS else [])
        folders = Versions(spark, loads.path).newest()[1]["months"]["202601"]
        assert len(folders) == (1 if batch == refresh.MAX_FOLDERS else batch + 1)
    loads.check()


def test_of_two_refreshes_at_once_one_counts(loads, spark, monkeypatch):
    loads.statement(0, sales=[("1", DAY(2026, 1, 1), 100)])
    written = refresh._written

    def slow(*args):
        out = written(*args)
        monkeypatch.setattr(refresh, "_written", written)
        loads.refresh()  # the other one ends first
        return out

    monkeypatch.setattr(refresh, "_written", slow)
    with pytest.raises(VersionTaken):
        loads.refresh()
    assert loads.check()["1"][2] == 100


def test_a_refresh_that_fails_is_done_by_the_next(loads, monkeypatch):
    loads.statement(0, sales=[("1", DAY(2026, 1, 1), 100)])
    with monkeypatch.context() as m:
        m.setattr(Versions, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            loads.refresh()
    assert loads.stored().count() == 0
    loads.refresh()
    assert loads.check()["1"][2] == 100


def test_sums_stay_in_generated_hash_aggregates(loads):
    loads.statement(0, sales=[("1", DAY(2026, 1, 1), 100)])
    full = refresh.summed(refresh.new_facts(loads.spark, loads.stores, dict.fromkeys(loads.stores.logs(), -1), refresh.positions(loads.spark, loads.stores)))
    assert "SortAggregate" not in full._jdf.queryExecution().executedPlan().toString()


def test_stored_sums_and_changes_are_joined(spark):
    """Both have one row per order: nothing is grouped again; a fact that one side lacks comes from the other."""
    names = [f.split()[0] for f in refresh.SUMS.replace("array<string>", "texts").split(", ")]
    low, high = DAY(2026, 1, 1), DAY(2026, 2, 1)

    def sums(rows):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], refresh.SUMS)

    old = sums([{"order_no": "1", "sale_date": high, "listed": 1, "sales": 5, "waybills": ["b", "c"]}, {"order_no": "2", "refunds": 1}])
    new = sums([{"order_no": "1", "sale_date": low, "sales": -2, "refunds": 4, "waybills": ["a", "b"]}, {"order_no": "3", "sale_date": high, "listed": 1, "waybills": ["x"]}])
    both = refresh.merged(old, new)
    found = {r.order_no: (r.sale_date, r.listed, r.sales, r.refunds, r.pool_expense, r.waybills) for r in both.collect()}
    assert found == {"1": (low, 1, 3, 4, None, ["a", "b", "c"]), "2": (None, None, None, 1, None, None), "3": (high, 1, None, None, None, ["x"])}
    assert both.columns == names
    assert "Aggregate" not in both._jdf.queryExecution().optimizedPlan().toString()
