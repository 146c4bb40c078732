"""Registered queries against DuckDB on the smallest data; check.py runs the same on larger folders."""

from pathlib import Path

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from marginloom.workload import queries as queries_module
from marginloom.workload.oracles import oracles
from marginloom.workload.queries import registered

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def test_every_query_has_sql():
    assert set(registered()) == set(oracles()) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, con, name):
    assert check.compare(spark, con, FOLDER, name).startswith("equal")


@pytest.mark.parametrize("name", ["order_financials", "kpi_compare", "orders_page", "search_orders", "allocate_shipping", "allocate_pool"])
def test_no_cross_join(spark, name):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "profit" in df.columns


@pytest.mark.parametrize("name", ["kpi_summary", "kpi_compare", "expense_breakdown", "orders_page"])
def test_dated_reports_read_only_their_months(spark, name):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "sale_month" in plan.split("PartitionFilters: ")[1].split("]")[0]
    months = {int(f.split("sale_month=")[1].split("/")[0]) for f in df.inputFiles() if "sale_month=" in f}
    assert len(months) > 12  # the stored table holds many more than the window


def test_staged_rows_hold_their_hash_once_as_bytes(spark):
    w = queries_module.Workload(spark, FOLDER)
    stored = dict(spark.read.parquet(queries_module._staged_rows(w)).dtypes)
    assert stored["fingerprint"] == "binary" and "transaction_hash" not in stored
    told = queries_module._staged(w).selectExpr("bool_and(transaction_hash = fingerprint and length(fingerprint) = 64)")
    assert told.first()[0]
