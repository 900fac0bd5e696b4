"""Batches published as one give what the operators give, and read their requests once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from comandix.operators import apply_cash, apply_dims, apply_orders, apply_stock, publish
from comandix.plans.catalog import Tables
from comandix.session import work_dir
from comandix.sources import requests as R
from comandix.sources.sinks import VersionedTables
from tests.conftest import rows

NAMES = "supply staff dish dining_table recipe stock_snapshot open_order order_line register".split()


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


@pytest.fixture
def store(spark, t):
    made = VersionedTables(spark, work_dir(spark, "test"))
    tables = {name: getattr(t, name) for name in NAMES}
    tables["stock_ledger"] = t.stock_ledger.select("supply_id", F.col("qty").cast("decimal(18,2)").alias("qty"), "is_adjustment")
    made.publish(tables)
    return made


def counted(spark, df):
    """The rows, each counted when a task reads it."""
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    first = df.columns[0]
    passed = F.udf(count, df.schema[first].dataType).asNondeterministic()(F.col(first))
    return df.withColumn(first, passed), seen


def same(found, expected):
    assert rows(found, *expected.columns) == rows(expected)


def test_receipts(spark, t, store):
    asked, seen = counted(spark, t.receipt_requests)
    assert publish.publish_receipts(store, asked) == 2 and seen.value == t.receipt_requests.count()
    plain = apply_stock.apply_receipts(t.receipt_requests, t.supply, t.staff, t.stock_snapshot)
    same(store.read("receipt_result"), plain.results)
    same(store.read("stock_snapshot"), plain.snapshot)
    assert store.read("stock_ledger").count() == t.stock_ledger.count() + plain.ledger_rows.count()
    assert store.read("stock_ledger", 1).count() == t.stock_ledger.count()  # the version before is as it was
    assert publish.publish_receipts(store, asked, version=2) == 2 and seen.value == t.receipt_requests.count()


def test_issues_and_counts(spark, t, store):
    publish.publish_issues(store, t.movement_requests, R.MOVEMENT_ORDER)
    plain = apply_stock.apply_issues(t.movement_requests, t.supply, t.staff, t.stock_snapshot, R.MOVEMENT_ORDER)
    same(store.read("issue_result"), plain.results)
    same(store.read("stock_snapshot"), plain.snapshot)
    ledger = store.read("stock_ledger")
    asked, seen = counted(spark, R.counts(t.supply))
    publish.publish_counts(store, asked)
    assert seen.value == R.counts(t.supply).count()
    done = apply_stock.adjust_to_counts(R.counts(t.supply), ledger, t.supply)
    same(store.read("count_result"), done.results)
    totals = store.read("stock_ledger").groupBy("supply_id").agg(F.sum("qty").alias("qty"))
    assert totals.join(t.supply, "supply_id").where("qty <> min_qty").count() == 0


def test_orders_edits_and_cancels(spark, t, store):
    asked, seen = counted(spark, t.order_requests)
    publish.publish_orders(store, asked)
    assert seen.value == t.order_requests.count()
    last = t.open_order.agg(F.max("order_id")).first()[0]
    plain = apply_orders.apply_orders(t.order_requests, t.dish, t.dining_table, t.staff, t.recipe, t.stock_snapshot, last)
    same(store.read("stock_snapshot"), plain.snapshot)
    kept = ["order_id", "dish_id", "table_no", "waiter_id", "state"]
    assert rows(store.read("open_order"), *kept) == sorted(rows(t.open_order, *kept) + rows(plain.orders, *kept), key=lambda r: tuple((v is None, str(v)) for v in r))
    orders, stock = store.read("open_order"), store.read("stock_snapshot")
    asked, seen = counted(spark, t.order_edits)
    publish.publish_order_edits(store, asked)
    assert seen.value == t.order_edits.count()
    plain = apply_orders.apply_order_edits(t.order_edits, orders, t.dish, t.dining_table, t.staff, t.recipe, stock)
    same(store.read("stock_snapshot"), plain.snapshot)
    same(store.read("open_order").select(*kept), plain.orders.select(*kept))
    orders, stock = store.read("open_order"), store.read("stock_snapshot")
    publish.publish_order_cancels(store, t.order_cancels)
    plain = apply_orders.apply_order_cancels(t.order_cancels, orders, t.recipe, stock)
    same(store.read("open_order"), plain.orders)
    same(store.read("stock_snapshot"), plain.snapshot)


def test_payments_and_cash(spark, t, store):
    asked, seen = counted(spark, t.payment_requests)
    publish.publish_table_payments(store, asked)
    assert seen.value <= 2 * t.payment_requests.count()  # the first payer of a table is found before all are coded
    plain = apply_orders.apply_table_payments(t.payment_requests, t.order_line, t.dish, t.staff, t.register)
    for name, df in {"table_cash_op": plain.cash_ops, "sale": plain.sales, "order_line": plain.open_orders, "register": plain.register}.items():
        same(store.read(name), df)
    asked, seen = counted(spark, t.cash_requests)
    register = store.read("register")
    publish.publish_cash_ops(store, asked)
    assert seen.value == t.cash_requests.count()
    plain = apply_cash.apply_cash_ops(t.cash_requests, t.staff, register)
    same(store.read("cash_op"), plain.cash_ops)
    same(store.read("register"), plain.register)


def test_dimensions(spark, t, store):
    publish.publish_dimension(store, "dish", t.dish_changes, "dish_id")
    same(store.read("dish"), apply_dims.upsert_dimension(t.dish, t.dish_changes, "dish_id"))
    dishes = store.read("dish")
    publish.publish_toggles(store, "dish", t.dish_toggles, "dish_id", "active")
    same(store.read("dish"), apply_dims.toggle_flag(dishes, t.dish_toggles, "dish_id", "active"))
    dishes = store.read("dish")
    publish.publish_deletes(store, "dish", t.dish_deletes, "dish_id", ["recipe", "open_order"])
    same(store.read("dish"), apply_dims.delete_rows(t.dish_deletes, dishes, "dish_id", [t.recipe, t.open_order]).table)
    dishes = store.read("dish")
    publish.publish_recipe_lines(store, t.recipe_additions)
    same(store.read("recipe"), apply_dims.add_recipe_lines(t.recipe_additions, t.recipe, dishes, t.supply).table)
    publish.publish_state_changes(store, t.order_event)
    plain = apply_orders.apply_state_changes(t.order_event, t.open_order)
    same(store.read("open_order"), plain.select("order_id", "state"))
