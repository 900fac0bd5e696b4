"""Known results on the small seed tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from comandix import model
from comandix.operators import aggregates, apply_cash, audits, joins, lists
from tests.conftest import rows


def d(text):
    return Decimal(text)


def test_stock_levels(seed):
    found = rows(aggregates.stock_status(seed.stock_ledger, seed.supply))
    assert found == sorted(
        [
            (1, "Carne de puerco", d("10.00"), d("40.00"), "VERDE"),
            (2, "Gaseosa Incakola 1L", d("5.00"), d("5.00"), "ROJO"),
            (5, "Gaseosa coca cola 1L", d("5.00"), d("10.00"), "VERDE"),
            (17, "sal", d("1.00"), d("10.00"), "VERDE"),
            (25, "Pavita", d("5.00"), d("30.00"), "VERDE"),
        ],
        key=lambda r: str(r[0]),
    )
    assert aggregates.stock_on_hand(seed.stock_ledger, seed.supply).count() == 5


def test_stock_of_one_supply_is_always_one_row(seed):
    known = rows(aggregates.stock_of_supply(seed.stock_ledger, seed.supply, 1))
    assert known == [(1, "Carne de puerco", d("40.00"))]
    assert rows(aggregates.stock_of_supply(seed.stock_ledger, seed.supply, 999)) == [(None, None, None)]


def test_sales_by_day_loses_the_last_day_after_midnight(seed):
    sessions = seed.cash_session
    assert rows(aggregates.sales_by_day(sessions, "2019-11-09", "2019-11-10")) == [("2019-11-09", d("800.00"))]
    assert rows(aggregates.sales_by_day(sessions, "2019-11-09", "2019-11-10", inclusive_end=True)) == [
        ("2019-11-09", d("800.00")),
        ("2019-11-10", d("2090.00")),
    ]
    longer = rows(aggregates.sales_by_day(sessions, "2019-11-09", "2019-11-14"))
    assert longer == [("2019-11-09", d("800.00")), ("2019-11-10", d("2090.00")), ("2019-11-13", None)]
    closings = rows(aggregates.register_closings(sessions, "2019-11-09", "2019-11-14"))
    assert [(str(day), amount) for day, amount in closings] == longer


def test_sales_by_dish_and_hour(seed):
    assert rows(aggregates.sales_by_dish(seed.sale, seed.dish, "2019-11-13", "2019-11-14")) == [
        ("Ajiaco", d("7.00")),
        ("Crema de rocoto", d("3.70")),
        ("Plato prueba 2", d("22.50")),
        ("Pollo al horno con pallares", d("7.50")),
        ("ceviche", d("15.00")),
    ]
    assert rows(aggregates.orders_by_hour(seed.sale, "2019-11-13", "created_at")) == [(20, 5)]
    assert rows(aggregates.sales_by_waiter(seed.sale)) == [(18, 5, d("55.70"))]


def test_bills_and_queues(seed):
    assert rows(aggregates.table_bill(seed.order_line, seed.dish)) == [
        (1, 12, d("126.40")),
        (2, 4, d("47.00")),
        (3, 6, d("61.20")),
        (7, 1, d("4.50")),
        (None, 2, d("20.00")),
    ]
    assert rows(lists.orders_for_table(seed.order_line, seed.dish, None)) == [
        (10, 1, "Lomo saltado", None, "PREPARADO"),
        (15, 1, "Lomo saltado", None, "PREPARADO"),
    ]
    consumed = joins.table_consumption(seed.order_line, seed.dish, seed.staff, 3)
    assert rows(consumed, "order_id", "state", "dish_name", "price") == [
        (19, "PREPARADO", "ceviche", d("15.00")),
        (23, "PREPARADO", "ceviche", d("15.00")),
        (24, "EN PREPARACION", "Lomo saltado", d("10.00")),
        (25, "PREPARADO", "Crema de rocoto", d("3.70")),
        (31, "PENDIENTE", "Aji de pollo", d("7.50")),
        (32, "PENDIENTE", "Lomo saltado", d("10.00")),
    ]
    assert rows(aggregates.order_state_counts(seed.order_line, seed.dish)) == [
        ("EN PREPARACION", True, 2),
        ("ENTREGADO", True, 1),
        ("PENDIENTE", False, 4),
        ("PENDIENTE", True, 7),
        ("PREPARADO", False, 5),
        ("PREPARADO", True, 6),
    ]
    assert rows(lists.kitchen_board(seed.order_line, seed.dish)) == [
        ("EN PREPARACION", 2),
        ("PENDIENTE CON PREPARACION", 7),
        ("PENDIENTE SIN PREPARACION", 4),
        ("PREPARADO", 11),
    ]
    assert lists.kitchen_pending_prep(seed.order_line, seed.dish).count() == 7
    assert lists.kitchen_pending_noprep(seed.order_line, seed.dish).count() == 4
    assert lists.kitchen_in_preparation(seed.order_line, seed.dish).count() == 2
    assert lists.kitchen_ready(seed.order_line, seed.dish).count() == 11
    assert rows(lists.order_by_id(seed.order_line, seed.dish, 43)) == [(43, 6, "Papa a la huancaina", 7, "PENDIENTE")]


def test_movements(seed):
    receipts = lists.stock_receipts(seed.stock_ledger, seed.supply)
    assert receipts.count() == 10
    assert rows(receipts.agg(F.sum("qty"))) == [(d("95.00"),)]
    assert lists.stock_issues(seed.stock_ledger, seed.supply).count() == 0
    assert lists.stock_adjustments(seed.stock_ledger, seed.supply).count() == 0
    one = lists.stock_receipt_by_id(seed.stock_ledger, seed.supply, 6, key="ledger_id")
    assert rows(one, "ledger_id", "supply_name", "qty") == [(6, "Gaseosa coca cola 1L", d("10.00"))]


def test_recipes_and_vendors(seed):
    assert rows(joins.recipe_lines(seed.recipe, seed.dish, seed.supply, 1), "supply_id", "supply_name", "qty") == [
        (1, "Carne de puerco", d("2.00")),
        (2, "Gaseosa Incakola 1L", d("5.00")),
        (5, "Gaseosa coca cola 1L", d("10.00")),
    ]
    offered = joins.supplier_supplies(seed.vendor, seed.vendor_supply, seed.supply)
    assert rows(offered, "vendor_id", "supply_name") == [
        (10, "Papa amarilla"),
        (10, "sal"),
        (11, "Gas"),
        (12, "Carne de res"),
        (12, "Gallina"),
        (12, "Pavita"),
    ]
    pending = seed.order_line.where(F.col("state") == model.PENDING)
    assert rows(joins.bom_explosion(pending, seed.recipe)) == [(1, d("2.00")), (2, d("5.00")), (5, d("10.00"))]


def test_cash(seed):
    assert rows(lists.register_state(seed.register)) == [(d("400.00"), True)]
    assert joins.current_session_ops(seed.cash_op, seed.register, ["op_id"]).count() == 0
    closed = seed.register.withColumn("session_id", F.lit(None).cast("bigint"))
    assert joins.current_session_ops(seed.cash_op, closed, ["op_id"]).count() == 0
    checked = joins.cash_reconciliation(seed.cash_session, seed.cash_op)
    unequal = checked.where("NOT expected <=> computed")
    assert rows(unequal, "session_id", "expected", "computed") == [
        (11, d("355.70"), d("318.70")),
        (12, d("400.00"), None),
    ]
    gaps = {2: "-100", 3: "-200", 4: "-190", 5: "100", 6: "100", 7: "40", 8: "-200", 9: "0", 10: "-100", 11: "-18.70"}
    assert dict(rows(checked, "session_id", "entered_gap")) == {**{k: d(v) for k, v in gaps.items()}, 12: None}
    running = apply_cash.cash_running_balance(seed.cash_op, seed.cash_session, ["created_at", "op_id"])
    assert rows(running.where("session_id = 11"), "op_id", "balance") == [
        (4, d("200.00")),
        (5, d("300.00")),
        (6, d("337.00")),
        (7, d("355.70")),
    ]


def test_drift(seed):
    drift = joins.ledger_vs_snapshot(seed.stock_ledger, seed.stock_snapshot)
    found = {r[0]: (r[1], r[2]) for r in drift.collect()}
    assert found[1] == (d("40.00"), d("40.00"))
    assert found[2] == (d("5.00"), d("15.00"))
    assert found[5] == (d("10.00"), d("0.00"))
    assert {k for k, v in found.items() if v[1] is None} == {17, 25}
    assert {k for k, v in found.items() if v[0] is None} == {10, 11, 12, 13, 14, 15, 16, 37}
    missing = audits.supplies_without_stock(seed.supply, seed.stock_snapshot)
    assert {r[0] for r in missing.collect()} == {17, 18, 25, 27, 33}
    assert audits.orphans(seed.stock_ledger, "supply_id", seed.supply, "supply_id").count() == 0


def test_users(seed):
    assert joins.list_users(seed.staff, seed.role).count() == 5
    assert rows(aggregates.admin_guard(seed.staff)) == [(1, False)]
    assert rows(lists.find_by_key(seed.dish, "dish_id", 4), "dish_name") == [("ceviche",)]
    assert lists.find_by_key(seed.dish, "dish_id", 5).count() == 0
    assert lists.selectable_dishes(seed.dish).count() == 9
    assert lists.selectable_tables(seed.dining_table).count() == 6
    assert lists.editable_orders(seed.order_line).count() == 11


def test_first_row_and_names_in_any_case(spark, seed):
    assert rows(lists.first_row(seed.cash_session, "opening", "session_id"), "session_id") == [(7,)]
    names = spark.createDataFrame([("Ana",), ("ana",), ("Luz",)], "username string")
    assert audits.duplicate_keys(names, ["username"]).count() == 0
    assert audits.duplicate_keys(names, ["username"], ignore_case=True).count() == 1
