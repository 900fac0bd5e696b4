"""Bulk requests: edge cases, and rules that must hold for any batch."""

from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from comandix import model
from comandix.operators import apply_cash, apply_dims, apply_orders, apply_stock, joins
from tests.conftest import rows

d = Decimal
ISSUES = "req_id bigint, supply_id bigint, keeper_id bigint, qty decimal(8,2)"
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def codes(df):
    return {r["req_id"]: r["result_code"] for r in df.collect()}


def test_order_codes(spark, seed):
    asked = spark.createDataFrame(
        [
            (1, 2, 1, 18, 0),  # fine
            (2, 1, 1, 18, 0),  # inactive dish
            (3, 99, 4, 99, 0),  # unknown dish comes before the other two
            (4, None, 1, 18, 0),  # no dish
            (5, 2, 4, 18, 0),  # inactive table
            (6, 2, 77, 99, 0),  # unknown table comes before the waiter
            (7, 2, None, None, 0),  # take-away without a waiter
            (8, 2, 1, 99, 0),  # unknown waiter
        ],
        "req_id bigint, dish_id bigint, table_no bigint, waiter_id bigint, ts bigint",
    )
    applied = apply_orders.apply_orders(
        asked, seed.dish, seed.dining_table, seed.staff, seed.recipe, seed.stock_snapshot, 43
    )
    assert codes(applied.results) == {1: 1, 2: 2, 3: 2, 4: 2, 5: 3, 6: 3, 7: 1, 8: 4}
    assert rows(applied.orders, "order_id", "dish_id", "table_no", "state") == [
        (44, 2, 1, "PENDIENTE"),
        (45, 2, None, "PENDIENTE"),
    ]
    assert applied.results.where("message IS NULL").count() == 0


def test_orders_take_ingredients_even_below_zero(spark, seed):
    dishes = seed.dish.withColumn("active", F.lit(True))
    asked = spark.createDataFrame([(i, 1, None, None, 0) for i in range(4)],
                                  "req_id bigint, dish_id bigint, table_no bigint, waiter_id bigint, ts bigint")
    applied = apply_orders.apply_orders(asked, dishes, seed.dining_table, seed.staff, seed.recipe, seed.stock_snapshot)
    stock = dict(rows(applied.snapshot))
    assert (stock[1], stock[2], stock[5], stock[10]) == (d("32.00"), d("-5.00"), d("-40.00"), d("20.00"))


def test_receipt_codes(spark, seed):
    asked = spark.createDataFrame(
        [
            (1, 1, 18, d("2.50")),
            (2, 99, 18, d("1")),
            (3, None, 18, d("1")),
            (4, 1, None, d("1")),
            (5, 1, 99, d("1")),
            (6, 1, 18, d("0")),
            (7, 1, 18, None),
            (8, 1, 18, d("-1")),
            (9, 99, 99, d("-1")),
            (10, 17, 18, d("3")),  # no stock row: the ledger grows, the stock does not
        ],
        ISSUES,
    )
    applied = apply_stock.apply_receipts(asked, seed.supply, seed.staff, seed.stock_snapshot)
    assert codes(applied.results) == {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 4, 7: 4, 8: 4, 9: 2, 10: 1}
    stock = dict(rows(applied.snapshot))
    assert stock[1] == d("42.50") and 17 not in stock
    assert applied.ledger_rows.count() == 2


def test_issue_refused_leaves_the_stock_for_the_next(spark, seed):
    asked = spark.createDataFrame(
        [
            (1, 2, 18, d("-20")),  # more than 15
            (2, 2, 18, d("-10")),  # fits, as the one before was refused
            (3, 2, 18, d("-6")),  # only 5 left
            (4, 2, 18, d("-5")),
            (5, 2, 18, d("-0.01")),
            (6, 17, 18, d("-1")),  # no stock row
            (7, 1, 99, d("-100")),  # keeper comes before stock
            (8, 1, 18, None),
        ],
        ISSUES,
    )
    applied = apply_stock.apply_issues(asked, seed.supply, seed.staff, seed.stock_snapshot, ["req_id"])
    assert codes(applied.results) == {1: 5, 2: 1, 3: 5, 4: 1, 5: 5, 6: 5, 7: 3, 8: 4}
    assert dict(rows(applied.snapshot))[2] == d("0.00")


def test_adjustment_brings_the_ledger_to_the_count(spark, seed):
    counted = spark.createDataFrame([(1, d("39.50")), (12, d("4"))], "supply_id bigint, counted decimal(8,2)")
    found = apply_stock.apply_adjustments(counted, seed.stock_ledger)
    assert rows(found) == [(1, d("-0.50"), True), (12, d("4.00"), True)]


def test_ledger_corrections(spark, seed):
    edits = spark.createDataFrame([(1, d("9.00"))], "ledger_id bigint, new_qty decimal(8,2)")
    deletes = spark.createDataFrame([(6, True), (8, False), (77, True)], "ledger_id bigint, reverse_stock boolean")
    done = apply_stock.apply_ledger_corrections(seed.stock_ledger, seed.stock_snapshot, edits, deletes, ["ledger_id"])
    ledger = dict(rows(done.ledger, "ledger_id", "qty"))
    assert ledger[1] == d("9.00") and not {6, 8} & set(ledger) and len(ledger) == 8
    stock = dict(rows(done.snapshot))
    assert stock[5] == d("-10.00") and stock[1] == d("40.00")


def test_cash_operations(spark, seed):
    asked = spark.createDataFrame(
        [(1, d("10.50"), 18, 0), (2, d("0"), 18, 0), (3, d("0"), None, 0), (4, d("5"), None, 0), (5, d("5"), 99, 0), (6, d("-30.25"), 20, 0)],
        "req_id bigint, amount decimal(8,2), cashier_id bigint, ts bigint",
    )
    applied = apply_cash.apply_cash_ops(asked, seed.staff, seed.register)
    assert codes(applied.results) == {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 1}
    assert rows(applied.register) == [(1, d("380.25"), 12)]
    closed = seed.register.withColumn("session_id", F.lit(None).cast("bigint"))
    assert codes(apply_cash.apply_cash_ops(asked, seed.staff, closed).results) == {1: 4, 2: 2, 3: 2, 4: 3, 5: 3, 6: 4}


def test_table_payments(spark, seed):
    asked = spark.createDataFrame(
        [(1, 1, 99), (2, 1, 20), (3, 1, 20), (4, None, 20), (5, 5, 20), (6, 5, 99), (7, 3, 18), (8, 3, 99)],
        "req_id bigint, table_no bigint, cashier_id bigint",
    )
    applied = apply_orders.apply_table_payments(asked, seed.order_line, seed.dish, seed.staff, seed.register)
    assert codes(applied.results) == {1: 3, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 7: 1, 8: 2}
    assert rows(applied.cash_ops, "session_id", "amount", "note", "cashier_id") == [
        (12, d("126.40"), "Pago por consumo de la mesa 1", 20),
        (12, d("61.20"), "Pago por consumo de la mesa 3", 18),
    ]
    assert rows(applied.sales.agg(F.count("*"), F.sum("amount"))) == [(18, d("187.60"))]
    assert applied.open_orders.count() == 25 - 18
    closed = seed.register.withColumn("session_id", F.lit(None).cast("bigint"))
    shut = apply_orders.apply_table_payments(asked, seed.order_line, seed.dish, seed.staff, closed)
    assert codes(shut.results) == {1: 3, 2: 4, 3: 4, 4: 2, 5: 2, 6: 2, 7: 4, 8: 3}
    assert shut.open_orders.count() == 25


def test_edits_and_cancels_move_stock_only_with_the_order(spark, seed):
    edits = spark.createDataFrame(
        [(1, 24, 2, 3, 18, "e"), (2, 32, 2, None, None, "e"), (3, 32 + 900, 2, 1, 18, "e"), (4, 31, 1, 3, 18, "e")],
        "req_id bigint, order_id bigint, dish_id bigint, table_no bigint, waiter_id bigint, ts string",
    ).withColumn("ts", F.lit("2020-01-01").cast("timestamp"))
    done = apply_orders.apply_order_edits(
        edits, seed.order_line, seed.dish, seed.dining_table, seed.staff, seed.recipe, seed.stock_snapshot
    )
    assert rows(done.results, "req_id", "result_code", "rows_affected") == [(1, 1, 0), (2, 1, 1), (3, 1, 0), (4, 2, 0)]
    after = {r["order_id"]: r for r in done.orders.collect()}
    assert (after[32]["dish_id"], after[32]["table_no"], after[32]["waiter_id"]) == (2, None, None)
    assert after[24]["dish_id"] == 1 and after[31]["dish_id"] == 3
    stock = dict(rows(done.snapshot))
    assert (stock[1], stock[2], stock[5]) == (d("42.00"), d("20.00"), d("10.00"))

    cancels = spark.createDataFrame([(1, 32), (2, 32), (3, 10), (4, 999)], "req_id bigint, order_id bigint")
    gone = apply_orders.apply_order_cancels(cancels, seed.order_line, seed.recipe, seed.stock_snapshot)
    assert rows(gone.results, "req_id", "rows_affected") == [(1, 1), (2, 0), (3, 0), (4, 0)]
    assert gone.orders.count() == 24
    assert dict(rows(gone.snapshot))[1] == d("42.00")


def test_state_changes(spark, seed):
    events = spark.createDataFrame(
        [(1, 2, "EN PREPARACION", 5), (2, 2, "PREPARADO", 5), (3, 2, "ENTREGADO", 4), (4, 999, "PREPARADO", 1)],
        "event_id bigint, order_id bigint, state string, s bigint",
    ).withColumn("ts", F.timestamp_seconds("s"))
    after = dict(rows(apply_orders.apply_state_changes(events, seed.order_line), "order_id", "state"))
    assert after[2] == "PREPARADO" and after[30] == "PENDIENTE" and len(after) == 25


def test_upsert_and_toggle(spark, seed):
    changes = spark.createDataFrame(
        [(1, "Lomo", None, True), (50, "Nuevo", d("3.00"), None)], "dish_id bigint, dish_name string, price decimal(6,2), active boolean"
    )
    after = {r["dish_id"]: r for r in apply_dims.upsert_dimension(seed.dish, changes, "dish_id", defaults={"active": True}).collect()}
    assert (after[1]["dish_name"], after[1]["price"], after[1]["active"]) == ("Lomo", d("10.00"), True)
    assert (after[50]["dish_name"], after[50]["active"]) == ("Nuevo", True) and len(after) == 11

    dated = seed.cash_session
    touched = dated.where("session_id = 2").select("session_id", F.lit(d("7.00")).alias("entered"))
    moment = F.lit("2020-01-01 00:00:00").cast("timestamp")
    moved = apply_dims.upsert_dimension(dated, touched, "session_id", as_of=moment)
    assert moved.where(F.col("updated_at") == moment).count() == 1

    asked = spark.createDataFrame([(1, 18, False), (2, 19, False), (3, 99, False), (4, 18, True)], "req_id bigint, staff_id bigint, target boolean")
    toggled = apply_dims.toggle_staff(asked.where("req_id < 4"), seed.staff)
    assert rows(toggled.results, "req_id", "ok", "message") == [
        (1, False, model.USER_IS_ADMIN),
        (2, True, model.USER_DISABLED),
        (3, False, model.USER_UNKNOWN),
    ]
    assert rows(toggled.table.where("NOT enabled"), "staff_id") == [(19,)]


def test_new_staff(spark, seed):
    asked = spark.createDataFrame([(1, 30, "ana", 2), (2, 31, "luz", 9), (3, 19, "coc", 9)], "req_id bigint, staff_id bigint, username string, role_id bigint")
    applied = apply_dims.apply_staff_changes(asked, seed.staff, seed.role)
    assert rows(applied.results, "req_id", "ok", "change") == [(1, True, "insert"), (2, False, "insert"), (3, True, "update")]
    after = {r["staff_id"]: r for r in applied.table.collect()}
    assert after[30]["enabled"] is False and 31 not in after and after[19]["username"] == "coc" and after[19]["enabled"]


def test_the_last_admin_stays(spark, seed):
    asked = spark.createDataFrame([(1, 18), (2, 19), (3, 18), (4, 77)], "req_id bigint, staff_id bigint")
    applied = apply_dims.delete_staff(asked, seed.staff)
    assert rows(applied.results, "req_id", "ok", "rows_affected") == [(1, False, 0), (2, True, 1), (3, False, 0), (4, True, 0)]
    more = seed.staff.unionByName(spark.createDataFrame([(90, 1, "b", True)], seed.staff.schema))
    both = spark.createDataFrame([(1, 18), (2, 90)], "req_id bigint, staff_id bigint")
    assert rows(apply_dims.delete_staff(both, more).results, "req_id", "ok") == [(1, True), (2, False)]
    assert rows(apply_dims.delete_staff(both.where("req_id = 2"), more).results, "req_id", "ok") == [(2, True)]


def test_deletes(spark, seed):
    asked = spark.createDataFrame([(1, 1), (2, 12), (3, 12), (4, 99)], "req_id bigint, dish_id bigint")
    applied = apply_dims.delete_rows(asked, seed.dish, "dish_id", [seed.recipe, seed.order_line])
    assert rows(applied.results, "req_id", "result_code", "rows_affected") == [(1, 2, 0), (2, 1, 1), (3, 1, 0), (4, 3, 0)]
    assert applied.table.count() == 9
    gone = spark.createDataFrame([(1, 16), (2, 10)], "req_id bigint, supply_id bigint")
    supplies, stock = apply_dims.delete_supplies(gone, seed.supply, seed.stock_snapshot, [seed.recipe, seed.vendor_supply])
    assert supplies.table.count() == 15 and stock.count() == 10


def test_recipe_and_vendor_links(spark, seed):
    asked = spark.createDataFrame(
        [(1, 2, 10, d("1.5")), (2, 2, 10, d("9")), (3, 1, 1, d("9")), (4, 99, 1, d("9")), (5, 1, 999, d("9"))],
        "req_id bigint, dish_id bigint, supply_id bigint, qty decimal(8,2)",
    )
    applied = apply_dims.add_recipe_lines(asked, seed.recipe, seed.dish, seed.supply)
    assert codes(applied.results) == {1: 1, 2: 3, 3: 3, 4: 2, 5: 2}
    assert (2, 10, d("1.50")) in rows(applied.table)
    assert apply_dims.remove_recipe_lines(asked.where("req_id = 3"), seed.recipe).count() == 2

    offers = seed.vendor_supply.unionByName(spark.createDataFrame([(11, 10, d("1"))], seed.vendor_supply.schema))
    one = spark.createDataFrame([(10, 10)], "vendor_id bigint, supply_id bigint")
    everywhere = spark.createDataFrame([(None, 10)], "vendor_id bigint, supply_id bigint")
    assert apply_dims.unlink_supplies(one, offers).count() == 6
    assert apply_dims.unlink_supplies(everywhere, offers).count() == 5

    new = spark.createDataFrame([(1, 10, "Ajo", d("1")), (2, 11, "Oca", d("2"))], "req_id bigint, vendor_id bigint, supply_name string, min_qty decimal(8,2)")
    linked = apply_dims.link_new_supplies(new, seed.supply)
    assert rows(linked.supplies, "supply_id", "supply_name") == [(38, "Ajo"), (39, "Oca")]
    assert rows(linked.offers, "vendor_id", "supply_id") == [(10, 38), (11, 39)]
    assert rows(linked.stock_rows) == [(38, d("0.00")), (39, d("0.00"))]


movements = st.lists(
    st.tuples(
        st.sampled_from([1, 2, 5, 10, 17, 99, None]),
        st.sampled_from([18, 19, 99, None]),
        st.one_of(st.none(), st.decimals(-30, 30, places=2)),
    ),
    min_size=1,
    max_size=60,
)


@SETTINGS
@given(batch=movements)
def test_any_batch_of_movements(spark, seed, batch):
    asked = spark.createDataFrame([(i, *m) for i, m in enumerate(batch)], ISSUES)
    applied = apply_stock.apply_issues(asked, seed.supply, seed.staff, seed.stock_snapshot, ["req_id"], hot_rows=8)
    found = applied.results.collect()
    assert sorted(r["req_id"] for r in found) == list(range(len(batch)))
    before, after = dict(rows(seed.stock_snapshot)), dict(rows(applied.snapshot))
    assert min(after.values()) >= 0
    for supply in before:
        moved = sum((r["qty"] for r in found if r["result_code"] == 1 and r["supply_id"] == supply), d(0))
        assert after[supply] - before[supply] == moved


@SETTINGS
@given(tables=st.lists(st.tuples(st.sampled_from([1, 2, 3, 4, 7, None]), st.sampled_from([18, 20, 99])), min_size=1, max_size=20))
def test_payments_conserve_prices(spark, seed, tables):
    asked = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "req_id bigint, table_no bigint, cashier_id bigint")
    applied = apply_orders.apply_table_payments(asked, seed.order_line, seed.dish, seed.staff, seed.register)

    def priced(orders):
        return joins.orders_with_dish(orders, seed.dish).agg(F.coalesce(F.sum("price"), F.lit(0))).first()[0]

    paid = applied.cash_ops.agg(F.coalesce(F.sum("amount"), F.lit(0))).first()[0]
    sold = applied.sales.agg(F.coalesce(F.sum("amount"), F.lit(0))).first()[0]
    assert paid == sold == priced(seed.order_line) - priced(applied.open_orders)


@pytest.mark.parametrize("total, minimum, expected", [("0", "0", "ROJO"), ("5", "5", "ROJO"), ("6.49", "5", "AMARILLO"), ("6.50", "5", "VERDE"), ("-1", "0", "ROJO")])
def test_traffic_light(spark, total, minimum, expected):
    from comandix.functions.expressions import stock_status

    one = spark.createDataFrame([(d(total), d(minimum))], "t decimal(8,2), m decimal(8,2)")
    assert one.select(stock_status("t", "m")).first()[0] == expected


def test_repeated_keys_leave_one_row_each(spark, seed):
    """Requests for one key follow each other; every request keeps its own result."""
    changes = spark.createDataFrame(
        [(1, 1, "first", None), (2, 1, None, d("9.90")), (3, 900, "new", d("1.00")), (4, 900, "newer", None), (5, None, "lost", d("2.00"))],
        "req_id bigint, dish_id bigint, dish_name string, price decimal(8,2)",
    )
    after = apply_dims.upsert_dimension(seed.dish, changes, "dish_id", defaults={"active": True})
    assert after.count() == seed.dish.count() + 1 == after.select("dish_id").distinct().count()
    found = {r["dish_id"]: (r["dish_name"], r["price"]) for r in after.collect()}
    assert found[1] == ("first", d("9.90")) and found[900] == ("newer", d("1.00"))
    flags = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, None, True)], "req_id bigint, dish_id bigint, target boolean")
    toggled = apply_dims.toggle_flag(seed.dish, flags, "dish_id", "active")
    assert toggled.count() == seed.dish.count() and not toggled.where("dish_id = 1").first()["active"]
    people = spark.createDataFrame(
        [(1, 900, "a", 99), (2, 900, "b", 1), (3, 900, "c", 99), (4, None, "d", 1)], "req_id bigint, staff_id bigint, username string, role_id bigint"
    )
    done = apply_dims.apply_staff_changes(people, seed.staff, seed.role)
    assert [(r["ok"], r["change"]) for r in done.results.orderBy("req_id").collect()] == [(False, "insert"), (True, "insert"), (True, "update"), (False, "insert")]
    assert done.table.where("staff_id = 900").count() == 1 and done.table.count() == seed.staff.count() + 1


def test_two_edits_of_one_order(spark, seed):
    pending = seed.order_line.where("state = 'PENDIENTE'").first()
    edits = spark.createDataFrame(
        [(1, pending["order_id"], 2, 3, 18, "2019-12-01 10:00:00"), (2, pending["order_id"], 3, 3, 18, "2019-12-01 11:00:00")],
        "req_id bigint, order_id bigint, dish_id bigint, table_no bigint, waiter_id bigint, ts string",
    )

    def edited(which):
        return apply_orders.apply_order_edits(which, seed.order_line, seed.dish, seed.dining_table, seed.staff, seed.recipe, seed.stock_snapshot)

    both, last = edited(edits), edited(edits.where("req_id = 2"))
    assert both.results.count() == 2
    assert both.orders.count() == seed.order_line.count()
    assert rows(both.snapshot) == rows(last.snapshot) and rows(both.orders) == rows(last.orders)


def test_counts_and_corrections_follow_each_other(spark, seed):
    ledger = spark.createDataFrame([(1, 7, d("1.00"))], "ledger_id bigint, supply_id bigint, qty decimal(8,2)")
    counted = spark.createDataFrame([(1, 7, d("3")), (2, 7, d("4"))], "req_id bigint, supply_id bigint, counted decimal(8,2)")
    assert sorted(r["qty"] for r in apply_stock.apply_adjustments(counted, ledger).collect()) == [d("1.00"), d("2.00")]
    edits = spark.createDataFrame([(1, 1, d("5")), (2, 1, d("2"))], "req_id bigint, ledger_id bigint, new_qty decimal(8,2)")
    none = spark.createDataFrame([], "ledger_id bigint, reverse_stock boolean")
    after = apply_stock.apply_ledger_corrections(ledger, seed.stock_snapshot, edits, none, ["ledger_id"]).ledger
    assert [r["qty"] for r in after.collect()] == [d("2.00")]


def test_missing_keys_and_amounts_are_refused(spark, seed):
    asked = spark.createDataFrame([(1, None), (2, 900), (3, 1)], "req_id bigint, dish_id bigint")
    assert codes(apply_dims.delete_rows(asked, seed.dish, "dish_id").results) == {1: 3, 2: 3, 3: 1}
    cash = spark.createDataFrame([(1, None, 20, 5)], "req_id bigint, amount decimal(8,2), cashier_id bigint, ts bigint")
    assert codes(apply_cash.apply_cash_ops(cash, seed.staff, seed.register).results) == {1: 2}


def test_kinds_of_movements(spark, seed):
    supply = seed.stock_snapshot.where("qty > 1").first()["supply_id"]
    asked = spark.createDataFrame(
        [(1, supply, 20, d("1"), "issue"), (2, supply, 20, d("-1"), "issue"), (3, supply, 20, d("-1"), "receipt"), (4, supply, 20, d("1"), "receipt")],
        "req_id bigint, supply_id bigint, keeper_id bigint, qty decimal(8,2), kind string",
    )
    done = apply_stock.apply_issues(asked, seed.supply, seed.staff, seed.stock_snapshot, ["req_id"])
    assert codes(done.results) == {1: 4, 2: 1, 3: 4, 4: 1}


@pytest.mark.parametrize("unknown", [[(3, 900)], [(3, 900), (3, 1), (4, 1)]])
def test_payments_lose_no_order(spark, seed, unknown):
    orders = spark.createDataFrame([(i, dish, table, 18, "ENTREGADO", None, None) for i, (table, dish) in enumerate(unknown)], seed.order_line.schema)
    asked = spark.createDataFrame([(1, 3, 20)], "req_id bigint, table_no bigint, cashier_id bigint")
    applied = apply_orders.apply_table_payments(asked, orders, seed.dish, seed.staff, seed.register)
    assert applied.open_orders.count() + applied.sales.count() == len(unknown)
    assert applied.open_orders.where("dish_id = 900").count() == 1
    paid = applied.cash_ops.agg(F.coalesce(F.sum("amount"), F.lit(0))).first()[0]
    assert applied.register.first()["current_amount"] == seed.register.first()["current_amount"] + paid


def test_seed_columns_go_by_the_header(spark, tmp_path):
    from comandix.sources.tables import load_seed

    file = tmp_path / "supply.csv"
    file.write_text("min_qty,supply_name,supply_id\n5.00,rice,9\n")
    row = load_seed(spark, str(file), "supply").first()
    assert (row["supply_id"], row["supply_name"], row["min_qty"]) == (9, "rice", d("5.00"))


def test_counts_that_are_missing_or_name_nothing_change_nothing(spark):
    kind = "req_id bigint, supply_id bigint, counted decimal(8,2)"
    ledger = spark.createDataFrame([(7, d("1.00")), (8, d("2.00"))], "supply_id bigint, qty decimal(8,2)")
    supplies = spark.createDataFrame([(7,), (8,), (9,)], "supply_id bigint")
    counted = spark.createDataFrame([(1, 7, d("3")), (2, 7, None), (3, 7, d("4")), (4, None, d("5")), (5, 99, d("5")), (6, 9, d("0")), (7, 8, None)], kind)
    done = apply_stock.adjust_to_counts(counted, ledger, supplies, hot_rows=2)
    assert codes(done.results) == {1: 1, 2: 4, 3: 1, 4: 2, 5: 2, 6: 1, 7: 4}
    totals = {r["supply_id"]: r["qty"] for r in ledger.unionByName(done.ledger_rows.drop("is_adjustment")).groupBy("supply_id").agg(F.sum("qty").alias("qty")).collect()}
    assert totals == {7: d("4.00"), 8: d("2.00"), 9: d("0.00")}
    assert apply_stock.apply_adjustments(counted.limit(0), ledger, supplies).count() == 0


def test_changes_without_a_sequence_are_refused(spark, seed):
    """Columns of two rows are never mixed into one that nobody asked for."""
    kind = "dish_id bigint, dish_name string, price decimal(8,2)"
    once = spark.createDataFrame([(1, "apple", d("9"))], kind)
    twice = spark.createDataFrame([(1, "ziti", d("1")), (1, "apple", d("9"))], kind)
    assert apply_dims.upsert_dimension(seed.dish, once, "dish_id").where("dish_name = 'apple'").count() == 1
    with pytest.raises(Exception, match="req_id"):
        apply_dims.upsert_dimension(seed.dish, twice, "dish_id").collect()
    flags = spark.createDataFrame([(1, True), (1, False)], "dish_id bigint, target boolean")
    with pytest.raises(Exception, match="req_id"):
        apply_dims.toggle_flag(seed.dish, flags, "dish_id", "active").collect()


def test_the_first_delete_of_a_row_counts(spark, seed):
    ledger = spark.createDataFrame([(1, 7, d("5.00")), (2, 7, d("2.00"))], "ledger_id bigint, supply_id bigint, qty decimal(8,2)")
    stock = spark.createDataFrame([(7, d("7.00"))], "supply_id bigint, qty decimal(18,2)")
    none = spark.createDataFrame([], "req_id bigint, ledger_id bigint, new_qty decimal(8,2)")
    deletes = spark.createDataFrame([(4, 1, True), (3, 1, False), (5, 2, True), (6, None, True)], "req_id bigint, ledger_id bigint, reverse_stock boolean")
    after = apply_stock.apply_ledger_corrections(ledger, stock, none, deletes, ["ledger_id"])
    assert after.ledger.count() == 0 and rows(after.snapshot) == [(7, d("5.00"))]
