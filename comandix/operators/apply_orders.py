"""Bulk order requests: new orders, edits, cancels, state changes and table payments."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comandix import model
from comandix.functions.expressions import first_failure, message_for, money, payment_text, total
from comandix.operators import hotkeys
from comandix.operators.aggregates import table_bill
from comandix.operators.joins import (
    add_to_stock,
    bom_explosion,
    known_reference,
    order_checks,
)


@dataclass(frozen=True)
class OrdersApplied:
    """A code per request, the open orders afterwards (or the new ones), the stock afterwards."""

    results: DataFrame
    orders: DataFrame
    snapshot: DataFrame


def apply_orders(
    requests: DataFrame,
    dishes: DataFrame,
    tables: DataFrame,
    staff: DataFrame,
    recipe: DataFrame,
    snapshot: DataFrame,
    last_id: Column | int = 0,
) -> OrdersApplied:
    """New orders: 2 dish, 3 table, 4 waiter unknown or inactive.

    Accepted orders start pending and take their ingredients from stock, which may go below zero.
    """
    results = _order_results(requests, dishes, tables, staff)
    return accepted_orders(results, recipe, snapshot, last_id)


def accepted_orders(
    results: DataFrame, recipe: DataFrame, snapshot: DataFrame, last_id: Column | int = 0
) -> OrdersApplied:
    """New orders and stock that follow from a batch's results."""
    accepted = results.where("result_code = 1")
    ids = hotkeys.assign_ids(accepted, "req_id", "order_id", last_id)
    new = ids.select("order_id", "dish_id", "table_no", "waiter_id", F.lit(model.PENDING).alias("state"), "ts")
    return OrdersApplied(results, new, _take(snapshot, bom_explosion(accepted, recipe)))


def apply_order_edits(
    edits: DataFrame,
    orders: DataFrame,
    dishes: DataFrame,
    tables: DataFrame,
    staff: DataFrame,
    recipe: DataFrame,
    snapshot: DataFrame,
) -> OrdersApplied:
    """Edits. Only pending orders change, and only then stock moves.

    Edits of one order follow each other by ``req_id``, so the last accepted one stays. The stored dish's
    ingredients go back and the last dish's are taken, as one net change per supply.
    ``rows_affected`` is 0 where the request was in order but the order was not pending.
    """
    return accepted_edits(_order_results(edits, dishes, tables, staff), orders, recipe, snapshot)


def accepted_edits(results: DataFrame, orders: DataFrame, recipe: DataFrame, snapshot: DataFrame) -> OrdersApplied:
    """Orders and stock that follow from a batch's results."""
    last = F.max_by(F.struct("dish_id", "table_no", "waiter_id", "ts"), "req_id").alias("_last")
    accepted = results.where("result_code = 1 AND order_id IS NOT NULL").groupBy("order_id").agg(last)
    accepted = accepted.select(
        "order_id",
        F.col("_last.dish_id").alias("_dish"),
        F.col("_last.table_no").alias("_table"),
        F.col("_last.waiter_id").alias("_waiter"),
        F.col("_last.ts").alias("_ts"),
        F.lit(True).alias("_edit"),
    )
    matched = orders.join(accepted, "order_id", "left")
    edited = F.col("_edit").isNotNull() & (F.col("state") == model.PENDING)
    after = matched.select(
        "order_id",
        F.when(edited, F.col("_dish")).otherwise(F.col("dish_id")).alias("dish_id"),
        F.when(edited, F.col("_table")).otherwise(F.col("table_no")).alias("table_no"),
        F.when(edited, F.col("_waiter")).otherwise(F.col("waiter_id")).alias("waiter_id"),
        "state",
        F.when(edited, F.col("_ts")).otherwise(F.col("created_at")).alias("updated_at"),
    )
    moved = matched.where(edited)
    swap = moved.select(
        F.explode(
            F.array(
                F.struct(F.col("dish_id").alias("dish_id"), F.lit(1).alias("sign")),
                F.struct(F.col("_dish").alias("dish_id"), F.lit(-1).alias("sign")),
            )
        ).alias("s")
    ).select("s.*")
    portions = swap.groupBy("dish_id").agg(F.sum("sign").alias("portions"))
    change = portions.join(recipe, "dish_id").groupBy("supply_id").agg(
        total(F.col("qty") * F.col("portions")).alias("qty")
    )
    touched = moved.groupBy("order_id").agg(F.lit(1).alias("_rows"))
    reported = results.join(touched, "order_id", "left").select(
        "req_id", "order_id", "result_code", "message",
        F.when(F.col("result_code") == 1, F.coalesce("_rows", F.lit(0))).otherwise(F.lit(0)).alias("rows_affected"),
    )
    return OrdersApplied(reported, after, add_to_stock(snapshot, change))


def edit_results(edits: DataFrame, dishes: DataFrame, tables: DataFrame, staff: DataFrame) -> DataFrame:
    """Edits with their codes, before it is known whether their orders are pending."""
    return _order_results(edits, dishes, tables, staff)


def apply_order_cancels(
    cancels: DataFrame, orders: DataFrame, recipe: DataFrame, snapshot: DataFrame
) -> OrdersApplied:
    """Cancels. Only pending orders go away, and only their ingredients go back."""
    asked = cancels.select("order_id").distinct()
    gone = orders.where(F.col("state") == model.PENDING).join(asked, "order_id", "left_semi")
    kept = orders.join(asked.withColumn("_asked", F.lit(True)), "order_id", "left").where(
        F.col("_asked").isNull() | (F.col("state") != model.PENDING)
    )
    first = cancels.groupBy("order_id").agg(F.min("req_id").alias("_first"))
    hit = first.join(gone.select("order_id"), "order_id", "left_semi")
    results = cancels.join(hit, "order_id", "left").select(
        "req_id", "order_id", F.coalesce((F.col("_first") == F.col("req_id")).cast("int"), F.lit(0)).alias("rows_affected")
    )
    return OrdersApplied(results, kept.select(*orders.columns), add_to_stock(snapshot, bom_explosion(gone, recipe)))


def latest_states(events: DataFrame) -> DataFrame:
    """Newest state of every order; combined before the shuffle, so a busy order is few rows.

    Instant and event id are compared as one number and the state travels as its place in the list
    of states: with fixed-width values only, Spark can aggregate by hashing instead of sorting.
    """
    places = F.create_map(*[F.lit(x) for place, state in enumerate(model.ORDER_STATES, 1) for x in (state, place)])
    moment = _micros("ts").cast("decimal(19,0)") * F.lit(Decimal(10**19)) + F.col("event_id")
    newest = events.groupBy("order_id").agg(
        F.max_by(places[F.col("state")], moment).alias("_place"), F.max("ts").alias("updated_at")
    )
    states = F.array(*[F.lit(state) for state in model.ORDER_STATES])
    return newest.select("order_id", F.element_at(states, F.col("_place")).alias("state"), "updated_at")


def apply_state_changes(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders after their state changes; any state may follow any other."""
    newest = latest_states(events).select("order_id", F.col("state").alias("_state"), F.col("updated_at").alias("_at"))
    return orders.join(newest, "order_id", "left").select(
        "order_id",
        "dish_id",
        "table_no",
        "waiter_id",
        F.coalesce("_state", "state").alias("state"),
        F.coalesce(F.col("_at").cast("timestamp_ntz"), F.col("created_at")).alias("updated_at"),
    )


def state_jumps(events: DataFrame, hot_rows: int = hotkeys.HOT_ROWS) -> DataFrame:
    """How often each state followed each other one, and whether that is the usual next step."""
    steps = hotkeys.previous(events, "order_id", ["ts", "event_id"], {"from_state": "state"}, hot_rows)
    usual = F.create_map(*[F.lit(s) for pair in zip(model.ORDER_STATES, model.ORDER_STATES[1:]) for s in pair])
    return (
        steps.groupBy("from_state", F.col("state").alias("to_state"))
        .agg(F.count(F.lit(1)).alias("changes"))
        .withColumn(
            "usual",
            F.when(F.col("from_state").isNull(), F.col("to_state") == model.PENDING).otherwise(
                F.coalesce(usual[F.col("from_state")] == F.col("to_state"), F.lit(False))
            ),
        )
    )


def state_durations(events: DataFrame, hot_rows: int = hotkeys.HOT_ROWS) -> DataFrame:
    """Microseconds an order spent in its previous state before each event."""
    looked = hotkeys.previous(
        events, "order_id", ["ts", "event_id"], {"from_state": "state", "from_ts": "ts"}, hot_rows
    )
    return looked.select(
        "event_id",
        "order_id",
        "from_state",
        F.col("state").alias("to_state"),
        (_micros("ts") - _micros("from_ts")).alias("micros_in_state"),
    )


@dataclass(frozen=True)
class PaymentsApplied:
    """A code per request, cash operations, sales history rows, the orders still open, the register."""

    results: DataFrame
    cash_ops: DataFrame
    sales: DataFrame
    open_orders: DataFrame
    register: DataFrame


def apply_table_payments(
    requests: DataFrame, orders: DataFrame, dishes: DataFrame, staff: DataFrame, register: DataFrame
) -> PaymentsApplied:
    """Payments of whole tables: 2 nothing ordered, 3 cashier, 4 register closed.

    The first payment of a table in request order that passes takes all its orders at today's
    price; later payments of that table find nothing to pay. Take-away orders have no table to pay.
    Orders of a dish without a price are on no bill and stay open. The register takes what was paid.
    """
    coded, first = coded_payments(requests, orders, dishes, staff, register)
    # What pays a table does not depend on its orders, so the orders are only read where they move.
    return settled_payments(coded, first.select("table_no"), orders, dishes, register)


def coded_payments(
    requests: DataFrame, orders: DataFrame, dishes: DataFrame, staff: DataFrame, register: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Payments with their codes, session, sum and orders; and the tables that are paid, priced orders or not."""
    bills = table_bill(orders.where("table_no IS NOT NULL"), dishes.where("price IS NOT NULL"))
    session = register.agg(F.max("session_id").alias("id")).scalar()
    checked = known_reference(requests, staff.where("enabled"), "staff_id", "cashier_id", "_cashier")
    checked = checked.withColumn("_session", session).withColumn(
        "_code", first_failure((F.col("_cashier").isNull(), 3), (F.col("_session").isNull(), 4))
    )
    first = checked.where("_code = 1 AND table_no IS NOT NULL").groupBy("table_no").agg(F.min("req_id").alias("_first"))
    paying = bills.join(first, "table_no", "left")
    nothing = F.col("orders").isNull() | F.coalesce(F.col("req_id") > F.col("_first"), F.lit(False))
    coded = (
        checked.join(paying, "table_no", "left")
        .withColumn("result_code", F.when(nothing, 2).otherwise(F.col("_code")).cast("int"))
        .withColumn("message", message_for("table_payment", "result_code"))
    )
    return coded, first


def settled_payments(
    coded: DataFrame, closed: DataFrame, orders: DataFrame, dishes: DataFrame, register: DataFrame
) -> PaymentsApplied:
    """All that follows from coded payments; ``closed`` are the tables they pay."""
    results = coded.select("req_id", "table_no", "cashier_id", "result_code", "message")
    ops = coded.where("result_code = 1").select(
        F.col("_session").alias("session_id"),
        money("total", 18).alias("amount"),
        payment_text("table_no").alias("note"),
        "cashier_id",
        "orders",
    )
    # A table without priced orders may be among these; it has nothing that moves.
    sales = (
        orders.join(closed, "table_no", "left_semi")
        .join(dishes.where("price IS NOT NULL").select("dish_id", "price"), "dish_id")
        .select("dish_id", "waiter_id", F.col("price").alias("amount"))
    )
    priced = dishes.where("price IS NOT NULL").select("dish_id", F.lit(True).alias("_priced"))
    marked = orders.join(closed.withColumn("_closed", F.lit(True)), "table_no", "left").join(priced, "dish_id", "left")
    still = marked.where("_closed IS NULL OR _priced IS NULL").select(*orders.columns)
    paid = ops.agg(total("amount").alias("paid")).scalar()
    after = register.select(
        "register_id",
        money(F.col("current_amount") + F.coalesce(paid, F.lit(0)), 18).alias("current_amount"),
        "session_id",
    )
    return PaymentsApplied(results, ops, sales, still, after)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _order_results(requests: DataFrame, dishes: DataFrame, tables: DataFrame, staff: DataFrame) -> DataFrame:
    code = first_failure((F.col("bad_dish"), 2), (F.col("bad_table"), 3), (F.col("bad_waiter"), 4))
    coded = order_checks(requests, dishes, tables, staff).withColumn("result_code", code)
    return coded.select(*requests.columns, "result_code", message_for("order", "result_code").alias("message"))


def _take(snapshot: DataFrame, used: DataFrame) -> DataFrame:
    return add_to_stock(snapshot, used.select("supply_id", (-F.col("qty")).alias("qty")))
