"""Lists: projections, filters and lookups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix import model


def list_supplies(supplies: DataFrame) -> DataFrame:
    return supplies.select("supply_id", "supply_name", "min_qty")


def list_dishes(dishes: DataFrame) -> DataFrame:
    return dishes.select("dish_id", "dish_name", "price", "active", "needs_prep")


def list_tables(tables: DataFrame) -> DataFrame:
    return tables.select("table_no", "active")


def list_vendors(vendors: DataFrame) -> DataFrame:
    return vendors.select("vendor_id", "vendor_name")


def list_roles(roles: DataFrame) -> DataFrame:
    return roles.select("*")


def register_state(register: DataFrame) -> DataFrame:
    """Amount in the register and whether a session is open."""
    return register.select("current_amount", F.col("session_id").isNotNull().alias("is_open"))


def find_by_key(table: DataFrame, key: str, value: Any) -> DataFrame:
    """At most one row, as a point lookup; the filter reaches the scan."""
    return table.where(F.col(key) == F.lit(value)).limit(1)


def first_row(df: DataFrame, *order: str) -> DataFrame:
    """The first row of a result in an order given explicitly."""
    return df.orderBy(*order).limit(1)


def lookup_by_key(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Many point lookups at once: every requested key, with NULLs where nothing is stored."""
    return keys.select(key).distinct().join(table, key, "left")


def orders_for_table(orders: DataFrame, dishes: DataFrame, table_no: int | None) -> DataFrame:
    """Orders of one table; None means take-away."""
    chosen = orders.where(F.col("table_no").eqNullSafe(F.lit(table_no).cast("bigint")))
    return _with_dish(chosen, dishes)


def kitchen_in_preparation(orders: DataFrame, dishes: DataFrame) -> DataFrame:
    return _with_dish(orders.where(F.col("state") == model.IN_PREPARATION), dishes)


def kitchen_ready(orders: DataFrame, dishes: DataFrame) -> DataFrame:
    return _with_dish(orders.where(F.col("state") == model.READY), dishes)


def kitchen_pending_prep(orders: DataFrame, dishes: DataFrame) -> DataFrame:
    return _with_dish(orders.where(F.col("state") == model.PENDING), dishes.where("needs_prep"))


def kitchen_pending_noprep(orders: DataFrame, dishes: DataFrame) -> DataFrame:
    return _with_dish(orders.where(F.col("state") == model.PENDING), dishes.where("NOT needs_prep"))


def kitchen_board(orders: DataFrame, dishes: DataFrame) -> DataFrame:
    """Length of the four kitchen queues in one pass.

    Orders are counted per dish and state before they meet the dishes, so a popular dish is one row.
    """
    counted = orders.groupBy("dish_id", "state").agg(F.count(F.lit(1)).alias("n"))
    state = F.col("state")
    queue = (
        F.when((state == model.PENDING) & F.col("needs_prep"), "PENDIENTE CON PREPARACION")
        .when(state == model.PENDING, "PENDIENTE SIN PREPARACION")
        .when(state == model.IN_PREPARATION, model.IN_PREPARATION)
        .when(state == model.READY, model.READY)
    )
    return (
        counted.join(dishes.select("dish_id", "needs_prep"), "dish_id")
        .withColumn("queue", queue)
        .where("queue IS NOT NULL")
        .groupBy("queue")
        .agg(F.sum("n").alias("orders"))
    )


def stock_receipts(ledger: DataFrame, supplies: DataFrame) -> DataFrame:
    """Movements in; a quantity of zero counts as in and as out."""
    return _movements(ledger.where("qty >= 0 AND NOT is_adjustment"), supplies)


def stock_issues(ledger: DataFrame, supplies: DataFrame) -> DataFrame:
    return _movements(ledger.where("qty <= 0 AND NOT is_adjustment"), supplies)


def stock_adjustments(ledger: DataFrame, supplies: DataFrame) -> DataFrame:
    return _movements(ledger.where("is_adjustment"), supplies)


def stock_receipt_by_id(
    ledger: DataFrame, supplies: DataFrame, value: Any, key: str = "ledger_ref"
) -> DataFrame:
    return stock_receipts(ledger.where(F.col(key) == F.lit(value)), supplies)


def stock_receipts_by_ids(
    keys: DataFrame, ledger: DataFrame, supplies: DataFrame, key: str = "ledger_ref"
) -> DataFrame:
    """Receipts of many ids at once."""
    return stock_receipts(ledger.join(keys.select(key), key, "left_semi"), supplies)


def order_by_id(orders: DataFrame, dishes: DataFrame, order_id: int) -> DataFrame:
    return _with_dish(orders.where(F.col("order_id") == F.lit(order_id)), dishes)


def orders_by_ids(keys: DataFrame, orders: DataFrame, dishes: DataFrame) -> DataFrame:
    """Orders of many ids at once."""
    return _with_dish(orders.join(keys.select("order_id"), "order_id", "left_semi"), dishes)


def selectable_dishes(dishes: DataFrame) -> DataFrame:
    return list_dishes(dishes.where("active"))


def selectable_tables(tables: DataFrame) -> DataFrame:
    return list_tables(tables.where("active"))


def editable_orders(orders: DataFrame) -> DataFrame:
    """Only orders nobody has started on may be edited or removed."""
    return orders.where(F.col("state") == model.PENDING)


def _with_dish(orders: DataFrame, dishes: DataFrame) -> DataFrame:
    line = ["line_no"] if "line_no" in orders.columns else []
    named = orders.join(dishes.select("dish_id", "dish_name"), "dish_id")
    return named.select("order_id", *line, "dish_id", "dish_name", "table_no", "state")


def _movements(ledger: DataFrame, supplies: DataFrame) -> DataFrame:
    ids = [name for name in ("ledger_id", "ledger_ref", "ledger_line") if name in ledger.columns]
    named = ledger.join(supplies.select("supply_id", "supply_name"), "supply_id")
    return named.select(*ids, "supply_id", "supply_name", "keeper_id", "qty", F.col("created_at").alias("moved_at"))
