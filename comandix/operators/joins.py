"""Operators that bring several tables together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix.functions.expressions import money, total
from comandix.operators import lists


def orders_with_dish(orders: DataFrame, dishes: DataFrame) -> DataFrame:
    named = orders.join(dishes.select("dish_id", "dish_name", "price"), "dish_id")
    line = ["line_no"] if "line_no" in orders.columns else []
    return named.select("order_id", *line, "dish_id", "dish_name", "price", "table_no", "state")


def recipe_lines(recipe: DataFrame, dishes: DataFrame, supplies: DataFrame, dish_id: int | None = None) -> DataFrame:
    """Ingredients of one dish, or of all dishes."""
    if dish_id is not None:
        recipe = recipe.where(F.col("dish_id") == F.lit(dish_id))
    return (
        recipe.join(dishes.select("dish_id", "dish_name"), "dish_id")
        .join(supplies.select("supply_id", "supply_name"), "supply_id")
        .select("dish_id", "dish_name", "supply_id", "supply_name", "qty")
    )


def supplier_supplies(
    vendors: DataFrame, offers: DataFrame, supplies: DataFrame, vendor_id: int | None = None
) -> DataFrame:
    """Supplies one vendor offers, or the offers of all vendors."""
    if vendor_id is not None:
        vendors = vendors.where(F.col("vendor_id") == F.lit(vendor_id))
    return (
        offers.select("vendor_id", "supply_id")
        .join(vendors.select("vendor_id"), "vendor_id")
        .join(supplies, "supply_id")
        .select("vendor_id", "supply_id", "supply_name", "min_qty")
    )


def table_consumption(
    orders: DataFrame, dishes: DataFrame, staff: DataFrame, table_no: int | None = None
) -> DataFrame:
    """What a table, or every table, has ordered and from whom. Orders without a waiter drop out."""
    at_table = orders.where("table_no IS NOT NULL" if table_no is None else F.col("table_no") == F.lit(table_no))
    line = ["line_no"] if "line_no" in orders.columns else []
    return (
        at_table.join(dishes.select("dish_id", "dish_name", "price"), "dish_id")
        .join(staff.select(F.col("staff_id").alias("waiter_id"), "username"), "waiter_id")
        .select("order_id", *line, "table_no", "state", "dish_name", "price", "username")
    )


def list_users(staff: DataFrame, roles: DataFrame) -> DataFrame:
    """Staff with the role's own id and name, NULL where the role does not exist."""
    known = roles.select(F.col("role_id").alias("known_role_id"), "role_name")
    return staff.join(known, staff["role_id"] == known["known_role_id"], "left").select(
        "staff_id", F.col("known_role_id").alias("role_id"), "role_name", "username", "enabled"
    )


def known_reference(requests: DataFrame, table: DataFrame, key: str, column: str, flag: str) -> DataFrame:
    """Mark requests whose ``column`` names a row of ``table``; ``flag`` is NULL for the others."""
    known = table.select(F.col(key).alias(column), F.lit(True).alias(flag))
    return requests.join(known, column, "left")


def semi_active_refs(
    requests: DataFrame, dishes: DataFrame, tables: DataFrame, staff: DataFrame
) -> DataFrame:
    """Order requests whose dish, table and waiter, where given, exist and are active."""
    return _checked(requests, dishes, tables, staff).where(_all_known()).select(*requests.columns)


def anti_unknown_refs(
    requests: DataFrame, dishes: DataFrame, tables: DataFrame, staff: DataFrame
) -> DataFrame:
    """Order requests with at least one unknown or inactive reference."""
    return _checked(requests, dishes, tables, staff).where(~_all_known()).select(*requests.columns)


def bom_explosion(orders: DataFrame, recipe: DataFrame) -> DataFrame:
    """Ingredients the orders use. Orders are counted per dish first, so a popular dish is one row."""
    portions = orders.groupBy("dish_id").agg(F.count(F.lit(1)).alias("portions"))
    return (
        portions.join(recipe, "dish_id")
        .groupBy("supply_id")
        .agg(total(F.col("qty") * F.col("portions")).alias("qty"))
    )


def bom_release(snapshot: DataFrame, orders: DataFrame, recipe: DataFrame) -> DataFrame:
    """Stock after the ingredients of the given orders were put back."""
    return add_to_stock(snapshot, bom_explosion(orders, recipe))


def add_to_stock(snapshot: DataFrame, change: DataFrame) -> DataFrame:
    """Stock rows plus a signed change per supply; supplies without a stock row gain none."""
    delta = change.select("supply_id", F.col("qty").alias("_change"))
    return snapshot.join(delta, "supply_id", "left").select(
        "supply_id", money(F.col("qty") + F.coalesce("_change", F.lit(0)), 18).alias("qty")
    )


def changed_stock(snapshot: DataFrame, change: DataFrame) -> DataFrame:
    """As ``add_to_stock``, but only the stock rows that a change names."""
    delta = change.select("supply_id", F.col("qty").alias("_change"))
    return snapshot.join(delta, "supply_id").select("supply_id", money(F.col("qty") + F.coalesce("_change", F.lit(0)), 18).alias("qty"))


def current_session_ops(ops: DataFrame, register: DataFrame, tie_break: list[str]) -> DataFrame:
    """Operations of the open session, oldest first; none when the register is closed."""
    current = register.agg(F.max("session_id").alias("id")).scalar()
    return ops.where(F.col("session_id") == current).orderBy("created_at", *tie_break)


def sales_with_dish(sales: DataFrame, dishes: DataFrame) -> DataFrame:
    return sales.join(dishes.select("dish_id", "dish_name"), "dish_id").select(
        "dish_id", "dish_name", "waiter_id", "amount", "created_at"
    )


def ledger_vs_snapshot(ledger: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Ledger total and snapshot of every supply that has either, and how far apart they are."""
    sums = ledger.groupBy("supply_id").agg(total("qty").alias("ledger_qty"))
    kept = snapshot.select("supply_id", money("qty", 18).alias("snapshot_qty"))
    both = sums.join(kept, "supply_id", "full_outer")
    gap = F.coalesce("ledger_qty", F.lit(0)) - F.coalesce("snapshot_qty", F.lit(0))
    return both.select("supply_id", "ledger_qty", "snapshot_qty", money(gap, 18).alias("difference"))


def cash_reconciliation(sessions: DataFrame, ops: DataFrame) -> DataFrame:
    """Closing amount worked out from the operations against the stored and the entered one."""
    moved = ops.groupBy("session_id").agg(total("amount").alias("ops_total"))
    joined = sessions.join(moved, "session_id", "left")
    expected = F.col("opening") + F.coalesce("ops_total", F.lit(0))
    return joined.select(
        "session_id",
        money("opening", 18).alias("opening"),
        money(expected, 18).alias("expected"),
        money("computed", 18).alias("computed"),
        money("entered", 18).alias("entered"),
        money(F.col("computed") - expected, 18).alias("stored_gap"),
        money(F.col("entered") - expected, 18).alias("expected_gap"),
        money(F.col("entered") - F.col("computed"), 18).alias("entered_gap"),
    )


def _checked(requests: DataFrame, dishes: DataFrame, tables: DataFrame, staff: DataFrame) -> DataFrame:
    marked = known_reference(requests, lists.selectable_dishes(dishes), "dish_id", "dish_id", "_dish")
    marked = known_reference(marked, lists.selectable_tables(tables), "table_no", "table_no", "_table")
    return known_reference(marked, staff.where("enabled"), "staff_id", "waiter_id", "_waiter")


def last_by_key(df: DataFrame, key: list[str], columns: list[str], order: str | None = "req_id") -> DataFrame:
    """One row per key: what applying its rows one after the other leaves in ``columns``.

    A NULL leaves what an earlier row said. Rows without a key go. Without ``order`` in the columns rows have no
    sequence, so a key that has more than one is an error.
    """
    named = df.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    if order in df.columns:
        kept = [F.expr(f"max_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in columns]
    else:
        message = F.lit(f"changes of one key need a column {order} that tells their sequence")
        kept = [F.when(F.count(F.lit(1)) > 1, F.raise_error(message)).otherwise(F.max(c)).alias(c) for c in columns]
    return named.groupBy(*key).agg(F.lit(True).alias("_named"), *kept).drop("_named")


def order_checks(requests: DataFrame, dishes: DataFrame, tables: DataFrame, staff: DataFrame) -> DataFrame:
    """Requests with what is wrong with them: ``bad_dish``, ``bad_table``, ``bad_waiter``."""
    return _checked(requests, dishes, tables, staff).select(
        *requests.columns,
        F.col("_dish").isNull().alias("bad_dish"),
        (F.col("table_no").isNotNull() & F.col("_table").isNull()).alias("bad_table"),
        (F.col("waiter_id").isNotNull() & F.col("_waiter").isNull()).alias("bad_waiter"),
    )


def _all_known():
    return (
        F.col("_dish").isNotNull()
        & (F.col("table_no").isNull() | F.col("_table").isNotNull())
        & (F.col("waiter_id").isNull() | F.col("_waiter").isNotNull())
    )
