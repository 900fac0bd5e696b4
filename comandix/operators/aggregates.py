"""Totals and reports.

Where a report names its groups through another table, rows are added up by id first and joined
afterwards: what is shuffled and joined is one row per id, whatever share of the rows an id has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix import model
from comandix.functions import expressions as E
from comandix.functions.expressions import money, total


def stock_totals(ledger: DataFrame, supplies: DataFrame) -> DataFrame:
    """Ledger total of every supply that has movements."""
    sums = ledger.groupBy("supply_id").agg(total("qty").alias("on_hand"))
    return sums.join(supplies, "supply_id").select("supply_id", "supply_name", "min_qty", "on_hand")


def stock_on_hand(ledger: DataFrame, supplies: DataFrame) -> DataFrame:
    """Stock on hand, without supplies whose total is negative."""
    return stock_totals(ledger, supplies).where("on_hand >= 0")


def stock_status(ledger: DataFrame, supplies: DataFrame) -> DataFrame:
    """Stock levels of all supplies with movements, and their traffic light."""
    return stock_totals(ledger, supplies).withColumn("status", E.stock_status("on_hand", "min_qty"))


def stock_of_supply(ledger: DataFrame, supplies: DataFrame, supply_id: int) -> DataFrame:
    """Stock of one supply: always one row, NULL where there is nothing."""
    moved = ledger.where(F.col("supply_id") == F.lit(supply_id)).select("supply_id", "qty")
    return (
        moved.join(supplies.select("supply_id", "supply_name"), "supply_id")
        .agg(
            F.any_value("supply_id").alias("supply_id"),
            F.any_value("supply_name").alias("supply_name"),
            total("qty").alias("on_hand"),
        )
    )


def stock_of_supplies(keys: DataFrame, ledger: DataFrame, supplies: DataFrame) -> DataFrame:
    """The same for many supplies: one row per requested key."""
    return (
        keys.select("supply_id")
        .distinct()
        .join(stock_totals(ledger, supplies).select("supply_id", "supply_name", "on_hand"), "supply_id", "left")
    )


def sales_by_day(sessions: DataFrame, first: str, last: str, inclusive_end: bool = False) -> DataFrame:
    """Entered closing amounts per calendar day; a day with only open sessions reports NULL."""
    chosen = sessions.where(E.within_days("created_at", first, last, inclusive_end))
    return chosen.groupBy(E.day_text("created_at").alias("day")).agg(total("entered").alias("total"))


def sales_by_dish(
    sales: DataFrame, dishes: DataFrame, first: str, last: str, inclusive_end: bool = False
) -> DataFrame:
    """Sales per dish name; dishes of the same name are one line."""
    sold = sales.where(E.within_days("created_at", first, last, inclusive_end))
    by_id = sold.groupBy("dish_id").agg(total("amount").alias("amount"))
    named = by_id.join(dishes.select("dish_id", "dish_name"), "dish_id")
    return named.groupBy("dish_name").agg(total("amount").alias("total"))


def register_closings(sessions: DataFrame, first: str, last: str, inclusive_end: bool = False) -> DataFrame:
    """Entered amounts per day the session was opened, for sessions updated in the range."""
    chosen = sessions.where(E.within_days("updated_at", first, last, inclusive_end))
    return chosen.groupBy(E.day_of("created_at").alias("day")).agg(total("entered").alias("total"))


def orders_by_hour(events: DataFrame, day: str, ts: str = "ts") -> DataFrame:
    """Orders per hour of one day, in the order of the hours."""
    counted = events.where(E.on_day(ts, day)).groupBy(E.hour_of(ts).alias("hour")).agg(F.count(F.lit(1)).alias("orders"))
    return counted.orderBy("hour")


def orders_by_day_and_hour(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Orders per hour of every day."""
    return events.groupBy(E.day_label(ts).alias("day"), E.hour_of(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("orders")
    )


def table_bill(orders: DataFrame, dishes: DataFrame) -> DataFrame:
    """Orders and price per table; the NULL table is take-away.

    Counted per table and dish first, so neither a busy table nor a popular dish gathers rows.
    """
    portions = orders.groupBy("table_no", "dish_id").agg(F.count(F.lit(1)).alias("n"))
    priced = portions.join(dishes.select("dish_id", "price"), "dish_id")
    return priced.groupBy("table_no").agg(
        F.sum("n").alias("orders"), total(F.col("price") * F.col("n")).alias("total")
    )


def admin_guard(staff: DataFrame) -> DataFrame:
    """Number of administrators, and whether one of them may be removed."""
    admins = F.count(F.when(F.col("role_id") == model.ADMIN_ROLE, 1))
    return staff.agg(admins.alias("admins"), (admins > 1).alias("may_remove_one"))


def sales_by_waiter(sales: DataFrame) -> DataFrame:
    """Sales per waiter; sales without a waiter are a group of their own."""
    return sales.groupBy("waiter_id").agg(F.count(F.lit(1)).alias("sales"), total("amount").alias("total"))


def stock_flow_by_class(ledger: DataFrame) -> DataFrame:
    """Received, issued and adjusted quantity per supply in one pass."""
    qty, adjusted = F.col("qty"), F.col("is_adjustment")

    def flow(rule):
        return money(F.coalesce(F.sum(F.when(rule, qty)), F.lit(0)), 18)

    return ledger.groupBy("supply_id").agg(
        flow(~adjusted & (qty >= 0)).alias("received"),
        flow(~adjusted & (qty < 0)).alias("issued"),
        flow(adjusted).alias("adjusted"),
    )


def dish_cost_margin(recipe: DataFrame, offers: DataFrame, dishes: DataFrame) -> DataFrame:
    """Cheapest ingredient cost of every dish against its price. A supply nobody offers makes it NULL."""
    cheapest = offers.groupBy("supply_id").agg(F.min("unit_price").alias("unit_price"))
    priced = recipe.join(cheapest, "supply_id", "left").withColumn("cost", F.col("qty") * F.col("unit_price"))
    cost = F.when(F.count(F.lit(1)) == F.count("cost"), F.sum("cost"))
    costs = priced.groupBy("dish_id").agg(money(cost, 18).alias("cost"))
    return dishes.join(costs, "dish_id").select(
        "dish_id",
        "dish_name",
        money("price", 18).alias("price"),
        "cost",
        money(F.col("price") - F.col("cost"), 18).alias("margin"),
    )


def order_state_counts(orders: DataFrame, dishes: DataFrame) -> DataFrame:
    """Orders per state and need of preparation."""
    counted = orders.groupBy("dish_id", "state").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.join(dishes.select("dish_id", "needs_prep"), "dish_id")
        .groupBy("state", "needs_prep")
        .agg(F.sum("n").alias("orders"))
    )
