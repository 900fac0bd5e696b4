"""Batches of business requests derived from the stored tables, for the bulk operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comandix.functions.expressions import money
from comandix.sources.tables import read_table
from comandix.sources.views import count_of


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    dishes = count_of(read_table(spark, sf_dir, "part"))
    people = count_of(read_table(spark, sf_dir, "supplier"))
    return as_order_requests(read_table(spark, sf_dir, "events"), dishes, people)


def as_order_requests(events: DataFrame, dishes: Column | int, people: Column | int) -> DataFrame:
    """New orders, with unknown dishes, tables and waiters and with no table or waiter among them."""
    return events.select(
        F.col("event_id").alias("req_id"),
        (F.col("event_id") % (dishes + 50)).alias("dish_id"),
        F.nullif(F.col("user_id") % 24, F.lit(0)).alias("table_no"),
        F.nullif(F.col("user_id") % (people + 10), F.lit(0)).alias("waiter_id"),
        F.col("ts"),
    )


def order_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of existing orders: the order id is the request's own id."""
    return order_requests(spark, sf_dir).withColumn("order_id", F.col("req_id"))


def order_cancels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"), (F.col("event_id") * 2).alias("order_id")
    )


def movement_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_movements(read_table(spark, sf_dir, "lineitem"))


def as_movements(lineitem: DataFrame) -> DataFrame:
    """Stock movements in one sequence: receipts positive, issues negative."""
    receipt = F.col("l_returnflag") == "R"
    return lineitem.select(
        F.col("l_orderkey").alias("req_ref"),
        F.col("l_linenumber").alias("req_line"),
        F.col("l_partkey").alias("supply_id"),
        F.col("l_suppkey").alias("keeper_id"),
        money(F.when(receipt, F.col("l_quantity")).otherwise(-F.col("l_quantity")), 8).alias("qty"),
        F.col("l_shipdate").alias("ts"),
        money("l_extendedprice").alias("req_value"),
    )


def sent_again(movements: DataFrame, attempts: list[int]) -> DataFrame:
    """Each movement once per attempt; all but attempt 0 say another quantity under the same id."""
    each = movements.withColumn("attempt", F.explode(F.array(*[F.lit(a) for a in attempts])))
    return each.withColumn("qty", (F.col("qty") + F.col("attempt")).cast(movements.schema["qty"].dataType))


MOVEMENT_KEY = ["req_ref", "req_line", "supply_id", "keeper_id", "ts", "req_value"]
MOVEMENT_ORDER = ["ts", "req_ref", "req_line", "keeper_id", "req_value"]


def receipt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts; line 7 names an unknown supply and a quantity of one becomes zero."""
    parts = count_of(read_table(spark, sf_dir, "part"))
    unknown = F.col("l_linenumber") == 7
    return (
        read_table(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .select(
            F.col("l_orderkey").alias("req_ref"),
            F.col("l_linenumber").alias("req_line"),
            F.when(unknown, F.col("l_partkey") + parts).otherwise(F.col("l_partkey")).alias("supply_id"),
            F.col("l_suppkey").alias("keeper_id"),
            money(F.col("l_quantity") - 1, 8).alias("qty"),
        )
    )


def _each(table: DataFrame, *rows: dict[str, Column]) -> DataFrame:
    """For each row of a table, the given rows in turn."""
    made = F.explode(F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]))
    return table.select(made.alias("_row")).select("_row.*")


def counts(supplies: DataFrame) -> DataFrame:
    """Counts of every supply: five more than the minimum, none, the minimum; then of supplies unknown and not named."""
    req, supply, least = F.col("supply_id") * 5, F.col("supply_id"), F.col("min_qty")
    none = F.lit(None)
    return _each(
        supplies,
        {"req_id": req, "supply_id": supply, "counted": (least + 5).cast("decimal(8,2)")},
        {"req_id": req + 1, "supply_id": supply, "counted": none.cast("decimal(8,2)")},
        {"req_id": req + 2, "supply_id": supply, "counted": least.cast("decimal(8,2)")},
        {"req_id": req + 3, "supply_id": -supply - 1, "counted": least.cast("decimal(8,2)")},
        {"req_id": req + 4, "supply_id": none.cast("bigint"), "counted": least.cast("decimal(8,2)")},
    )


def cash_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash operations: money in, money out, and zero amounts."""
    people = count_of(read_table(spark, sf_dir, "supplier"))
    kind = F.col("event_type")
    amount = F.when(kind == "purchase", F.col("value")).when(kind == "click", -F.col("value")).otherwise(F.lit(0.0))
    return (
        read_table(spark, sf_dir, "events")
        .where(kind.isin("purchase", "click", "error"))
        .select(
            F.col("event_id").alias("req_id"),
            money(amount).alias("amount"),
            F.nullif(F.col("user_id") % (people + 10), F.lit(0)).alias("cashier_id"),
            "ts",
        )
    )


def payment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of tables, some of them repeated, unknown or without a table."""
    return read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("req_id"),
        F.nullif(F.col("s_suppkey") % 24, F.lit(0)).alias("table_no"),
        F.col("s_suppkey").alias("cashier_id"),
    )


def register_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opens, closes and cash operations of many registers."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "open").when(kind == "purchase", "close").when(kind == "click", "op")
    return (
        read_table(spark, sf_dir, "events")
        .where(kind.isin("signup", "purchase", "click"))
        .select(
            F.col("event_id").alias("req_id"),
            F.col("user_id").alias("register_id"),
            action.alias("action"),
            money("value").alias("amount"),
            "ts",
        )
    )


def dish_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dishes to insert or update: each first with other values, then with its own, and a change that names no dish."""
    own = {
        "dish_name": F.col("c_name"),
        "price": money(F.abs("c_acctbal")),
        "active": F.col("c_acctbal") >= 0,
        "needs_prep": F.col("c_mktsegment") == "BUILDING",
    }
    first = {"dish_name": F.concat(F.lit("zz"), F.col("c_name")), "price": money(F.abs("c_acctbal") + 1), "active": ~own["active"], "needs_prep": F.lit(True)}
    req, dish = F.col("c_custkey") * 3, F.col("c_custkey") * 2
    return _each(
        read_table(spark, sf_dir, "customer"),
        {"req_id": req, "dish_id": dish, **first},
        {"req_id": req + 1, "dish_id": dish, **own},
        {"req_id": req + 2, "dish_id": F.lit(None).cast("bigint"), **first},
    )


def staff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff to insert or update; some name a role that does not exist."""
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"),
        F.col("c_custkey").alias("staff_id"),
        F.col("c_name").alias("username"),
        (F.col("c_nationkey") % 7).alias("role_id"),
    )


def dish_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dish_changes(spark, sf_dir).select("req_id", "dish_id", F.col("active").alias("target"))


def staff_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff to activate or deactivate, with unknown people and administrators among them."""
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"),
        F.col("c_custkey").alias("staff_id"),
        (F.col("c_acctbal") > 5000).alias("target"),
    )


def dish_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"), (F.col("c_custkey") * 3).alias("dish_id")
    )


def staff_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"), F.col("c_custkey").alias("staff_id")
    )


def recipe_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipe lines to add, with unknown dishes and repeated lines among them."""
    dishes = count_of(read_table(spark, sf_dir, "part"))
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"),
        (F.col("event_id") % (dishes + 50)).alias("dish_id"),
        F.col("user_id").alias("supply_id"),
        money("value", 5).alias("qty"),
    )


def unlink_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplies to unlink from one vendor, or from all where no vendor is named."""
    vendors = count_of(read_table(spark, sf_dir, "supplier"))
    return (
        read_table(spark, sf_dir, "customer")
        .select(
            F.when(F.col("c_acctbal") >= 0, F.col("c_custkey") % vendors).alias("vendor_id"),
            F.col("c_custkey").alias("supply_id"),
        )
    )


def new_linked_supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New supplies, each offered by a vendor."""
    vendors = count_of(read_table(spark, sf_dir, "supplier"))
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"),
        (F.col("c_custkey") % vendors).alias("vendor_id"),
        F.col("c_name").alias("supply_name"),
        money(F.abs("c_acctbal"), 8).alias("min_qty"),
    )


LEDGER_KEY = ["ledger_ref", "ledger_line", "supply_id", "keeper_id", "created_at", "ledger_value"]


def ledger_edits(ledger: DataFrame) -> DataFrame:
    """Receipts whose quantity is to become nine, and then one."""
    key = {c: F.col(c) for c in LEDGER_KEY}
    return _each(
        ledger.where((F.col("ledger_line") == 6) & (F.col("qty") > 0)),
        {"req_id": F.lit(1), **key, "new_qty": money(F.lit(9), 8)},
        {"req_id": F.lit(2), **key, "new_qty": money(F.lit(1), 8)},
    )


def ledger_deletes(ledger: DataFrame) -> DataFrame:
    """Ledger rows to delete: issues give their stock back, receipts leave it as it is. Each is asked for twice, the
    second time the other way round, when the row is gone."""
    key, issue = {c: F.col(c) for c in LEDGER_KEY}, F.col("qty") < 0
    return _each(
        ledger.where(F.col("ledger_line") == 7),
        {"req_id": F.lit(1), **key, "reverse_stock": issue},
        {"req_id": F.lit(2), **key, "reverse_stock": ~issue},
    )
