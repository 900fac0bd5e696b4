"""The model's tables as views of the stored star-schema tables.

Money arrives as double with exact cents and becomes decimal before any arithmetic. Every view
is a narrow projection, so only the columns a query uses are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comandix import model
from comandix.functions.expressions import money, total
from comandix.operators import hotkeys
from comandix.sources.tables import read_table

View = Callable[[SparkSession, str], DataFrame]


def count_of(df: DataFrame) -> Column:
    """Row count of a table as a value, computed once per query."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def dish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dish_id"),
        F.col("p_name").alias("dish_name"),
        money("p_retailprice").alias("price"),
        (F.col("p_size") > 5).alias("active"),
        (F.col("p_size") % 2 == 1).alias("needs_prep"),
    )


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("supply_id"),
        F.col("p_name").alias("supply_name"),
        money(F.col("p_size") * 10, 8).alias("min_qty"),
    )


def stock_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_stock_ledger(read_table(spark, sf_dir, "lineitem"))


def as_stock_ledger(lineitem: DataFrame) -> DataFrame:
    """Ledger rows from line items; works on a table and on a stream."""
    issue = F.col("l_returnflag") == "A"
    return lineitem.select(
        F.col("l_orderkey").alias("ledger_ref"),
        F.col("l_linenumber").alias("ledger_line"),
        F.col("l_partkey").alias("supply_id"),
        F.col("l_suppkey").alias("keeper_id"),
        money(F.when(issue, -F.col("l_quantity")).otherwise(F.col("l_quantity")), 8).alias("qty"),
        ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("is_adjustment"),
        F.col("l_shipdate").alias("created_at"),
        money("l_extendedprice").alias("ledger_value"),
    )


LEDGER_ORDER = ["created_at", "ledger_ref", "ledger_line", "keeper_id", "ledger_value"]


def stock_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stock_ledger(spark, sf_dir).where(~F.col("is_adjustment"))
    return ledger.groupBy("supply_id").agg(total("qty").alias("qty"))


def sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("dish_id"),
        F.nullif(F.col("l_suppkey") % 10, F.lit(0)).alias("waiter_id"),
        money("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("created_at"),
    )


def order_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = (
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), model.PENDING)
        .when(F.col("l_returnflag") == "N", model.IN_PREPARATION)
        .when(F.col("l_returnflag") == "R", model.READY)
        .otherwise(model.DELIVERED)
    )
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("dish_id"),
        F.nullif(F.col("l_suppkey") % 20, F.lit(0)).alias("table_no"),
        F.nullif(F.col("l_suppkey") % 10, F.lit(0)).alias("waiter_id"),
        state.alias("state"),
    )


def open_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a unique id, one dish each, for edits, cancels and state changes."""
    dishes = count_of(read_table(spark, sf_dir, "part"))
    state = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), model.PENDING)
        .when(F.col("o_orderpriority") == "2-HIGH", model.IN_PREPARATION)
        .when(F.col("o_orderpriority") == "3-MEDIUM", model.READY)
        .otherwise(model.DELIVERED)
    )
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        ((F.col("o_orderkey") * 31 + F.col("o_custkey")) % dishes).alias("dish_id"),
        F.nullif(F.col("o_custkey") % 20, F.lit(0)).alias("table_no"),
        F.nullif(F.col("o_custkey") % 10, F.lit(0)).alias("waiter_id"),
        state.alias("state"),
        F.col("o_orderdate").alias("created_at"),
    )


def dining_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = read_table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("table_no"))
    return numbers.where("table_no <> 0").distinct().select("table_no", (F.col("table_no") % 4 != 0).alias("active"))


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("staff_id"),
        F.col("s_name").alias("username"),
        (F.col("s_nationkey") % 6).alias("role_id"),
        (F.col("s_acctbal") >= 0).alias("enabled"),
    )


def role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).alias("role_id"), F.col("r_name").alias("role_name")
    )


def vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name")
    )


def offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price a vendor has asked for a supply."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("vendor_id"),
        F.col("l_partkey").alias("supply_id"),
        money("l_extendedprice").alias("unit_price"),
    )


def vendor_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest price per vendor and supply. Few offers share both, so they are dealt out as they are."""
    return hotkeys.spread(offer(spark, sf_dir), "vendor_id", "supply_id").groupBy("vendor_id", "supply_id").agg(F.min("unit_price").alias("unit_price"))


def recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    lines = part.select("p_partkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return lines.select(
        F.col("p_partkey").alias("dish_id"),
        ((F.col("p_partkey") * 7 + F.col("k") * 13) % count_of(part)).alias("supply_id"),
        money(F.col("k") + 1, 5).alias("qty"),
    )


def cash_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    closing = money("o_totalprice")
    entered = (
        F.when(F.col("o_orderstatus") == "O", None)
        .when(F.col("o_orderstatus") == "P", closing - 1)
        .otherwise(closing)
    )
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        money(F.lit(100)).alias("opening"),
        closing.alias("computed"),
        money(entered).alias("entered"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def cash_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid_out = F.col("l_returnflag") == "A"
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").alias("op_line"),
        money(F.when(paid_out, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))).alias("amount"),
        F.col("l_suppkey").alias("cashier_id"),
        F.col("l_partkey").alias("op_ref"),
        F.col("l_shipdate").alias("created_at"),
    )


CASH_OP_ORDER = ["created_at", "op_line", "op_ref", "cashier_id", "amount"]


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one register, open on the newest session."""
    return (
        read_table(spark, sf_dir, "orders")
        .agg(
            F.max("o_orderkey").alias("session_id"),
            F.max_by(money("o_totalprice"), "o_orderkey").alias("current_amount"),
        )
        .select(F.lit(1).alias("register_id"), "current_amount", "session_id")
    )


def order_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_order_events(read_table(spark, sf_dir, "events"))


def as_order_events(events: DataFrame) -> DataFrame:
    """Order events from raw events; works on a table and on a stream."""
    kind = F.col("event_type")
    state = (
        F.when(kind == "signup", model.PENDING)
        .when(kind.isin("view", "click"), model.IN_PREPARATION)
        .when(kind == "purchase", model.READY)
        .when(kind == "error", model.DELIVERED)
    )
    return events.select("event_id", "ts", F.col("user_id").alias("order_id"), state.alias("state"))


def as_stream_events(events: DataFrame) -> DataFrame:
    """The same with instants, which watermarks need."""
    return as_order_events(events).withColumn("ts", F.col("ts").cast("timestamp"))


VIEWS: dict[str, View] = {
    view.__name__: view
    for view in (
        dish,
        supply,
        stock_ledger,
        stock_snapshot,
        sale,
        order_line,
        open_order,
        dining_table,
        staff,
        role,
        vendor,
        offer,
        vendor_supply,
        recipe,
        cash_session,
        cash_op,
        register,
        order_event,
    )
}


def register_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Make the model's tables known to SQL under their own names."""
    for name in names or VIEWS:
        VIEWS[name](spark, sf_dir).createOrReplaceTempView(name)
