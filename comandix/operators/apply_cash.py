"""Bulk cash requests: operations of the open register, and sessions from open and close events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix.functions.expressions import first_failure, message_for, money, total
from comandix.operators import hotkeys
from comandix.operators.joins import known_reference


@dataclass(frozen=True)
class CashApplied:
    """A code per request, new cash operations and the register afterwards."""

    results: DataFrame
    cash_ops: DataFrame
    register: DataFrame


def apply_cash_ops(requests: DataFrame, staff: DataFrame, register: DataFrame) -> CashApplied:
    """Operations: 2 amount zero or missing, 3 cashier missing, unknown or disabled, 4 register closed.

    The new balance is one sum over the accepted operations, whatever their order.
    """
    coded = coded_cash_ops(requests, staff, register)
    return accepted_cash_ops(coded, requests.columns, register)


def coded_cash_ops(requests: DataFrame, staff: DataFrame, register: DataFrame) -> DataFrame:
    """Operations with their codes and the open session."""
    session = register.agg(F.max("session_id").alias("id")).scalar()
    checked = known_reference(requests, staff.where("enabled"), "staff_id", "cashier_id", "_cashier")
    code = first_failure(
        (F.coalesce(F.col("amount") == 0, F.lit(True)), 2), (F.col("_cashier").isNull(), 3), (F.col("_session").isNull(), 4)
    )
    return (
        checked.withColumn("_session", session)
        .withColumn("result_code", code)
        .withColumn("message", message_for("cash_operation", "result_code"))
    )


def accepted_cash_ops(coded: DataFrame, columns: list[str], register: DataFrame) -> CashApplied:
    """Operations and register that follow from coded requests, which carry their session."""
    accepted = coded.where("result_code = 1")
    ops = accepted.select("req_id", F.col("_session").alias("session_id"), "amount", "cashier_id", "ts")
    moved = accepted.agg(total("amount").alias("moved")).scalar()
    after = register.select(
        "register_id",
        money(F.col("current_amount") + F.coalesce(moved, F.lit(0)), 18).alias("current_amount"),
        "session_id",
    )
    return CashApplied(coded.select(*columns, "result_code", "message"), ops, after)


def cash_running_balance(
    ops: DataFrame, sessions: DataFrame, order: list[str], hot_rows: int = hotkeys.HOT_ROWS
) -> DataFrame:
    """Amount in the register after every operation, per session, starting from its opening amount."""
    running = hotkeys.running_total(ops.where("session_id IS NOT NULL"), "session_id", order, "amount", "_moved", hot_rows)
    opened = sessions.select("session_id", "opening")
    return running.join(opened, "session_id").withColumn(
        "balance", money(F.col("opening") + F.col("_moved"), 18)
    ).drop("_moved", "opening")


def stock_running_balance(ledger: DataFrame, order: list[str], hot_rows: int = hotkeys.HOT_ROWS) -> DataFrame:
    """Stock after every movement, per supply; nothing is refused."""
    running = hotkeys.running_total(ledger, "supply_id", order, "qty", "balance", hot_rows)
    return running.withColumn("balance", money("balance", 18))


@dataclass(frozen=True)
class SessionsApplied:
    """A code per open, close and operation, and the sessions they make up."""

    results: DataFrame
    sessions: DataFrame


def cash_sessions_from_events(events: DataFrame, hot_rows: int = hotkeys.HOT_ROWS) -> SessionsApplied:
    """Sessions of each register from ordered ``open``, ``close`` and ``op`` events.

    After any open, accepted or not, the register is open; after any close it is closed. So the
    open or close before an event tells whether it is accepted: opening needs a closed register,
    closing and operations an open one. Codes are 2 for a refused open or close, and 4 for an
    operation on a closed register.
    """
    order = ["ts", "req_id"]
    switches = events.where(F.col("action").isin("open", "close"))
    switches = hotkeys.previous(switches, "register_id", order, {"_before": "action"}, hot_rows)
    turned = F.coalesce(F.col("_before"), F.lit("close")) != F.col("action")
    action = F.col("action")
    switches = switches.withColumns(
        {
            "_opens": (turned & (action == "open")).cast("bigint"),
            "_level": F.when(turned, F.when(action == "open", 1).otherwise(-1)).otherwise(0).cast("bigint"),
        }
    ).drop("_before")
    ops = events.where(action == "op").withColumns(
        {"_opens": F.lit(0).cast("bigint"), "_level": F.lit(0).cast("bigint")}
    )
    # One counter carries both: accepted opens in the high part, open or closed in the low part.
    stepped = switches.unionByName(ops).withColumn("_step", F.col("_opens") * 2 + F.col("_level"))
    running = hotkeys.running_total(stepped, "register_id", order, "_step", "_running", hot_rows)
    is_open = F.col("_running") % 2 == 1
    code = (
        F.when(action == "op", F.when(is_open, 1).otherwise(4))
        .when(F.col("_level") != 0, 1)
        .otherwise(2)
        .cast("int")
    )
    coded = running.withColumns(
        {"result_code": code, "session_no": F.floor(F.col("_running") / 2).cast("bigint")}
    )
    message = (
        F.when(action == "open", message_for("open_register", "result_code"))
        .when(action == "close", message_for("close_register", "result_code"))
        .otherwise(message_for("cash_operation", "result_code"))
    )
    accepted = coded.where("result_code = 1")
    first = F.when(action == "open", F.col("amount"))
    last = F.when(action == "close", F.col("amount"))
    opening, moved = F.max(first), F.sum(F.when(action == "op", F.col("amount")))
    sessions = accepted.groupBy("register_id", "session_no").agg(
        money(opening, 18).alias("opening"),
        F.when(F.max(last).isNotNull(), money(opening + F.coalesce(moved, F.lit(0)), 18)).alias("computed"),
        money(F.max(last), 18).alias("entered"),
        F.min(F.when(action == "open", F.col("ts"))).alias("opened_at"),
        F.max(F.when(action == "close", F.col("ts"))).alias("closed_at"),
    )
    return SessionsApplied(coded.select(*events.columns, "result_code", message.alias("message")), sessions)
