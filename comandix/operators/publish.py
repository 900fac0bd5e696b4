"""Batches of requests applied to versioned tables and published as one.

Every function reads the tables of the newest version, decides about all requests, stores one row per request, derives every
other output from the stored rows and publishes all of them with one commit. Requests are read once for all outputs
together; readers see all of a batch or none of it; a batch published before (``version``) is left as it is.

Tables have the names of the model. A table that a batch adds rows to (``stock_ledger``, ``cash_op``, ``sale``) grows by
a part, stock and new rows of a dimension are laid over what was there, and only tables that lose rows are
written whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comandix.functions.expressions import total
from comandix.operators import apply_cash, apply_dims, apply_orders, apply_stock
from comandix.operators.joins import bom_explosion, changed_stock, last_by_key
from comandix.sources.sinks import Outputs, VersionedTables

Tables = Callable[[str], DataFrame]


def _stock(snapshot: DataFrame, rows: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    change = rows.groupBy("supply_id").agg(total("qty").alias("qty"))
    return {"stock_snapshot": (changed_stock(snapshot, change), ["supply_id"])}


def publish_receipts(store: VersionedTables, requests: DataFrame, version: int | None = None) -> int:
    """M2: results in ``receipt_result``, rows in ``stock_ledger``, stock."""

    def decide(at: Tables) -> DataFrame:
        return apply_stock.apply_receipts(requests, at("supply"), at("staff"), at("stock_snapshot")).results

    return store.decided("receipt_result", decide, lambda at, results: _moved(at, results, requests.columns), version)


def publish_issues(store: VersionedTables, requests: DataFrame, order: list[str], version: int | None = None) -> int:
    """M3: results in ``issue_result``, rows in ``stock_ledger``, stock."""

    def decide(at: Tables) -> DataFrame:
        return apply_stock.apply_issues(requests, at("supply"), at("staff"), at("stock_snapshot"), order).results

    return store.decided("issue_result", decide, lambda at, results: _moved(at, results, requests.columns), version)


def _moved(at: Tables, results: DataFrame, columns: list[str]) -> Outputs:
    snapshot = at("stock_snapshot")
    rows = apply_stock.accepted(results, columns, snapshot).ledger_rows.select("supply_id", "qty", "is_adjustment")
    return Outputs(changes=_stock(snapshot, rows), appends={"stock_ledger": rows})


def publish_counts(store: VersionedTables, counted: DataFrame, version: int | None = None) -> int:
    """M4: results in ``count_result``, rows in ``stock_ledger``. The stock's own table is not touched."""

    def derive(at: Tables, results: DataFrame) -> Outputs:
        return Outputs(appends={"stock_ledger": apply_stock.accepted_counts(results, at("stock_ledger")).ledger_rows})

    return store.decided("count_result", lambda at: apply_stock.count_results(counted, at("supply")), derive, version)


def publish_orders(store: VersionedTables, requests: DataFrame, version: int | None = None) -> int:
    """M1: results in ``order_result``, new rows of ``open_order``, stock."""

    def decide(at: Tables) -> DataFrame:
        return apply_orders.apply_orders(requests, at("dish"), at("dining_table"), at("staff"), at("recipe"), at("stock_snapshot")).results

    def derive(at: Tables, results: DataFrame) -> Outputs:
        orders, snapshot = at("open_order"), at("stock_snapshot")
        last = orders.agg(F.coalesce(F.max("order_id"), F.lit(0)).alias("id")).scalar()
        new = apply_orders.accepted_orders(results, at("recipe"), snapshot, last).orders
        new = new.select(*[F.col("ts" if c == "created_at" else c).cast(orders.schema[c].dataType).alias(c) for c in orders.columns])
        used = bom_explosion(results.where("result_code = 1"), at("recipe"))
        taken = used.select("supply_id", (-F.col("qty")).alias("qty"))
        return Outputs(changes={"open_order": (new, ["order_id"]), **_stock(snapshot, taken)})

    return store.decided("order_result", decide, derive, version)


def publish_order_edits(store: VersionedTables, edits: DataFrame, version: int | None = None) -> int:
    """M8: results in ``edit_result``, edited rows of ``open_order``, stock."""

    def decide(at: Tables) -> DataFrame:
        return apply_orders.edit_results(edits, at("dish"), at("dining_table"), at("staff"))

    def derive(at: Tables, results: DataFrame) -> Outputs:
        orders = at("open_order")
        done = apply_orders.accepted_edits(results, orders, at("recipe"), at("stock_snapshot"))
        named = results.where("result_code = 1").select("order_id").distinct()
        edited = done.orders.join(named, "order_id", "left_semi").withColumnRenamed("updated_at", "created_at")
        return Outputs({"stock_snapshot": done.snapshot}, {"open_order": (edited.select(*orders.columns), ["order_id"])})

    return store.decided("edit_result", decide, derive, version)


def publish_order_cancels(store: VersionedTables, cancels: DataFrame, version: int | None = None) -> int:
    """M9: results in ``cancel_result``; ``open_order`` without what went, stock."""

    def decide(at: Tables) -> DataFrame:
        return apply_orders.apply_order_cancels(cancels, at("open_order"), at("recipe"), at("stock_snapshot")).results

    def derive(at: Tables, results: DataFrame) -> Outputs:
        gone = results.where("rows_affected = 1").select("order_id")
        orders = at("open_order")
        back = bom_explosion(orders.join(gone, "order_id", "left_semi"), at("recipe"))
        return Outputs({"open_order": orders.join(gone, "order_id", "left_anti")}, _stock(at("stock_snapshot"), back))

    return store.decided("cancel_result", decide, derive, version)


def publish_cash_ops(store: VersionedTables, requests: DataFrame, version: int | None = None) -> int:
    """M5: results in ``cash_result``, rows in ``cash_op``, the register."""

    def derive(at: Tables, coded: DataFrame) -> Outputs:
        done = apply_cash.accepted_cash_ops(coded, requests.columns, at("register"))
        return Outputs({"register": done.register}, appends={"cash_op": done.cash_ops})

    return store.decided("cash_result", lambda at: apply_cash.coded_cash_ops(requests, at("staff"), at("register")), derive, version)


def publish_table_payments(store: VersionedTables, requests: DataFrame, version: int | None = None) -> int:
    """M6: results in ``payment_result``, rows in ``table_cash_op`` and ``sale``, the open lines and the register."""

    def decide(at: Tables) -> DataFrame:
        coded, _ = apply_orders.coded_payments(requests, at("order_line"), at("dish"), at("staff"), at("register"))
        return coded

    def derive(at: Tables, coded: DataFrame) -> Outputs:
        closed = coded.where("result_code = 1").select("table_no")
        done = apply_orders.settled_payments(coded, closed, at("order_line"), at("dish"), at("register"))
        return Outputs(
            {"register": done.register, "order_line": done.open_orders}, appends={"table_cash_op": done.cash_ops, "sale": done.sales}
        )

    return store.decided("payment_result", decide, derive, version)


def publish_state_changes(store: VersionedTables, events: DataFrame, version: int | None = None) -> int:
    """M7: events in ``order_event``, orders that moved."""

    def derive(at: Tables, stored: DataFrame) -> Outputs:
        newest = apply_orders.latest_states(stored).select("order_id", F.col("state").alias("_state"))
        orders = at("open_order")
        moved = orders.join(newest, "order_id").withColumn("state", F.col("_state")).select(*orders.columns)
        return Outputs(changes={"open_order": (moved, ["order_id"])})

    return store.decided("order_event", lambda at: events, derive, version)


def publish_dimension(
    store: VersionedTables, name: str, changes: DataFrame, key: str, as_of: Column | None = None,
    defaults: dict | None = None, version: int | None = None,
) -> int:
    """M12: requests in ``<name>_change``, inserted and updated rows laid over the table."""

    def derive(at: Tables, stored: DataFrame) -> Outputs:
        table = at(name)
        asked = stored.select(key).where(F.col(key).isNotNull()).distinct()
        touched = table.join(asked, key, "left_semi")
        return Outputs(changes={name: (apply_dims.upsert_dimension(touched, stored, key, as_of, defaults), [key])})

    return store.decided(f"{name}_change", lambda at: changes, derive, version)


def publish_toggles(store: VersionedTables, name: str, requests: DataFrame, key: str, flag: str, version: int | None = None) -> int:
    """M13: requests in ``<name>_toggle``, rows whose flag was set."""

    def derive(at: Tables, stored: DataFrame) -> Outputs:
        table = at(name)
        asked = last_by_key(stored, [key], ["target"]).select(key)
        return Outputs(changes={name: (apply_dims.toggle_flag(table.join(asked, key, "left_semi"), stored, key, flag), [key])})

    return store.decided(f"{name}_toggle", lambda at: requests, derive, version)


def publish_deletes(
    store: VersionedTables, name: str, requests: DataFrame, key: str, children: list[str], version: int | None = None
) -> int:
    """M14: results in ``<name>_delete``; the table without the rows that went."""

    def decide(at: Tables) -> DataFrame:
        return apply_dims.delete_rows(requests, at(name), key, [at(c) for c in children]).results

    def derive(at: Tables, results: DataFrame) -> Outputs:
        return Outputs({name: at(name).join(results.where("rows_affected = 1").select(key), key, "left_anti")})

    return store.decided(f"{name}_delete", decide, derive, version)


def publish_recipe_lines(store: VersionedTables, requests: DataFrame, version: int | None = None) -> int:
    """M15: results in ``recipe_result``, new rows of ``recipe``."""
    pair = ["dish_id", "supply_id"]

    def decide(at: Tables) -> DataFrame:
        return apply_dims.recipe_line_results(requests, at("recipe"), at("dish"), at("supply"))

    def derive(at: Tables, results: DataFrame) -> Outputs:
        kind = at("recipe").schema["qty"].dataType
        return Outputs(changes={"recipe": (results.where("result_code = 1").select(*pair, F.col("qty").cast(kind).alias("qty")), pair)})

    return store.decided("recipe_result", decide, derive, version)
