"""Every operator bound to the stored tables, by name.

Each entry takes (spark, sf_dir) and returns a DataFrame over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comandix import model
from comandix.functions import expressions as E
from comandix.operators import (
    aggregates,
    apply_cash,
    apply_dims,
    apply_orders,
    apply_stock,
    audits,
    hotkeys,
    joins,
    lists,
    publish,
)
from comandix.plans import sql_functions
from comandix.session import work_dir
from comandix.sources import requests, sinks, tables, views
from comandix.streaming import boards, jobs

Query = Callable[[SparkSession, str], DataFrame]

EVER = ("1900-01-01", "2100-01-01")
YEAR = ("1996-01-01", "1996-12-31")
EVENT_DAYS = ("2024-01-10", "2024-01-12")
DAY = "2024-01-10"


class Tables:
    """The model's tables, and the request batches, of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        source = views.VIEWS.get(name) or getattr(requests, name)
        table = source(self.spark, self.sf_dir)
        setattr(self, name, table)
        return table

    def stored(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, self.sf_dir, name)


CATALOG: dict[str, Query] = {}


def query(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Add a query on the model's tables to the catalogue under its own name."""
    CATALOG[function.__name__.rstrip("_")] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
    return function


# Sources and sinks


@query
def read_table(t):
    return t.stock_ledger


@query
def load_seed(t):
    path = work_dir(t.spark, "seed")
    people = t.staff.select("staff_id", "role_id", "username", F.col("enabled").cast("int").alias("enabled"))
    people.write.csv(path, header=True)
    return tables.load_seed(t.spark, path, "staff")


@query
def order_event_stream(t):
    path = work_dir(t.spark, "stream")
    jobs.run_to_files(tables.order_event_stream(t.spark, t.sf_dir), f"{path}/out", f"{path}/checkpoint")
    return views.as_order_events(t.spark.read.schema(tables.STORED_SCHEMAS["events"]).parquet(f"{path}/out"))


@query
def json_envelope(t):
    priced = t.dish.select("dish_id", "dish_name", F.col("price").cast("string").alias("price"), "active")
    return sinks.json_envelope(priced)


@query
def append_ledger(t):
    path = work_dir(t.spark, "ledger")
    applied = apply_stock.apply_receipts(t.receipt_requests, t.supply, t.staff, _minimum_stock(t))
    rows = applied.ledger_rows.select("supply_id", "qty")
    sinks.append_ledger(t.stock_ledger.select("supply_id", "qty"), path, "0")
    sinks.append_ledger(rows, path, "1")
    sinks.append_ledger(rows, path, "1")
    ledger = sinks.read_ledger(t.spark, path)
    return ledger.groupBy("batch", "supply_id").agg(
        F.count(F.lit(1)).alias("rows"), E.total("qty").alias("qty")
    ).withColumn("batch", F.col("batch").cast("int"))


@query
def replace_snapshot(t):
    path = work_dir(t.spark, "stock")
    sinks.replace_snapshot(t.spark, path, "stock", t.stock_snapshot)
    current = sinks.VersionedTables(t.spark, path).read("stock")
    after = joins.add_to_stock(current, joins.bom_explosion(t.order_line, t.recipe))
    return sinks.replace_snapshot(t.spark, path, "stock", after)


@query
def chart_series(t):
    days = aggregates.sales_by_day(t.cash_session, *EVER).select(
        F.substring("day", 1, 4).alias("year"), "day", F.coalesce(F.col("total").cast("string"), F.lit("")).alias("total")
    )
    series = sinks.chart_series(days, "day", "total", by="year")
    return series.select(
        "year", F.array_join("labels", ",").alias("labels"), F.array_join("values", ",").alias("amounts")
    )


# Lists


@query
def list_supplies(t):
    return lists.list_supplies(t.supply)


@query
def list_dishes(t):
    return lists.list_dishes(t.dish)


@query
def list_tables(t):
    return lists.list_tables(t.dining_table)


@query
def list_suppliers(t):
    return lists.list_vendors(t.vendor)


@query
def list_roles(t):
    return lists.list_roles(t.role)


@query
def register_state(t):
    return lists.register_state(t.register)


@query
def lookup_by_key(t):
    return lists.lookup_by_key(t.order_requests, t.dish, "dish_id")


@query
def orders_for_table(t):
    return lists.orders_for_table(t.order_line, t.dish, None)


@query
def kitchen_in_preparation(t):
    return lists.kitchen_in_preparation(t.order_line, t.dish)


@query
def kitchen_ready(t):
    return lists.kitchen_ready(t.order_line, t.dish)


@query
def kitchen_pending_prep(t):
    return lists.kitchen_pending_prep(t.order_line, t.dish)


@query
def kitchen_pending_noprep(t):
    return lists.kitchen_pending_noprep(t.order_line, t.dish)


@query
def kitchen_board(t):
    return lists.kitchen_board(t.order_line, t.dish)


@query
def stock_receipts(t):
    return lists.stock_receipts(t.stock_ledger, t.supply)


@query
def stock_issues(t):
    return lists.stock_issues(t.stock_ledger, t.supply)


@query
def stock_receipt_by_id(t):
    keys = t.stored("events").select(F.col("event_id").alias("ledger_ref"))
    return lists.stock_receipts_by_ids(keys, t.stock_ledger, t.supply)


@query
def stock_adjustments(t):
    return lists.stock_adjustments(t.stock_ledger, t.supply)


@query
def order_by_id(t):
    keys = t.stored("events").select(F.col("event_id").alias("order_id"))
    return lists.orders_by_ids(keys, t.order_line, t.dish)


@query
def selectable_dishes(t):
    return lists.selectable_dishes(t.dish)


@query
def selectable_tables(t):
    return lists.selectable_tables(t.dining_table)


@query
def editable_orders(t):
    return lists.editable_orders(t.order_line)


# Joins


@query
def orders_with_dish(t):
    return joins.orders_with_dish(t.order_line, t.dish)


@query
def recipe_lines(t):
    return joins.recipe_lines(t.recipe, t.dish, t.supply)


@query
def supplier_supplies(t):
    return joins.supplier_supplies(t.vendor, t.vendor_supply, t.supply)


@query
def table_consumption(t):
    return joins.table_consumption(t.order_line, t.dish, t.staff)


@query
def list_users(t):
    return joins.list_users(t.staff, t.role)


@query
def semi_active_refs(t):
    return joins.semi_active_refs(t.order_requests, t.dish, t.dining_table, t.staff)


@query
def anti_unknown_refs(t):
    return joins.anti_unknown_refs(t.order_requests, t.dish, t.dining_table, t.staff)


@query
def bom_explosion(t):
    return joins.bom_explosion(t.order_line, t.recipe)


@query
def bom_release(t):
    return joins.bom_release(t.stock_snapshot, lists.editable_orders(t.order_line), t.recipe)


@query
def current_session_ops(t):
    return joins.current_session_ops(t.cash_op, t.register, ["op_line", "op_ref", "cashier_id", "amount"])


@query
def sales_with_dish(t):
    return joins.sales_with_dish(t.sale, t.dish)


@query
def ledger_vs_snapshot(t):
    return joins.ledger_vs_snapshot(t.stock_ledger, t.stock_snapshot)


@query
def cash_reconciliation(t):
    return joins.cash_reconciliation(t.cash_session, t.cash_op)


# Totals and reports


@query
def stock_on_hand(t):
    return aggregates.stock_on_hand(t.stock_ledger, t.supply)


@query
def stock_totals(t):
    return aggregates.stock_totals(t.stock_ledger, t.supply)


@query
def stock_of_supply(t):
    keys = t.order_requests.select(F.col("dish_id").alias("supply_id"))
    return aggregates.stock_of_supplies(keys, t.stock_ledger, t.supply)


@query
def stock_status(t):
    return aggregates.stock_status(t.stock_ledger, t.supply)


@query
def sales_by_day(t):
    return aggregates.sales_by_day(t.cash_session, *EVER)


@query
def sales_by_day_in_range(t):
    return aggregates.sales_by_day(t.cash_session, *YEAR)


@query
def sales_by_dish(t):
    return aggregates.sales_by_dish(t.sale, t.dish, *EVER)


@query
def sales_by_dish_in_range(t):
    return aggregates.sales_by_dish(t.sale, t.dish, *YEAR)


@query
def register_closings(t):
    return aggregates.register_closings(t.cash_session, *EVER)


@query
def register_closings_in_range(t):
    return aggregates.register_closings(t.cash_session, *YEAR, inclusive_end=True)


@query
def orders_by_hour(t):
    return aggregates.orders_by_hour(t.order_event, DAY)


@query
def orders_by_day_and_hour(t):
    return aggregates.orders_by_day_and_hour(t.order_event)


@query
def events_between_days(t):
    """The two readings of a range's last day side by side."""
    return t.order_event.agg(
        F.count(F.when(E.within_days("ts", *EVENT_DAYS), 1)).alias("midnight_end"),
        F.count(F.when(E.within_days("ts", *EVENT_DAYS, inclusive_end=True), 1)).alias("inclusive_end"),
    )


@query
def table_bill(t):
    return aggregates.table_bill(t.order_line, t.dish)


@query
def admin_guard(t):
    return aggregates.admin_guard(t.staff)


@query
def sales_by_waiter(t):
    return aggregates.sales_by_waiter(t.sale)


@query
def stock_flow_by_class(t):
    return aggregates.stock_flow_by_class(t.stock_ledger)


@query
def dish_cost_margin(t):
    return aggregates.dish_cost_margin(t.recipe, t.offer, t.dish)


@query
def order_state_counts(t):
    return aggregates.order_state_counts(t.order_line, t.dish)


# Ordered work


@query
def cash_running_balance(t):
    return apply_cash.cash_running_balance(t.cash_op, t.cash_session, views.CASH_OP_ORDER)


@query
def stock_running_balance(t):
    return apply_cash.stock_running_balance(t.stock_ledger, views.LEDGER_ORDER)


@query
def row_index(t):
    return hotkeys.row_index(aggregates.sales_by_day(t.cash_session, *EVER), ["day"])


@query
def assign_ids(t):
    last = t.open_order.agg(F.max("order_id").alias("id")).scalar()
    return hotkeys.assign_ids(t.order_requests.select("req_id"), "req_id", "order_id", last)


# Expressions


@query
def date_expressions(t):
    ts = F.col("ts")
    return t.order_event.select(
        "event_id",
        E.hour_of(ts).alias("hour"),
        E.day_of(ts).alias("day"),
        E.day_text(ts).alias("day_text"),
        E.day_label(ts).alias("day_label"),
        E.parse_day_label(E.day_label(ts)).alias("day_again"),
        E.clock_text(ts).alias("clock"),
        E.within_days(ts, *EVENT_DAYS).alias("in_range"),
        E.on_day(ts, DAY).alias("on_day"),
    )


@query
def money_expressions(t):
    amount = F.col("amount")
    return t.cash_op.select(
        "session_id",
        "op_line",
        amount,
        E.money(-amount, 18).alias("turned"),
        (amount + F.lit("10.25").cast("decimal(4,2)")).cast("decimal(18,2)").alias("raised"),
        (amount * F.lit("1.5").cast("decimal(2,1)")).cast("decimal(18,3)").alias("scaled"),
        amount.cast("decimal(12,1)").alias("one_decimal"),
        E.fixed2(amount).alias("shown"),
        E.direction(amount).alias("direction"),
        F.abs(amount).alias("size"),
    )


@query
def label_expressions(t):
    return t.order_requests.select(
        "req_id",
        E.table_label("table_no").alias("table_label"),
        E.payment_text("table_no").alias("payment_text"),
        E.message_for("order", (F.col("req_id") % 5).cast("int")).alias("message"),
        E.to_number(F.when(F.col("waiter_id").isNull(), "none").otherwise(F.col("waiter_id").cast("string"))).alias(
            "waiter_number"
        ),
    )


@query
def clean_strings(t):
    raw = t.supply.select(
        "supply_id",
        F.when(F.col("min_qty") <= 50, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), "supply_name", F.lit(" \n"))).alias(
            "supply_name"
        ),
    )
    return E.clean_strings(raw)


@query
def hide_sensitive(t):
    secret = t.staff.withColumns({name: F.col("username") for name in model.SENSITIVE_COLUMNS})
    return E.hide_sensitive(secret)


# Bulk requests


def _minimum_stock(t) -> DataFrame:
    """Stock before the first request: every supply at its minimum."""
    return t.supply.select("supply_id", F.col("min_qty").alias("qty"))


def _orders_applied(t):
    last = t.open_order.agg(F.max("order_id").alias("id")).scalar()
    return apply_orders.apply_orders(
        t.order_requests, t.dish, t.dining_table, t.staff, t.recipe, t.stock_snapshot, last
    )


@query
def apply_orders_(t):
    return _orders_applied(t).results


@query
def apply_orders_new_lines(t):
    return _orders_applied(t).orders


@query
def apply_orders_stock(t):
    return _orders_applied(t).snapshot


def _receipts_applied(t):
    return apply_stock.apply_receipts(t.receipt_requests, t.supply, t.staff, _minimum_stock(t))


@query
def apply_receipts(t):
    return _receipts_applied(t).results


@query
def apply_receipts_stock(t):
    return _receipts_applied(t).snapshot


def _issues_applied(t):
    return apply_stock.apply_issues(
        t.movement_requests, t.supply, t.staff, _minimum_stock(t), requests.MOVEMENT_ORDER
    )


@query
def apply_issues(t):
    return _issues_applied(t).results


@query
def apply_issues_stock(t):
    return _issues_applied(t).snapshot


@query
def apply_adjustments(t):
    return apply_stock.apply_adjustments(requests.counts(t.supply), t.stock_ledger, t.supply)


@query
def apply_adjustments_results(t):
    return apply_stock.adjust_to_counts(requests.counts(t.supply), t.stock_ledger, t.supply).results


@query
def apply_cash_ops(t):
    return apply_cash.apply_cash_ops(t.cash_requests, t.staff, t.register).results


@query
def apply_cash_ops_register(t):
    return apply_cash.apply_cash_ops(t.cash_requests, t.staff, t.register).register


def _payments_applied(t):
    return apply_orders.apply_table_payments(t.payment_requests, t.order_line, t.dish, t.staff, t.register)


@query
def apply_table_payments(t):
    return _payments_applied(t).results


@query
def apply_table_payments_ops(t):
    return _payments_applied(t).cash_ops


@query
def apply_table_payments_sales(t):
    return _payments_applied(t).sales


@query
def apply_table_payments_open(t):
    return _payments_applied(t).open_orders


@query
def apply_table_payments_register(t):
    return _payments_applied(t).register


@query
def apply_state_changes(t):
    return apply_orders.apply_state_changes(t.order_event, t.open_order)


@query
def state_jumps(t):
    return apply_orders.state_jumps(t.order_event)


def _edits_applied(t):
    return apply_orders.apply_order_edits(
        t.order_edits, t.open_order, t.dish, t.dining_table, t.staff, t.recipe, t.stock_snapshot
    )


@query
def apply_order_edits(t):
    return _edits_applied(t).results


@query
def apply_order_edits_orders(t):
    return _edits_applied(t).orders


@query
def apply_order_edits_stock(t):
    return _edits_applied(t).snapshot


def _cancels_applied(t):
    return apply_orders.apply_order_cancels(t.order_cancels, t.open_order, t.recipe, t.stock_snapshot)


@query
def apply_order_cancels(t):
    return _cancels_applied(t).results


@query
def apply_order_cancels_orders(t):
    return _cancels_applied(t).orders


@query
def apply_order_cancels_stock(t):
    return _cancels_applied(t).snapshot


def _corrected(t):
    ledger = t.stock_ledger
    return apply_stock.apply_ledger_corrections(
        ledger, t.stock_snapshot, requests.ledger_edits(ledger), requests.ledger_deletes(ledger), requests.LEDGER_KEY
    )


@query
def apply_ledger_corrections(t):
    return _corrected(t).ledger


@query
def apply_ledger_corrections_stock(t):
    return _corrected(t).snapshot


@query
def register_event_codes(t):
    return apply_cash.cash_sessions_from_events(t.register_events).results


@query
def cash_sessions_from_events(t):
    return apply_cash.cash_sessions_from_events(t.register_events).sessions


@query
def upsert_dimension(t):
    return apply_dims.upsert_dimension(t.dish, t.dish_changes, "dish_id")


@query
def upsert_staff(t):
    return apply_dims.apply_staff_changes(t.staff_changes, t.staff, t.role).table


@query
def upsert_staff_results(t):
    return apply_dims.apply_staff_changes(t.staff_changes, t.staff, t.role).results


@query
def toggle_flags(t):
    return apply_dims.toggle_flag(t.dish, t.dish_toggles, "dish_id", "active")


@query
def toggle_staff(t):
    return apply_dims.toggle_staff(t.staff_toggles, t.staff).table


@query
def toggle_staff_results(t):
    return apply_dims.toggle_staff(t.staff_toggles, t.staff).results


def _dishes_deleted(t):
    grown = apply_dims.upsert_dimension(t.dish, t.dish_changes, "dish_id")
    return apply_dims.delete_rows(t.dish_deletes, grown, "dish_id", [t.recipe, t.open_order])


@query
def delete_rows(t):
    return _dishes_deleted(t).table


@query
def delete_rows_results(t):
    return _dishes_deleted(t).results


def _supplies_deleted(t):
    linked = apply_dims.link_new_supplies(t.new_linked_supplies, t.supply)
    grown = t.supply.unionByName(linked.supplies)
    stock = _minimum_stock(t).unionByName(linked.stock_rows)
    asked = t.dish_deletes.select("req_id", F.col("dish_id").alias("supply_id"))
    return apply_dims.delete_supplies(asked, grown, stock, [t.recipe, t.offer])


@query
def delete_supplies(t):
    return _supplies_deleted(t)[0].table


@query
def delete_supplies_stock(t):
    return _supplies_deleted(t)[1]


@query
def delete_staff(t):
    return apply_dims.delete_staff(t.staff_deletes, t.staff).results


@query
def delete_staff_remaining(t):
    return apply_dims.delete_staff(t.staff_deletes, t.staff).table


@query
def upsert_bridge(t):
    return apply_dims.add_recipe_lines(t.recipe_additions, t.recipe, t.dish, t.supply).table


@query
def upsert_bridge_results(t):
    return apply_dims.add_recipe_lines(t.recipe_additions, t.recipe, t.dish, t.supply).results


@query
def remove_recipe_lines(t):
    return apply_dims.remove_recipe_lines(t.recipe_additions, t.recipe)


@query
def unlink_supplies(t):
    return apply_dims.unlink_supplies(t.unlink_requests, t.vendor_supply)


@query
def add_supplies(t):
    added = apply_dims.add_supplies(t.new_linked_supplies, t.supply)
    return t.supply.unionByName(added.supplies).join(
        _minimum_stock(t).unionByName(added.stock_rows), "supply_id"
    )


@query
def link_new_supplies(t):
    linked = apply_dims.link_new_supplies(t.new_linked_supplies, t.supply)
    return linked.supplies.join(linked.offers, "supply_id").join(linked.stock_rows, "supply_id")


# Batches published as one version


def _store(t, **given: DataFrame) -> sinks.VersionedTables:
    store = sinks.VersionedTables(t.spark, work_dir(t.spark, "published"))
    store.publish(given)
    return store


@query
def publish_receipts(t):
    store = _store(t, supply=t.supply, staff=t.staff, stock_snapshot=_minimum_stock(t))
    publish.publish_receipts(store, t.receipt_requests)
    return store.read("stock_snapshot")


@query
def publish_table_payments(t):
    store = _store(t, order_line=t.order_line, dish=t.dish, staff=t.staff, register=t.register)
    publish.publish_table_payments(store, t.payment_requests)
    return store.read("sale")


@query
def publish_order_edits(t):
    store = _store(
        t, open_order=t.open_order, dish=t.dish, dining_table=t.dining_table, staff=t.staff, recipe=t.recipe, stock_snapshot=t.stock_snapshot
    )
    publish.publish_order_edits(store, t.order_edits)
    return store.read("stock_snapshot")


@query
def publish_dishes(t):
    """New and changed dishes, then deletes, as two versions."""
    store = _store(t, dish=t.dish, recipe=t.recipe, open_order=t.open_order)
    publish.publish_dimension(store, "dish", t.dish_changes, "dish_id")
    publish.publish_deletes(store, "dish", t.dish_deletes, "dish_id", ["recipe", "open_order"])
    return store.read("dish")


# Audits


@query
def audit_primary_keys(t):
    return audits.audit_keys(
        {
            "dish": (t.dish, ["dish_id"]),
            "supply": (t.supply, ["supply_id"]),
            "staff": (t.staff, ["staff_id"]),
            "role": (t.role, ["role_id"]),
            "dining_table": (t.dining_table, ["table_no"]),
            "vendor_supply": (t.vendor_supply, ["vendor_id", "supply_id"]),
            "recipe": (t.recipe, ["dish_id", "supply_id"]),
            "cash_session": (t.cash_session, ["session_id"]),
            "open_order": (t.open_order, ["order_id"]),
            "order_event": (t.order_event, ["event_id"]),
            "order_line": (t.order_line, ["order_id", "line_no"]),
            "stock_ledger": (t.stock_ledger, requests.LEDGER_KEY),
        }
    )


@query
def audit_foreign_keys(t):
    return audits.audit_foreign_keys(_references(t))


def _references(t) -> list[audits.Source]:
    """What the model's tables refer to, by the stored table that each is made from."""
    R, c = audits.Reference, F.col
    part, supplier, events = t.stored("part"), t.stored("supplier"), t.stored("events")
    dishes, people = views.count_of(part), views.count_of(supplier)
    waiter, table = F.nullif(c("l_suppkey") % 10, F.lit(0)), F.nullif(c("l_suppkey") % 20, F.lit(0))
    settled = ~((c("l_returnflag") == "N") & (c("l_linestatus") == "O"))
    lines = {
        "stock_ledger.supply": R("supply", c("l_partkey")),
        "stock_ledger.keeper": R("staff", c("l_suppkey")),
        "stock_snapshot.supply": R("supply", c("l_partkey"), settled, once=True),
        "sale.dish": R("dish", c("l_partkey")),
        "sale.waiter": R("staff", waiter),
        "order_line.dish": R("dish", c("l_partkey")),
        "order_line.table": R("dining_table", table),
        "offer.vendor": R("vendor", c("l_suppkey")),
        "offer.supply": R("supply", c("l_partkey")),
        "cash_op.session": R("cash_session", c("l_orderkey")),
    }
    recipe = {
        "recipe.dish": [R("dish", c("p_partkey"))] * 3,
        "recipe.supply": [R("supply", (c("p_partkey") * 7 + k * 13) % dishes) for k in range(3)],
    }
    asked = {
        "order_request.dish": R("dish", c("event_id") % (dishes + 50)),
        "order_request.table": R("dining_table", F.nullif(c("user_id") % 24, F.lit(0))),
        "order_request.waiter": R("staff", F.nullif(c("user_id") % (people + 10), F.lit(0))),
    }
    keys = {"staff": c("s_suppkey"), "vendor": c("s_suppkey"), "dining_table": F.nullif(c("s_suppkey") % 20, F.lit(0))}
    return [
        audits.Source(t.stored("lineitem"), lines, {}),
        audits.Source(part, recipe, {"dish": c("p_partkey"), "supply": c("p_partkey")}),
        audits.Source(supplier, {"staff.role": R("role", c("s_nationkey") % 6)}, keys),
        audits.Source(t.stored("region"), {}, {"role": c("r_regionkey") + 1}),
        audits.Source(t.stored("orders"), {}, {"cash_session": c("o_orderkey")}),
        audits.Source(events, asked, {}),
    ]


@query
def audit_unique(t):
    return audits.audit_keys(
        {
            "role": (t.role, ["role_name"]),
            "staff": (t.staff, ["username"]),
            "dish": (t.dish, ["dish_name"]),
        }
    )


@query
def audit_domains(t):
    line_states = (model.PENDING, model.IN_PREPARATION, model.READY)
    return audits.audit_domains(
        {
            "dish": (
                t.dish,
                {
                    "name missing": audits.missing("dish_name"),
                    "name too long": audits.too_long("dish_name"),
                    "price below zero": audits.below_zero("price"),
                    "price out of range": audits.out_of_range("price", 3),
                },
            ),
            "order_line": (
                t.order_line,
                {
                    "state unknown": audits.not_one_of("state", model.ORDER_STATES),
                    "state not open": audits.not_one_of("state", line_states),
                    "waiter missing": audits.missing("waiter_id"),
                },
            ),
            "cash_session": (
                t.cash_session,
                {
                    "entered missing": audits.missing("entered"),
                    "computed out of range": audits.out_of_range("computed", 5),
                },
            ),
            "stock_ledger": (t.stock_ledger, {"qty missing": audits.missing("qty"), "qty below zero": audits.below_zero("qty")}),
        }
    )


@query
def audit_ledger_drift(t):
    return audits.audit_ledger_drift(t.stock_ledger, t.stock_snapshot)


@query
def supplies_without_stock(t):
    return audits.supplies_without_stock(t.supply, t.stock_snapshot)


# Streams over what is stored now, and their batch twins


def _event_stream(t) -> DataFrame:
    return views.as_stream_events(tables.order_event_stream(t.spark, t.sf_dir))


def _ledger_stream(t) -> DataFrame:
    return views.as_stock_ledger(_line_stream(t))


def _line_stream(t) -> DataFrame:
    return tables.table_stream(t.spark, t.sf_dir, "lineitem")


@query
def stream_orders_by_hour(t):
    path = work_dir(t.spark, "stream")
    jobs.run_to_files(boards.orders_by_hour(_event_stream(t)), f"{path}/out", f"{path}/checkpoint")
    hours = t.spark.read.parquet(f"{path}/out")
    return hours.select(
        F.col("hour_start").cast("timestamp_ntz").alias("hour_start"),
        F.col("hour_end").cast("timestamp_ntz").alias("hour_end"),
        "state",
        "orders",
    )


@query
def orders_by_hour_windows(t):
    windows = t.order_event.groupBy(F.window("ts", "1 hour"), "state").agg(F.count(F.lit(1)).alias("orders"))
    return windows.select(F.col("window.start").alias("hour_start"), F.col("window.end").alias("hour_end"), "state", "orders")


@query
def stream_kitchen_board(t):
    path = work_dir(t.spark, "stream")
    store = sinks.VersionedTables(t.spark, f"{path}/board")
    jobs.run_batches(
        boards.kitchen_board_changes(_event_stream(t), forget="7 days"), jobs.add_board_changes(store), f"{path}/checkpoint"
    )
    return store.read("board").where("orders <> 0")


@query
def latest_order_states(t):
    return apply_orders.latest_states(t.order_event)


@query
def stream_stock_levels(t):
    path = work_dir(t.spark, "stream")
    store = sinks.VersionedTables(t.spark, f"{path}/levels")
    jobs.run_batches(boards.stock_levels(_ledger_stream(t), t.supply), jobs.keep_newest(store, "levels", "supply_id"), f"{path}/checkpoint")
    return store.read("levels")


@query
def stream_low_stock_alerts(t):
    path = work_dir(t.spark, "stream")
    store = sinks.VersionedTables(t.spark, f"{path}/levels")
    each = jobs.raise_alerts(store, f"{path}/alerts", t.supply, views.LEDGER_ORDER)
    jobs.run_batches(_ledger_stream(t), each, f"{path}/checkpoint", mode="append")
    return sinks.read_ledger(t.spark, f"{path}/alerts").select("supply_id", "on_hand", "min_qty", "status")


@query
def stream_apply_requests(t):
    """All movements, each sent again with another quantity in the same trigger, and once more in a later one."""
    path = work_dir(t.spark, "stream")
    store = sinks.VersionedTables(t.spark, f"{path}/stock")
    each = jobs.apply_movements(
        store, f"{path}/ledger", f"{path}/results", t.supply, t.staff, _minimum_stock(t),
        requests.MOVEMENT_ORDER, requests.MOVEMENT_KEY, "ts", "365 days", ["attempt"],
    )
    for attempts in ([0, 1], [2]):
        sent = requests.sent_again(t.movement_requests, attempts)
        sent.write.mode("append").parquet(f"{path}/inbox")
        jobs.run_batches(t.spark.readStream.schema(sent.schema).parquet(f"{path}/inbox"), each, f"{path}/checkpoint", mode="append")
    return store.read("stock")


@query
def stream_apply_orders(t):
    path = work_dir(t.spark, "stream")
    store = sinks.VersionedTables(t.spark, f"{path}/stock")
    asked = requests.as_order_requests(
        tables.order_event_stream(t.spark, t.sf_dir),
        views.count_of(t.stored("part")),
        views.count_of(t.stored("supplier")),
    )
    each = jobs.apply_order_requests(
        store, f"{path}/orders", f"{path}/results", t.dish, t.dining_table, t.staff, t.recipe, t.stock_snapshot
    )
    jobs.run_batches(asked, each, f"{path}/checkpoint", mode="append")
    orders = sinks.read_ledger(t.spark, f"{path}/orders")
    return orders.select("order_id", "dish_id", "table_no", "waiter_id", "state", "ts")


@query
def order_durations(t):
    return apply_orders.state_durations(t.order_event)


@query
def stream_order_durations(t):
    path = work_dir(t.spark, "stream")
    jobs.run_to_files(boards.order_durations(_event_stream(t), forget="7 days"), f"{path}/out", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/out")


@query
def find_by_key(t):
    return lists.find_by_key(t.supply, "supply_id", 7)


@query
def first_row(t):
    return lists.first_row(t.stock_ledger, *views.LEDGER_ORDER)


@query
def upsert_dimension_as_of(t):
    dated = t.cash_session.select("session_id", "opening", "updated_at")
    touched = dated.select("session_id", (F.col("opening") + 1).alias("opening"))
    moment = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return apply_dims.upsert_dimension(dated, touched, "session_id", as_of=moment)


@query
def stream_dedup(t):
    path = work_dir(t.spark, "stream")
    twice = _event_stream(t)
    sent = twice.unionByName(twice)
    jobs.run_to_files(boards.deduplicated(sent), f"{path}/out", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/out").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "order_id", "state"
    )


# Reports as SQL table functions


def _sql_report(name: str, *values: date | int) -> None:
    CATALOG[f"sql_{name}"] = lambda spark, sf_dir: sql_functions.call_report(spark, sf_dir, name, *values)


_sql_report("sales_by_day", date(1900, 1, 1), date(2100, 1, 1))
_sql_report("sales_by_dish", date(1900, 1, 1), date(2100, 1, 1))
_sql_report("register_closings", date(1900, 1, 1), date(2100, 1, 1))
_sql_report("orders_by_hour", date(2024, 1, 10))
_sql_report("stock_on_hand")
_sql_report("stock_totals")
_sql_report("stock_of_supply", 1)
_sql_report("table_bill")
_sql_report("admin_guard")
_sql_report("sales_by_waiter")
_sql_report("stock_flow_by_class")
_sql_report("dish_cost_margin")
