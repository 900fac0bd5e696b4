"""Reports as SQL table functions, and parameterised SQL with bound values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from comandix import model
from comandix.sources.views import register_views

TABLE_FUNCTIONS = {
    "sales_by_day": """
        CREATE OR REPLACE TEMPORARY FUNCTION sales_by_day(first DATE, last DATE)
        RETURNS TABLE (day STRING, total DECIMAL(18,2))
        RETURN SELECT date_format(created_at, 'yyyy-MM-dd'), CAST(sum(entered) AS DECIMAL(18,2))
               FROM cash_session
               WHERE created_at BETWEEN CAST(first AS TIMESTAMP_NTZ) AND CAST(last AS TIMESTAMP_NTZ)
               GROUP BY date_format(created_at, 'yyyy-MM-dd')
    """,
    "sales_by_dish": """
        CREATE OR REPLACE TEMPORARY FUNCTION sales_by_dish(first DATE, last DATE)
        RETURNS TABLE (dish_name STRING, total DECIMAL(18,2))
        RETURN SELECT dish_name, CAST(sum(amount) AS DECIMAL(18,2))
               FROM (SELECT dish_id, sum(amount) AS amount
                     FROM sale
                     WHERE created_at BETWEEN CAST(first AS TIMESTAMP_NTZ) AND CAST(last AS TIMESTAMP_NTZ)
                     GROUP BY dish_id)
               JOIN dish USING (dish_id)
               GROUP BY dish_name
    """,
    "register_closings": """
        CREATE OR REPLACE TEMPORARY FUNCTION register_closings(first DATE, last DATE)
        RETURNS TABLE (day DATE, total DECIMAL(18,2))
        RETURN SELECT to_date(created_at), CAST(sum(entered) AS DECIMAL(18,2))
               FROM cash_session
               WHERE updated_at BETWEEN CAST(first AS TIMESTAMP_NTZ) AND CAST(last AS TIMESTAMP_NTZ)
               GROUP BY to_date(created_at)
    """,
    "orders_by_hour": """
        CREATE OR REPLACE TEMPORARY FUNCTION orders_by_hour(day DATE)
        RETURNS TABLE (hour INT, orders BIGINT)
        RETURN SELECT hour(ts), count(*)
               FROM order_event
               WHERE ts >= CAST(orders_by_hour.day AS TIMESTAMP_NTZ)
                 AND ts < CAST(orders_by_hour.day AS TIMESTAMP_NTZ) + INTERVAL 1 DAY
               GROUP BY hour(ts)
    """,
    "stock_on_hand": """
        CREATE OR REPLACE TEMPORARY FUNCTION stock_on_hand()
        RETURNS TABLE (supply_id BIGINT, supply_name STRING, min_qty DECIMAL(8,2), on_hand DECIMAL(18,2))
        RETURN SELECT supply_id, supply_name, min_qty, on_hand
               FROM (SELECT supply_id, CAST(sum(qty) AS DECIMAL(18,2)) AS on_hand
                     FROM stock_ledger GROUP BY supply_id)
               JOIN supply USING (supply_id)
               WHERE on_hand >= 0
    """,
    "stock_totals": """
        CREATE OR REPLACE TEMPORARY FUNCTION stock_totals()
        RETURNS TABLE (supply_id BIGINT, supply_name STRING, min_qty DECIMAL(8,2), on_hand DECIMAL(18,2))
        RETURN SELECT supply_id, supply_name, min_qty, on_hand
               FROM (SELECT supply_id, CAST(sum(qty) AS DECIMAL(18,2)) AS on_hand
                     FROM stock_ledger GROUP BY supply_id)
               JOIN supply USING (supply_id)
    """,
    "stock_of_supply": """
        CREATE OR REPLACE TEMPORARY FUNCTION stock_of_supply(wanted BIGINT)
        RETURNS TABLE (supply_id BIGINT, supply_name STRING, on_hand DECIMAL(18,2))
        RETURN SELECT any_value(supply_id), any_value(supply_name), CAST(sum(qty) AS DECIMAL(18,2))
               FROM (SELECT supply_id, qty FROM stock_ledger WHERE supply_id = stock_of_supply.wanted)
               JOIN supply USING (supply_id)
    """,
    "table_bill": """
        CREATE OR REPLACE TEMPORARY FUNCTION table_bill()
        RETURNS TABLE (table_no BIGINT, orders BIGINT, total DECIMAL(18,2))
        RETURN SELECT table_no, sum(n), CAST(sum(price * n) AS DECIMAL(18,2))
               FROM (SELECT table_no, dish_id, count(*) AS n FROM order_line GROUP BY table_no, dish_id)
               JOIN dish USING (dish_id)
               GROUP BY table_no
    """,
    "admin_guard": f"""
        CREATE OR REPLACE TEMPORARY FUNCTION admin_guard()
        RETURNS TABLE (admins BIGINT, may_remove_one BOOLEAN)
        RETURN SELECT count_if(role_id = {model.ADMIN_ROLE}), count_if(role_id = {model.ADMIN_ROLE}) > 1 FROM staff
    """,
    "sales_by_waiter": """
        CREATE OR REPLACE TEMPORARY FUNCTION sales_by_waiter()
        RETURNS TABLE (waiter_id BIGINT, sales BIGINT, total DECIMAL(18,2))
        RETURN SELECT waiter_id, count(*), CAST(sum(amount) AS DECIMAL(18,2)) FROM sale GROUP BY waiter_id
    """,
    "stock_flow_by_class": """
        CREATE OR REPLACE TEMPORARY FUNCTION stock_flow_by_class()
        RETURNS TABLE (supply_id BIGINT, received DECIMAL(18,2), issued DECIMAL(18,2), adjusted DECIMAL(18,2))
        RETURN SELECT supply_id,
                      CAST(coalesce(sum(qty) FILTER (WHERE NOT is_adjustment AND qty >= 0), 0) AS DECIMAL(18,2)),
                      CAST(coalesce(sum(qty) FILTER (WHERE NOT is_adjustment AND qty < 0), 0) AS DECIMAL(18,2)),
                      CAST(coalesce(sum(qty) FILTER (WHERE is_adjustment), 0) AS DECIMAL(18,2))
               FROM stock_ledger GROUP BY supply_id
    """,
    "dish_cost_margin": """
        CREATE OR REPLACE TEMPORARY FUNCTION dish_cost_margin()
        RETURNS TABLE (dish_id BIGINT, dish_name STRING, price DECIMAL(18,2), cost DECIMAL(18,2), margin DECIMAL(18,2))
        RETURN SELECT dish_id, dish_name, CAST(price AS DECIMAL(18,2)), cost, CAST(price - cost AS DECIMAL(18,2))
               FROM dish JOIN (
                   SELECT dish_id, CAST(CASE WHEN count(*) = count(unit_price) THEN sum(qty * unit_price) END AS DECIMAL(18,2)) AS cost
                   FROM recipe LEFT JOIN (SELECT supply_id, min(unit_price) AS unit_price FROM offer GROUP BY supply_id) USING (supply_id)
                   GROUP BY dish_id) USING (dish_id)
    """,
}

NEEDED_VIEWS = {
    "sales_by_day": ["cash_session"],
    "sales_by_dish": ["sale", "dish"],
    "register_closings": ["cash_session"],
    "orders_by_hour": ["order_event"],
    "stock_on_hand": ["stock_ledger", "supply"],
    "stock_totals": ["stock_ledger", "supply"],
    "stock_of_supply": ["stock_ledger", "supply"],
    "table_bill": ["order_line", "dish"],
    "admin_guard": ["staff"],
    "sales_by_waiter": ["sale"],
    "stock_flow_by_class": ["stock_ledger"],
    "dish_cost_margin": ["dish", "recipe", "offer"],
}


def register_table_functions(spark: SparkSession, sf_dir: str) -> None:
    """Make the reports callable from SQL, e.g. ``SELECT * FROM sales_by_day(DATE'...', DATE'...')``."""
    for name, text in TABLE_FUNCTIONS.items():
        _register(spark, sf_dir, name, text)


def call_report(spark: SparkSession, sf_dir: str, name: str, *values: date) -> DataFrame:
    """Call a report with bound values, never with values pasted into the text."""
    _register(spark, sf_dir, name, TABLE_FUNCTIONS[name])
    marks = ", ".join(f":p{i}" for i in range(len(values)))
    return spark.sql(f"SELECT * FROM {name}({marks})", args={f"p{i}": value for i, value in enumerate(values)})


def _register(spark: SparkSession, sf_dir: str, name: str, text: str) -> None:
    register_views(spark, sf_dir, NEEDED_VIEWS[name])
    spark.sql(text)
