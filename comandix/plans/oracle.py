"""ANSI SQL over the stored tables with the same results as the catalogue's queries.

Used only to cross-check results with a second engine; nothing here runs on Spark.
"""

from __future__ import annotations

# The model's tables, and what each is built from.
VIEWS = {
    "dish": """
        SELECT p_partkey AS dish_id, p_name AS dish_name, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
               p_size > 5 AS active, p_size % 2 = 1 AS needs_prep
        FROM part""",
    "supply": """
        SELECT p_partkey AS supply_id, p_name AS supply_name, CAST(p_size * 10 AS DECIMAL(8,2)) AS min_qty
        FROM part""",
    "stock_ledger": """
        SELECT l_orderkey AS ledger_ref, l_linenumber AS ledger_line, l_partkey AS supply_id, l_suppkey AS keeper_id,
               CAST(CASE WHEN l_returnflag = 'A' THEN -l_quantity ELSE l_quantity END AS DECIMAL(8,2)) AS qty,
               l_returnflag = 'N' AND l_linestatus = 'O' AS is_adjustment,
               l_shipdate AS created_at, CAST(l_extendedprice AS DECIMAL(12,2)) AS ledger_value
        FROM lineitem""",
    "stock_snapshot": """
        SELECT supply_id, CAST(sum(qty) AS DECIMAL(18,2)) AS qty
        FROM stock_ledger WHERE NOT is_adjustment GROUP BY supply_id""",
    "sale": """
        SELECT l_partkey AS dish_id, nullif(l_suppkey % 10, 0) AS waiter_id,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS amount, l_shipdate AS created_at
        FROM lineitem""",
    "order_line": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS dish_id,
               nullif(l_suppkey % 20, 0) AS table_no, nullif(l_suppkey % 10, 0) AS waiter_id,
               CASE l_returnflag || l_linestatus
                    WHEN 'NO' THEN 'PENDIENTE' WHEN 'NF' THEN 'EN PREPARACION'
                    WHEN 'RO' THEN 'PREPARADO' WHEN 'RF' THEN 'PREPARADO' ELSE 'ENTREGADO' END AS state
        FROM lineitem""",
    "open_order": """
        SELECT o_orderkey AS order_id, (o_orderkey * 31 + o_custkey) % (SELECT count(*) FROM part) AS dish_id,
               nullif(o_custkey % 20, 0) AS table_no, nullif(o_custkey % 10, 0) AS waiter_id,
               CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'PENDIENTE'
                    WHEN o_orderpriority = '2-HIGH' THEN 'EN PREPARACION'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'PREPARADO' ELSE 'ENTREGADO' END AS state,
               o_orderdate AS created_at
        FROM orders""",
    "dining_table": """
        SELECT DISTINCT s_suppkey % 20 AS table_no, (s_suppkey % 20) % 4 <> 0 AS active
        FROM supplier WHERE s_suppkey % 20 <> 0""",
    "staff": """
        SELECT s_suppkey AS staff_id, s_name AS username, s_nationkey % 6 AS role_id, s_acctbal >= 0 AS enabled
        FROM supplier""",
    "enabled_staff": "SELECT staff_id FROM staff WHERE enabled",
    "role": "SELECT r_regionkey + 1 AS role_id, r_name AS role_name FROM region",
    "vendor": "SELECT s_suppkey AS vendor_id, s_name AS vendor_name FROM supplier",
    "offer": """
        SELECT l_suppkey AS vendor_id, l_partkey AS supply_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price
        FROM lineitem""",
    "vendor_supply": """
        SELECT vendor_id, supply_id, min(unit_price) AS unit_price FROM offer GROUP BY vendor_id, supply_id""",
    "recipe": """
        SELECT p_partkey AS dish_id, (p_partkey * 7 + k * 13) % (SELECT count(*) FROM part) AS supply_id,
               CAST(k + 1 AS DECIMAL(5,2)) AS qty
        FROM part, (VALUES (0), (1), (2)) AS ks(k)""",
    "cash_session": """
        SELECT o_orderkey AS session_id, CAST(100 AS DECIMAL(12,2)) AS opening,
               CAST(o_totalprice AS DECIMAL(12,2)) AS computed,
               CAST(CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'P' THEN CAST(o_totalprice AS DECIMAL(12,2)) - 1
                    ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS DECIMAL(12,2)) AS entered,
               o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders""",
    "cash_op": """
        SELECT l_orderkey AS session_id, l_linenumber AS op_line,
               CAST(CASE WHEN l_returnflag = 'A' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(12,2)) AS amount,
               l_suppkey AS cashier_id, l_partkey AS op_ref, l_shipdate AS created_at
        FROM lineitem""",
    "register": """
        SELECT 1 AS register_id, CAST(arg_max(o_totalprice, o_orderkey) AS DECIMAL(12,2)) AS current_amount,
               max(o_orderkey) AS session_id
        FROM orders""",
    "order_event": """
        SELECT event_id, ts, user_id AS order_id,
               CASE event_type WHEN 'signup' THEN 'PENDIENTE' WHEN 'view' THEN 'EN PREPARACION'
                    WHEN 'click' THEN 'EN PREPARACION' WHEN 'purchase' THEN 'PREPARADO'
                    WHEN 'error' THEN 'ENTREGADO' END AS state
        FROM events""",
    "order_request": """
        SELECT event_id AS req_id, event_id % ((SELECT count(*) FROM part) + 50) AS dish_id,
               nullif(user_id % 24, 0) AS table_no,
               nullif(user_id % ((SELECT count(*) FROM supplier) + 10), 0) AS waiter_id, ts
        FROM events""",
    "coded_order_request": """
        SELECT r.*, CAST(CASE
                   WHEN d.dish_id IS NULL THEN 2
                   WHEN r.table_no IS NOT NULL AND m.table_no IS NULL THEN 3
                   WHEN r.waiter_id IS NOT NULL AND s.staff_id IS NULL THEN 4 ELSE 1 END AS INTEGER) AS result_code
        FROM order_request r
        LEFT JOIN (SELECT dish_id FROM dish WHERE active) d ON r.dish_id = d.dish_id
        LEFT JOIN (SELECT table_no FROM dining_table WHERE active) m ON r.table_no = m.table_no
        LEFT JOIN enabled_staff s ON r.waiter_id = s.staff_id""",
    "order_message": """
        SELECT * FROM (VALUES (1, 'Pedido registrado correctamente'),
                              (2, 'El plato no existe o está desactivado'),
                              (3, 'La mesa no existe o está deshabilitada'),
                              (4, 'El mozo no existe o está deshabilitado')) AS m(result_code, message)""",
    "receipt_request": """
        SELECT l_orderkey AS req_ref, l_linenumber AS req_line,
               CASE WHEN l_linenumber = 7 THEN l_partkey + (SELECT count(*) FROM part) ELSE l_partkey END AS supply_id,
               l_suppkey AS keeper_id, CAST(l_quantity - 1 AS DECIMAL(8,2)) AS qty
        FROM lineitem WHERE l_returnflag = 'R'""",
    "coded_receipt": """
        SELECT r.*, CAST(CASE WHEN s.supply_id IS NULL THEN 2 WHEN k.staff_id IS NULL THEN 3
                              WHEN r.qty IS NULL OR r.qty <= 0 THEN 4 ELSE 1 END AS INTEGER) AS result_code
        FROM receipt_request r
        LEFT JOIN supply s ON r.supply_id = s.supply_id
        LEFT JOIN enabled_staff k ON r.keeper_id = k.staff_id""",
    "movement": """
        SELECT l_orderkey AS req_ref, l_linenumber AS req_line, l_partkey AS supply_id, l_suppkey AS keeper_id,
               CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS DECIMAL(8,2)) AS qty,
               l_shipdate AS ts, CAST(l_extendedprice AS DECIMAL(12,2)) AS req_value
        FROM lineitem""",
    "checked_movement": """
        SELECT r.*, s.min_qty AS stock,
               CASE WHEN s.supply_id IS NULL THEN 2 WHEN k.staff_id IS NULL THEN 3
                    WHEN r.qty IS NULL OR r.qty = 0 THEN 4 ELSE 1 END AS code,
               row_number() OVER (PARTITION BY r.supply_id
                                  ORDER BY ts, req_ref, req_line, keeper_id, req_value) AS place
        FROM movement r
        LEFT JOIN supply s ON r.supply_id = s.supply_id
        LEFT JOIN enabled_staff k ON r.keeper_id = k.staff_id""",
    "folded": """
        SELECT supply_id, CAST(0 AS BIGINT) AS place, CAST(min_qty AS DECIMAL(18,2)) AS balance, true AS accepted
        FROM supply
        UNION ALL
        SELECT m.supply_id, m.place,
               CAST(CASE WHEN m.code = 1 AND (m.qty > 0 OR f.balance + m.qty >= 0)
                         THEN f.balance + m.qty ELSE f.balance END AS DECIMAL(18,2)),
               m.code <> 1 OR m.qty > 0 OR f.balance + m.qty >= 0
        FROM folded f JOIN checked_movement m ON m.supply_id = f.supply_id AND m.place = f.place + 1""",
    "coded_movement": """
        SELECT m.*, CAST(CASE WHEN f.accepted THEN m.code ELSE 5 END AS INTEGER) AS result_code
        FROM checked_movement m JOIN folded f ON m.supply_id = f.supply_id AND m.place = f.place""",
    "cash_request": """
        SELECT event_id AS req_id,
               CAST(CASE event_type WHEN 'purchase' THEN value WHEN 'click' THEN -value ELSE 0 END
                    AS DECIMAL(12,2)) AS amount,
               nullif(user_id % ((SELECT count(*) FROM supplier) + 10), 0) AS cashier_id, ts
        FROM events WHERE event_type IN ('purchase', 'click', 'error')""",
    "coded_cash_request": """
        SELECT r.*, CAST(CASE WHEN r.amount = 0 THEN 2 WHEN s.staff_id IS NULL THEN 3
                              WHEN (SELECT session_id FROM register) IS NULL THEN 4 ELSE 1 END AS INTEGER) AS result_code
        FROM cash_request r LEFT JOIN enabled_staff s ON r.cashier_id = s.staff_id""",
    "payment_request": """
        SELECT s_suppkey AS req_id, nullif(s_suppkey % 24, 0) AS table_no, s_suppkey AS cashier_id FROM supplier""",
    "bill": """
        SELECT o.table_no, count(*) AS orders, CAST(sum(d.price) AS DECIMAL(18,2)) AS total
        FROM order_line o JOIN dish d ON o.dish_id = d.dish_id GROUP BY o.table_no""",
    "coded_payment": """
        SELECT c.req_id, c.table_no, c.cashier_id, c.orders, c.total,
               CAST(CASE WHEN c.req_id > w.first_req THEN 2 ELSE c.code END AS INTEGER) AS result_code
        FROM (SELECT r.*, b.orders, b.total,
                     CASE WHEN b.orders IS NULL THEN 2 WHEN s.staff_id IS NULL THEN 3
                          WHEN (SELECT session_id FROM register) IS NULL THEN 4 ELSE 1 END AS code
              FROM payment_request r
              LEFT JOIN bill b ON r.table_no = b.table_no
              LEFT JOIN enabled_staff s ON r.cashier_id = s.staff_id) c
        LEFT JOIN (SELECT r.table_no, min(r.req_id) AS first_req
                   FROM payment_request r
                   JOIN bill b ON r.table_no = b.table_no
                   JOIN enabled_staff s ON r.cashier_id = s.staff_id
                   WHERE (SELECT session_id FROM register) IS NOT NULL
                   GROUP BY r.table_no) w ON c.table_no = w.table_no""",
    "paid_table": "SELECT DISTINCT table_no FROM coded_payment WHERE result_code = 1",
    "edited_order": """
        SELECT o.order_id, o.dish_id, o.state, o.table_no, o.waiter_id, o.created_at,
               r.req_id, r.dish_id AS new_dish, r.table_no AS new_table, r.waiter_id AS new_waiter, r.ts
        FROM open_order o JOIN coded_order_request r ON r.req_id = o.order_id
        WHERE o.state = 'PENDIENTE' AND r.result_code = 1""",
    "cancel": "SELECT event_id AS req_id, event_id * 2 AS order_id FROM events",
    "cancelled_order": """
        SELECT o.* FROM open_order o WHERE o.state = 'PENDIENTE' AND o.order_id IN (SELECT order_id FROM cancel)""",
    "numbered_event": """
        SELECT event_id AS req_id, user_id AS register_id,
               CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'close' ELSE 'op' END AS action,
               CAST(value AS DECIMAL(12,2)) AS amount, ts
        FROM events WHERE event_type IN ('signup', 'purchase', 'click')""",
    "register_step": """
        SELECT e.*, last_value(CASE WHEN action <> 'op' THEN action END IGNORE NULLS) OVER (
                        PARTITION BY register_id ORDER BY ts, req_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM numbered_event e""",
    "coded_register_event": """
        SELECT req_id, register_id, action, amount, ts, CAST(CASE
                   WHEN action = 'open' THEN CASE WHEN coalesce(before, 'close') = 'close' THEN 1 ELSE 2 END
                   WHEN action = 'close' THEN CASE WHEN before = 'open' THEN 1 ELSE 2 END
                   ELSE CASE WHEN before = 'open' THEN 1 ELSE 4 END END AS INTEGER) AS result_code
        FROM register_step""",
    "dish_change": """
        SELECT c_custkey * 2 AS dish_id, c_name AS dish_name, CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS price,
               c_acctbal >= 0 AS active, c_mktsegment = 'BUILDING' AS needs_prep
        FROM customer""",
    "grown_dish": """
        SELECT coalesce(c.dish_id, d.dish_id) AS dish_id, coalesce(c.dish_name, d.dish_name) AS dish_name,
               coalesce(c.price, d.price) AS price, coalesce(c.active, d.active) AS active,
               coalesce(c.needs_prep, d.needs_prep) AS needs_prep
        FROM dish d FULL OUTER JOIN dish_change c ON d.dish_id = c.dish_id""",
    "staff_change": """
        SELECT c_custkey AS req_id, c_custkey AS staff_id, c_name AS username, c_nationkey % 7 AS role_id
        FROM customer""",
    "coded_staff_change": """
        SELECT c.*, s.staff_id IS NOT NULL AS stored, s.staff_id IS NOT NULL OR r.role_id IS NOT NULL AS ok
        FROM staff_change c LEFT JOIN staff s ON c.staff_id = s.staff_id LEFT JOIN role r ON c.role_id = r.role_id""",
    "coded_staff_toggle": """
        SELECT c.c_custkey AS req_id, c.c_custkey AS staff_id, c.c_acctbal > 5000 AS target,
               s.staff_id IS NOT NULL AS stored,
               s.staff_id IS NOT NULL AND (c.c_acctbal > 5000 OR s.role_id <> 1) AS ok
        FROM customer c LEFT JOIN staff s ON c.c_custkey = s.staff_id""",
    "coded_dish_delete": """
        SELECT c_custkey AS req_id, c_custkey * 3 AS dish_id,
               CAST(CASE WHEN c_custkey * 3 NOT IN (SELECT dish_id FROM grown_dish) THEN 3
                    WHEN c_custkey * 3 IN (SELECT dish_id FROM recipe)
                      OR c_custkey * 3 IN (SELECT dish_id FROM open_order) THEN 2 ELSE 1 END AS INTEGER) AS result_code
        FROM customer""",
    "linked_supply": """
        SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY c_custkey) AS supply_id,
               c_custkey % (SELECT count(*) FROM supplier) AS vendor_id,
               c_name AS supply_name, CAST(abs(c_acctbal) AS DECIMAL(8,2)) AS min_qty
        FROM customer""",
    "grown_supply": """
        SELECT supply_id, supply_name, min_qty, min_qty AS qty FROM supply
        UNION ALL SELECT supply_id, supply_name, min_qty, 0 FROM linked_supply""",
    "kept_supply": """
        SELECT * FROM grown_supply
        WHERE supply_id NOT IN (SELECT c_custkey * 3 FROM customer)
           OR supply_id IN (SELECT supply_id FROM recipe) OR supply_id IN (SELECT supply_id FROM offer)""",
    "coded_staff_delete": """
        SELECT c.c_custkey AS req_id, c.c_custkey AS staff_id, s.staff_id IS NOT NULL AS stored,
               coalesce(s.role_id = 1
                        AND (SELECT count(*) FROM staff WHERE role_id = 1 AND staff_id NOT IN (SELECT c_custkey FROM customer)) = 0
                        AND c.c_custkey = (SELECT max(staff_id) FROM staff WHERE role_id = 1
                                             AND staff_id IN (SELECT c_custkey FROM customer)), false) AS stays
        FROM customer c LEFT JOIN staff s ON c.c_custkey = s.staff_id""",
    "coded_recipe_line": """
        SELECT r.*, CAST(CASE WHEN NOT known THEN 2
                              WHEN stored OR row_number() OVER (PARTITION BY dish_id, supply_id ORDER BY req_id) > 1 THEN 3
                              ELSE 1 END AS INTEGER) AS result_code
        FROM (SELECT e.event_id AS req_id, e.event_id % ((SELECT count(*) FROM part) + 50) AS dish_id,
                     e.user_id AS supply_id, CAST(e.value AS DECIMAL(5,2)) AS qty,
                     d.dish_id IS NOT NULL AND s.supply_id IS NOT NULL AS known, x.dish_id IS NOT NULL AS stored
              FROM events e
              LEFT JOIN dish d ON d.dish_id = e.event_id % ((SELECT count(*) FROM part) + 50)
              LEFT JOIN supply s ON s.supply_id = e.user_id
              LEFT JOIN recipe x ON x.dish_id = e.event_id % ((SELECT count(*) FROM part) + 50)
                                AND x.supply_id = e.user_id) r""",
    "unlink": """
        SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey % (SELECT count(*) FROM supplier) END AS vendor_id,
               c_custkey AS supply_id
        FROM customer""",
}

USES = {
    "stock_snapshot": ["stock_ledger"],
    "enabled_staff": ["staff"],
    "vendor_supply": ["offer"],
    "coded_order_request": ["order_request", "dish", "dining_table", "enabled_staff"],
    "coded_receipt": ["receipt_request", "supply", "enabled_staff"],
    "checked_movement": ["movement", "supply", "enabled_staff"],
    "folded": ["checked_movement"],
    "coded_movement": ["folded"],
    "coded_cash_request": ["cash_request", "register", "enabled_staff"],
    "bill": ["order_line", "dish"],
    "coded_payment": ["payment_request", "bill", "enabled_staff", "register"],
    "paid_table": ["coded_payment"],
    "edited_order": ["open_order", "coded_order_request"],
    "cancelled_order": ["open_order", "cancel"],
    "register_step": ["numbered_event"],
    "coded_register_event": ["register_step"],
    "grown_dish": ["dish", "dish_change"],
    "coded_staff_change": ["staff_change", "staff", "role"],
    "coded_staff_toggle": ["staff"],
    "coded_dish_delete": ["grown_dish", "recipe", "open_order"],
    "grown_supply": ["supply", "linked_supply"],
    "kept_supply": ["grown_supply", "recipe", "offer"],
    "coded_staff_delete": ["staff"],
    "coded_recipe_line": ["dish", "supply", "recipe"],
}


def with_views(names: str, body: str) -> str:
    """``body`` with the named tables, and what they need, in front of it."""
    placed: list[str] = []

    def place(name: str) -> None:
        for needed in USES.get(name, []):
            place(needed)
        if name not in placed:
            placed.append(name)

    for name in names.split():
        place(name)
    if not placed:
        return body.strip()
    tables = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in placed)
    return f"WITH RECURSIVE {tables}\n{body.strip()}"


ORACLE: dict[str, str] = {}


def check(name: str, names: str, body: str) -> None:
    ORACLE[name] = with_views(names, body)


# Sources and sinks

check("read_table", "stock_ledger", "SELECT * FROM stock_ledger")
check("load_seed", "staff", "SELECT staff_id, CAST(role_id AS BIGINT) AS role_id, username, enabled FROM staff")
check("order_event_stream", "order_event", "SELECT * FROM order_event")
check("json_envelope", "dish", """
    SELECT '{"ok":true,"result":{"dish_id":' || dish_id || ',"dish_name":"' || dish_name || '","price":"' || price
           || '","active":' || CASE WHEN active THEN 'true' ELSE 'false' END || '}}' AS document
    FROM dish""")
check("append_ledger", "stock_ledger coded_receipt", """
    SELECT 0 AS batch, supply_id, count(*) AS rows, CAST(sum(qty) AS DECIMAL(18,2)) AS qty
    FROM stock_ledger GROUP BY supply_id
    UNION ALL
    SELECT 1, supply_id, count(*), CAST(sum(qty) AS DECIMAL(18,2))
    FROM coded_receipt WHERE result_code = 1 GROUP BY supply_id""")
check("replace_snapshot", "stock_snapshot order_line recipe", """
    SELECT s.supply_id, CAST(s.qty + coalesce(u.qty, 0) AS DECIMAL(18,2)) AS qty
    FROM stock_snapshot s
    LEFT JOIN (SELECT r.supply_id, sum(r.qty) AS qty FROM order_line o JOIN recipe r ON o.dish_id = r.dish_id
               GROUP BY r.supply_id) u ON s.supply_id = u.supply_id""")
check("chart_series", "cash_session", """
    SELECT substr(day, 1, 4) AS year, string_agg(day, ',' ORDER BY day) AS labels,
           string_agg(coalesce(CAST(total AS VARCHAR), ''), ',' ORDER BY day) AS amounts
    FROM (SELECT strftime(created_at, '%Y-%m-%d') AS day, CAST(sum(entered) AS DECIMAL(18,2)) AS total
          FROM cash_session GROUP BY 1)
    GROUP BY 1""")

# Lists

WITH_DISH = """SELECT o.order_id, o.line_no, o.dish_id, d.dish_name, o.table_no, o.state
               FROM order_line o JOIN dish d ON o.dish_id = d.dish_id"""
MOVED = """SELECT l.ledger_ref, l.ledger_line, l.supply_id, s.supply_name, l.keeper_id, l.qty, l.created_at AS moved_at
           FROM stock_ledger l JOIN supply s ON l.supply_id = s.supply_id"""

check("list_supplies", "supply", "SELECT supply_id, supply_name, min_qty FROM supply")
check("list_dishes", "dish", "SELECT dish_id, dish_name, price, active, needs_prep FROM dish")
check("list_tables", "dining_table", "SELECT table_no, active FROM dining_table")
check("list_suppliers", "vendor", "SELECT vendor_id, vendor_name FROM vendor")
check("list_roles", "role", "SELECT * FROM role")
check("register_state", "register", "SELECT current_amount, session_id IS NOT NULL AS is_open FROM register")
check("lookup_by_key", "order_request dish", """
    SELECT k.dish_id, d.dish_name, d.price, d.active, d.needs_prep
    FROM (SELECT DISTINCT dish_id FROM order_request) k LEFT JOIN dish d ON k.dish_id = d.dish_id""")
check("orders_for_table", "order_line dish", f"{WITH_DISH} WHERE o.table_no IS NULL")
check("kitchen_in_preparation", "order_line dish", f"{WITH_DISH} WHERE o.state = 'EN PREPARACION'")
check("kitchen_ready", "order_line dish", f"{WITH_DISH} WHERE o.state = 'PREPARADO'")
check("kitchen_pending_prep", "order_line dish", f"{WITH_DISH} WHERE o.state = 'PENDIENTE' AND d.needs_prep")
check("kitchen_pending_noprep", "order_line dish", f"{WITH_DISH} WHERE o.state = 'PENDIENTE' AND NOT d.needs_prep")
check("kitchen_board", "order_line dish", """
    SELECT CASE WHEN o.state = 'PENDIENTE' AND d.needs_prep THEN 'PENDIENTE CON PREPARACION'
                WHEN o.state = 'PENDIENTE' THEN 'PENDIENTE SIN PREPARACION' ELSE o.state END AS queue, count(*) AS orders
    FROM order_line o JOIN dish d ON o.dish_id = d.dish_id WHERE o.state <> 'ENTREGADO' GROUP BY 1""")
check("stock_receipts", "stock_ledger supply", f"{MOVED} WHERE l.qty >= 0 AND NOT l.is_adjustment")
check("stock_issues", "stock_ledger supply", f"{MOVED} WHERE l.qty <= 0 AND NOT l.is_adjustment")
check("stock_receipt_by_id", "stock_ledger supply", f"""
    {MOVED} WHERE l.qty >= 0 AND NOT l.is_adjustment AND l.ledger_ref IN (SELECT event_id FROM events)""")
check("stock_adjustments", "stock_ledger supply", f"{MOVED} WHERE l.is_adjustment")
check("order_by_id", "order_line dish", f"{WITH_DISH} WHERE o.order_id IN (SELECT event_id FROM events)")
check("selectable_dishes", "dish", "SELECT dish_id, dish_name, price, active, needs_prep FROM dish WHERE active")
check("selectable_tables", "dining_table", "SELECT table_no, active FROM dining_table WHERE active")
check("editable_orders", "order_line", "SELECT * FROM order_line WHERE state = 'PENDIENTE'")

# Joins

check("orders_with_dish", "order_line dish", """
    SELECT o.order_id, o.line_no, o.dish_id, d.dish_name, d.price, o.table_no, o.state
    FROM order_line o JOIN dish d ON o.dish_id = d.dish_id""")
check("recipe_lines", "recipe dish supply", """
    SELECT r.dish_id, d.dish_name, r.supply_id, s.supply_name, r.qty
    FROM recipe r JOIN dish d ON r.dish_id = d.dish_id JOIN supply s ON r.supply_id = s.supply_id""")
check("supplier_supplies", "vendor vendor_supply supply", """
    SELECT v.vendor_id, s.supply_id, s.supply_name, s.min_qty
    FROM vendor v JOIN vendor_supply o ON v.vendor_id = o.vendor_id JOIN supply s ON o.supply_id = s.supply_id""")
check("table_consumption", "order_line dish staff", """
    SELECT o.order_id, o.line_no, o.table_no, o.state, d.dish_name, d.price, s.username
    FROM order_line o JOIN dish d ON o.dish_id = d.dish_id JOIN staff s ON o.waiter_id = s.staff_id
    WHERE o.table_no IS NOT NULL""")
check("list_users", "staff role", """
    SELECT s.staff_id, r.role_id, r.role_name, s.username, s.enabled
    FROM staff s LEFT JOIN role r ON s.role_id = r.role_id""")
check("semi_active_refs", "coded_order_request", """
    SELECT req_id, dish_id, table_no, waiter_id, ts FROM coded_order_request WHERE result_code = 1""")
check("anti_unknown_refs", "coded_order_request", """
    SELECT req_id, dish_id, table_no, waiter_id, ts FROM coded_order_request WHERE result_code <> 1""")
check("bom_explosion", "order_line recipe", """
    SELECT r.supply_id, CAST(sum(r.qty) AS DECIMAL(18,2)) AS qty
    FROM order_line o JOIN recipe r ON o.dish_id = r.dish_id GROUP BY r.supply_id""")
check("bom_release", "stock_snapshot order_line recipe", """
    SELECT s.supply_id, CAST(s.qty + coalesce(u.qty, 0) AS DECIMAL(18,2)) AS qty
    FROM stock_snapshot s
    LEFT JOIN (SELECT r.supply_id, sum(r.qty) AS qty FROM order_line o JOIN recipe r ON o.dish_id = r.dish_id
               WHERE o.state = 'PENDIENTE' GROUP BY r.supply_id) u ON s.supply_id = u.supply_id""")
check("current_session_ops", "cash_op register", """
    SELECT * FROM cash_op WHERE session_id = (SELECT session_id FROM register) ORDER BY created_at""")
check("sales_with_dish", "sale dish", """
    SELECT s.dish_id, d.dish_name, s.waiter_id, s.amount, s.created_at
    FROM sale s JOIN dish d ON s.dish_id = d.dish_id""")
DRIFT = """
    SELECT supply_id, l.qty AS ledger_qty, s.qty AS snapshot_qty,
           CAST(coalesce(l.qty, 0) - coalesce(s.qty, 0) AS DECIMAL(18,2)) AS difference
    FROM (SELECT supply_id, CAST(sum(qty) AS DECIMAL(18,2)) AS qty FROM stock_ledger GROUP BY supply_id) l
    FULL OUTER JOIN stock_snapshot s USING (supply_id)"""
check("ledger_vs_snapshot", "stock_ledger stock_snapshot", DRIFT)
check("cash_reconciliation", "cash_session cash_op", """
    SELECT session_id, CAST(opening AS DECIMAL(18,2)) AS opening, CAST(expected AS DECIMAL(18,2)) AS expected,
           CAST(computed AS DECIMAL(18,2)) AS computed, CAST(entered AS DECIMAL(18,2)) AS entered,
           CAST(computed - expected AS DECIMAL(18,2)) AS stored_gap,
           CAST(entered - expected AS DECIMAL(18,2)) AS expected_gap,
           CAST(entered - computed AS DECIMAL(18,2)) AS entered_gap
    FROM (SELECT s.*, s.opening + coalesce(o.moved, 0) AS expected
          FROM cash_session s
          LEFT JOIN (SELECT session_id, sum(amount) AS moved FROM cash_op GROUP BY session_id) o
                 ON s.session_id = o.session_id)""")

# Totals and reports

TOTALS = """
    SELECT s.supply_id, s.supply_name, s.min_qty, CAST(sum(l.qty) AS DECIMAL(18,2)) AS on_hand
    FROM stock_ledger l JOIN supply s ON l.supply_id = s.supply_id
    GROUP BY s.supply_id, s.supply_name, s.min_qty"""
check("stock_on_hand", "stock_ledger supply", f"{TOTALS} HAVING sum(l.qty) >= 0")
check("stock_totals", "stock_ledger supply", TOTALS)
check("stock_of_supply", "stock_ledger supply order_request", f"""
    SELECT k.supply_id, t.supply_name, t.on_hand
    FROM (SELECT DISTINCT dish_id AS supply_id FROM order_request) k
    LEFT JOIN ({TOTALS}) t ON k.supply_id = t.supply_id""")
STATUS = f"""
    SELECT *, CASE WHEN on_hand <= min_qty THEN 'ROJO' WHEN on_hand < min_qty * 1.3 THEN 'AMARILLO' ELSE 'VERDE' END AS status
    FROM ({TOTALS})"""
check("stock_status", "stock_ledger supply", STATUS)
BY_DAY = """SELECT strftime(created_at, '%Y-%m-%d') AS day, CAST(sum(entered) AS DECIMAL(18,2)) AS total
            FROM cash_session"""
YEAR = "BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"
check("sales_by_day", "cash_session", f"{BY_DAY} GROUP BY 1")
check("sales_by_day_in_range", "cash_session", f"{BY_DAY} WHERE created_at {YEAR} GROUP BY 1")
BY_DISH = """SELECT d.dish_name, CAST(sum(s.amount) AS DECIMAL(18,2)) AS total
             FROM sale s JOIN dish d ON s.dish_id = d.dish_id"""
check("sales_by_dish", "sale dish", f"{BY_DISH} GROUP BY 1")
check("sales_by_dish_in_range", "sale dish", f"{BY_DISH} WHERE s.created_at {YEAR} GROUP BY 1")
CLOSED = """SELECT CAST(created_at AS DATE) AS day, CAST(sum(entered) AS DECIMAL(18,2)) AS total FROM cash_session"""
check("register_closings", "cash_session", f"{CLOSED} GROUP BY 1")
check("register_closings_in_range", "cash_session", f"""
    {CLOSED} WHERE updated_at >= DATE '1996-01-01' AND updated_at < DATE '1997-01-01' GROUP BY 1""")
HOURS = """SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS orders FROM order_event
           WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-11' GROUP BY 1 ORDER BY 1"""
check("orders_by_hour", "order_event", HOURS)
check("orders_by_day_and_hour", "order_event", """
    SELECT strftime(ts, '%Y-%b-%d') AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS orders
    FROM order_event GROUP BY 1, 2""")
check("events_between_days", "order_event", """
    SELECT count(*) FILTER (WHERE ts BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') AS midnight_end,
           count(*) FILTER (WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-13') AS inclusive_end
    FROM order_event""")
check("table_bill", "bill", "SELECT * FROM bill")
check("admin_guard", "staff", """
    SELECT count(*) FILTER (WHERE role_id = 1) AS admins, count(*) FILTER (WHERE role_id = 1) > 1 AS may_remove_one
    FROM staff""")
check("sales_by_waiter", "sale", """
    SELECT waiter_id, count(*) AS sales, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM sale GROUP BY waiter_id""")
check("stock_flow_by_class", "stock_ledger", """
    SELECT supply_id,
           CAST(coalesce(sum(qty) FILTER (WHERE NOT is_adjustment AND qty >= 0), 0) AS DECIMAL(18,2)) AS received,
           CAST(coalesce(sum(qty) FILTER (WHERE NOT is_adjustment AND qty < 0), 0) AS DECIMAL(18,2)) AS issued,
           CAST(coalesce(sum(qty) FILTER (WHERE is_adjustment), 0) AS DECIMAL(18,2)) AS adjusted
    FROM stock_ledger GROUP BY supply_id""")
check("dish_cost_margin", "recipe vendor_supply dish", """
    SELECT d.dish_id, d.dish_name, CAST(d.price AS DECIMAL(18,2)) AS price, c.cost,
           CAST(d.price - c.cost AS DECIMAL(18,2)) AS margin
    FROM dish d
    JOIN (SELECT r.dish_id, CAST(CASE WHEN count(*) = count(m.unit_price) THEN sum(r.qty * m.unit_price) END
                                 AS DECIMAL(18,2)) AS cost
          FROM recipe r
          LEFT JOIN (SELECT supply_id, min(unit_price) AS unit_price FROM vendor_supply GROUP BY supply_id) m
                 ON r.supply_id = m.supply_id
          GROUP BY r.dish_id) c ON d.dish_id = c.dish_id""")
check("order_state_counts", "order_line dish", """
    SELECT o.state, d.needs_prep, count(*) AS orders
    FROM order_line o JOIN dish d ON o.dish_id = d.dish_id GROUP BY 1, 2""")

# Ordered work

check("cash_running_balance", "cash_op cash_session", """
    SELECT o.*, CAST(s.opening + sum(o.amount) OVER (
                    PARTITION BY o.session_id ORDER BY o.created_at, o.op_line, o.op_ref, o.cashier_id, o.amount
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance
    FROM cash_op o JOIN cash_session s ON o.session_id = s.session_id""")
check("stock_running_balance", "stock_ledger", """
    SELECT *, CAST(sum(qty) OVER (
                    PARTITION BY supply_id ORDER BY created_at, ledger_ref, ledger_line, keeper_id, ledger_value
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance
    FROM stock_ledger""")
check("row_index", "cash_session", f"""
    SELECT *, row_number() OVER (ORDER BY day) AS position FROM ({BY_DAY} GROUP BY 1)""")
check("assign_ids", "order_request", """
    SELECT req_id, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY req_id) AS order_id
    FROM order_request""")

# Expressions

check("date_expressions", "order_event", """
    SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m-%d') AS day_text,
           strftime(ts, '%Y-%b-%d') AS day_label, CAST(ts AS DATE) AS day_again, strftime(ts, '%H:%M') AS clock,
           ts BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AS in_range,
           ts >= DATE '2024-01-10' AND ts < DATE '2024-01-11' AS on_day
    FROM order_event""")
check("money_expressions", "cash_op", """
    SELECT session_id, op_line, amount, CAST(-amount AS DECIMAL(18,2)) AS turned,
           CAST(amount + 10.25 AS DECIMAL(18,2)) AS raised, CAST(amount * 1.5 AS DECIMAL(18,3)) AS scaled,
           CAST(amount AS DECIMAL(12,1)) AS one_decimal, format('{:,.2f}', CAST(amount AS DOUBLE)) AS shown,
           CASE WHEN amount > 0 THEN 'IN' WHEN amount < 0 THEN 'OUT' END AS direction, abs(amount) AS size
    FROM cash_op""")
check("label_expressions", "order_request order_message", """
    SELECT req_id, coalesce('Mesa ' || table_no, 'Para llevar') AS table_label,
           'Pago por consumo de la mesa ' || table_no AS payment_text, message,
           CAST(waiter_id AS DECIMAL(12,2)) AS waiter_number
    FROM order_request LEFT JOIN order_message ON result_code = req_id % 5""")
check("clean_strings", "supply", """
    SELECT supply_id, CASE WHEN min_qty > 50 THEN supply_name END AS supply_name FROM supply""")
check("hide_sensitive", "staff", "SELECT staff_id, username, role_id, enabled FROM staff")

# Bulk requests

check("apply_orders", "coded_order_request order_message", """
    SELECT req_id, dish_id, table_no, waiter_id, ts, result_code, message
    FROM coded_order_request JOIN order_message USING (result_code)""")
check("apply_orders_new_lines", "coded_order_request", """
    SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY req_id) AS order_id,
           dish_id, table_no, waiter_id, 'PENDIENTE' AS state, ts
    FROM coded_order_request WHERE result_code = 1""")
check("apply_orders_stock", "coded_order_request recipe stock_snapshot", """
    SELECT s.supply_id, CAST(s.qty - coalesce(u.qty, 0) AS DECIMAL(18,2)) AS qty
    FROM stock_snapshot s
    LEFT JOIN (SELECT x.supply_id, sum(x.qty) AS qty FROM coded_order_request r JOIN recipe x ON r.dish_id = x.dish_id
               WHERE r.result_code = 1 GROUP BY x.supply_id) u ON s.supply_id = u.supply_id""")
check("apply_receipts", "coded_receipt", """
    SELECT *, CASE result_code WHEN 1 THEN 'Entrada registrada correctamente' WHEN 2 THEN 'El insumo no existe'
                   WHEN 3 THEN 'El almacenero no existe o está deshabilitado'
                   WHEN 4 THEN 'La cantidad ingresada es inválida' END AS message
    FROM coded_receipt""")
check("apply_receipts_stock", "coded_receipt supply", """
    SELECT s.supply_id, CAST(s.min_qty + coalesce(u.qty, 0) AS DECIMAL(18,2)) AS qty
    FROM supply s LEFT JOIN (SELECT supply_id, sum(qty) AS qty FROM coded_receipt WHERE result_code = 1
                             GROUP BY supply_id) u ON s.supply_id = u.supply_id""")
check("apply_issues", "coded_movement", """
    SELECT req_ref, req_line, supply_id, keeper_id, qty, ts, req_value, result_code,
           CASE result_code WHEN 1 THEN 'Salida registrada correctamente' WHEN 2 THEN 'El insumo no existe'
                WHEN 3 THEN 'El almacenero no existe o está deshabilitado'
                WHEN 4 THEN 'La cantidad ingresada es inválida'
                WHEN 5 THEN 'La cantidad excede a la cantidad del insumo existente' END AS message
    FROM coded_movement""")
FOLDED_STOCK = "SELECT supply_id, arg_max(balance, place) AS qty FROM folded GROUP BY supply_id"
check("apply_issues_stock", "folded", FOLDED_STOCK)
check("apply_adjustments", "supply stock_ledger", """
    SELECT s.supply_id, CAST(s.min_qty + 5 - coalesce(l.qty, 0) AS DECIMAL(18,2)) AS qty, true AS is_adjustment
    FROM supply s LEFT JOIN (SELECT supply_id, sum(qty) AS qty FROM stock_ledger GROUP BY supply_id) l
                         ON s.supply_id = l.supply_id
    UNION ALL SELECT supply_id, CAST(-5 AS DECIMAL(18,2)), true FROM supply""")
check("apply_adjustments_results", "supply", """
    SELECT supply_id * 5 + k AS req_id, CASE k WHEN 3 THEN -supply_id - 1 WHEN 4 THEN NULL ELSE supply_id END AS supply_id,
           CAST(CASE k WHEN 0 THEN min_qty + 5 WHEN 1 THEN NULL ELSE min_qty END AS DECIMAL(8,2)) AS counted,
           CAST(CASE k WHEN 1 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 1 END AS INTEGER) AS result_code,
           CASE k WHEN 1 THEN 'La cantidad ingresada es inválida' WHEN 3 THEN 'El insumo no existe' WHEN 4 THEN 'El insumo no existe'
                  ELSE 'Existencia ajustada correctamente' END AS message
    FROM supply, range(5) r(k)""")
check("apply_cash_ops", "coded_cash_request", """
    SELECT *, CASE result_code WHEN 1 THEN 'Operacion registrada correctamente' WHEN 2 THEN 'Monto no valido'
                   WHEN 3 THEN 'Cajero no existe o esta deshabilitado'
                   WHEN 4 THEN 'La caja todavía no está abierta' END AS message
    FROM coded_cash_request""")
check("apply_cash_ops_register", "coded_cash_request register", """
    SELECT register_id, CAST(current_amount + coalesce((SELECT sum(amount) FROM coded_cash_request WHERE result_code = 1), 0)
                             AS DECIMAL(18,2)) AS current_amount, session_id
    FROM register""")
check("apply_table_payments", "coded_payment", """
    SELECT req_id, table_no, cashier_id, result_code,
           CASE result_code WHEN 1 THEN 'Pago registrada correctamente' WHEN 2 THEN 'La mesa no tiene ningún pedido'
                WHEN 3 THEN 'Cajero no existe o esta deshabilitado'
                WHEN 4 THEN 'La caja todavía no está abierta' END AS message
    FROM coded_payment""")
check("apply_table_payments_ops", "coded_payment register", """
    SELECT (SELECT session_id FROM register) AS session_id, total AS amount,
           'Pago por consumo de la mesa ' || table_no AS note, cashier_id, orders
    FROM coded_payment WHERE result_code = 1""")
check("apply_table_payments_sales", "paid_table order_line dish", """
    SELECT o.dish_id, o.waiter_id, d.price AS amount
    FROM order_line o JOIN paid_table p ON o.table_no = p.table_no JOIN dish d ON o.dish_id = d.dish_id""")
check("apply_table_payments_register", "coded_payment register", """
    SELECT register_id, CAST(current_amount + coalesce((SELECT sum(total) FROM coded_payment WHERE result_code = 1), 0)
                             AS DECIMAL(18,2)) AS current_amount, session_id
    FROM register""")
check("apply_table_payments_open", "paid_table order_line", """
    SELECT * FROM order_line WHERE table_no IS NULL OR table_no NOT IN (SELECT table_no FROM paid_table)""")
NEWEST = """SELECT order_id, state, ts FROM (
                SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) AS place
                FROM order_event) WHERE place = 1"""
check("apply_state_changes", "open_order order_event", f"""
    SELECT o.order_id, o.dish_id, o.table_no, o.waiter_id, coalesce(n.state, o.state) AS state,
           coalesce(n.ts, o.created_at) AS updated_at
    FROM open_order o LEFT JOIN ({NEWEST}) n ON o.order_id = n.order_id""")
check("state_jumps", "order_event", """
    SELECT from_state, to_state, count(*) AS changes,
           CASE WHEN from_state IS NULL THEN to_state = 'PENDIENTE'
                ELSE (from_state = 'PENDIENTE' AND to_state = 'EN PREPARACION')
                  OR (from_state = 'EN PREPARACION' AND to_state = 'PREPARADO')
                  OR (from_state = 'PREPARADO' AND to_state = 'ENTREGADO') END AS usual
    FROM (SELECT lag(state) OVER (PARTITION BY order_id ORDER BY ts, event_id) AS from_state, state AS to_state
          FROM order_event)
    GROUP BY from_state, to_state""")
check("apply_order_edits", "coded_order_request order_message edited_order", """
    SELECT r.req_id, r.req_id AS order_id, r.result_code, m.message,
           CAST(CASE WHEN r.req_id IN (SELECT order_id FROM edited_order) THEN 1 ELSE 0 END AS INTEGER) AS rows_affected
    FROM coded_order_request r JOIN order_message m USING (result_code)""")
check("apply_order_edits_orders", "open_order edited_order", """
    SELECT o.order_id, CASE WHEN e.order_id IS NULL THEN o.dish_id ELSE e.new_dish END AS dish_id,
           CASE WHEN e.order_id IS NULL THEN o.table_no ELSE e.new_table END AS table_no,
           CASE WHEN e.order_id IS NULL THEN o.waiter_id ELSE e.new_waiter END AS waiter_id,
           o.state, CASE WHEN e.order_id IS NULL THEN o.created_at ELSE e.ts END AS updated_at
    FROM open_order o LEFT JOIN edited_order e ON o.order_id = e.order_id""")
check("apply_order_edits_stock", "edited_order recipe stock_snapshot", """
    SELECT s.supply_id, CAST(s.qty + coalesce(u.qty, 0) AS DECIMAL(18,2)) AS qty
    FROM stock_snapshot s
    LEFT JOIN (SELECT supply_id, sum(qty) AS qty
               FROM (SELECT x.supply_id, x.qty FROM edited_order e JOIN recipe x ON e.dish_id = x.dish_id
                     UNION ALL
                     SELECT x.supply_id, -x.qty FROM edited_order e JOIN recipe x ON e.new_dish = x.dish_id)
               GROUP BY supply_id) u ON s.supply_id = u.supply_id""")
check("apply_order_cancels", "cancel cancelled_order", """
    SELECT req_id, order_id,
           CAST(CASE WHEN order_id IN (SELECT order_id FROM cancelled_order) THEN 1 ELSE 0 END AS INTEGER) AS rows_affected
    FROM cancel""")
check("apply_order_cancels_orders", "open_order cancelled_order", """
    SELECT * FROM open_order WHERE order_id NOT IN (SELECT order_id FROM cancelled_order)""")
check("apply_order_cancels_stock", "cancelled_order recipe stock_snapshot", """
    SELECT s.supply_id, CAST(s.qty + coalesce(u.qty, 0) AS DECIMAL(18,2)) AS qty
    FROM stock_snapshot s
    LEFT JOIN (SELECT x.supply_id, sum(x.qty) AS qty FROM cancelled_order o JOIN recipe x ON o.dish_id = x.dish_id
               GROUP BY x.supply_id) u ON s.supply_id = u.supply_id""")
check("apply_ledger_corrections", "stock_ledger", """
    SELECT ledger_ref, ledger_line, supply_id, keeper_id,
           CAST(CASE WHEN ledger_line = 6 AND qty > 0 THEN 1 ELSE qty END AS DECIMAL(8,2)) AS qty,
           is_adjustment, created_at, ledger_value
    FROM stock_ledger WHERE ledger_line <> 7""")
check("apply_ledger_corrections_stock", "stock_ledger stock_snapshot", """
    SELECT s.supply_id, CAST(s.qty - coalesce(u.qty, 0) AS DECIMAL(18,2)) AS qty
    FROM stock_snapshot s
    LEFT JOIN (SELECT supply_id, sum(qty) AS qty FROM stock_ledger WHERE ledger_line = 7 AND qty < 0
               GROUP BY supply_id) u ON s.supply_id = u.supply_id""")
check("register_event_codes", "coded_register_event", """
    SELECT *, CASE WHEN action = 'open' AND result_code = 1 THEN 'Caja abierta correctamente'
                   WHEN action = 'open' THEN 'La caja ya estaba abierta'
                   WHEN action = 'close' AND result_code = 1 THEN 'Caja cerrada correctamente'
                   WHEN action = 'close' THEN 'No hay una caja abierta'
                   WHEN result_code = 1 THEN 'Operacion registrada correctamente'
                   ELSE 'La caja todavía no está abierta' END AS message
    FROM coded_register_event""")
check("cash_sessions_from_events", "coded_register_event", """
    SELECT register_id, session_no,
           CAST(max(amount) FILTER (WHERE action = 'open') AS DECIMAL(18,2)) AS opening,
           CAST(CASE WHEN count(*) FILTER (WHERE action = 'close') > 0
                     THEN coalesce(sum(amount) FILTER (WHERE action <> 'close'), 0) END AS DECIMAL(18,2)) AS computed,
           CAST(max(amount) FILTER (WHERE action = 'close') AS DECIMAL(18,2)) AS entered,
           min(ts) FILTER (WHERE action = 'open') AS opened_at, max(ts) FILTER (WHERE action = 'close') AS closed_at
    FROM (SELECT *, count(*) FILTER (WHERE action = 'open') OVER (
                        PARTITION BY register_id ORDER BY ts, req_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no
          FROM coded_register_event WHERE result_code = 1)
    GROUP BY register_id, session_no""")
check("upsert_dimension", "grown_dish", "SELECT * FROM grown_dish")
check("upsert_staff", "staff coded_staff_change", """
    SELECT coalesce(c.staff_id, s.staff_id) AS staff_id, coalesce(c.username, s.username) AS username,
           coalesce(c.role_id, s.role_id) AS role_id, coalesce(s.enabled, false) AS enabled
    FROM staff s FULL OUTER JOIN (SELECT * FROM coded_staff_change WHERE ok) c ON s.staff_id = c.staff_id""")
check("upsert_staff_results", "coded_staff_change", """
    SELECT req_id, staff_id, ok, CASE WHEN stored THEN 'update' ELSE 'insert' END AS change,
           CASE WHEN NOT ok THEN 'No existe ese rol' WHEN NOT stored THEN 'Usuario registrado' END AS message
    FROM coded_staff_change""")
check("toggle_flags", "dish dish_change", """
    SELECT d.dish_id, d.dish_name, d.price, coalesce(c.active, d.active) AS active, d.needs_prep
    FROM dish d LEFT JOIN dish_change c ON d.dish_id = c.dish_id""")
check("toggle_staff", "staff coded_staff_toggle", """
    SELECT s.staff_id, s.username, s.role_id, CASE WHEN t.ok THEN t.target ELSE s.enabled END AS enabled
    FROM staff s LEFT JOIN coded_staff_toggle t ON s.staff_id = t.staff_id""")
check("toggle_staff_results", "coded_staff_toggle", """
    SELECT req_id, staff_id, ok,
           CASE WHEN NOT stored THEN 'El usuario no existe en la base de datos'
                WHEN NOT ok THEN 'El usuario es de tipo admministrador. No se pudo desactivar su cuenta'
                WHEN NOT target THEN 'Usuario desactivado correctamente' END AS message
    FROM coded_staff_toggle""")
check("delete_rows", "grown_dish coded_dish_delete", """
    SELECT * FROM grown_dish WHERE dish_id NOT IN (SELECT dish_id FROM coded_dish_delete WHERE result_code = 1)""")
check("delete_rows_results", "coded_dish_delete", """
    SELECT req_id, dish_id, result_code, CAST(CASE WHEN result_code = 1 THEN 1 ELSE 0 END AS INTEGER) AS rows_affected
    FROM coded_dish_delete""")
check("delete_supplies", "kept_supply", "SELECT supply_id, supply_name, min_qty FROM kept_supply")
check("delete_supplies_stock", "kept_supply", "SELECT supply_id, CAST(qty AS DECIMAL(8,2)) AS qty FROM kept_supply")
check("delete_staff", "coded_staff_delete", """
    SELECT req_id, staff_id, NOT stays AS ok,
           CASE WHEN stays THEN 'No se puede eliminar al ultimo usuario administrador'
                ELSE 'Usuario eliminado correctamente' END AS message,
           CAST(CASE WHEN stored AND NOT stays THEN 1 ELSE 0 END AS INTEGER) AS rows_affected
    FROM coded_staff_delete""")
check("delete_staff_remaining", "staff coded_staff_delete", """
    SELECT * FROM staff WHERE staff_id NOT IN (SELECT staff_id FROM coded_staff_delete WHERE NOT stays)""")
check("upsert_bridge", "recipe coded_recipe_line", """
    SELECT dish_id, supply_id, qty FROM recipe
    UNION ALL SELECT dish_id, supply_id, qty FROM coded_recipe_line WHERE result_code = 1""")
check("upsert_bridge_results", "coded_recipe_line", """
    SELECT req_id, dish_id, supply_id, result_code FROM coded_recipe_line""")
check("remove_recipe_lines", "recipe coded_recipe_line", """
    SELECT r.* FROM recipe r
    WHERE NOT EXISTS (SELECT 1 FROM coded_recipe_line c WHERE c.dish_id = r.dish_id AND c.supply_id = r.supply_id)""")
check("unlink_supplies", "vendor_supply unlink", """
    SELECT v.* FROM vendor_supply v
    WHERE NOT EXISTS (SELECT 1 FROM unlink u WHERE u.supply_id = v.supply_id
                        AND (u.vendor_id IS NULL OR u.vendor_id = v.vendor_id))""")
check("add_supplies", "grown_supply", """
    SELECT supply_id, supply_name, min_qty, CAST(qty AS DECIMAL(8,2)) AS qty FROM grown_supply""")
check("link_new_supplies", "linked_supply", """
    SELECT supply_id, supply_name, min_qty, vendor_id, CAST(0 AS DECIMAL(8,2)) AS unit_price, CAST(0 AS DECIMAL(8,2)) AS qty
    FROM linked_supply""")

# Audits


def _keys(name: str, key: str) -> str:
    null_test = " OR ".join(f"{column.strip()} IS NULL" for column in key.split(","))
    return f"""
        SELECT '{name}' AS table_name, count(*) FILTER (WHERE n > 1) AS repeated_keys,
               CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeated_rows,
               CAST(coalesce(sum(n) FILTER (WHERE {null_test}), 0) AS BIGINT) AS null_rows
        FROM (SELECT {key}, count(*) AS n FROM {name} GROUP BY {key})"""


check(
    "audit_primary_keys",
    "dish supply staff role dining_table vendor_supply recipe cash_session open_order order_event order_line stock_ledger",
    "\nUNION ALL".join(
        [
            _keys("dish", "dish_id"),
            _keys("supply", "supply_id"),
            _keys("staff", "staff_id"),
            _keys("role", "role_id"),
            _keys("dining_table", "table_no"),
            _keys("vendor_supply", "vendor_id, supply_id"),
            _keys("recipe", "dish_id, supply_id"),
            _keys("cash_session", "session_id"),
            _keys("open_order", "order_id"),
            _keys("order_event", "event_id"),
            _keys("order_line", "order_id, line_no"),
            _keys("stock_ledger", "ledger_ref, ledger_line, supply_id, keeper_id, created_at, ledger_value"),
        ]
    ),
)


def _orphans(name: str, child: str, column: str, parent: str, key: str) -> str:
    return f"""
        SELECT '{name}' AS reference, count(DISTINCT {column}) AS orphan_keys, count(*) AS orphan_rows
        FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})"""


check(
    "audit_foreign_keys",
    "stock_ledger stock_snapshot supply staff sale dish order_line dining_table recipe offer vendor cash_op cash_session"
    " role order_request",
    "\nUNION ALL".join(
        [
            _orphans("stock_ledger.supply", "stock_ledger", "supply_id", "supply", "supply_id"),
            _orphans("stock_ledger.keeper", "stock_ledger", "keeper_id", "staff", "staff_id"),
            _orphans("stock_snapshot.supply", "stock_snapshot", "supply_id", "supply", "supply_id"),
            _orphans("sale.dish", "sale", "dish_id", "dish", "dish_id"),
            _orphans("sale.waiter", "sale", "waiter_id", "staff", "staff_id"),
            _orphans("order_line.dish", "order_line", "dish_id", "dish", "dish_id"),
            _orphans("order_line.table", "order_line", "table_no", "dining_table", "table_no"),
            _orphans("recipe.dish", "recipe", "dish_id", "dish", "dish_id"),
            _orphans("recipe.supply", "recipe", "supply_id", "supply", "supply_id"),
            _orphans("offer.vendor", "offer", "vendor_id", "vendor", "vendor_id"),
            _orphans("offer.supply", "offer", "supply_id", "supply", "supply_id"),
            _orphans("cash_op.session", "cash_op", "session_id", "cash_session", "session_id"),
            _orphans("staff.role", "staff", "role_id", "role", "role_id"),
            _orphans("order_request.dish", "order_request", "dish_id", "dish", "dish_id"),
            _orphans("order_request.table", "order_request", "table_no", "dining_table", "table_no"),
            _orphans("order_request.waiter", "order_request", "waiter_id", "staff", "staff_id"),
        ]
    ),
)
check(
    "audit_unique",
    "role staff dish",
    "\nUNION ALL".join([_keys("role", "role_name"), _keys("staff", "username"), _keys("dish", "dish_name")]),
)


def _rule(table: str, rule: str, broken: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) AS bad_rows FROM {table} WHERE {broken}"


check(
    "audit_domains",
    "dish order_line cash_session stock_ledger",
    "\nUNION ALL ".join(
        [
            _rule("dish", "name missing", "dish_name IS NULL"),
            _rule("dish", "name too long", "length(dish_name) > 45"),
            _rule("dish", "price below zero", "price < 0"),
            _rule("dish", "price out of range", "abs(price) >= 1000"),
            _rule("order_line", "state unknown", "state NOT IN ('PENDIENTE', 'EN PREPARACION', 'PREPARADO', 'ENTREGADO')"),
            _rule("order_line", "state not open", "state NOT IN ('PENDIENTE', 'EN PREPARACION', 'PREPARADO')"),
            _rule("order_line", "waiter missing", "waiter_id IS NULL"),
            _rule("cash_session", "entered missing", "entered IS NULL"),
            _rule("cash_session", "computed out of range", "abs(computed) >= 100000"),
            _rule("stock_ledger", "qty missing", "qty IS NULL"),
            _rule("stock_ledger", "qty below zero", "qty < 0"),
        ]
    ),
)
check("audit_ledger_drift", "stock_ledger stock_snapshot", f"SELECT * FROM ({DRIFT}) WHERE difference <> 0")
check("supplies_without_stock", "supply stock_snapshot", """
    SELECT supply_id, supply_name FROM supply WHERE supply_id NOT IN (SELECT supply_id FROM stock_snapshot)""")

# Streams: what a run over the stored files must give

WINDOWS = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour_start,
                    time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS hour_end, state, count(*) AS orders
             FROM order_event GROUP BY 1, 2, 3"""
check("stream_orders_by_hour", "order_event", f"""
    SELECT * FROM ({WINDOWS})
    WHERE hour_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM order_event)""")
check("orders_by_hour_windows", "order_event", WINDOWS)
check("stream_kitchen_board", "order_event", f"SELECT state, count(*) AS orders FROM ({NEWEST}) GROUP BY state")
check("latest_order_states", "order_event", f"SELECT order_id, state, ts AS updated_at FROM ({NEWEST})")
check("stream_stock_levels", "stock_ledger supply", STATUS)
check("stream_low_stock_alerts", "stock_ledger supply", f"""
    SELECT * FROM (WITH level AS (
        SELECT supply_id, min_qty, created_at, ledger_ref, ledger_line, keeper_id, ledger_value,
               sum(qty) OVER (PARTITION BY supply_id ORDER BY created_at, ledger_ref, ledger_line, keeper_id, ledger_value
                              ROWS UNBOUNDED PRECEDING) AS on_hand
        FROM stock_ledger JOIN supply USING (supply_id)),
    light AS (
        SELECT *, lag(on_hand <= min_qty, 1, false) OVER (
            PARTITION BY supply_id ORDER BY created_at, ledger_ref, ledger_line, keeper_id, ledger_value) AS was_red FROM level)
    SELECT supply_id, CAST(on_hand AS DECIMAL(18,2)) AS on_hand, min_qty, 'ROJO' AS status
    FROM light WHERE on_hand <= min_qty AND NOT was_red)""")
check("stream_apply_requests", "folded", FOLDED_STOCK)
check("stream_apply_orders", "coded_order_request", """
    SELECT row_number() OVER (ORDER BY req_id) AS order_id, dish_id, table_no, waiter_id, 'PENDIENTE' AS state, ts
    FROM coded_order_request WHERE result_code = 1""")
# The stream holds events back until the watermark, an hour behind the newest, has passed them.
check("stream_order_durations", "order_event", """
    SELECT * EXCLUDE (ts) FROM (
        SELECT event_id, order_id, lag(state) OVER w AS from_state, state AS to_state,
               epoch_us(ts) - epoch_us(lag(ts) OVER w) AS micros_in_state, ts
        FROM order_event WINDOW w AS (PARTITION BY order_id ORDER BY ts, event_id))
    WHERE ts < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM order_event)""")
check("find_by_key", "supply", "SELECT * FROM supply WHERE supply_id = 7")
check("first_row", "stock_ledger", "SELECT * FROM stock_ledger ORDER BY created_at, ledger_ref, ledger_line, keeper_id, ledger_value LIMIT 1")
check("upsert_dimension_as_of", "cash_session", """
    SELECT session_id, CAST(opening + 1 AS DECIMAL(12,2)) AS opening, TIMESTAMP '2020-01-01 00:00:00' AS updated_at FROM cash_session""")
check("order_durations", "order_event", """
    SELECT event_id, order_id, lag(state) OVER w AS from_state, state AS to_state,
           epoch_us(ts) - epoch_us(lag(ts) OVER w) AS micros_in_state
    FROM order_event WINDOW w AS (PARTITION BY order_id ORDER BY ts, event_id)""")
check("stream_dedup", "order_event", "SELECT * FROM order_event")

# Published batches give what the operators give.
for _name, _source in {
    "publish_receipts": "apply_receipts_stock",
    "publish_table_payments": "apply_table_payments_sales",
    "publish_order_edits": "apply_order_edits_stock",
    "publish_dishes": "delete_rows",
}.items():
    ORACLE[_name] = ORACLE[_source]

# Reports as SQL table functions

for _name, _source in {
    "sales_by_day": "sales_by_day",
    "sales_by_dish": "sales_by_dish",
    "register_closings": "register_closings",
    "orders_by_hour": "orders_by_hour",
    "stock_on_hand": "stock_on_hand",
    "stock_totals": "stock_totals",
    "table_bill": "table_bill",
    "admin_guard": "admin_guard",
    "sales_by_waiter": "sales_by_waiter",
    "stock_flow_by_class": "stock_flow_by_class",
    "dish_cost_margin": "dish_cost_margin",
}.items():
    ORACLE[f"sql_{_name}"] = ORACLE[_source]
check("sql_stock_of_supply", "stock_ledger supply", """
    SELECT any_value(supply_id) AS supply_id, any_value(supply_name) AS supply_name, CAST(sum(qty) AS DECIMAL(18,2)) AS on_hand
    FROM stock_ledger JOIN supply USING (supply_id) WHERE supply_id = 1""")
