"""Fixed schemas, value domains and result messages of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _decimal(precision: int = 8) -> T.DecimalType:
    return T.DecimalType(precision, 2)


# States an order line can be in.
PENDING = "PENDIENTE"
IN_PREPARATION = "EN PREPARACION"
READY = "PREPARADO"
DELIVERED = "ENTREGADO"
ORDER_STATES = (PENDING, IN_PREPARATION, READY, DELIVERED)

# Traffic light of a stock level.
RED, AMBER, GREEN = "ROJO", "AMARILLO", "VERDE"

# The role that may not be deactivated or removed entirely.
ADMIN_ROLE = 1

# The longest name the model stores.
NAME_LENGTH = 45

# Message of every result code, per kind of request.
MESSAGES = {
    "open_register": {
        1: "Caja abierta correctamente",
        2: "La caja ya estaba abierta",
    },
    "close_register": {
        1: "Caja cerrada correctamente",
        2: "No hay una caja abierta",
    },
    "cash_operation": {
        1: "Operacion registrada correctamente",
        2: "Monto no valido",
        3: "Cajero no existe o esta deshabilitado",
        4: "La caja todavía no está abierta",
    },
    "table_payment": {
        1: "Pago registrada correctamente",
        2: "La mesa no tiene ningún pedido",
        3: "Cajero no existe o esta deshabilitado",
        4: "La caja todavía no está abierta",
    },
    "order": {
        1: "Pedido registrado correctamente",
        2: "El plato no existe o está desactivado",
        3: "La mesa no existe o está deshabilitada",
        4: "El mozo no existe o está deshabilitado",
    },
    "adjustment": {
        1: "Existencia ajustada correctamente",
        2: "El insumo no existe",
        4: "La cantidad ingresada es inválida",
    },
    "receipt": {
        1: "Entrada registrada correctamente",
        2: "El insumo no existe",
        3: "El almacenero no existe o está deshabilitado",
        4: "La cantidad ingresada es inválida",
    },
    "issue": {
        1: "Salida registrada correctamente",
        2: "El insumo no existe",
        3: "El almacenero no existe o está deshabilitado",
        4: "La cantidad ingresada es inválida",
        5: "La cantidad excede a la cantidad del insumo existente",
    },
}

USER_CREATED = "Usuario registrado"
USER_ROLE_UNKNOWN = "No existe ese rol"
USER_DISABLED = "Usuario desactivado correctamente"
USER_IS_ADMIN = "El usuario es de tipo admministrador. No se pudo desactivar su cuenta"
USER_UNKNOWN = "El usuario no existe en la base de datos"
USER_DELETED = "Usuario eliminado correctamente"
USER_LAST_ADMIN = "No se puede eliminar al ultimo usuario administrador"
TABLE_PAYMENT_TEXT = "Pago por consumo de la mesa "
TAKE_AWAY_TEXT = "Para llevar"

# Columns that never leave the engine.
SENSITIVE_COLUMNS = ("password", "api_token", "remember_token")


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


LONG, TEXT, FLAG = T.LongType(), T.StringType(), T.BooleanType()
INSTANT, CLOCK = T.TimestampType(), T.TimestampNTZType()

SCHEMAS = {
    "supply": _schema(("supply_id", LONG, False), ("supply_name", TEXT, False), ("min_qty", _decimal(), False)),
    "dish": _schema(
        ("dish_id", LONG, False),
        ("dish_name", TEXT, False),
        ("price", _decimal(6), False),
        ("active", FLAG, True),
        ("needs_prep", FLAG, True),
    ),
    "dining_table": _schema(("table_no", LONG, False), ("active", FLAG, False)),
    "role": _schema(("role_id", LONG, False), ("role_name", TEXT, True)),
    "staff": _schema(
        ("staff_id", LONG, False), ("role_id", LONG, False), ("username", TEXT, True), ("enabled", FLAG, True)
    ),
    "vendor": _schema(("vendor_id", LONG, False), ("vendor_name", TEXT, False)),
    "vendor_supply": _schema(("vendor_id", LONG, False), ("supply_id", LONG, False), ("unit_price", _decimal(), False)),
    "recipe": _schema(("dish_id", LONG, False), ("supply_id", LONG, False), ("qty", _decimal(5), False)),
    "stock_snapshot": _schema(("supply_id", LONG, False), ("qty", _decimal(), False)),
    "stock_ledger": _schema(
        ("ledger_id", LONG, False),
        ("is_adjustment", FLAG, False),
        ("supply_id", LONG, False),
        ("keeper_id", LONG, False),
        ("qty", _decimal(), False),
        ("note", TEXT, True),
        ("created_at", CLOCK, False),
    ),
    "register": _schema(
        ("register_id", LONG, False), ("current_amount", _decimal(), True), ("session_id", LONG, True)
    ),
    "cash_session": _schema(
        ("session_id", LONG, False),
        ("opening", _decimal(), False),
        ("computed", _decimal(), True),
        ("entered", _decimal(), True),
        ("created_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "cash_op": _schema(
        ("op_id", LONG, False),
        ("session_id", LONG, False),
        ("amount", _decimal(), False),
        ("note", TEXT, False),
        ("cashier_id", LONG, False),
        ("created_at", CLOCK, False),
    ),
    "sale": _schema(
        ("sale_id", LONG, False),
        ("dish_id", LONG, False),
        ("waiter_id", LONG, True),
        ("amount", _decimal(6), False),
        ("created_at", INSTANT, False),
    ),
    "order_line": _schema(
        ("order_id", LONG, False),
        ("dish_id", LONG, False),
        ("table_no", LONG, True),
        ("waiter_id", LONG, True),
        ("state", TEXT, False),
        ("created_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "order_event": _schema(
        ("event_id", LONG, False), ("ts", INSTANT, False), ("order_id", LONG, False), ("state", TEXT, False)
    ),
}
