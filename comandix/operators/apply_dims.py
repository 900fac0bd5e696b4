"""Bulk changes of dimensions and bridges: insert, update, enable, disable, delete, link, unlink.

Plain Parquet tables have no MERGE, so each operator returns the whole new table, made by one join
on the key, for the caller to publish as a new version.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comandix import model
from comandix.operators import hotkeys
from comandix.operators.joins import known_reference, last_by_key


def upsert_dimension(
    table: DataFrame, changes: DataFrame, key: str, as_of: Column | None = None, defaults: dict | None = None
) -> DataFrame:
    """Insert unknown keys and update known ones. Changes of one key follow each other by ``req_id``.

    Changes without a key go.     A NULL or missing column in a change leaves the stored value. Inserts take ``defaults`` for
    columns they do not carry. ``as_of`` refreshes ``updated_at`` where a row was inserted or updated.
    """
    defaults = defaults or {}
    values = [c for c in changes.columns if c not in (key, "req_id")]
    new = last_by_key(changes, [key], values).select(key, *[F.col(c).alias(f"_new_{c}") for c in values])
    old = table.withColumn("_stored", F.lit(True))
    both = old.join(new.withColumn("_change", F.lit(True)), key, "full_outer")
    columns = []
    for name in table.columns:
        if name == key:
            columns.append(F.col(key))
            continue
        value = F.coalesce(f"_new_{name}", name) if name in values else F.col(name)
        if name in defaults:
            value = F.when(F.col("_stored").isNull(), F.coalesce(value, F.lit(defaults[name]))).otherwise(value)
        if name == "updated_at" and as_of is not None:
            value = F.when(F.col("_change").isNotNull(), as_of).otherwise(F.col(name))
        columns.append(value.cast(table.schema[name].dataType).alias(name))
    return both.select(*columns)


@dataclass(frozen=True)
class DimensionApplied:
    """A report per request and the table afterwards."""

    results: DataFrame
    table: DataFrame


def apply_staff_changes(changes: DataFrame, staff: DataFrame, roles: DataFrame) -> DimensionApplied:
    """New staff start disabled and need an existing role; known staff are updated as asked.

    Requests for one person follow each other by ``req_id``: after the first that inserts, they update.
    """
    marked = known_reference(changes, roles, "role_id", "role_id", "_role")
    stored = staff.select("staff_id", F.lit(True).alias("_stored"))
    marked = marked.join(stored, "staff_id", "left")
    inserts = marked.where("_stored IS NULL AND _role IS NOT NULL").groupBy("staff_id").agg(F.min("req_id").alias("_first"))
    marked = marked.join(inserts, "staff_id", "left")
    there = F.col("_stored").isNotNull() | F.coalesce(F.col("req_id") > F.col("_first"), F.lit(False))
    marked = marked.withColumn("_stored", F.when(there, F.lit(True)))
    ok = F.col("staff_id").isNotNull() & (F.col("_stored").isNotNull() | F.col("_role").isNotNull())
    reported = marked.withColumn("ok", ok)
    results = reported.select(
        "req_id",
        "staff_id",
        "ok",
        F.when(F.col("_stored").isNull(), "insert").otherwise("update").alias("change"),
        F.when(F.col("ok") & F.col("_stored").isNull(), model.USER_CREATED)
        .when(~F.col("ok"), model.USER_ROLE_UNKNOWN)
        .alias("message"),
    )
    accepted = reported.where("ok").select("req_id", "staff_id", "username", "role_id")
    return DimensionApplied(results, upsert_dimension(staff, accepted, "staff_id", defaults={"enabled": False}))


def toggle_flag(table: DataFrame, requests: DataFrame, key: str, flag: str) -> DataFrame:
    """Set a flag to the ``target`` of each key's last request by ``req_id``."""
    wanted = last_by_key(requests, [key], ["target"]).withColumnRenamed("target", "_target")
    joined = table.join(wanted, key, "left")
    return joined.withColumn(flag, F.coalesce("_target", flag)).select(*table.columns)


def toggle_staff(requests: DataFrame, staff: DataFrame) -> DimensionApplied:
    """Activate or deactivate staff. Administrators may not be deactivated; unknown people are reported."""
    stored = staff.select("staff_id", "role_id", F.lit(True).alias("_stored"))
    marked = requests.join(stored, "staff_id", "left")
    admin = F.col("role_id") == model.ADMIN_ROLE
    marked = marked.withColumn("ok", F.col("_stored").isNotNull() & (F.col("target") | ~admin))
    results = marked.select(
        "req_id",
        "staff_id",
        "ok",
        F.when(F.col("_stored").isNull(), model.USER_UNKNOWN)
        .when(~F.col("ok"), model.USER_IS_ADMIN)
        .when(~F.col("target"), model.USER_DISABLED)
        .alias("message"),
    )
    return DimensionApplied(results, toggle_flag(staff, marked.where("ok"), "staff_id", "enabled"))


def delete_rows(
    requests: DataFrame, table: DataFrame, key: str, children: list[DataFrame] = ()
) -> DimensionApplied:
    """Delete rows by key: 1 deleted, 2 other tables still refer to it, 3 no such row.

    ``children`` are tables that have the key. ``rows_affected`` counts what the first request of a key deleted. A request
    without a key finds no row.
    """
    return _deleted(requests, table, key, _verdicts(requests, table, key, children))


def _verdicts(requests: DataFrame, table: DataFrame, key: str, children: list[DataFrame]) -> DataFrame:
    """Per key that is asked for: its code, its first request and how many rows of the table have it.

    Requests, rows and references are tagged rows of one aggregation. Joined, all of them would be sorted in one task.
    """
    asked = requests.select(key, F.lit("asked").alias("_tag"), "req_id")
    none = F.lit(None).cast(requests.schema["req_id"].dataType).alias("req_id")
    others = [table.select(key, F.lit("row").alias("_tag"), none)]
    others += [child.select(key, F.lit("used").alias("_tag"), none) for child in children]
    counts = [F.count(F.when(F.col("_tag") == tag, 1)).alias(f"_{tag}") for tag in ("asked", "row", "used")]
    tagged = reduce(DataFrame.unionByName, others, asked).where(F.col(key).isNotNull())
    found = tagged.groupBy(key).agg(F.min("req_id").alias("_first"), *counts)
    code = F.when(F.col("_row") == 0, 3).when(F.col("_used") > 0, 2).otherwise(1)
    return found.where("_asked > 0").select(key, "_first", "_row", code.alias("result_code"))


def _deleted(requests: DataFrame, table: DataFrame, key: str, verdicts: DataFrame) -> DimensionApplied:
    # A key that several rows of the table have is reported once for each.
    times = F.array_repeat(F.lit(0), F.greatest(F.col("_row"), F.lit(1)).cast("int"))
    results = (
        requests.join(verdicts, key, "left")
        .withColumn("_time", F.explode(times))
        .withColumn("result_code", F.coalesce("result_code", F.lit(3)))
        .withColumn("rows_affected", F.coalesce(((F.col("result_code") == 1) & (F.col("req_id") == F.col("_first"))).cast("int"), F.lit(0)))
        .select("req_id", key, "result_code", "rows_affected")
    )
    return DimensionApplied(results, table.join(verdicts.where("result_code = 1"), key, "left_anti"))


def delete_supplies(
    requests: DataFrame, supplies: DataFrame, snapshot: DataFrame, children: list[DataFrame]
) -> tuple[DimensionApplied, DataFrame]:
    """Delete supplies together with their stock row."""
    verdicts = _verdicts(requests, supplies, "supply_id", children)
    gone = verdicts.where("result_code = 1 AND _first IS NOT NULL").select("supply_id")
    return _deleted(requests, supplies, "supply_id", verdicts), snapshot.join(gone, "supply_id", "left_anti")


def delete_staff(requests: DataFrame, staff: DataFrame) -> DimensionApplied:
    """Delete staff one after the other; the last administrator stays.

    Only the last of the requested administrators can be the last one there is, and only when
    every administrator is requested, so one count and one maximum decide it.
    """
    admin = F.col("role_id") == model.ADMIN_ROLE
    admins = staff.where(admin).agg(F.count(F.lit(1)).alias("n")).scalar()
    first = requests.groupBy("staff_id").agg(F.min("req_id").alias("_first"))
    known = first.join(staff.select("staff_id", "role_id"), "staff_id")
    asked = known.where(admin).agg(
        F.when(F.count(F.lit(1)) >= admins, F.max("_first")).alias("last_req")
    )
    last_req = asked.scalar()
    verdict = known.select("staff_id", "_first", "role_id").withColumn(
        "_stays", F.coalesce(admin & (F.col("_first") == last_req), F.lit(False))
    )
    marked = requests.join(verdict, "staff_id", "left")
    # A repeated request for the administrator who stays is refused again; for anyone else it finds nobody.
    stays = F.coalesce("_stays", F.lit(False))
    results = marked.select(
        "req_id",
        "staff_id",
        (~stays).alias("ok"),
        F.when(stays, model.USER_LAST_ADMIN).otherwise(model.USER_DELETED).alias("message"),
        F.coalesce((~stays & (F.col("req_id") == F.col("_first"))).cast("int"), F.lit(0)).alias("rows_affected"),
    )
    gone = verdict.where("NOT _stays").select("staff_id")
    return DimensionApplied(results, staff.join(gone, "staff_id", "left_anti"))


def add_recipe_lines(
    requests: DataFrame, recipe: DataFrame, dishes: DataFrame, supplies: DataFrame
) -> DimensionApplied:
    """Add recipe lines: 1 added, 2 unknown dish or supply, 3 the dish already has that supply.

    The first request of a dish and supply in request order counts.
    """
    pair = ["dish_id", "supply_id"]
    coded = _coded_lines(requests, recipe, dishes, supplies)
    new = coded.where("result_code = 1").select(*pair, F.col("qty").cast(recipe.schema["qty"].dataType).alias("qty"))
    return DimensionApplied(
        coded.select("req_id", *pair, "result_code"), recipe.select(*pair, "qty").unionByName(new)
    )


def _coded_lines(requests: DataFrame, recipe: DataFrame, dishes: DataFrame, supplies: DataFrame) -> DataFrame:
    pair = ["dish_id", "supply_id"]
    marked = known_reference(requests, dishes, "dish_id", "dish_id", "_dish")
    marked = known_reference(marked, supplies, "supply_id", "supply_id", "_supply")
    marked = marked.join(recipe.select(*pair, F.lit(True).alias("_stored")), pair, "left")
    marked = marked.withColumn("_known", F.col("_dish").isNotNull() & F.col("_supply").isNotNull())
    first = marked.where("_known AND _stored IS NULL").groupBy(*pair).agg(F.min("req_id").alias("_first"))
    return marked.join(first, pair, "left").withColumn(
        "result_code",
        F.when(~F.col("_known"), 2)
        .when(F.col("_stored").isNotNull() | (F.col("req_id") != F.col("_first")), 3)
        .otherwise(1),
    )


def recipe_line_results(requests: DataFrame, recipe: DataFrame, dishes: DataFrame, supplies: DataFrame) -> DataFrame:
    """Requests with their codes and quantities."""
    return _coded_lines(requests, recipe, dishes, supplies).select("req_id", "dish_id", "supply_id", "qty", "result_code")


def remove_recipe_lines(requests: DataFrame, recipe: DataFrame) -> DataFrame:
    return recipe.join(requests.select("dish_id", "supply_id"), ["dish_id", "supply_id"], "left_anti")


def unlink_supplies(requests: DataFrame, offers: DataFrame) -> DataFrame:
    """Take supplies away from the named vendor, or from all vendors where none is named."""
    everywhere = requests.where("vendor_id IS NULL").select("supply_id")
    named = requests.where("vendor_id IS NOT NULL").select("vendor_id", "supply_id")
    return offers.join(everywhere, "supply_id", "left_anti").join(named, ["vendor_id", "supply_id"], "left_anti").select(
        *offers.columns
    )


@dataclass(frozen=True)
class SuppliesAdded:
    """New rows: supplies, their empty stock rows and, where vendors bring them, their offers."""

    supplies: DataFrame
    stock_rows: DataFrame
    offers: DataFrame | None = None


def add_supplies(requests: DataFrame, supplies: DataFrame) -> SuppliesAdded:
    """New supplies with new ids and an empty stock row each."""
    return _supplies_added(_numbered(requests, supplies))


def link_new_supplies(requests: DataFrame, supplies: DataFrame) -> SuppliesAdded:
    """New supplies as above, each offered by the vendor that brings it."""
    numbered = _numbered(requests, supplies)
    added = _supplies_added(numbered)
    return SuppliesAdded(added.supplies, added.stock_rows, numbered.select("vendor_id", "supply_id", _zero("unit_price")))


def _numbered(requests: DataFrame, supplies: DataFrame) -> DataFrame:
    last = supplies.agg(F.coalesce(F.max("supply_id"), F.lit(0)).alias("id")).scalar()
    return hotkeys.assign_ids(requests, "req_id", "supply_id", last)


def _supplies_added(numbered: DataFrame) -> SuppliesAdded:
    return SuppliesAdded(
        numbered.select("supply_id", "supply_name", "min_qty"), numbered.select("supply_id", _zero("qty"))
    )


def _zero(alias: str) -> Column:
    return F.lit(0).cast("decimal(8,2)").alias(alias)
