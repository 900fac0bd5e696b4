"""Running the streams: sinks that survive a retry, and a run over what is there now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comandix.functions.expressions import total
from comandix.operators import apply_orders, apply_stock, hotkeys
from comandix.operators.joins import bom_explosion, changed_stock
from comandix.session import keep_state_on_disk
from comandix.sources.sinks import Ledger, VersionedTables
from comandix.streaming import boards


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream's final rows to Parquet files until all present input is taken."""
    keep_state_on_disk(stream.sparkSession)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"
) -> None:
    """Hand every micro-batch to ``each`` until all present input is taken.

    ``each`` may see a batch id again after a failure and must then write the same place.
    """
    keep_state_on_disk(stream.sparkSession)
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def keep_newest(store: VersionedTables, name: str, key: str) -> Callable[[DataFrame, int], None]:
    """Keep the newest row of every key: each batch's rows are laid over what was there.

    Reading the table costs its keys and the changes of a few batches, not all changes ever made.
    """

    def each(rows: DataFrame, batch_id: int) -> None:
        if store.version() <= batch_id:
            store.publish(changes={name: (rows, [key])}, version=batch_id + 1)

    return each


def raise_alerts(
    store: VersionedTables, alerts_path: str, supplies: DataFrame, order: list[str], hot_rows: int = hotkeys.HOT_ROWS
) -> Callable[[DataFrame, int], None]:
    """Write a row for every movement that turns a supply's level red, and keep levels from batch to batch.

    A supply's movements of one trigger are cut into slices like any prefix scan, so one that has a third of
    all rows is many tasks, and a trigger may be of any size.
    """

    def each(movements: DataFrame, batch_id: int) -> None:
        if store.version() > batch_id:
            return
        held = store.read("levels") if store.version() else None
        known = movements.select("supply_id", "qty", *order).join(supplies.select("supply_id", "min_qty"), "supply_id")
        known = known.persist(StorageLevel.DISK_ONLY)
        try:
            Ledger(store.spark, alerts_path).append(boards.turned_red(known, held, order, hot_rows), str(batch_id))
            store.publish(changes={"levels": (boards.levels_after(known, held), ["supply_id"])}, version=batch_id + 1)
        finally:
            known.unpersist()

    return each


def add_board_changes(store: VersionedTables) -> Callable[[DataFrame, int], None]:
    """Add changes to a board of one row per state and publish it as the batch's version."""

    def each(changes: DataFrame, batch_id: int) -> None:
        if store.version() > batch_id:
            return
        board = changes.groupBy("state").agg(F.sum("change").alias("orders"))
        if batch_id > 0:
            board = board.unionByName(store.read("board")).groupBy("state").agg(F.sum("orders").alias("orders"))
        store.publish({"board": board}, version=batch_id + 1)

    return each


def unseen(
    requests: DataFrame, store: VersionedTables, key: list[str], ts: str | None, first_by: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Requests whose id was not applied before, each once, and those too old to tell.

    Of several requests with one id, whatever else they say, the first by ``first_by`` counts, then the smallest by its
    other columns. Ids applied by earlier batches are in the store's table ``applied``; a request from before the
    store's ``horizon``, behind which ids are forgotten, is not applied either. Requests without an id can't be told
    from each other and all count.
    """
    return _in_time(_not_applied(requests, store, key, first_by), store, ts)


def _not_applied(requests: DataFrame, store: VersionedTables, key: list[str], first_by: list[str] | None = None) -> DataFrame:
    others = [c for c in requests.columns if c not in key]
    named = F.lit(True)
    for c in key:
        named = named & F.col(c).isNotNull()
    first = F.min_by(F.struct(*others), F.struct(*(first_by or []), *others)).alias("_first")
    once = requests.where(named).groupBy(*key).agg(first).select(*[F.col(c) if c in key else F.col(f"_first.{c}") for c in requests.columns])
    if store.version() and "applied" in store.names():
        # The ids of a trigger are few beside all that were applied, so those are looked through, not dealt out.
        again = store.read("applied").select(*key).join(requests.where(named).select(*key), key, "left_semi")
        once = once.join(again, key, "left_anti")
    return once.select(*requests.columns).unionByName(requests.where(~named))


def _in_time(once: DataFrame, store: VersionedTables, ts: str | None) -> tuple[DataFrame, DataFrame]:
    horizon = store.read("horizon").first()["horizon"] if store.version() and "horizon" in store.names() else None
    if ts is None or horizon is None:
        return once, once.limit(0)
    late = F.coalesce(F.col(ts) < F.lit(horizon), F.lit(False))
    return once.where(~late), once.where(late)


def _applied(
    store: VersionedTables, given: DataFrame, key: list[str], ts: str | None, remember: str | None
) -> tuple[dict[str, tuple[DataFrame, list[str]]], dict[str, DataFrame], dict[str, Column]]:
    """What to publish so that the requests' ids are known from now on: changes, tables, what is expired."""
    named = given.dropna(subset=key)
    if ts is None or remember is None:
        return {"applied": (named.select(*key), key)}, {}, {}
    before = store.read("horizon") if store.version() and "horizon" in store.names() else None
    now = given.agg((F.max(ts) - F.expr(f"INTERVAL {remember}")).alias("horizon"))
    horizon = (now if before is None else now.unionByName(before)).agg(F.max("horizon").alias("horizon")).first()["horizon"]
    table = store.spark.createDataFrame([(horizon,)], now.schema)
    return {"applied": (named.select(*dict.fromkeys([*key, ts])), key)}, {"horizon": table}, {"applied": F.col(ts) < F.lit(horizon)}


def apply_movements(
    store: VersionedTables,
    ledger_path: str,
    results_path: str,
    supplies: DataFrame,
    staff: DataFrame,
    opening: DataFrame,
    order: list[str],
    req_key: list[str],
    ts: str | None = None,
    remember: str | None = None,
    first_by: list[str] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Apply each micro-batch of stock movements to the stock the batch before left.

    All outputs carry the batch id, and the new stock is published last, so a batch that is run
    again after a failure replaces what its first run wrote. A request id counts once, in a batch and over all
    batches: applied ids are published with the stock, and the requests of a batch that count are stored in ``results_path``
    + ``-fresh`` before they are applied. With ``ts`` and ``remember``, an interval, ids are
    forgotten once the newest request is that much newer; older requests then go to ``results_path`` + ``-late``. Only
    supplies that moved are written.
    """

    def each(requests: DataFrame, batch_id: int) -> None:
        if store.version() > batch_id:
            return
        spark = requests.sparkSession
        snapshot = store.read("stock") if store.version() else opening
        # Stored, as hot supplies are counted, movements applied and late ones put aside from the same rows.
        fresh = Ledger(spark, f"{results_path}-fresh")
        fresh.append(_not_applied(requests, store, req_key, first_by), str(batch_id))
        once, late = _in_time(fresh.batch(str(batch_id)).select(*requests.columns), store, ts)
        applied = apply_stock.apply_issues(once, supplies, staff, snapshot, order)
        results = Ledger(spark, results_path)
        results.append(applied.results, str(batch_id))
        if store.version() and "horizon" in store.names():
            Ledger(spark, f"{results_path}-late").append(late, str(batch_id))
        # The rows, the stock and the ids follow from the stored results, which fixes them for all.
        given = results.batch(str(batch_id))
        stored = apply_stock.accepted(given, requests.columns, snapshot)
        Ledger(spark, ledger_path).append(stored.ledger_rows, str(batch_id))
        moved = stored.ledger_rows.groupBy("supply_id").agg(total("qty").alias("qty"))
        _publish_stock(store, snapshot, moved, batch_id, {}, _applied(store, given, req_key, ts, remember))

    return each


def _publish_stock(store, snapshot, change, batch_id, tables, applied) -> None:
    changes, more, expired = applied
    if store.version():
        changes = {**changes, "stock": (changed_stock(snapshot, change), ["supply_id"])}
    else:
        tables = {**tables, "stock": apply_stock.add_to_stock(snapshot, change)}
    store.publish({**tables, **more}, batch_id + 1, changes, expired)


def apply_order_requests(
    store: VersionedTables,
    orders_path: str,
    results_path: str,
    dishes: DataFrame,
    tables: DataFrame,
    staff: DataFrame,
    recipe: DataFrame,
    opening: DataFrame,
    last_id: int = 0,
    ts: str | None = None,
    remember: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Apply each micro-batch of order requests: new orders with ids, and the ingredients they take.

    The same rules for repeats hold as for movements. The last id given out is published with the
    stock, so a batch that is run again gives out the same ids.
    """

    def each(requests: DataFrame, batch_id: int) -> None:
        if store.version() > batch_id:
            return
        spark = requests.sparkSession
        snapshot = store.read("stock") if store.version() else opening
        last = store.read("last_order").first()["order_id"] if store.version() else last_id
        once, late = unseen(requests, store, ["req_id"], ts)
        checked = apply_orders.apply_orders(once, dishes, tables, staff, recipe, snapshot)
        results = Ledger(spark, results_path)
        results.append(checked.results, str(batch_id))
        if store.version() and "horizon" in store.names():
            Ledger(spark, f"{results_path}-late").append(late, str(batch_id))
        given = results.batch(str(batch_id))
        orders = Ledger(spark, orders_path)
        orders.append(apply_orders.accepted_orders(given, recipe, snapshot, last).orders, str(batch_id))
        newest = orders.batch(str(batch_id)).agg(F.coalesce(F.max("order_id"), F.lit(last)).cast("bigint").alias("order_id"))
        taken = bom_explosion(given.where("result_code = 1"), recipe).select("supply_id", (-F.col("qty")).alias("qty"))
        _publish_stock(store, snapshot, taken, batch_id, {"last_order": newest}, _applied(store, given, ["req_id"], ts, remember))

    return each
