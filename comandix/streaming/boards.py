"""Live boards as incremental jobs: each keeps state instead of reading everything again.

Where a job's state is kept by Python code, rows are combined inside each input task first, so a
key with a large part of all rows reaches its state as a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from comandix import model
from comandix.functions import expressions as E
from comandix.functions.expressions import money, total
from comandix.operators import hotkeys
from comandix.streaming.keyed_state import newest_per_order, order_mover, order_releaser


def orders_by_hour(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Order events per hour and state. In append mode an hour appears once it can no longer change."""
    hours = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "state")
    return hours.agg(F.count(F.lit(1)).alias("orders")).select(
        F.col("window.start").alias("hour_start"), F.col("window.end").alias("hour_end"), "state", "orders"
    )


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Every event once, however often it was sent within the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stock_levels(movements: DataFrame, supplies: DataFrame) -> DataFrame:
    """Level and traffic light of every supply that moved; update mode."""
    levels = movements.groupBy("supply_id").agg(total("qty").alias("on_hand"))
    known = levels.join(supplies.select("supply_id", "supply_name", "min_qty"), "supply_id")
    return known.select(
        "supply_id", "supply_name", "min_qty", "on_hand", E.stock_status("on_hand", "min_qty").alias("status")
    )


def kitchen_board_changes(events: DataFrame, forget: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Changes of the number of orders in each state; update mode.

    An order that moves takes one from the state it was in and adds one to the new one. An event
    older than the newest one seen of its order changes nothing.

    With ``forget``, an interval, a delivered order's state ends once the newest event, less ``delay``, is that much
    newer than its delivery. The order stays counted as delivered; events of it older than the watermark are
    dropped, and one that comes later all the same counts as a new order's.
    """
    if forget is None:
        narrow = events.select("order_id", F.unix_micros("ts").alias("micros"), "event_id", "state")
        newest, keep, timeout = narrow.mapInPandas(newest_per_order, narrow.schema), None, GroupStateTimeout.NoTimeout
    else:
        # Combining rows in Python would cut the column off the watermark; one call per key sees the trigger's events.
        newest = events.withWatermark("ts", delay).select("order_id", "ts", F.unix_micros("ts").alias("micros"), "event_id", "state")
        keep, timeout = interval_micros(events, forget), GroupStateTimeout.EventTimeTimeout
    return newest.groupBy("order_id").applyInPandasWithState(
        order_mover(keep),
        "state string, change int",
        "micros long, event_id long, state string",
        "update",
        timeout,
    )


def _levels(known: DataFrame, held: DataFrame | None) -> DataFrame:
    """Movements with the level and colour their supply had before: ``_held``, ``_was_red``."""
    if held is None:
        return known.withColumns({"_held": F.lit(0).cast("decimal(18,2)"), "_was_red": F.lit(False)})
    before = held.select("supply_id", F.col("on_hand").alias("_held"), F.col("red").alias("_was_red"))
    joined = known.join(before, "supply_id", "left")
    return joined.withColumns({"_held": F.coalesce("_held", F.lit(0).cast("decimal(18,2)")), "_was_red": F.coalesce("_was_red", F.lit(False))})


def turned_red(known: DataFrame, held: DataFrame | None, order: list[str], hot_rows: int) -> DataFrame:
    """Movements (with ``min_qty``) that turn their supply's level red, following each other by ``order``.

    ``held`` has the levels and colours of earlier triggers; without it every supply starts at zero and not red. A missing
    quantity moves nothing.
    """
    order = [*order, "qty"]
    # The level before a movement is the level after it without the movement, so one scan tells both.
    moves = hotkeys.total_and_previous(_levels(known, held), "supply_id", order, "qty", "_moved", {"_min_before": "min_qty"}, hot_rows)
    level = moves.withColumn("on_hand", money(F.col("_held") + F.coalesce("_moved", F.lit(0)), 18))
    before = F.col("on_hand") - F.coalesce("qty", F.lit(0)) <= F.col("_min_before")
    turned = (F.col("on_hand") <= F.col("min_qty")) & ~F.coalesce(before, "_was_red")
    return level.where(turned).select("supply_id", "on_hand", "min_qty", F.lit(model.RED).alias("status"))


def levels_after(known: DataFrame, held: DataFrame | None) -> DataFrame:
    """Level and colour of every supply that moved."""
    moved = known.groupBy("supply_id").agg(total("qty").alias("_moved"), F.max("min_qty").alias("_min"))
    on_hand = money(F.col("_held") + F.coalesce("_moved", F.lit(0)), 18)
    after = _levels(moved, held).withColumn("on_hand", on_hand)
    return after.select("supply_id", "on_hand", (F.col("on_hand") <= F.col("_min")).alias("red"))


def interval_micros(df: DataFrame, text: str) -> int:
    """Microseconds of an interval of days and shorter units."""
    start = "TIMESTAMP'2000-01-01 00:00:00'"
    return df.sparkSession.sql(f"SELECT unix_micros({start} + INTERVAL {text}) - unix_micros({start}) AS n").first()["n"]


def order_durations(events: DataFrame, delay: str = "1 hour", forget: str | None = None) -> DataFrame:
    """Microseconds each order spent in its previous state, once events can no longer arrive in between.

    Events wait in state until the watermark has passed them and leave in event order, so events
    that arrive out of order within the delay still give the right durations. What one call holds
    is one trigger's events of one order; bound it with the source's files per trigger.

    With ``forget``, a delivered order's state ends once the watermark is that much behind its last event; a
    later event of it then has no state before it.
    """
    timed = events.withWatermark("ts", delay)
    return timed.groupBy("order_id").applyInPandasWithState(
        order_releaser(None if forget is None else interval_micros(events, forget)),
        "event_id long, order_id long, from_state string, to_state string, micros_in_state long",
        "waiting_micros array<long>, waiting_ids array<long>, waiting_states array<string>,"
        " last_micros long, last_state string",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
