"""Streams in several triggers give what the batch form gives on the same rows."""

from __future__ import annotations

import os
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from comandix.operators import aggregates, apply_orders
from comandix.session import work_dir
from comandix.sources.sinks import VersionedTables, read_ledger
from comandix.sources.tables import order_event_stream, read_table, table_stream
from comandix.sources.views import as_order_events, as_stock_ledger, as_stream_events
from comandix.streaming import boards, jobs
from tests.conftest import rows

MINUTE = 60_000_000
STATES = {"signup": "PENDIENTE", "view": "EN PREPARACION", "purchase": "PREPARADO", "error": "ENTREGADO"}


def write_events(folder, *files):
    """One file per list of (event_id, minute, user, type), oldest file first."""
    target = folder / "events.parquet"
    target.mkdir(parents=True, exist_ok=True)
    schema = pa.schema(
        [("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())]
    )
    for place, events in enumerate(files):
        columns = list(zip(*[(e, 10**15 + m * MINUTE, u, t, 1.0, "{}") for e, m, u, t in events], strict=True))
        path = target / f"part-{place}.parquet"
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema), path)
        os.utime(path, (10**9 + place * 60, 10**9 + place * 60))
    return str(folder)


def split_table(spark, sf_dir, name, folder, parts, order):
    """The rows of a stored table in several files."""
    table = pq.read_table(f"{sf_dir}/{name}.parquet").sort_by(order)
    target = folder / f"{name}.parquet"
    target.mkdir(parents=True)
    size = -(-table.num_rows // parts)
    for place in range(parts):
        path = target / f"part-{place}.parquet"
        pq.write_table(table.slice(place * size, size), path)
        os.utime(path, (10**9 + place * 60, 10**9 + place * 60))
    return str(folder)


def events_of(spark, folder):
    return as_stream_events(order_event_stream(spark, folder, max_files_per_trigger=1))


def test_hours_drop_only_what_is_later_than_the_watermark(spark, tmp_path):
    folder = write_events(
        tmp_path,
        [(1, 10, 1, "signup"), (2, 70, 1, "view")],
        [(3, 200, 2, "signup"), (4, 150, 2, "signup")],  # 4 is out of order but within the hour
        [(5, 210, 2, "view")],
        [(6, 5, 3, "signup")],  # later than the watermark, dropped
        [(7, 1000, 9, "error")],  # closes everything before
    )
    path = work_dir(spark, "test")
    jobs.run_to_files(boards.orders_by_hour(events_of(spark, folder)), f"{path}/out", f"{path}/checkpoint")
    found = spark.read.parquet(f"{path}/out")
    batch = as_order_events(read_table(spark, folder, "events")).where("event_id < 6")
    expected = batch.groupBy(F.window("ts", "1 hour"), "state").agg(F.count("*").alias("orders"))
    assert rows(found.select(F.col("hour_start").cast("timestamp_ntz"), "state", "orders")) == rows(
        expected.select("window.start", "state", "orders")
    )


def test_board_follows_the_newest_state(spark, tmp_path):
    folder = write_events(
        tmp_path,
        [(1, 1, 1, "signup"), (2, 2, 2, "signup"), (3, 3, 3, "signup")],
        [(4, 10, 1, "view"), (5, 9, 1, "purchase"), (6, 8, 2, "purchase")],
        [(7, 4, 2, "error")],  # older than what is known of order 2
        [(8, 20, 3, "error"), (9, 20, 3, "view")],  # same instant: the later event counts
    )
    path = work_dir(spark, "test")
    store = VersionedTables(spark, f"{path}/board")
    jobs.run_batches(boards.kitchen_board_changes(events_of(spark, folder)), jobs.add_board_changes(store), f"{path}/checkpoint")
    batch = apply_orders.latest_states(as_order_events(read_table(spark, folder, "events")))
    assert rows(store.read("board").where("orders <> 0")) == rows(batch.groupBy("state").count())
    assert store.version() == 4


def test_board_on_the_stored_events(spark, sf_dir, tmp_path):
    folder = split_table(spark, sf_dir, "events", tmp_path, 4, "event_id")
    path = work_dir(spark, "test")
    store = VersionedTables(spark, f"{path}/board")
    jobs.run_batches(boards.kitchen_board_changes(events_of(spark, folder)), jobs.add_board_changes(store), f"{path}/checkpoint")
    batch = apply_orders.latest_states(as_order_events(read_table(spark, sf_dir, "events")))
    assert rows(store.read("board").where("orders <> 0")) == rows(batch.groupBy("state").count())


def test_stock_levels_and_alerts(spark, sf_dir, tmp_path):
    from comandix.sources.views import LEDGER_ORDER, stock_ledger, supply

    folder = split_table(spark, sf_dir, "lineitem", tmp_path, 3, "l_shipdate")

    def moves():
        return as_stock_ledger(table_stream(spark, folder, "lineitem", max_files_per_trigger=1))

    supplies = supply(spark, sf_dir)
    path = work_dir(spark, "test")
    levels = VersionedTables(spark, f"{path}/levels")
    jobs.run_batches(boards.stock_levels(moves(), supplies), jobs.keep_newest(levels, "levels", "supply_id"), f"{path}/c1")
    expected = aggregates.stock_status(stock_ledger(spark, sf_dir), supplies)
    assert rows(levels.read("levels").select(*expected.columns)) == rows(expected) and levels.version() == 3

    each = jobs.raise_alerts(VersionedTables(spark, f"{path}/a"), f"{path}/alerts", supplies, LEDGER_ORDER)
    jobs.run_batches(moves(), each, f"{path}/c2", mode="append")
    found = read_ledger(spark, f"{path}/alerts").select("supply_id", "on_hand").collect()
    minimum = {r["supply_id"]: r["min_qty"] for r in supplies.collect()}
    total, red, alerts = {}, set(), []
    for row in stock_ledger(spark, sf_dir).orderBy(*LEDGER_ORDER).collect():
        key = row["supply_id"]
        total[key] = total.get(key, Decimal(0)) + row["qty"]
        if total[key] <= minimum[key] and key not in red:
            alerts.append((key, total[key]))
        red = red | {key} if total[key] <= minimum[key] else red - {key}
    assert sorted((r["supply_id"], r["on_hand"]) for r in found) == sorted(alerts)
    each = jobs.raise_alerts(VersionedTables(spark, f"{path}/b"), f"{path}/once", supplies, LEDGER_ORDER, hot_rows=64)
    jobs.run_batches(as_stock_ledger(table_stream(spark, folder, "lineitem")), each, f"{path}/c3", mode="append")
    assert rows(read_ledger(spark, f"{path}/once"), "supply_id", "on_hand") == rows(read_ledger(spark, f"{path}/alerts"), "supply_id", "on_hand")


def test_events_sent_twice_count_once(spark, tmp_path):
    folder = write_events(
        tmp_path, [(1, 1, 1, "signup"), (1, 1, 1, "signup"), (2, 2, 1, "view")], [(2, 2, 1, "view"), (3, 3, 1, "view")]
    )
    path = work_dir(spark, "test")
    jobs.run_to_files(boards.deduplicated(events_of(spark, folder)), f"{path}/out", f"{path}/checkpoint")
    assert rows(spark.read.parquet(f"{path}/out"), "event_id") == [(1,), (2,), (3,)]


def test_durations_in_event_order(spark, tmp_path):
    folder = write_events(
        tmp_path,
        [(1, 0, 1, "signup"), (3, 30, 1, "purchase"), (4, 5, 2, "signup")],
        [(2, 10, 1, "view"), (5, 40, 2, "view")],  # 2 belongs between 1 and 3
        [(6, 90, 1, "error")],
        [(7, 600, 9, "signup")],  # lets the others leave; stays itself
    )
    path = work_dir(spark, "test")
    jobs.run_to_files(boards.order_durations(events_of(spark, folder)), f"{path}/out", f"{path}/checkpoint")
    batch = apply_orders.state_durations(as_order_events(read_table(spark, folder, "events"))).where("event_id <> 7")
    assert rows(spark.read.parquet(f"{path}/out").select(*batch.columns)) == rows(batch)


def test_durations_of_the_stored_events(spark, sf_dir, tmp_path):
    folder = split_table(spark, sf_dir, "events", tmp_path, 3, "event_id")
    path = work_dir(spark, "test")
    jobs.run_to_files(boards.order_durations(events_of(spark, folder)), f"{path}/out", f"{path}/checkpoint")
    events = as_order_events(read_table(spark, sf_dir, "events"))
    end = events.agg(F.max("ts").alias("end")).first()["end"]
    closed = events.where(F.col("ts") < F.date_trunc("millisecond", F.lit(end)) - F.expr("INTERVAL 1 HOUR"))
    batch = apply_orders.state_durations(events).join(closed, "event_id", "left_semi")
    assert rows(spark.read.parquet(f"{path}/out").select(*batch.columns)) == rows(batch)


@pytest.fixture
def movement_job(spark, tmp_path):
    supplies = spark.createDataFrame([(1,), (2,)], "supply_id bigint")
    staff = spark.createDataFrame([(18, True)], "staff_id bigint, enabled boolean")
    opening = spark.createDataFrame([(1, Decimal("10")), (2, Decimal("0"))], "supply_id bigint, qty decimal(18,2)")
    path = work_dir(spark, "test")
    store = VersionedTables(spark, f"{path}/stock")
    each = jobs.apply_movements(store, f"{path}/ledger", f"{path}/results", supplies, staff, opening, ["req_id"], ["req_id"])
    return path, store, each


def batch_of(spark, *moves):
    return spark.createDataFrame([(r, s, 18, Decimal(q)) for r, s, q in moves], "req_id bigint, supply_id bigint, keeper_id bigint, qty decimal(8,2)")


def test_requests_that_count_are_stored_once_per_trigger(spark, movement_job):
    """What is applied is read from the store, not told apart again for every use."""
    path, _, each = movement_job
    each(batch_of(spark, (1, 1, "-8"), (2, 1, "-5"), (2, 1, "-5")), 0)
    each(batch_of(spark, (2, 1, "-1"), (3, 2, "4")), 1)
    assert rows(read_ledger(spark, f"{path}/results-fresh"), "batch", "req_id") == [("0", 1), ("0", 2), ("1", 3)]
    assert rows(read_ledger(spark, f"{path}/results"), "batch", "req_id") == [("0", 1), ("0", 2), ("1", 3)]


def test_alerts_cut_and_sort_movements_once(spark):
    known = spark.range(60).select(
        (F.col("id") % 3).alias("supply_id"), (5 - F.col("id") % 11).cast("decimal(8,2)").alias("qty"), F.col("id").alias("n"),
        (F.col("id") % 3).cast("decimal(8,2)").alias("min_qty"),
    )
    found = boards.turned_red(known, None, ["n"], 16)
    levels, red, alerts = {}, {}, []
    for k, qty, _, least in known.orderBy("n").collect():
        levels[k] = levels.get(k, Decimal(0)) + qty
        now = levels[k] <= least
        if now and not red.get(k):
            alerts.append((k, levels[k]))
        red[k] = now
    assert len(alerts) > 3 and rows(found, "supply_id", "on_hand") == sorted(alerts, key=lambda r: tuple((v is None, str(v)) for v in r))
    # Both passes of one scan ask for the same shuffle.
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("REPARTITION_BY_COL") <= 2


def test_movements_build_on_the_batch_before(spark, movement_job):
    path, store, each = movement_job
    each(batch_of(spark, (1, 1, "-8"), (2, 1, "-5"), (2, 1, "-5"), (3, 2, "4")), 0)
    each(batch_of(spark, (4, 1, "-2"), (5, 1, "-1"), (6, 2, "-4")), 1)
    each(batch_of(spark, (4, 1, "-2"), (5, 1, "-1"), (6, 2, "-4")), 1)  # the same batch after a failure
    assert rows(store.read("stock")) == [(1, Decimal("0.00")), (2, Decimal("0.00"))]
    results = read_ledger(spark, f"{path}/results")
    assert rows(results, "req_id", "result_code") == [(1, 1), (2, 5), (3, 1), (4, 1), (5, 5), (6, 1)]
    assert rows(read_ledger(spark, f"{path}/ledger"), "req_id") == [(1,), (3,), (4,), (6,)]


def test_a_failure_before_publishing_is_repeated_cleanly(spark, movement_job, monkeypatch):
    path, store, each = movement_job
    monkeypatch.setattr(VersionedTables, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        each(batch_of(spark, (1, 1, "-8")), 0)
    monkeypatch.undo()
    each(batch_of(spark, (1, 1, "-8")), 0)
    assert rows(store.read("stock"), "supply_id", "qty")[0] == (1, Decimal("2.00"))
    assert read_ledger(spark, f"{path}/ledger").count() == 1


def test_orders_keep_their_ids_over_batches(spark, seed):
    path = work_dir(spark, "test")
    store = VersionedTables(spark, f"{path}/stock")
    each = jobs.apply_order_requests(
        store, f"{path}/orders", f"{path}/results", seed.dish, seed.dining_table, seed.staff, seed.recipe, seed.stock_snapshot, 43
    )
    kind = "req_id bigint, dish_id bigint, table_no bigint, waiter_id bigint, ts bigint"
    each(spark.createDataFrame([(1, 2, 1, 18, 0), (2, 99, 1, 18, 0), (2, 99, 1, 18, 0)], kind), 0)
    each(spark.createDataFrame([(3, 99, 1, 18, 0)], kind), 1)  # nothing accepted
    for _ in range(2):
        each(spark.createDataFrame([(4, 3, None, None, 0), (5, 4, 2, 19, 0)], kind), 2)
    assert rows(read_ledger(spark, f"{path}/orders"), "order_id", "dish_id") == [(44, 2), (45, 3), (46, 4)]
    assert rows(read_ledger(spark, f"{path}/results"), "req_id", "result_code") == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 1)]


@pytest.mark.parametrize("files", [1, 3, 10])
def test_alerts_of_a_hot_supply_in_any_number_of_triggers(spark, files):
    """One supply has a third of all movements, in one trigger or many; its slices are of a few rows."""
    import random

    draw = random.Random(5)
    moves = [(n, draw.choice([1, 2 + n % 7, 2 + n % 5]), None if n % 97 == 0 else Decimal(draw.randrange(-900, 900)).scaleb(-2)) for n in range(900)]
    supplies = spark.createDataFrame([(k, Decimal(k)) for k in range(1, 8)], "supply_id bigint, min_qty decimal(8,2)")
    path = work_dir(spark, "test")
    each = jobs.raise_alerts(VersionedTables(spark, f"{path}/s"), f"{path}/alerts", supplies, ["n"], hot_rows=16)
    size = len(moves) // files
    for batch in range(files):
        each(spark.createDataFrame(moves[batch * size : (batch + 1) * size], "n bigint, supply_id bigint, qty decimal(8,2)"), batch)
    level, red, expected = {}, {}, []
    for _, key, qty in moves:
        if key <= 7:
            level[key] = level.get(key, Decimal(0)) + (qty or 0)
            if level[key] <= key and not red.get(key):
                expected.append((key, level[key]))
            red[key] = level[key] <= key
    found = read_ledger(spark, f"{path}/alerts").select("supply_id", "on_hand").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_a_request_id_counts_once_over_all_triggers(spark, movement_job):
    path, store, each = movement_job
    each(batch_of(spark, (1, 1, "5"), (1, 1, "7"), (2, 2, "3")), 0)  # two contents under one id: the smaller one
    each(batch_of(spark, (1, 1, "5"), (2, 2, "9"), (3, 1, "1"), (None, 2, "1"), (None, 2, "1")), 1)
    each(batch_of(spark, (3, 1, "1"), (2, 1, "-1")), 2)
    assert rows(store.read("stock"), "supply_id", "qty") == [(1, Decimal("16.00")), (2, Decimal("5.00"))]
    assert rows(read_ledger(spark, f"{path}/results"), "req_id", "batch") == [(1, "0"), (2, "0"), (3, "1"), (None, "1"), (None, "1")]


def test_ids_are_forgotten_behind_the_horizon(spark, monkeypatch):
    from comandix.sources import sinks

    monkeypatch.setattr(sinks, "CHANGES", 1)
    supplies = spark.createDataFrame([(1,)], "supply_id bigint")
    staff = spark.createDataFrame([(18, True)], "staff_id bigint, enabled boolean")
    opening = spark.createDataFrame([(1, Decimal("0"))], "supply_id bigint, qty decimal(18,2)")
    path = work_dir(spark, "test")
    store = VersionedTables(spark, f"{path}/stock")
    each = jobs.apply_movements(store, f"{path}/ledger", f"{path}/results", supplies, staff, opening, ["req_id"], ["req_id"], "ts", "2 hours")
    sent = [[(1, 0), (2, 60)], [(3, 200), (1, 0)], [(4, 50), (3, 200), (5, 300)]]  # (id, minute)
    for batch, moves in enumerate(sent):
        data = [(r, 1, 18, Decimal(1), 10**9 + 60 * m) for r, m in moves]
        frame = spark.createDataFrame(data, "req_id bigint, supply_id bigint, keeper_id bigint, qty decimal(8,2), s bigint")
        each(frame.withColumn("ts", F.col("s").cast("timestamp")), batch)
    assert rows(store.read("stock"), "qty") == [(Decimal("4.00"),)]
    assert rows(store.read("applied"), "req_id") == [(3,), (5,)]  # others are behind the horizon
    assert rows(read_ledger(spark, f"{path}/results-late"), "req_id") == [(4,)]  # may be a repeat: not applied


def _state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


@pytest.mark.parametrize("stream", ["board", "durations"])
def test_state_ends_after_delivery(spark, tmp_path, stream):
    folder = write_events(
        tmp_path,
        [(1, 0, 1, "signup"), (2, 5, 2, "signup"), (3, 30, 1, "error")],
        [(4, 90, 2, "error")],
        [(5, 400, 9, "error")],  # moves the watermark past both
        [(6, 900, 10, "error")],
    )
    path = work_dir(spark, "test")
    store = VersionedTables(spark, f"{path}/board")
    if stream == "board":
        frame, each = boards.kitchen_board_changes(events_of(spark, folder), forget="1 hour"), jobs.add_board_changes(store)
        writer = frame.writeStream.outputMode("update").foreachBatch(each)
    else:
        frame = boards.order_durations(events_of(spark, folder), forget="1 hour")
        writer = frame.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out")
    jobs.keep_state_on_disk(spark)
    query = writer.option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    held = _state_rows(query)
    assert max(held) >= 2 and held[-1] == 1  # only the newest event's order is left
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    if stream == "board":
        assert rows(store.read("board").where("orders <> 0")) == [("ENTREGADO", 4)]
    else:
        assert rows(spark.read.parquet(f"{path}/out"), "event_id", "micros_in_state") == [(1, None), (2, None), (3, 30 * MINUTE), (4, 85 * MINUTE), (5, None)]
