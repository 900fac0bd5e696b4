"""Keys with a large share of the rows give the same results as small ones."""

from __future__ import annotations

import random
import shutil
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from comandix.operators import apply_cash, apply_orders, apply_stock, hotkeys
from comandix.operators.stock_fold import fold_movements
from tests.conftest import rows

MOVES = "req_id bigint, supply_id bigint, keeper_id bigint, qty decimal(8,2), ts bigint"


def skewed_moves(seed, count, low, high):
    """Key 7 has half of the rows and key 3 a sixth; the rest is spread."""
    draw = random.Random(seed)
    moves = []
    for req in range(count):
        key = draw.choice([7, 7, 7, 3, draw.randrange(40), draw.randrange(40)])
        moves.append((req, key, 1, Decimal(draw.randrange(low, high)).scaleb(-2), draw.randrange(count // 3)))
    return moves


def walked(moves, opening):
    """The plain loop the operator has to agree with."""
    balance, accepted = {}, {}
    for req, key, _, qty, ts in sorted(moves, key=lambda m: (m[1], m[4], m[0])):
        at = balance.get(key, opening(key))
        accepted[req] = not (qty < 0 and at + qty < 0)
        balance[key] = at + qty if accepted[req] else at
    return accepted, balance


def folded(df, opening, hot_rows):
    rest, hot = hotkeys.split_hot(df, "supply_id", hot_rows)
    assert (hot is not None) == (hot_rows < 10**9)
    return fold_movements(rest, hot, "supply_id", ["ts", "req_id"], F.col("qty"), opening)


@pytest.mark.parametrize(
    "low, high",
    [(-900, 900), (-2000, 300), (-300, 2000), (-5000, -4000), (-5, 5), (-100000, 30000)],
    ids=["even", "mostly out", "mostly in", "only out", "cents", "large"],
)
@pytest.mark.parametrize("opening", [0, 250, -30])
def test_fold_with_hot_keys(spark, low, high, opening):
    moves = skewed_moves(low * 31 + high, 3000, low, high)
    df = spark.createDataFrame(moves, MOVES).repartition(5)
    done = folded(df, F.lit(Decimal(opening)), 200)
    expected, _ = walked(moves, lambda key: Decimal(opening))
    assert {r["req_id"]: r["accepted"] for r in done.collect()} == expected


def test_fold_without_hot_keys_agrees(spark):
    moves = skewed_moves(5, 2000, -900, 700)
    df = spark.createDataFrame(moves, MOVES)
    plain = folded(df, F.lit(10), 10**9)
    cut = folded(df, F.lit(10), 100)
    assert rows(plain, "req_id", "accepted") == rows(cut, "req_id", "accepted")


@pytest.fixture(params=["broadcast", "broadcast at run time", "never broadcast"])
def join_kind(spark, request):
    """The ways the planner may join, which must not change what a task sees."""
    changed = {
        "broadcast": {},
        "broadcast at run time": {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
        "never broadcast": {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        },
    }[request.param]
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    if changed:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", changed.get("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m"))
    yield
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


@pytest.mark.parametrize("hot_rows", [10**9, 150])
def test_issues_with_hot_keys(spark, join_kind, hot_rows):
    moves = skewed_moves(11, 2000, -900, 800)
    requests = spark.createDataFrame(moves, MOVES).repartition(11).withColumn("keeper_id", F.col("req_id") % 5)
    supplies = spark.range(40).withColumnRenamed("id", "supply_id")
    staff = spark.range(5).select(F.col("id").alias("staff_id"), F.lit(True).alias("enabled"))
    snapshot = supplies.select("supply_id", F.lit(Decimal("12.50")).alias("qty"))
    applied = apply_stock.apply_issues(requests, supplies, staff, snapshot, ["ts", "req_id"], hot_rows=hot_rows)
    counted = [m for m in moves if m[3] != 0]
    expected, balance = walked(counted, lambda key: Decimal("12.50"))
    codes = {r["req_id"]: r["result_code"] for r in applied.results.collect()}
    assert codes == {m[0]: 4 if m[3] == 0 else 1 if expected[m[0]] else 5 for m in moves}
    stock = {r["supply_id"]: r["qty"] for r in applied.snapshot.collect()}
    assert stock == {key: balance.get(key, Decimal("12.50")) for key in range(40)}
    assert min(stock.values()) >= 0


@pytest.mark.parametrize("hot_rows", [10**9, 100])
def test_running_total(spark, hot_rows):
    moves = skewed_moves(3, 2000, -900, 900)
    moves = [m if m[0] % 50 else (*m[:3], None, m[4]) for m in moves]
    df = spark.createDataFrame(moves, MOVES)
    found = hotkeys.running_total(df, "supply_id", ["ts", "req_id"], "qty", "balance", hot_rows)
    totals, expected = {}, {}
    for req, key, _, qty, ts in sorted(moves, key=lambda m: (m[1], m[4], m[0])):
        if qty is not None:
            totals[key] = totals.get(key, Decimal(0)) + qty
        expected[req] = totals.get(key)
    assert {r["req_id"]: r["balance"] for r in found.collect()} == expected


@pytest.mark.parametrize("hot_rows", [10**9, 100])
def test_previous(spark, hot_rows):
    moves = skewed_moves(4, 2000, -900, 900)
    df = spark.createDataFrame(moves, MOVES)
    found = hotkeys.previous(df, "supply_id", ["ts", "req_id"], {"before": "req_id", "qty_before": "qty"}, hot_rows)
    last, expected = {}, {}
    for req, key, _, qty, ts in sorted(moves, key=lambda m: (m[1], m[4], m[0])):
        expected[req] = last.get(key, (None, None))
        last[key] = (req, qty)
    assert {r["req_id"]: (r["before"], r["qty_before"]) for r in found.collect()} == expected


def test_rows_with_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 2), (1, 1, 3), (1, 2, 4), (1, 3, 5)], "k bigint, o bigint, v bigint")
    found = hotkeys.running_total(df, "k", ["o"], "v", "s", hot_rows=2)
    assert rows(found, "k", "o", "s") == [(1, 1, 3), (1, 2, 7), (1, 3, 12), (None, 1, 1), (None, 2, 3)]


@pytest.mark.parametrize("hot_rows", [10**9, 100])
def test_sessions_with_a_busy_register(spark, hot_rows):
    draw = random.Random(9)
    events = [
        (req, draw.choice([1, 1, 1, 2, 3]), draw.choice(["open", "close", "op", "op"]), Decimal(draw.randrange(500)), req // 2)
        for req in range(1500)
    ]
    df = spark.createDataFrame(events, "req_id bigint, register_id bigint, action string, amount decimal(12,2), ts bigint")
    applied = apply_cash.cash_sessions_from_events(df, hot_rows)
    open_now, number, codes, sessions = {}, {}, {}, {}
    for req, register, action, amount, ts in sorted(events, key=lambda e: (e[1], e[4], e[0])):
        is_open = open_now.get(register, False)
        if action == "op":
            codes[req] = 1 if is_open else 4
        else:
            codes[req] = 1 if is_open == (action == "close") else 2
            open_now[register] = action == "open"
        if codes[req] == 1:
            number[register] = number.get(register, 0) + (action == "open")
            entry = sessions.setdefault((register, number[register]), [None, Decimal(0), None])
            if action == "open":
                entry[0] = amount
            elif action == "close":
                entry[2] = amount
            else:
                entry[1] += amount
    assert {r["req_id"]: r["result_code"] for r in applied.results.collect()} == codes
    found = {(r["register_id"], r["session_no"]): (r["opening"], r["computed"], r["entered"]) for r in applied.sessions.collect()}
    assert found == {k: (o, None if e is None else o + m, e) for k, (o, m, e) in sessions.items()}


@pytest.mark.parametrize("hot_rows", [10**9, 50])
def test_state_durations_of_a_busy_order(spark, sf_dir, hot_rows):
    from comandix.sources.views import order_event

    events = order_event(spark, sf_dir).withColumn("order_id", F.col("order_id") % 3)
    plain = apply_orders.state_durations(events)
    assert rows(apply_orders.state_durations(events, hot_rows)) == rows(plain)


def test_row_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert rows(hotkeys.row_index(df, ["v"]).where("position <> v + 1")) == []


def test_assign_ids(spark):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "req_id").repartition(7)
    found = hotkeys.assign_ids(df, "req_id", "new_id", 500)
    assert rows(found.where("new_id <> 501 + req_id / 3")) == []
    assert found.select("new_id").distinct().count() == 1000


def test_issues_over_many_files(spark, tmp_path):
    """With many input files, a join that turns into a broadcast at run time leaves rows where they were read."""
    source = "/root/testdata/sf0.01"
    for name in ("part", "supplier"):
        shutil.copy(f"{source}/{name}.parquet", tmp_path)
    lines = pq.read_table(f"{source}/lineitem.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for part in range(8):
        pq.write_table(lines.slice(part * 7500, 7500), tmp_path / "lineitem.parquet" / f"part-{part}.parquet")
    query = queries()["apply_issues_stock"]
    assert rows(query(spark, str(tmp_path))) == rows(query(spark, source))


@pytest.mark.parametrize("spread", [1, 1_000_003, 2**42 + 7])
def test_assign_ids_for_dense_and_sparse_ids(spark, spread):
    df = spark.range(5000).selectExpr(f"(id - 2500) * {spread}L AS req_id")
    found = hotkeys.assign_ids(df, "req_id", "new_id", 10).orderBy("req_id").collect()
    assert [r.new_id for r in found] == list(range(11, 5011))


def test_a_hot_null_key_is_split(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id % 7 END AS k", "CAST(id % 11 AS decimal(12,2)) AS v")
    rest, hot = hotkeys.split_hot(df, "k", 500)
    assert hot.select("k").distinct().collect() == [(None,)] and rest.where("k IS NULL").count() == 0
    for cut in (500, 10**9):
        total = {r.id: r.total for r in hotkeys.running_total(df, "k", ["id"], "v", "total", cut).collect()}
        before = {r.id: r.was for r in hotkeys.previous(df, "k", ["id"], {"was": "v"}, cut).collect()}
        seen: dict = {}
        for r in sorted(df.collect()):
            own = seen.setdefault(r.k, [])
            assert before[r.id] == (own[-1] if own else None)
            own.append(r.v)
            assert total[r.id] == sum(own)


def test_total_and_previous_in_one_scan(spark):
    draw = random.Random(5)
    data = [(draw.choice([7, 7, 3, None]), draw.choice([None, draw.randrange(500)]), n, draw.choice([None, Decimal(n)])) for n in range(300)]
    df = spark.createDataFrame(data, "k bigint, at bigint, n bigint, v decimal(8,2)")
    order = ["at", "n"]
    both = hotkeys.total_and_previous(df, "k", order, "v", "sum", {"before": "v", "last_n": "n"}, 16)
    total = hotkeys.running_total(df, "k", order, "v", "sum", 16)
    looked = hotkeys.previous(df, "k", order, {"before": "v", "last_n": "n"}, 16)
    assert both.schema["sum"].dataType == total.schema["sum"].dataType
    assert rows(both, "k", "n", "sum") == rows(total, "k", "n", "sum")
    assert rows(both, "k", "n", "before", "last_n") == rows(looked, "k", "n", "before", "last_n")
