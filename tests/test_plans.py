"""The plans queries get: what reaches the scan, and how skewed joins run."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from comandix.operators import apply_dims, audits, joins

PACKAGE = Path(__file__).resolve().parent.parent / "comandix"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, column", [("sales_by_dish_in_range", "l_shipdate"), ("sales_by_day_in_range", "o_orderdate"), ("orders_by_hour", "ts")]
)
def test_ranges_reach_the_scan(name, column, spark, sf_dir):
    text = queries()[name](spark, sf_dir)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = re.search(rf"PushedFilters: \[.*GreaterThanOrEqual\({column}.*LessThan(OrEqual)?\({column}", text)
    assert pushed


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(queries()["table_bill"](spark, sf_dir))
    assert "FileScan parquet [l_partkey" in text and "l_extendedprice" not in text


@pytest.mark.parametrize("name", ["sales_by_dish", "stock_totals", "kitchen_board", "latest_order_states", "table_bill"])
def test_totals_hash_and_combine_before_the_shuffle(name, spark, sf_dir):
    text = plan(queries()[name](spark, sf_dir))
    assert "HashAggregate" in text and "partial_" in text
    assert "SortAggregate" not in text and "Window" not in text


@pytest.mark.parametrize("name", sorted(n for n in queries() if not n.startswith(("stream_", "append_", "replace_", "load_", "order_event_stream"))))
def test_no_pairing_of_all_rows(name, spark, sf_dir):
    text = plan(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_hot_key_is_split_over_tasks(spark):
    """With no side small enough to broadcast, a key with a third of the rows is still many tasks."""
    changed = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
        orders = spark.range(0, 300_000, 1, 16).select(
            F.col("id").alias("order_id"), hot.alias("dish_id"), F.lit(1).alias("table_no"), F.lit("x").alias("state")
        )
        dishes = spark.range(5000).select(
            F.col("id").alias("dish_id"), F.concat(F.lit("d"), "id").alias("dish_name"), F.lit(1).alias("price")
        )
        joined = joins.orders_with_dish(orders, dishes)
        assert len(joined.collect()) == 300_000
        assert "SortMergeJoin(skew=true)" in plan(joined)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_the_fold_gets_whole_keys_by_requirement(spark, sf_dir):
    """A plain repartition below the fold may be dropped, and its rows left where a join reads them."""
    for name in ("apply_issues", "apply_issues_stock"):
        below = plan(queries()[name](spark, sf_dir)).split("MapInArrow", 1)[1]
        assert below.index("Window [row_number()") < below.index("Join")


def test_tasks_do_not_need_the_package(tmp_path):
    """Executors have neither the package on their path nor the repository as working folder."""
    script = (
        f"import sys; sys.path.insert(0, {str(PACKAGE.parent)!r})\n"
        "from comandix.session import build_session\n"
        "from __spark_entry__ import queries\n"
        "spark = build_session('x', 'local[2]', spark__ui__enabled='false', spark__sql__shuffle__partitions='2')\n"
        "for name in ('apply_issues', 'stream_kitchen_board', 'stream_low_stock_alerts'):\n"
        "    print(queries()[name](spark, '/root/testdata/sf0.001').count() > 0)\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False
    )
    assert done.stdout.split()[-3:] == ["True"] * 3, done.stderr[-2000:]


def test_package_has_no_local_shortcuts():
    text = "\n".join(path.read_text() for path in PACKAGE.rglob("*.py"))
    for word in ("localCheckpoint", "crossJoin", ".toPandas(", "toLocalIterator", "F.udf", ".rdd"):
        assert word not in text, word
    # The only collected rows are the one-per-slice summaries of the stock fold.
    assert len(re.findall(r"\.collect\(\)", text)) == 2


SCANS = ["cash_running_balance", "stock_running_balance", "order_durations", "state_jumps", "row_index", "cash_sessions_from_events", "register_event_codes"]


@pytest.mark.parametrize("name", SCANS)
def test_prefix_scans_run_nothing_while_built_and_read_once(name, spark, sf_dir):
    group = f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        df = queries()[name](spark, sf_dir)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(group) == ()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    df.collect()
    final = plan(df).split("Initial Plan", maxsplit=1)[0]
    if name in ("cash_running_balance", "stock_running_balance", "order_durations", "state_jumps"):
        assert "ReusedExchange" in final and final.count("FileScan") == (2 if name == "cash_running_balance" else 1)


def test_foreign_keys_scan_each_stored_table_once(spark, sf_dir):
    text = plan(queries()["audit_foreign_keys"](spark, sf_dir))
    for column in ("l_orderkey", "r_regionkey", "o_orderkey", "event_id"):
        assert len(re.findall(rf"FileScan parquet [^\n]*\b{column}#", text)) == 1, column


def test_deletes_join_their_tables_with_verdicts_only(spark):
    """Requests, rows and references of a key meet in one aggregation, so no task sorts all of them for joins."""
    keys = spark.range(9).select(F.col("id").alias("k"))
    asked = keys.select("k", F.col("k").alias("req_id"))
    applied = apply_dims.delete_rows(asked, keys, "k", [keys.where("k > 3"), keys.where("k > 5")])
    for df in (applied.table, applied.results):
        assert len(re.findall(r"\w+Join", plan(df))) == 1
    assert sorted(r["k"] for r in applied.table.collect()) == [4, 5, 6, 7, 8]


def test_audited_keys_stay_in_as_many_tasks_as_there_are_partitions(spark):
    pairs = spark.range(0, 1000, 1, 4).select((F.col("id") % 999).alias("a"), (F.col("id") % 3).alias("b"))
    offers = pairs.where("a < 500")
    found = audits.audit_keys({"pairs": (pairs, ["a", "b"]), "offers": (offers, ["a"])})
    assert sorted(tuple(r) for r in found.collect()) == [("offers", 1, 2, 0), ("pairs", 1, 2, 0)]
    final = plan(found).split("Initial Plan", maxsplit=1)[0]
    assert "AQEShuffleRead" not in final and final.count("REPARTITION_BY_NUM") == 2
