"""Readers, writers, expressions and SQL table functions."""

from __future__ import annotations

import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from comandix import model
from comandix.functions import expressions as E
from comandix.operators import aggregates
from comandix.plans import sql_functions
from comandix.session import work_dir
from comandix.sources import sinks, tables, views
from tests.conftest import rows


def test_seed_types_and_nulls(seed):
    assert seed.order_line.schema.simpleString() == model.SCHEMAS["order_line"].simpleString()
    assert seed.order_line.where("table_no IS NULL").count() == 2
    assert seed.stock_ledger.where("note IS NULL").count() == 2


def test_stored_table_keeps_the_model_schema(spark, seed):
    path = work_dir(spark, "test")
    seed.dish.write.parquet(path)
    assert tables.read_stored(spark, path, "dish").schema.simpleString() == model.SCHEMAS["dish"].simpleString()


def test_documents_are_json(seed):
    documents = [json.loads(r[0]) for r in sinks.json_envelope(seed.role).collect()]
    assert {"ok": True, "result": {"role_id": 1, "role_name": "ADMINISTRADOR"}} in documents and len(documents) == 5


def test_json_files(spark, seed):
    path = work_dir(spark, "test")
    sinks.write_json(seed.role, path)
    assert spark.read.json(path).where("ok").count() == 5


def test_a_batch_written_twice_counts_once(spark, seed):
    path = work_dir(spark, "test")
    dated = seed.stock_ledger.withColumn("day", E.day_of("created_at"))
    sinks.append_ledger(dated, path, "1", day="day")
    sinks.append_ledger(dated, path, "1", day="day")
    sinks.append_ledger(dated.limit(1), path, "2", day="day")
    ledger = sinks.read_ledger(spark, path)
    assert ledger.count() == 11
    pruned = ledger.where("day = DATE'2019-10-30'")
    assert pruned.where("batch = 1").count() == 2
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().executedPlan().toString()


def test_readers_see_whole_versions(spark, seed):
    store = sinks.VersionedTables(spark, work_dir(spark, "test"))
    assert store.version() == 0
    store.publish({"role": seed.role, "dish": seed.dish})
    held = store.read("role")
    store.publish({"role": store.read("role").where("role_id > 2"), "dish": store.read("dish")})
    assert (held.count(), store.read("role").count(), store.version()) == (5, 3, 2)
    # A publication that stops before its manifest row is never seen.
    seed.role.limit(1).write.parquet(f"{store.path}/version=3/role")
    assert store.read("role").count() == 3
    store.publish({"role": seed.role, "dish": seed.dish})
    assert store.read("role").count() == 5
    assert store.publish({"role": seed.role.limit(0)}, version=2) == 3


def test_chart_points_are_in_label_order(seed):
    days = aggregates.sales_by_day(seed.cash_session, "2019-11-09", "2019-11-14")
    series = sinks.chart_series(days, "day", "total").first()
    assert series["labels"] == ["2019-11-09", "2019-11-10", "2019-11-13"]
    assert series["values"] == [Decimal("800.00"), Decimal("2090.00"), None]


def test_clean_strings(spark):
    raw = spark.createDataFrame([("  a b\t", 1), ("\n ", 2), ("", 3), (None, 4)], "s string, n int")
    assert rows(E.clean_strings(raw)) == [("a b", 1), (None, 2), (None, 3), (None, 4)]


def test_numbers_labels_and_rounding(spark):
    one = spark.createDataFrame([("12.5", Decimal("10.25"), 3), ("x", Decimal("1234.5"), None)], "t string, a decimal(8,2), n bigint")
    shown = one.select(E.to_number("t"), F.col("a").cast("decimal(8,1)"), E.fixed2("a"), E.table_label("n"), E.payment_text("n"))
    assert rows(shown) == [
        (Decimal("12.50"), Decimal("10.3"), "10.25", "Mesa 3", "Pago por consumo de la mesa 3"),
        (None, Decimal("1234.5"), "1,234.50", "Para llevar", None),
    ]
    signs = spark.createDataFrame([(Decimal(2),), (Decimal(-2),), (Decimal(0),)], "a decimal(8,2)")
    assert rows(signs.select(E.direction("a"))) == [("IN",), ("OUT",), (None,)]


def test_too_large_amounts_are_refused(spark):
    large = spark.createDataFrame([(Decimal("12345678.00"),)], "a decimal(12,2)")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        large.select(E.money("a", 8)).collect()


def test_first_failing_check_wins(spark):
    one = spark.createDataFrame([(True, True), (False, True), (None, None)], "a boolean, b boolean")
    assert rows(one.select(E.first_failure((F.col("a"), 2), (F.col("b"), 3)))) == [(1,), (2,), (3,)]


def test_sensitive_columns_go(seed):
    secret = seed.staff.withColumn("password", F.lit("x")).withColumn("api_token", F.lit("y"))
    assert E.hide_sensitive(secret).columns == seed.staff.columns


def test_reports_from_sql(spark, sf_dir):
    sql_functions.register_table_functions(spark, sf_dir)
    joined = spark.sql(
        "SELECT count(*) AS n FROM sales_by_day(DATE'1996-01-01', DATE'1996-12-31') d"
        " JOIN register_closings(DATE'1996-01-01', DATE'1996-12-31') c ON d.day = CAST(c.day AS STRING) AND d.total <=> c.total"
    )
    called = sql_functions.call_report(spark, sf_dir, "sales_by_day", date(1996, 1, 1), date(1996, 12, 31))
    assert joined.first()["n"] == called.count() > 0


def test_views_by_name(spark, sf_dir):
    views.register_views(spark, sf_dir, ["dish"])
    assert spark.sql("SELECT count(*) FROM dish WHERE price > :p", args={"p": 0}).first()[0] == 200


def test_two_writers_at_once_give_two_versions(spark, seed):
    path = work_dir(spark, "test")
    first, second = sinks.VersionedTables(spark, path), sinks.VersionedTables(spark, path)
    first.publish({"role": seed.role, "dish": seed.dish})
    written = first._write({"role": seed.role.limit(1)}, {}, 2)  # writes, and is overtaken before it claims
    assert second.publish({"role": seed.role.limit(2)}) == 2
    assert not first._claim(2, written) and first._claim(3, written)
    assert [first.read("role", v).count() for v in first.versions()] == [5, 2, 1]
    assert first.read("dish").count() == seed.dish.count()


def test_many_threads_publish(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = work_dir(spark, "test")
    sinks.VersionedTables(spark, path).publish({"n": spark.range(1)})

    def add(_):
        grown = lambda store, base: {"n": spark.range(store.read("n", base).count() + 1).coalesce(1)}
        return sinks.VersionedTables(spark, path).update(grown)

    with ThreadPoolExecutor(4) as threads:
        numbers = sorted(threads.map(add, range(8)))
    store = sinks.VersionedTables(spark, path)
    assert numbers == list(range(2, 10)) and store.read("n").count() == 9  # no update was lost


def test_changed_rows_are_merged(spark, monkeypatch):
    monkeypatch.setattr(sinks, "CHANGES", 3)
    store = sinks.VersionedTables(spark, work_dir(spark, "test"), keep=2)
    expected = {}
    for n in range(1, 9):
        changed = {k: n * 10 + k for k in (n % 4, 3)}
        expected |= changed
        store.publish(changes={"stock": (spark.createDataFrame(list(changed.items()), "k bigint, v bigint"), ["k"])})
        assert dict(rows(store.read("stock"))) == expected
    assert store.versions() == [7, 8]
    parts = store._tables(8)["stock"]["parts"]
    assert len(parts) <= 3 and len(store._commits.names("data")) <= 2 + len(parts)


@pytest.mark.parametrize("day", [None, "day"])
def test_batches_without_rows(spark, day):
    ledger = sinks.Ledger(spark, work_dir(spark, "test"), day)
    none = spark.range(0).selectExpr("id AS n", "DATE'2024-01-01' AS day")
    ledger.append(none, "0")
    assert ledger.read().count() == ledger.batch("0").count() == 0
    ledger.append(spark.range(3).selectExpr("id AS n", "DATE'2024-01-01' AS day"), "1")
    ledger.append(none, "2")
    assert (ledger.read().count(), ledger.batch("1").count(), ledger.batch("2").count()) == (3, 3, 0)
    assert set(ledger.batch("2").columns) == set(ledger.read().columns) == {"n", "day", "batch"}


def test_a_day_is_one_folder_and_batches_become_few_files(spark):
    path = work_dir(spark, "test")
    ledger = sinks.Ledger(spark, path, "day")
    for n in range(12):
        days = spark.range(4).selectExpr(f"id + {n * 4} AS n", "date_add(DATE'2024-01-01', cast(id AS int)) AS day")
        ledger.append(days.coalesce(1), str(n))
        if n == 5:
            ledger.append(days.limit(3).coalesce(1), "5")  # sent again, shorter
            assert ledger.compact() == 6
    one = ledger.read("2024-01-02", "2024-01-02")
    assert all("day=2024-01-02" in f for f in one.inputFiles()) and one.count() == 12
    assert rows(ledger.read(), "n") == [(n,) for n in sorted(range(48), key=str) if n != 23]
    assert ledger.compact(whole=True) == 7
    assert ledger.read().select(F.input_file_name()).distinct().count() <= 8
    assert rows(ledger.read(), "n") == [(n,) for n in sorted(range(48), key=str) if n != 23]
    for n in (100, 101):  # the batch's older rows are in the merged part
        ledger.append(spark.range(1).selectExpr(f"cast({n} AS bigint) AS n", "DATE'2024-01-01' AS day"), "0")
        assert ledger.read().where("n < 4 OR n = 100").count() == (n == 100) and ledger.read().count() == 44
    ledger.compact(whole=True)
    assert ledger.read().count() == 44 and ledger._state()[1]["hidden"] == []
    assert ledger.read("2030-01-01").count() == 0
