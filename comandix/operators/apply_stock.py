"""Bulk stock requests: receipts, issues, counts, and corrections of the ledger.

Every operator takes the requests and the current tables as DataFrames and returns DataFrames
derived from that one input state. The result code of a request is the first check that fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix.functions.expressions import first_failure, message_for, money, total
from comandix.operators import hotkeys
from comandix.operators.joins import add_to_stock, known_reference, last_by_key
from comandix.operators.stock_fold import fold_movements


@dataclass(frozen=True)
class Applied:
    """What a batch of requests did: a code per request, new ledger rows, the stock afterwards."""

    results: DataFrame
    ledger_rows: DataFrame
    snapshot: DataFrame


def apply_receipts(requests: DataFrame, supplies: DataFrame, staff: DataFrame, snapshot: DataFrame) -> Applied:
    """Receipts: 2 unknown supply, 3 unknown or disabled keeper, 4 quantity not above zero."""
    checked = _stock_checks(requests, supplies, staff)
    code = first_failure(
        (F.col("_supply").isNull(), 2),
        (F.col("_keeper").isNull(), 3),
        (F.coalesce(F.col("qty") <= 0, F.lit(True)), 4),
    )
    results = _coded(checked, code, requests, "receipt")
    return accepted(results, requests.columns, snapshot)


def apply_issues(
    requests: DataFrame,
    supplies: DataFrame,
    staff: DataFrame,
    snapshot: DataFrame,
    order: list[str],
    hot_rows: int = hotkeys.HOT_ROWS,
) -> Applied:
    """Movements in the sequence of ``order``: issues are negative, receipts between them positive.

    2 unknown supply, 3 unknown or disabled keeper, 4 no quantity, 5 more than is in stock at that
    moment. A refused movement leaves the stock as it is for the next one. Where requests have a
    ``kind``, an ``issue`` must be negative and a ``receipt`` positive, else 4; without it the sign tells.
    """
    wrong = F.coalesce(F.col("qty") == 0, F.lit(True))
    if "kind" in requests.columns:
        wrong = wrong | ((F.col("kind") == "issue") & (F.col("qty") > 0)) | ((F.col("kind") == "receipt") & (F.col("qty") < 0))
    stock = snapshot.select("supply_id", F.col("qty").alias("_stock"))
    stocked = supplies.select("supply_id").join(stock, "supply_id", "left").withColumn("_supply", F.lit(True))

    def checked(part: DataFrame) -> DataFrame:
        marked = known_reference(part, staff.where("enabled"), "staff_id", "keeper_id", "_keeper")
        marked = marked.join(stocked, "supply_id", "left")
        fixed = first_failure(
            (F.col("_supply").isNull(), 2),
            (F.col("_keeper").isNull(), 3),
            (wrong, 4),
            (F.col("_stock").isNull() & (F.col("qty") < 0), 5),
        )
        return marked.select(*requests.columns, "_stock", fixed.alias("_code"))

    # Hot supplies are told apart before anything else: the others then go through the stock join and
    # the fold in one shuffle, and the join of the hot ones can be split freely.
    # Requests without a supply are refused as they are; the scan skips files that have none.
    named = requests.where("supply_id IS NOT NULL")
    rest, hot = hotkeys.split_hot(named, "supply_id", hot_rows)
    counts = F.when((F.col("_code") == 1) & F.col("_stock").isNotNull(), F.col("qty")).otherwise(F.lit(0))
    folded = fold_movements(
        checked(rest),
        None if hot is None else checked(hot),
        "supply_id",
        order,
        counts,
        F.coalesce("_stock", F.lit(0)),
    )
    code = F.when(F.col("accepted"), F.col("_code")).otherwise(F.lit(5)).cast("int")
    results = _coded(folded, code, requests, "issue").unionByName(
        _coded(requests.where("supply_id IS NULL"), F.lit(2), requests, "issue")
    )
    return accepted(results, requests.columns, snapshot)


@dataclass(frozen=True)
class Adjusted:
    """A code per count, and the new ledger rows."""

    results: DataFrame
    ledger_rows: DataFrame


def adjust_to_counts(
    counted: DataFrame, ledger: DataFrame, supplies: DataFrame, hot_rows: int = hotkeys.HOT_ROWS
) -> Adjusted:
    """Counts (``req_id``, ``supply_id``, ``counted``): 2 unknown supply or none, 4 no count.

    Each accepted count gets one ledger row that brings the supply's total from where the count before it left
    it, at first the ledger's total, to what was counted, so the total ends at the last accepted count. A refused
    count changes nothing for the next one. Counts of one supply are cut into slices like any prefix scan.
    """
    return accepted_counts(count_results(counted, supplies), ledger, hot_rows)


def count_results(counted: DataFrame, supplies: DataFrame) -> DataFrame:
    marked = known_reference(counted, supplies, "supply_id", "supply_id", "_supply")
    code = first_failure((F.col("_supply").isNull(), 2), (F.col("counted").isNull(), 4))
    return _coded(marked, code, counted, "adjustment")


def accepted_counts(results: DataFrame, ledger: DataFrame, hot_rows: int = hotkeys.HOT_ROWS) -> Adjusted:
    """Ledger rows that follow from a batch's results."""
    valid = results.where("result_code = 1").select("req_id", "supply_id", "counted")
    looked = hotkeys.previous(valid, "supply_id", ["req_id"], {"_before": "counted"}, hot_rows)
    sums = ledger.groupBy("supply_id").agg(total("qty").alias("_total"))
    gap = F.col("counted") - F.coalesce("_before", "_total", F.lit(0))
    rows = looked.join(sums, "supply_id", "left").select("supply_id", money(gap, 18).alias("qty"), F.lit(True).alias("is_adjustment"))
    return Adjusted(results, rows)


def apply_adjustments(counted: DataFrame, ledger: DataFrame, supplies: DataFrame | None = None) -> DataFrame:
    """Ledger rows of ``adjust_to_counts``; without ``supplies``, every supply counted is known.

    Without ``req_id`` a supply may be counted once.
    """
    known = counted.select("supply_id").distinct() if supplies is None else supplies
    if "req_id" not in counted.columns:
        counted = last_by_key(counted, ["supply_id"], ["counted"]).withColumn("req_id", F.lit(0).cast("bigint"))
    return adjust_to_counts(counted, ledger, known).ledger_rows


@dataclass(frozen=True)
class Corrected:
    ledger: DataFrame
    snapshot: DataFrame


def apply_ledger_corrections(
    ledger: DataFrame, snapshot: DataFrame, edits: DataFrame, deletes: DataFrame, key: list[str]
) -> Corrected:
    """Edit quantities and delete rows of the ledger.

    ``edits`` has the key and ``new_qty``. ``deletes`` has the key and ``reverse_stock``: true takes
    the deleted quantity back out of the stock, false leaves the stock alone. Edits never move it.
    Of several edits of a row the last by ``req_id`` counts, of several deletes the first, as the others find nothing;
    without ``req_id`` a row may be named once by each. Requests without a key go.
    """
    sequence = -F.col("req_id") if "req_id" in deletes.columns else F.lit(0)
    asked = deletes.withColumn("_later", sequence).where(F.col("reverse_stock").isNotNull())
    gone = last_by_key(asked, key, ["reverse_stock"], "_later" if "req_id" in deletes.columns else "req_id")
    gone = gone.withColumnRenamed("reverse_stock", "_reverse")
    changed = last_by_key(edits, key, ["new_qty"]).withColumnRenamed("new_qty", "_new_qty")
    marked = ledger.join(gone, key, "left").join(changed, key, "left")
    kept = marked.where(F.col("_reverse").isNull())
    new_ledger = kept.withColumn("qty", F.coalesce("_new_qty", "qty").cast(ledger.schema["qty"].dataType))
    reversed_qty = (
        ledger.join(gone, key).where("_reverse").groupBy("supply_id").agg((-total("qty")).alias("qty"))
    )
    return Corrected(new_ledger.select(*ledger.columns), add_to_stock(snapshot, reversed_qty))


def _stock_checks(requests: DataFrame, supplies: DataFrame, staff: DataFrame) -> DataFrame:
    marked = known_reference(requests, staff.where("enabled"), "staff_id", "keeper_id", "_keeper")
    return known_reference(marked, supplies, "supply_id", "supply_id", "_supply")


def _coded(df: DataFrame, code, requests: DataFrame, kind: str) -> DataFrame:
    coded = df.withColumn("result_code", code)
    return coded.select(*requests.columns, "result_code", message_for(kind, "result_code").alias("message"))


def accepted(results: DataFrame, columns: list[str], snapshot: DataFrame) -> Applied:
    """Ledger rows and stock that follow from a batch's results."""
    rows = results.where("result_code = 1").select(*columns, F.lit(False).alias("is_adjustment"))
    change = rows.groupBy("supply_id").agg(total("qty").alias("qty"))
    return Applied(results, rows, add_to_stock(snapshot, change))
