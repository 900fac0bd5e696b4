"""Ordered work per key when one key may hold a large part of all rows.

A window puts all rows of a key into one task. Totals, previous rows and positions are worked out as prefix scans
instead: every key is cut into slices by the value of its first order column, and what one slice hands to the next is
worked out from one small row per key and slice. The cut depends on values only, so a task that runs again finds the
same one, and no count of the keys is needed.

The sequential fold of ``stock_fold`` can't be cut by value without knowing which keys are hot. For it, keys with more
than ``hot_rows`` rows (``split_hot``) are cut into slices of equal size by a range shuffle that a checkpoint fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comandix.operators.stock_walk import SLICE
from comandix.session import checkpoint_root

HOT_ROWS = 2_000_000
PIECE = "_piece"
ID_BITS = 16


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows brought together by ``keys`` in as many tasks as the session has shuffle partitions.

    The adaptive planner merges shuffle partitions by their compressed size, and ids compress so well that one task would hash
    many millions of them. It leaves a numbered repartition as it is.
    """
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)


def split_hot(df: DataFrame, key: str, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of hot keys if there are any. NULL is a key like any other."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.where(F.col("_rows") > hot_rows).select(F.col(key).alias("_hot"))
    if hot.isEmpty():
        return df, None
    checkpoint_root(df.sparkSession)
    # At most all rows / hot_rows keys, so the broadcast is bounded.
    hot = F.broadcast(hot.checkpoint())
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def cut(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows sorted by ``order``, in numbered slices of about equal size, fixed by a checkpoint."""
    checkpoint_root(df.sparkSession)
    parts = shuffle_partitions(df.sparkSession)
    return (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(SLICE, F.spark_partition_id())
        .checkpoint()
    )


def slice_of(df: DataFrame, column: str, span: int) -> Column:
    """A coarse value of an order column that rises with it, so equal slices are neighbours in the order.

    Whole and decimal numbers fall into runs of about ``span`` values, instants into runs of ``span`` times
    65 milliseconds (with the default about a day), dates are themselves and texts go by their first characters. Other
    kinds are one slice. NULL comes first, as in the order itself.
    """
    kind = df.schema[column].dataType
    bits = max(0, min(20, span.bit_length() - 1))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.left(column, F.lit(8)), F.lit(""))
    if isinstance(kind, T.DateType):
        whole = F.unix_date(column).cast("bigint")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.shiftright(F.unix_micros(F.col(column).cast("timestamp")), 16 + bits)
    elif isinstance(kind, T.IntegralType):
        whole = F.shiftright(F.col(column).cast("bigint"), bits)
    elif isinstance(kind, T.DecimalType) and kind.precision - kind.scale <= 18:
        whole = F.shiftright(F.floor(column).cast("bigint"), bits)
    else:
        return F.lit(0).cast("bigint")
    return F.coalesce(whole, F.lit(-(2**63)).cast("bigint"))


def _sliced(df: DataFrame, keys: list[str], order: list[str], span: int) -> DataFrame:
    """Rows brought together by ``PIECE``, their key and slice: the one shuffle that both passes of a scan read.

    As fields of a struct, NULL keys are equal, so windows, groups and joins all go by the one shuffle.
    """
    return df.withColumn(PIECE, F.struct(*keys, slice_of(df, order[0], span).alias(SLICE))).repartition(PIECE)


def _of_slices(slices: DataFrame, value: Column) -> DataFrame:
    """``value`` of every key and slice.

    The hash of whole rows is not used for anything: it has this pass ask for all columns as the other pass does, so
    that their shuffles are equal and Spark runs one for both.
    """
    whole = F.max(F.xxhash64(*slices.columns)).alias("_whole")
    return slices.groupBy(PIECE).agg(whole, value.alias("_value")).where("_whole IS NOT NULL").drop("_whole")


def _by_slice(*keys: str) -> WindowSpec:
    """The slices of a key in order."""
    return Window.partitionBy(*[F.col(f"{PIECE}.{k}") for k in keys]).orderBy(F.col(f"{PIECE}.{SLICE}"))


def _handed_down(slices: DataFrame, values: DataFrame) -> DataFrame:
    """Every row with the value that its slice starts from."""
    return slices.join(values.withColumnRenamed(PIECE, "_of"), F.col(PIECE) == F.col("_of"))


def running_total(
    df: DataFrame, key: str, order: list[str], value: str, alias: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Sum of ``value`` over a key's rows up to and including the current one.

    A key is cut into slices of its order (``slice_of``), whether it has many rows or few. A window adds up within a
    slice, sums of whole slices are added up over a key's slices, and a row's total is one plus the other. Nothing runs
    while the query is built, and the input is read and shuffled once. A task holds one slice of one key: about
    ``hot_rows`` rows where order values differ.
    """
    slices = _sliced(df, [key], order, hot_rows)
    earlier = _by_slice(key).rowsBetween(Window.unboundedPreceding, -1)
    carried = _of_slices(slices, F.sum(value)).select(PIECE, F.sum("_value").over(earlier).alias("_carried"))
    frame = Window.partitionBy(PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = slices.withColumn("_within", F.sum(value).over(frame))
    kind = within.schema["_within"].dataType
    whole = F.coalesce(F.col("_within") + F.coalesce("_carried", F.lit(0)), F.col("_carried")).cast(kind)
    return _handed_down(within, carried).select(*df.columns, whole.alias(alias))


def previous(
    df: DataFrame, key: str, order: list[str], columns: dict[str, str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Values of the row before, per key; ``columns`` maps a new name to the column it looks back at.

    Cut as in ``running_total``: a slice's last row is handed to the key's next slice.
    """
    slices = _sliced(df, [key], order, hot_rows)
    last = F.max_by(F.struct(*[F.col(name).alias(alias) for alias, name in columns.items()]), F.struct(*order))
    handed = _of_slices(slices, last).select(PIECE, F.lag("_value").over(_by_slice(key)).alias("_handed"))
    by_slice = Window.partitionBy(PIECE).orderBy(*order)
    looked = slices.withColumns({"_first": F.row_number().over(by_slice) == 1} | {alias: F.lag(name).over(by_slice) for alias, name in columns.items()})
    values = [F.when(F.col("_first"), F.col("_handed").getField(alias)).otherwise(F.col(alias)).alias(alias) for alias in columns]
    return _handed_down(looked, handed).select(*df.columns, *values)


def total_and_previous(
    df: DataFrame, key: str, order: list[str], value: str, alias: str, columns: dict[str, str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``running_total`` and ``previous`` of the same order in one scan: rows are cut, shuffled and sorted once for both."""
    slices = _sliced(df, [key], order, hot_rows)
    earlier = _by_slice(key).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.struct(*[F.col(name).alias(new) for new, name in columns.items()]), F.struct(*order))
    ends = _of_slices(slices, F.struct(F.sum(value).alias("_sum"), last.alias("_last")))
    handed = ends.select(
        PIECE, F.sum("_value._sum").over(earlier).alias("_carried"), F.lag("_value._last").over(_by_slice(key)).alias("_handed")
    )
    by_slice = Window.partitionBy(PIECE).orderBy(*order)
    within = F.sum(value).over(by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lags = {new: F.lag(name).over(by_slice) for new, name in columns.items()}
    looked = slices.withColumns({"_within": within, "_first": F.row_number().over(by_slice) == 1} | lags)
    kind = looked.schema["_within"].dataType
    whole = F.coalesce(F.col("_within") + F.coalesce("_carried", F.lit(0)), F.col("_carried")).cast(kind)
    before = [F.when(F.col("_first"), F.col("_handed").getField(new)).otherwise(F.col(new)).alias(new) for new in columns]
    return _handed_down(looked, handed).select(*df.columns, whole.alias(alias), *before)


def row_index(df: DataFrame, order: list[str], alias: str = "position", span: int = HOT_ROWS) -> DataFrame:
    """Position of every row in the whole order, starting at 1. ``order`` must tell all rows apart.

    Slices of the order are numbered each by itself, and sizes of the slices before are added; one task
    sees one row per slice.
    """
    slices = _sliced(df, [], order, span)
    earlier = _by_slice().rowsBetween(Window.unboundedPreceding, -1)
    before = _of_slices(slices, F.count(F.lit(1))).select(PIECE, F.coalesce(F.sum("_value").over(earlier), F.lit(0)).alias("_before"))
    placed = slices.withColumn("_place", F.row_number().over(Window.partitionBy(PIECE).orderBy(*order)))
    return _handed_down(placed, before).select(*df.columns, (F.col("_place") + F.col("_before")).alias(alias))


def assign_ids(requests: DataFrame, req_id: str, alias: str, after: Column | int = 0) -> DataFrame:
    """New ids after the largest one in use, in the order of a unique whole-number request id.

    Ids are counted by all but their last 16 bits, those counts by all but 32 and by all but 48. At
    each level a window adds up the children of one parent, of which there are at most 65,536, so dense and
    sparse ids are spread alike and no task orders more than that.
    """
    rows = requests.withColumn("_l1", F.shiftright(F.col(req_id).cast("bigint"), ID_BITS))
    level = rows.groupBy("_l1").agg(F.count(F.lit(1)).alias("_n1"))
    levels = [level]
    for k in (2, 3):
        level = level.withColumn(f"_l{k}", F.shiftright(f"_l{k - 1}", ID_BITS))
        levels[-1] = level
        level = level.groupBy(f"_l{k}").agg(F.sum(f"_n{k - 1}").alias(f"_n{k}"))
        levels.append(level)
    before = None
    for k in (3, 2, 1):
        by = Window.partitionBy(F.lit(0) if k == 3 else F.col(f"_l{k + 1}")).orderBy(f"_l{k}")
        own = F.coalesce(F.sum(f"_n{k}").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offset = levels[k - 1].withColumn("_own", own)
        if before is None:
            before = offset.select("_l3", F.col("_own").alias("_before"))
        else:
            before = offset.join(before, f"_l{k + 1}").select(f"_l{k}", (F.col("_own") + F.col("_before")).alias("_before"))
    after = F.lit(after) if isinstance(after, int) else after
    place = F.row_number().over(Window.partitionBy("_l1").orderBy(req_id))
    return (
        rows.join(before, "_l1")
        .withColumn(alias, (after + F.col("_before") + place).cast("bigint"))
        .select(*requests.columns, alias)
    )
