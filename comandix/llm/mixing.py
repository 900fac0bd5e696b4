"""A mix of sources in which each takes words up to its target, in an order that is random but fixed.

Everything is built-in expressions. Documents get a hash for a key and lie in ``SLICES`` slices of
the key's range per source. Sums per slice, combined before the shuffle, give each source the
slice in which its budget ends; slices before it are taken whole and those after it not at all, so
only the documents of that slice are put in order. A source with most of the rows is one row per
slice and task, and its ordered slice holds 1/``SLICES`` of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comandix.llm import common

#: Hexadecimal digits of the random key that name a slice.
SLICE_DIGITS = 3
SLICES = 16**SLICE_DIGITS
#: Fixed by the task: weights of the sources in code point order, and how often a document may be taken.
WEIGHTS, MOST = (5, 2, 1), 3


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (_source, _size): shares by weight, none above ``most`` times its size.

    The excess goes to the others by weight until none is above. That is one level: with sources in
    the order of cap / weight, the first whose cap reaches an equal share of what the earlier ones
    leave sets it for itself and all later ones. One row per source goes through one task here.
    """
    order = F.col("_source").asc_nulls_last()
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_weight", weight).withColumn("_cap", most * F.col("_size").cast("double"))
    by_ratio = Window.partitionBy(F.lit(1)).orderBy(F.col("_cap") / F.col("_weight"), order)
    all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_left", F.sum(F.col("_size").cast("double")).over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("_others", F.sum("_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("_left") / F.col("_others") <= F.col("_cap") / F.col("_weight"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_left") / F.col("_others")))).over(all_rows)
    level = F.coalesce(level["col2"], F.lit(0.0))
    return rows.select("_source", F.col("_size").alias("_source_size"), F.least(F.col("_cap"), level * F.col("_weight")).alias("_target"))


def taken(
    docs: DataFrame,
    seed: int = 1,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: key, id, source, size, source_size, target, taken.

    Size counts words; a NULL text has none and is never taken. The words taken from a source add up
    to its target, rounded: every document as many whole times as the target holds the source, then
    in random order once more until the budget ends, the last one in part. NULL is a source of its own,
    after the others. Equal rows share a key; which of them the budget cuts makes no difference.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(source_col).alias("_source"))
    key = common.row_key("_id", "_source", "_t")
    rows = base.select("_id", "_source", key.alias("_k"), common.word_count(F.col("_t")).alias("_n"))
    rows = rows.withColumn("_r", F.md5(F.concat(F.lower(F.hex("_k")), F.lit(f":{seed}"))))
    rows = common.stored(rows.withColumn("_slice", F.conv(F.substring("_r", 1, SLICE_DIGITS), 16, 10).cast("int")))
    sums = common.stored(rows.groupBy("_source", "_slice").agg(F.sum("_n").alias("_n")))
    budget = targets(sums.groupBy("_source").agg(F.sum("_n").alias("_size")), weights, most)
    budget = budget.withColumn("_times", F.when(F.col("_source_size") > 0, F.floor(F.round("_target") / F.col("_source_size"))).otherwise(F.lit(0)).cast("long"))
    budget = budget.withColumn("_rest", F.round("_target").cast("long") - F.col("_times") * F.col("_source_size"))
    order = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("_end", F.sum("_n").over(order)).alias("s").join(budget.alias("b"), F.col("s._source").eqNullSafe(F.col("b._source")))
    ends = ends.where(F.col("_end") >= F.col("_rest")).groupBy("b._source").agg(
        F.min(F.struct("_slice", (F.col("_end") - F.col("_n")).alias("_before"))).alias("_cut"), F.first("_source_size").alias("_source_size"),
        F.first("_target").alias("_target"), F.first("_times").alias("_times"), F.first("_rest").alias("_rest"),
    )
    ends = common.stored(ends.select(F.col("_source").alias("_from"), "_cut._slice", "_cut._before", "_source_size", "_target", "_times", "_rest").withColumnRenamed("_slice", "_cut"))
    placed = rows.join(ends, F.col("_source").eqNullSafe(F.col("_from")))
    whole = F.col("_n") * F.col("_times")
    outside = placed.where("_slice <> _cut").withColumn("_taken", whole + F.when(F.col("_slice") < F.col("_cut"), F.col("_n")).otherwise(F.lit(0)))
    inside = Window.partitionBy("_source").orderBy("_r", "_k").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = placed.where("_slice = _cut").withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    part = F.least(F.col("_n"), F.greatest(F.lit(0).cast("long"), F.col("_rest") - F.col("_start")))
    at_cut = at_cut.withColumn("_taken", whole + part).drop("_start")
    out = outside.unionByName(at_cut)
    return out.select(
        "_k", F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_n").alias("size"),
        F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").cast("long").alias("taken"),
    )


def leading_words(text: Column, n: Column) -> Column:
    """The text up to and with its ``n``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, n.cast("int")), "")


def mixed(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with its columns, each document as often as the mix takes it; a part is the text's leading words.

    Documents of no words are in no mix.
    """
    plan = taken(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col).where("taken > 0")
    numbered = Window.partitionBy("_k").orderBy("taken")
    plan = plan.select("_k", "size", F.col("taken").alias("_take"), F.row_number().over(numbered).alias("_copy"))
    inner = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    name = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    keyed = inner.withColumn("_k", common.row_key(name[id_col], name[source_col], name[text_col])).dropDuplicates(["_k"])
    times = F.ceil(F.col("_take") / F.col("size")).cast("int")
    rows = keyed.join(plan, "_k").withColumn("_time", F.explode(F.sequence(F.lit(1), times)))
    words = F.least(F.col("size"), F.col("_take") - (F.col("_time") - 1) * F.col("size"))
    text = F.when(words < F.col("size"), leading_words(F.col(name[text_col]), words)).otherwise(F.col(name[text_col]))
    return rows.select(*[(text if c == text_col else F.col(name[c])).alias(c) for c in docs.columns])
