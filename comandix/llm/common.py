"""Row keys, stored intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comandix.session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Whether Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder all executors share; later plans start from there.

    The shuffle files they were made with go at once. Plans are made with the setting of their time, so this one is
    made anew, and the session's setting is as before afterwards.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def row_key(*columns: str) -> Column:
    """16 bytes that equal rows share and different rows don't. NULL differs from any text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return row_key_of(F.concat_ws("\x1f", *parts))


def row_key_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def word_count(text: Column) -> Column:
    """Words of a text as a long; NULL has none. Counts word starts without building the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the component is its smallest node.

    Each round every node moves to the one with the smallest hash among itself and those it is linked
    with, and from there once more; links within one place go. About a third of the places of a chain is
    left after each round, and a star takes two. A hot node costs one row per task, as the minimum
    combines before the shuffle.
    """
    links = stored(links.where("a <> b").distinct())
    moves: list[DataFrame] = []

    def ranked(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))

    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min(ranked("b")).alias("_m")).select(F.col("a").alias("_n"), F.least(ranked("a"), "_m")["n"].alias("_p"))
        up = parent.select(F.col("_n").alias("_p"), F.col("_p").alias("_q"))
        parent = stored(parent.join(up, "_p").select("_n", F.col("_q").alias("_p")))
        moves.append(parent)
        for end in ("a", "b"):
            links = links.join(parent.select(F.col("_n").alias(end), F.col("_p").alias("_to")), end)
            links = links.drop(end).withColumnRenamed("_to", end)
        links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = moves[0].select(F.col("_n").alias("node"), F.col("_p").alias("_place"))
    for parent in moves[1:]:
        moved = labels.join(parent, F.col("_place") == F.col("_n"), "left")
        labels = moved.select("node", F.coalesce("_p", "_place").alias("_place"))
    if len(moves) > 1:
        labels = stored(labels)
    smallest = labels.groupBy("_place").agg(F.min("node").alias("component"))
    return labels.join(smallest, "_place").select("node", "component")
