"""Readers: stored tables, database tables, seed rows and the stream of order events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comandix import model


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _INT, _TEXT, _REAL, _CLOCK = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()

# Given schemas save a pass over file footers for every reference to a table.
STORED_SCHEMAS = {
    "region": _schema(r_regionkey=_INT, r_name=_TEXT),
    "nation": _schema(n_nationkey=_INT, n_name=_TEXT, n_regionkey=_INT),
    "customer": _schema(c_custkey=_LONG, c_name=_TEXT, c_nationkey=_INT, c_acctbal=_REAL, c_mktsegment=_TEXT),
    "supplier": _schema(s_suppkey=_LONG, s_name=_TEXT, s_nationkey=_INT, s_acctbal=_REAL),
    "part": _schema(
        p_partkey=_LONG, p_name=_TEXT, p_brand=_TEXT, p_type=_TEXT, p_size=_INT, p_retailprice=_REAL
    ),
    "orders": _schema(
        o_orderkey=_LONG,
        o_custkey=_LONG,
        o_orderstatus=_TEXT,
        o_totalprice=_REAL,
        o_orderdate=_CLOCK,
        o_orderpriority=_TEXT,
    ),
    "lineitem": _schema(
        l_orderkey=_LONG,
        l_partkey=_LONG,
        l_suppkey=_LONG,
        l_linenumber=_INT,
        l_quantity=_REAL,
        l_extendedprice=_REAL,
        l_discount=_REAL,
        l_tax=_REAL,
        l_returnflag=_TEXT,
        l_linestatus=_TEXT,
        l_shipdate=_CLOCK,
    ),
    "events": _schema(event_id=_LONG, ts=_CLOCK, user_id=_LONG, event_type=_TEXT, value=_REAL, props=_TEXT),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored Parquet table."""
    reader = spark.read.schema(STORED_SCHEMAS[name]) if name in STORED_SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_database_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A table of a running database, read in ranges of a key by many tasks at once."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, **options)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def read_stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the model at ``path``, with the model's schema rather than an inferred one."""
    return spark.read.schema(model.SCHEMAS[name]).parquet(path)


def load_seed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Seed rows from CSV files with a header; an empty field is NULL and flags are 0 or 1."""
    schema = model.SCHEMAS[name]
    # Without a schema all fields are text and go by the header, whatever the order of the columns.
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(
        *[
            (F.col(f.name) == "1" if isinstance(f.dataType, T.BooleanType) else F.col(f.name).cast(f.dataType)).alias(
                f.name
            )
            for f in schema
        ]
    )


def table_stream(
    spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of the Parquet files of a stored table. ``max_files_per_trigger`` bounds a trigger's work."""
    reader = spark.readStream.schema(STORED_SCHEMAS[name])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # A pattern is accepted for a table of one file as well as for a folder of files; a plain path is not.
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def order_event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of raw event files."""
    return table_stream(spark, sf_dir, "events", max_files_per_trigger)
