"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "comandix", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings every operator expects; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTING = "spark.sql.streaming.stateStore.providerClass"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams started from now on keep their state on disk, unless the session names another store than Spark's default."""
    if spark.conf.get(STATE_SETTING).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_SETTING, DISK_STATE)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A local session without one gets a fresh temporary folder. A cluster session without one is
    refused: a folder on one machine would be lost with that machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="comandix-")
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return configured or current


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new, empty path for one run's written tables or stream checkpoint."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
