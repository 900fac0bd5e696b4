from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from comandix.session import build_session  # noqa: E402
from comandix.sources.tables import load_seed  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "comandix-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


class Seed:
    def __init__(self, spark):
        self._spark = spark

    def __getattr__(self, name):
        return load_seed(self._spark, str(Path(__file__).parent / "fixtures" / f"{name}.csv"), name)


@pytest.fixture(scope="session")
def seed(spark):
    return Seed(spark)


def rows(df, *columns):
    """Rows as sorted tuples, NULLs last."""
    found = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in found.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
