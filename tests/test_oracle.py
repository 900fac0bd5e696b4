"""Every query against the same query in SQL on a second engine."""

from __future__ import annotations

import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from comandix.plans.catalog import CATALOG
from comandix.plans.oracle import ORACLE

# How a Spark type must show in the other engine; decimals show as themselves.
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["dish_name", "total"]
    assert result.count() > 0


def test_every_query_has_sql():
    """Text queries have tests of their own; every other query has SQL."""
    assert set(CATALOG) == set(ORACLE) and set(oracle_sql()) <= set(queries())


def test_without_the_text_operators(monkeypatch):
    """Whatever keeps them from being imported, the other queries are there."""
    monkeypatch.setitem(sys.modules, "comandix.llm", None)
    assert set(queries()) == set(CATALOG) and set(oracle_sql()) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_same_as_sql(name, spark, duck, sf_dir):
    sql = oracle_sql()[name]
    result = queries()[name](spark, sf_dir)
    columns = sorted(result.columns)
    kinds = {row[0]: row[1] for row in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert columns == sorted(kinds)
    for field in result.schema.fields:
        shown = field.dataType.simpleString()
        assert KINDS.get(shown, shown.upper()) == kinds[field.name], field.name
    cursor = duck.execute(sql)
    order = [[c[0] for c in cursor.description].index(name) for name in columns]
    expected = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    found = [tuple(row) for row in result.select(*[f"`{c}`" for c in columns]).collect()]

    def key(row):
        return tuple((value is None, str(value)) for value in row)

    assert sorted(found, key=key) == sorted(expected, key=key)
