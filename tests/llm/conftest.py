"""Rows that every operator must take: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

BASE = " ".join(f"alpha{i} beta{i * 7 % 13} gamma" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(40_000))
TEXTS = [
    BASE,
    BASE.upper(),
    BASE + " tail",
    None,
    "",
    " \n\t ",
    "one",
    "One",
    "one two",
    LONG,
    "x y z " + LONG[:3000] + " end",
    "é" * 500 + " ünï " + "日本" * 40,
    "lone text with its own few words here and there, longer than ten words",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component long, _k string, _t int, _h string"


def edge_rows() -> list[tuple]:
    rows = []
    for i, text in enumerate(TEXTS):
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None if text is None else len(text), None, i, "k", i, None))
    rows.append(rows[0])  # a repeated row
    rows.append((None, BASE, "en", None, 1, True, None, None, None, None))
    rows.append((99, "one two", None, "b", 7, False, 1, "", 0, "h"))
    return rows


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
