"""License scans against every block compared with every template in plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from comandix.llm import catalog, licenses

SCHEMA = "doc_id long, text string, labels string, score int, _id string, _text int"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    w = words(text)
    places, labels, score, spans = [], set(), 0.0, []
    for phrase, label in licenses.PHRASES:
        head = phrase.split()
        for i in range(len(w) - len(head) + 1):
            if w[i : i + len(head)] == head:
                places.append(i)
                labels.add(label)
    base = ",".join(sorted(labels))
    for number, (label, template) in enumerate(templates):
        step = licenses.block_step(len(words(template)))
        wanted = set(words(template))
        for start in range(0, max(1, len(w) - step), step):
            shared = len(wanted & set(w[start : start + 2 * step]))
            if shared >= math.ceil(threshold * len(wanted)):
                labels.add(label)
                score = max(score, shared / len(wanted))
                spans.append((start, min(start + 2 * step, len(w)), number, shared / len(wanted)))
    return (len(w), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), 1.0 if places else score, sorted(spans))


def found(df):
    return Counter((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, tuple(map(tuple, r.spans)))) for r in df.collect())


def as_key(doc_id, row):
    return doc_id, (*row[:-1], tuple(row[-1]))


GPL, APACHE = licenses.TEMPLATES[1][1], licenses.TEMPLATES[3][1]
TEXTS = [
    "Released under the MIT License.",
    "released UNDER the mit-license",
    "mit\nlicense mit license, MIT LICENSE",
    "x " * 37 + GPL + " y" * 50,
    GPL.replace("redistribute", "spread").replace("option", "wish"),
    " ".join(w for i, w in enumerate(APACHE.split()) if i % 4),
    "/* " + APACHE.replace(" ", "\n * ") + " */",
    "word " * 30_000 + "cc by" + " word" * 30_000 + " " + licenses.TEMPLATES[6][1],
    "Ünder the ÄPACHE license; apache license apache_license apache license9",
    "cc by cc by cc\x00by ccby",
    "under the license version 2 0 " * 400,
]


def test_edges(spark, edges, nothing):
    rows = [(i, t, "x", 1, "y", 2) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, None, None, None), (None, TEXTS[3], None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(licenses.license_scan(frame)) == Counter(as_key(r[0], expected(r[1])) for r in rows)
    assert found(licenses.license_scan(edges)) == Counter(as_key(r.doc_id, expected(r.text)) for r in edges.collect())
    assert licenses.license_scan(nothing).collect() == []


def test_notices_are_found(spark):
    """Each template, wrapped, commented and within other text, has its label; plain prose has none."""
    rows = []
    for label, text in licenses.TEMPLATES:
        for k, shown in enumerate([text, text.upper(), "\n// ".join(text.split()), "some words before " * 25 + text + " and behind" * 40]):
            rows.append((f"{label} {k}", shown))
    rows.append(("", "the license of a released work is free to use under version 2 of this permission " * 20))
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    for r in licenses.license_scan(frame).collect():
        assert r.doc_id.split(" ")[0] in r.labels.split(",") and (r.doc_id != "" or r.labels == "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("a b c d e f g h i j k L, M; n9 é".split()), max_size=60), st.sampled_from([Fraction(1, 2), Fraction(4, 5), Fraction(1)]))
def test_filters_lose_nothing(texts, threshold):
    """Blocks of a few words against templates of the same words, whatever their order of frequency."""
    import numpy as np

    templates = (("p", "a b c"), ("q", "c d e f g"), ("r", "h i j k l m n9 a b"), ("s", "é é a"))
    index = licenses.Templates(templates, (), threshold)
    index.ordered(np.arange(len(index.vocabulary))[::-1] % 5)
    raw = " ".join(texts).encode()
    got = licenses.searched(index, np.frombuffer(raw or b"\0", np.uint8)[: len(raw)], np.array([0, len(raw)]))
    assert [tuple(s) for s in got[0][-1]] == [s for s in expected(" ".join(texts), templates, threshold)[-1]]


def test_stored_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = Counter((r.doc_id, tuple(r)[1:]) for r in catalog.op11_license_scan(spark, sf_dir).collect())
    assert got == Counter((r.doc_id, expected(r.text)[:-1]) for r in docs)


def test_templates_are_bounded():
    with pytest.raises(ValueError):
        licenses.Templates((("x", "..."),), (), licenses.THRESHOLD)
