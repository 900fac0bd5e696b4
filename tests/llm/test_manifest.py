"""The manifest against a plain recursive Merkle tree."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from comandix.llm import catalog, manifest


def h(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(values) -> str:
    shown = (None if v is None else str(v) for v in values)
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in shown))


def climb(leaves: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root, and for each leaf (siblings on the left, siblings) level by level."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for leaf_no, node in enumerate(at):
            first = node // 8 * 8
            run = level[first : first + 8]
            paths[leaf_no].append((node - first, run[: node - first] + run[node - first + 1 :]))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [node // 8 for node in at]
    return level[0], paths


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(rows) -> Counter:
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        now = leaf((*r[:4], lowered(r[4]))) if tampered else leaf(r)
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0, leaf(r)), r[0], leaf(r), now))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[0])
        trees[g] = climb([x[2] for x in groups[g]])
    root, tops = climb([trees[g][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        subroot, paths = trees[g]
        for (_, doc_id, was, now), path in zip(groups[g], paths):
            path, end = path + tops[k], now
            for left, others in path:
                end = h(*others[:left], end, *others[left:])
            out[doc_id, was, subroot, root, h(*(d for _, others in path for d in others)), end, end == root] += 1
    return out


def found(df) -> Counter:
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def plain(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 63, 64, 65, 100, 513])
def test_positions_are_those_of_a_walk(leaves):
    log, counts = [], [leaves]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // 8))

    def walk(level, node):
        if level:
            for child in range(8 * node, min(8 * node + 8, counts[level - 1])):
                walk(level - 1, child)
        log.append((level, node))

    walk(len(counts) - 1, 0)
    assert manifest.height(leaves) == len(counts) - 1
    for level, count in enumerate(counts):
        got = manifest.position(level, np.arange(count), leaves)
        assert [log[p] for p in got] == [(level, i) for i in range(count)]


@pytest.mark.parametrize("height", [1, 4])
def test_edges(spark, edges, nothing, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    monkeypatch.setattr(manifest, "BUILDER", 8**height)
    assert found(manifest.verified(edges, manifest.lowered_thirds)) == expected(plain(edges))
    assert manifest.verified(nothing, manifest.lowered_thirds).collect() == []
    one = edges.where("doc_id = 5")
    assert found(manifest.verified(one, manifest.lowered_thirds)) == expected(plain(one))


def test_many_groups_and_tiers(spark, monkeypatch, height=2):
    """Groups of 1 to 700 rows, one with most of them, 90 groups of a few; the tops have tiers of their own."""
    monkeypatch.setattr(manifest, "HEIGHT", height)
    monkeypatch.setattr(manifest, "BUILDER", 8**height)
    rows = [(i * 7 % 1009, "s", "hot" if i < 700 else f"é{i % 90}" if i % 90 else None, i, f"Text {i % 50} A") for i in range(1200)]
    rows += [(5, "s", "hot", 1, "Same")] * 70
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = found(manifest.verified(docs, manifest.lowered_thirds))
    assert got == expected(rows)
    assert {v[-1] for v in got} == {True, False}


def test_the_log_is_in_postorder(spark, monkeypatch):
    monkeypatch.setattr(manifest, "HEIGHT", 2)
    monkeypatch.setattr(manifest, "BUILDER", 64)
    rows = spark.range(300).selectExpr("cast('t' as binary) as tree", "id as _order", "unhex(sha2(cast(id as string), 256)) as digest", "cast(cast(id as string) as binary) as payload")
    made = manifest.manifest(rows)
    assert made.tiers == 2 and made.root == made.subroots.first().subroot
    whole = spark.read.parquet(f"{made.folder}/rows").select("position", "digest")
    assert whole.count() == 344 + 5  # what a builder completes is in the log of its tier and of the next
    log = whole.distinct().orderBy("position").collect()
    assert [r.position for r in log] == list(range(300 + 38 + 5 + 1)) and log[-1].digest.hex() == made.root
    for parts in spark.read.parquet(f"{made.folder}/rows/tier=0").groupBy("block").agg({"position": "collect_list"}).collect():
        places = parts[1]
        assert places == list(range(places[0], places[0] + len(places)))  # as written, each builder's part is one run


def test_stored_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(catalog.op12_merkle_manifest(spark, sf_dir)) == expected(plain(docs))
