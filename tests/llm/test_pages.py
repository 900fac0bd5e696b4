"""URL filters, archives and vectors against plain Python over the same rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from comandix.llm import caps, catalog, common, url_rules, warc


def parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule(host: str, path: str) -> tuple[str | None, str | None]:
    fits = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    "http://a.example.net/en/1",
    "HTTP://A.Example.NET/EN/1",
    "https://example.net?x=/en/",
    "https://b.net/",
    "https://b.net",
    "https://www.example.com/de/x#top",
    "https://example.com/de",
    "https://xorg/fr/",
    "https://x.org/fr/",
    "no scheme",
    "",
    None,
    "a://b://c/d?e#f",
    "http://é.org/fr/\nx",
]


def test_written_rules(spark):
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y"), (None, None, None, None)], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "doc_id long, label string")
    got = url_rules.judged(frame, none).collect()
    expected = Counter()
    for key, url in [*enumerate(URLS), (0, URLS[0]), (None, None)]:
        host, path = parts(url)
        name, verdict = rule(host, path)
        expected[key, host, path, name, verdict or "allow"] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == expected
    assert url_rules.judged(frame.limit(0), none).collect() == []


def test_mined_rules_find_what_labels_say(spark):
    """Half of the pages of casino.example.com under /win are labelled; the other half is judged alike."""
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        rows.append((i, f"http://{'casino' if bad else 'news'}.example.com/{'win' if bad else 'world'}/{i}?ref=x"))
        if i % 2 == 0:
            labels.append((i, "block" if bad else "allow"))
    known = spark.createDataFrame(labels, "id long, label string")
    got = {r.page_id: r for r in url_rules.judged(spark.createDataFrame(rows, "page_id long, url string"), known).collect()}
    # Labelled ids are even, so of the good ones only those with i % 4 == 2 are.
    assert all(got[i].verdict == ("block" if i % 4 == 0 else "allow") for i in range(1200))
    assert {got[i].method for i in range(0, 1200, 4)} == {"mined"}
    mined = url_rules.mined(spark.createDataFrame([(["a=1", "b=2"], "block")] * 40 + [(["b=2"], "allow")] * 40, "_tokens array<string>, _label string")).collect()
    assert {(tuple(r._rule), r._verdict) for r in mined} == {(("a=1",), "block")}


@pytest.mark.parametrize("others", [500, 8000])
def test_rules_do_not_depend_on_other_rows(spark, others):
    """The same rules whatever number of other labels there is, and many constant words on a path don't multiply them."""
    deep = "/".join(f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30))
    rows = [(i, f"http://spam{chr(97 + i % 3)}.example.com/{deep}/{i}") for i in range(60)]
    rows += [(100 + i, f"http://mixed.example.com/{deep.replace('part', 'mix')}/{'bad' if i % 2 else 'good'}/{i}") for i in range(60)]
    known = [(i, "block") for i in range(60)] + [(100 + i, "block" if i % 2 or i == 4 else "allow") for i in range(60)]
    rows += [(1000 + i, f"http://news.example.org/world/{i}") for i in range(others)]
    known += [(1000 + i, "allow") for i in range(others)]
    rows += [(900_000, "http://elsewhere.example.com/partaa"), (900_001, "http://elsewhere.example.com/mixab/bad"), (900_002, "http://elsewhere.example.com/mixab/good")]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(known, "id long, label string")
    got = {r.page_id: (r.verdict, r.method) for r in url_rules.judged(pages, labels).collect()}
    assert {got[i] for i in range(60)} == {("block", "mined")}
    assert got[900_000] == ("block", "mined") and got[900_001] == ("block", "mined") and got[900_002][0] == "allow"


def test_mined_rules_are_those_of_all_token_sets(spark):
    """Against every set of up to four tokens counted in plain Python, with stand-ins put back."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    rows = []
    for _ in range(600):
        held = {f"t{k}" for k in range(6) if rng.random() < 0.45}
        held |= {"a1", "a2"} if rng.random() < 0.4 else set()
        bad = ("t0" in held and "t1" in held) or ("a1" in held and "t2" in held) or rng.random() < 0.1
        held |= {"pure"} if bad and rng.random() < 0.3 else set()
        rows.append((sorted(held) or ["t9"], "block" if bad else "allow"))
    rules, stand = url_rules.mined_from(spark.createDataFrame(rows, "_tokens array<string>, _label string"))
    got = {(tuple(sorted(r._rule)), r._verdict): round(r._confidence, 9) for r in rules.collect()}
    assert {(r._t, r._as) for r in stand.collect()} == {("a2", "a1")}
    tokens = sorted({t for held, _ in rows for t in held} - {"a2"})
    sure = {}
    for size in (1, 2, 3, 4, 5):
        for chosen in combinations(tokens, size):
            labels = [label for held, label in rows if set(chosen) <= set(held)]
            for verdict in ("block", "allow"):
                n, share = labels.count(verdict), sum(label == verdict for _, label in rows) / len(rows)
                if n >= url_rules.LEAST_URLS and n / len(labels) >= url_rules.CONFIDENCE and n / len(labels) >= url_rules.LIFT * share:
                    if not any(set(c) < set(chosen) and v == verdict and s >= n / len(labels) for (c, v), s in sure.items()):
                        sure[chosen, verdict] = n / len(labels)
    assert got == {k: round(v, 9) for k, v in sure.items()}


def test_many_archives_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE", 20_000)
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(cast(id AS string), 512), 8) AS html").repartition(4)
    folder, files = warc.write_archives(pages)
    assert files.count() >= 16
    back = warc.read_archives(folder, files).withColumn("_p", F.spark_partition_id())
    assert back.select("_p").distinct().count() >= 8 and back.count() == 400


def test_archives(spark, tmp_path):
    big = "<p>" + "words and more words " * 4000
    html = ["x" * 100, "x" * 99, "x" * 100, "x" * 99, None, "", big, big, "é" * 60, "\r\n\r\nWARC/1.1\r\n" * 20, "x" * 100]
    rows = [(10 - i, f"http://h/{i}" if i % 3 else None, h, "clash") for i, h in enumerate(html)] + [(10, "again", "x" * 100, "c"), (None, None, big, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    folder, files = warc.write_archives(frame)
    got = warc.read_archives(folder, files, with_payload=True).collect()
    first: dict[bytes, int] = {}
    for key, _, h, _ in rows:
        if key is not None:
            raw = (h or "").encode()
            first[raw] = min(first.get(raw, key), key)
    expected = Counter()
    for key, url, h, _ in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and first[raw] != key
        expected[key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None, url, None if revisit else raw] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url, None if r.payload is None else bytes(r.payload)) for r in got) == expected
    folder, files = warc.write_archives(frame.limit(0))
    assert warc.read_archives(folder, files).collect() == []


def test_an_archive_is_plain_frames_behind_a_dictionary(spark):
    frame = spark.range(500).selectExpr("id as page_id", "concat('http://h/', id) as url", "concat('<html><body>text number ', id, '</body></html>') as html").coalesce(1)
    folder, files = warc.write_archives(frame)
    name = files.collect()[0]["file"]
    with open(f"{folder.removeprefix('file://')}/{name}", "rb") as file:
        raw = file.read()
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    size = int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert reader.decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, _s string, kept int")


def brute(rows: list[tuple]) -> Counter:
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(np.float64)
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v, *_ in rows]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93:
                links[i].add(j)
                links[j].add(i)
    out = Counter()
    for i in range(len(rows)):
        reach, queue = {i}, [i]
        while queue:
            for j in links[queue.pop()] - reach:
                reach.add(j)
                queue.append(j)
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        out[rows[i][0], len(links[i]), min(ids) if ids else None] += 1
    return out


@pytest.mark.parametrize("block", [512, 20])
def test_near_vectors(spark, monkeypatch, block):
    """With the second size a filter is many blocks."""
    monkeypatch.setattr(caps, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = []
    for k in range(12):
        center = rng.normal(size=64)
        for c in range(12):
            rows.append((len(rows), (center + rng.normal(size=64) * rng.uniform(0, 0.5)).astype(np.float32).tolist(), k % 3, "s", 1))
    rows += [(200 + i, rows[5][1], rows[5][2], "t", 2) for i in range(30)]
    rows += [(300, None, 1, None, None), (301, [], 1, "", 0), (302, [0.0] * 64, 1, "", 0), (303, [float("nan")] * 64, 1, "", 0), (304, rows[0][1], None, "", 0)]
    rows += [(305, [None, 1.0], 1, "", 0), (306, [1.0, 0.0], 1, "", 0), (307, [2.0, -0.0], 1, "", 0), (308, [3.0], 1, "", 0), (None, rows[7][1], rows[7][2], "", 0), rows[9]]
    got = caps.near_vectors(vectors(spark, rows)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert caps.near_vectors(vectors(spark, [])).collect() == []


def test_filters_meet_at_the_threshold():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=(2000, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    near = 0.93 * u + math.sqrt(1 - 0.93**2) * w
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(caps.filters_of(u), caps.filters_of(near))]
    assert np.mean(met) > 0.995


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (350, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_every_query_has_an_entry():
    assert [q.split("_")[0] for q in catalog.QUERIES] == [f"op{n}" for n in range(1, 14)]
