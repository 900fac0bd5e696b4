"""The operators on documents against plain Python over the same rows."""

from __future__ import annotations

import glob
import hashlib
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from comandix.llm import catalog, common, language, minhash, mixing, ordinal, pieces, quality_rules, suffix
from tests.llm.conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text: str | None, size: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def groups(rows: list[tuple], size: int) -> dict:
    """Smallest id of each row's component, by comparing all rows."""
    sets = [shingle_set(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = {}
    for own in members.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        for i in own:
            out[i] = min(ids) if ids else None
    return out


def near_copies(n: int) -> list[tuple]:
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(n):
        base = rng.choice(words, 60).tolist()
        rows.append((10 * k, " ".join(base)))
        for c in range(1, 5):
            copy = list(base)
            for at in rng.choice(60, c, replace=False):
                copy[at] = f"edit{k}{c}"
            rows.append((10 * k + c, " ".join(copy)))
    return rows


def test_near_duplicates(spark, edges):
    rows = near_copies(40)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4, 5):
        got = {r.doc_id: r for r in minhash.near_duplicates(frame, size).collect()}
        for i, to in groups(rows, size).items():
            assert got[rows[i][0]].component_id == to
            assert got[rows[i][0]].n_shingles == len(shingle_set(rows[i][1], size))
    own = [(r[0], r[1]) for r in edge_rows()]
    expected = Counter((own[i][0], len(shingle_set(own[i][1], 4)), to) for i, to in groups(own, 4).items())
    got = minhash.near_duplicates(edges, 4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays(edges, nothing):
    kept = minhash.without_near_duplicates(edges)
    assert kept.columns == edges.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [0, 3, 4, 5, 6, 8, 9, 10, 11, 12]
    assert minhash.without_near_duplicates(nothing).collect() == []
    assert minhash.near_duplicates(nothing).collect() == []


def test_a_large_group_is_one_component(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j + 1 :])) for i in range(600) for j in [i % 120]]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.component_id for r in got} == {0}


def test_one_link_between_large_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 1000)
    monkeypatch.setattr(minhash, "UNIT", 100)
    shared, ends = [f"c{k}" for k in range(140)], [[f"{e}{k}" for k in range(20)] for e in "ab"]
    rows = [(10_000 * e + i, " ".join([*shared, *ends[e], f"u{e}x{i}", f"v{e}x{i}"])) for e in (0, 1) for i in range(1500)]
    # Only these two are linked across: 148 of 180 words; others have 140 of 184, or 144 of 182 with one of these.
    rows += [(5000 + 10_000 * e, " ".join([*shared, *ends[e], *ends[1 - e][:4]])) for e in (0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(frame, 1).collect()} == {0}
    apart = minhash.near_duplicates(frame.where("doc_id <> 5000"), 1).collect()
    assert {(r.doc_id // 10_000, r.component_id) for r in apart} == {(0, 0), (1, 10_000)}


def test_pairs_of_many_tables_are_compared_once(spark, monkeypatch):
    made, real = spark.sparkContext.accumulator(0), minhash.candidates

    def counted(percent):
        run = real(percent)

        def counting(table):
            out = run(table)
            made.add(out.num_rows)
            return out

        return counting

    monkeypatch.setattr(minhash, "candidates", counted)
    shared = [f"c{k}" for k in range(140)]
    # 140 of 176 words at most: all are possible partners, in tables of a quarter of them, and none is linked.
    rows = [(i, " ".join([*shared, *[f"u{i}x{k}" for k in range(18)]])) for i in range(400)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(400)]
    assert 400 <= made.value <= 20 * 400


def test_sets_of_few_pairs_are_held_at_once():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 500)) for _ in range(3000)]
    batch = pa.record_batch([pa.array(range(3000)), pa.array(texts), pa.array(range(3000)), pa.array([texts[i - i % 3] for i in range(3000)])], ["a", "_ta", "b", "_tb"])
    run = minhash.confirmed(4, 80)
    list(run([batch.slice(0, 1)]))
    tracemalloc.start()
    got = [x for found in run([batch]) for x in found.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == list(range(0, 3000, 3))
    assert peak < 20e6  # all sets have 24 MB


def test_stored_rows_leave_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    setting, before = spark.conf.get(common.FREED, None), files()
    kept = common.stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not files() - before
    assert sorted(tuple(r) for r in kept.collect()) == [(k, 100) for k in range(10)]
    assert spark.conf.get(common.FREED, None) == setting


def removed(texts: list[bytes], length: int) -> list[np.ndarray]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        out.append(cover)
    return out


def check_removed(got: list, rows: list[tuple], length: int) -> None:
    texts = [(text or "").encode() for _, text in rows]
    expected = Counter()
    for (key, _), raw, cover in zip(rows, texts, removed(texts, length)):
        runs = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
        rest = bytes(b for b, c in zip(raw, cover) if not c)
        expected[key, len(raw), int(cover.sum()), runs, hashlib.sha256(rest).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected


@pytest.mark.parametrize("length", [20, 100, 400])
def test_repeats(edges, length):
    rows = [(r[0], r[1]) for r in edge_rows() if r[1] is None or len(r[1]) < 20_000]
    check_removed(suffix.remove_repeats(edges.where("text is null or length(text) < 20000"), length).collect(), rows, length)


@pytest.mark.parametrize("group", [1 << 22, 600])
def test_shared_passages(spark, monkeypatch, group):
    """With the second size every owner counts as too large for an index."""
    monkeypatch.setattr(suffix, "GROUP", group)
    rng = np.random.default_rng(2)
    letters = list("abcdefgh ")
    passages = ["".join(rng.choice(letters, n)) for n in (70, 99, 130, 300)]
    rows = []
    for i in range(120):
        parts = ["".join(rng.choice(letters, int(rng.integers(0, 150)))) for _ in range(3)]
        rows.append((i, passages[i % 4].join(parts) + ("z" * 150 if i % 10 == 0 else "")))
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 90).collect()
    check_removed(got, rows, 90)


def test_texts_without_repeats(edges, nothing):
    out = suffix.without_repeats(edges, 400)
    assert out.columns == edges.columns and out.count() == edges.count()
    assert suffix.without_repeats(nothing, 400).collect() == []
    assert suffix.remove_repeats(nothing, 400).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=8, unique=True), st.integers(2, 12))
def test_run_index(strings, length):
    index = suffix.RunIndex(strings)
    assert index.run_lengths.sum() == sum(map(len, strings)) + len(strings)
    seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    expected = {(k, i) for k, s in enumerate(strings) for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1}
    got = {(k, i) for k, first, last in zip(*(x.tolist() for x in index.repeated(length))) for i in range(first, last + 1)}
    assert got == expected


def test_quality_rules(spark, edges, nothing, monkeypatch):
    rows = [(r[0], r[1]) for r in edge_rows()]
    expected = Counter()
    for key, text in rows:
        words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count = Counter(grams)
        cover = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
        figures = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover))
        expected[(key, *figures, len(words) < 10 or 100 * len(cover) > 20 * len(words))] += 1
    got = quality_rules.judged(edges).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    assert quality_rules.judged(nothing).collect() == [] and quality_rules.filtered(nothing).collect() == []
    monkeypatch.setattr(quality_rules, "LEAST_DOCUMENTS", 2)
    body = lambda i: " ".join(f"own{i}x{k}" for k in range(12))
    made = [(i, f"{body(i)}\nAll rights  RESERVED here", "h") for i in range(4)]
    made += [(4, "all rights reserved here\n" + "Read more now please friends dear all " * 2, "h"), (5, body(5) + "\nAll rights reserved here", "other")]
    frame = spark.createDataFrame([(*r, "x") for r in made], "doc_id long, text string, source string, _often string")
    verdicts = {r.doc_id: (r.n_frequent_words, r.kept) for r in quality_rules.judged(frame).collect()}
    # The first document that has a line keeps it.
    assert verdicts == {0: (0, True), 1: (4, True), 2: (4, True), 3: (4, True), 4: (4, False), 5: (0, True)}
    texts = {r.doc_id: r.text for r in quality_rules.filtered(frame).collect()}
    assert texts == {0: made[0][1], **{i: body(i) for i in range(1, 4)}, 5: made[5][1]}


def test_copies_of_one_text_are_documents(spark, monkeypatch):
    """A line of more documents than the limit goes, copies or not; the first copy stays, and a repeated row is one document."""
    monkeypatch.setattr(quality_rules, "LEAST_DOCUMENTS", 2)
    text = "one short line that is copied many times over here"
    frame = spark.createDataFrame([(i, text, "h") for i in range(30)], "doc_id long, text string, source string")
    assert {r.doc_id for r in quality_rules.judged(frame).collect() if r.kept} == {0}
    again = spark.createDataFrame([(i % 2, text, "h") for i in range(30)], "doc_id long, text string, source string")
    assert all(r.kept for r in quality_rules.judged(again).collect())


@pytest.mark.parametrize("size", [5, 29, 30, 31, 32, 200])
def test_lines_of_every_length_are_counted_alike(spark, monkeypatch, size):
    monkeypatch.setattr(quality_rules, "LEAST_DOCUMENTS", 2)
    body = lambda i: " ".join(f"own{i}x{k}" for k in range(300))
    notice = " ".join(f"cookie{k}" for k in range(size))
    rows = [(i, f"{body(i)}\n{notice}", "h") for i in range(4)] + [(None, f"{body(4)}\n{notice}", "h")]
    # Near copies: one line and a word of their own.
    passage = " ".join(f"long{k}" for k in range(50))
    rows += [(10 + i, f"{passage}\nown{i}", None) for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts = {r.doc_id: (r.n_frequent_words, r.kept) for r in quality_rules.judged(frame).collect()}
    assert verdicts == {0: (0, True), **{i: (size, True) for i in (1, 2, 3, None)}, 10: (0, True), **{i: (50, False) for i in (11, 12, 13)}}
    texts = {r.doc_id: r.text for r in quality_rules.filtered(frame).collect()}
    assert texts == {0: rows[0][1], 1: body(1), 2: body(2), 3: body(3), None: body(4), 10: rows[5][1]}


def test_a_large_host_has_the_limit_of_a_small_one(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LEAST_DOCUMENTS", 2)
    body = lambda i: " ".join(f"own{i}x{k}" for k in range(12))
    rows = [(i, body(i) + ("\nAll rights reserved here" if i < 3 else ""), "h") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.n_frequent_words for r in quality_rules.judged(frame).collect()} == {i: 4 * (0 < i < 3) for i in range(300)}


def test_mix(spark, edges, nothing):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{i % 7}" if i % 7 else None) for i in range(700)] + [(900, "a b c", "tiny")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(frame).collect()
    assert sorted(got) == sorted(mixing.taken(frame.repartition(5)).collect())
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(r.size for r in by[s]) for s in names}
    target, free, left = {}, set(names), float(sum(size.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    for s in names:
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in by[s])
        assert sum(r.taken for r in by[s]) == round(target[s])
    mixed = mixing.mixed(frame).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in got)
    assert mixing.taken(edges).count() == edges.count() and mixing.mixed(edges).columns == edges.columns
    assert mixing.taken(nothing).collect() == [] and mixing.mixed(nothing).collect() == []


def test_pieces_are_the_librarys(spark, edges, nothing, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=catalog.PIECE_MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for frame in (docs, edges):
        given_ = frame.select("doc_id", "text").collect()
        got = Counter((r.doc_id, None if r.piece_ids is None else tuple(r.piece_ids), r.decoded) for r in pieces.encode_decode(frame, catalog.PIECE_MODEL).collect())
        expected = Counter()
        for r in given_:
            ids = None if r.text is None else library.encode(r.text)
            expected[r.doc_id, None if ids is None else tuple(ids), None if ids is None else library.decode(ids)] += 1
        assert got == expected
    assert pieces.encode_decode(nothing, catalog.PIECE_MODEL).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" \nabethingTH1.▁éü☃日🙂", max_size=60))
def test_any_string_has_the_librarys_pieces(text):
    library = test_any_string_has_the_librarys_pieces.__dict__.setdefault("library", sentencepiece.SentencePieceProcessor(model_file=catalog.PIECE_MODEL))
    with open(catalog.PIECE_MODEL, "rb") as file:
        own = test_any_string_has_the_librarys_pieces.__dict__.setdefault("own", pieces.Model(file.read()))
    ids = own.encode([text])[0]
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids) == library.decode(ids.tolist())


def test_grades_on_texts_held_out(spark, edges, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id < 4000")
    grade = "case when toxic = 1 then 0 when quality = 0 then 1 else 2 end"
    known = labels.where("doc_id % 4 <> 1").selectExpr("doc_id", f"{grade} as grade")
    got = {r.doc_id: r for r in ordinal.graded(docs, known).collect()}
    held = labels.where("doc_id % 4 = 1").selectExpr("doc_id", f"{grade} as grade").collect()
    good, bad = [got[r.doc_id] for r in held if r.grade == 2], [got[r.doc_id] for r in held if r.grade < 2]
    assert np.mean([r.kept for r in good]) > 0.95
    assert np.mean([r.kept for r in bad]) < 0.15
    assert np.mean([r.expected_grade for r in good]) > np.mean([r.expected_grade for r in bad]) + 1
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert {(r.expected_grade, r.kept) for r in ordinal.graded(edges, none).collect()} == {(0.0, False)}
    out = {r.doc_id: r for r in ordinal.graded(edges, known).collect()}
    assert out[3].expected_grade == 0 and not out[4].kept
    assert ordinal.graded(nothing, known).collect() == []


def test_language_on_texts_held_out(spark, edges, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    out = language.languages(edges).collect()
    assert len(out) == edges.count()
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5))
    assert language.languages(nothing).collect() == []


def test_sql_agrees(spark, sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in catalog.ORACLE.items():
        got = catalog.QUERIES[name](spark, sf_dir).toPandas()
        expected = connection.execute(sql).df()
        key = [c for c in ("doc_id", "page_id", "vec_id") if c in got][0]
        columns = sorted(got.columns)
        assert columns == sorted(expected.columns)
        a, b = (x[columns].sort_values(key).reset_index(drop=True) for x in (got, expected))
        for c in columns:
            plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
            assert [plain(v) for v in a[c].astype(object)] == [plain(v) for v in b[c].astype(object)], (name, c)


@pytest.mark.parametrize("words", [51, 60, 80])
def test_planted_passages(spark, words):
    """Passages of 51 to 80 words in many documents: what 400 equal bytes cover goes, shorter runs stay, whatever their words."""
    rng = np.random.default_rng(words)
    letters = list("abcdefghijklmnop")
    made = lambda n, size: " ".join("".join(rng.choice(letters, int(rng.integers(*size)))) for _ in range(n))
    planted = [made(words, (2, 5)), made(words, (5, 9)), made(words, (8, 12))]
    assert len(planted[0]) < 400 < len(planted[2])
    rows = [(i, f"{made(30, (3, 9))} {planted[i % 3]} {made(30, (3, 9))}" if i % 4 else made(80, (3, 9))) for i in range(48)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400, with_text=True).collect()
    check_removed(got, rows, 400)
    for r in got:
        own = planted[r.doc_id % 3] if r.doc_id % 4 else None
        if own is None or len(own) < 380:
            assert r.n_removed == 0 and r.kept_text == rows[r.doc_id][1]
        elif len(own) >= 400:
            assert own not in r.kept_text and r.n_removed >= len(own)


def test_query_shows_what_is_left(spark, tmp_path):
    """The query's removal is read from ``text``, as from the pipeline's stage; n_bytes is the size of the input."""
    rng = np.random.default_rng(5)
    made = lambda n, size: " ".join("".join(rng.choice(list("abcdefghijklmnopé"), int(rng.integers(*size)))) for _ in range(n))
    planted = [made(90, (5, 9)), made(51, (2, 5))]
    assert len(planted[1].encode()) < 400 < len(planted[0].encode())
    rows = [(i, f"{made(40, (3, 9))} {planted[i % 2]} {made(40, (3, 9))}" if i % 3 else made(120, (3, 9))) for i in range(24)]
    rows += [(24, None), (25, ""), (26, rows[0][1]), (26, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.op5_suffix_dedup(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = out.collect()
    check_removed(got, rows, 400)
    for r in got:
        if r.doc_id in (0, 26):
            assert r.text == "" and r.n_bytes == r.n_removed
        elif r.doc_id >= 24 or r.doc_id % 3 == 0 or r.doc_id % 2:
            assert r.text == rows[r.doc_id][1] and r.n_removed == 0
        else:
            assert planted[0] not in r.text and 0 < len(r.text) < len(rows[r.doc_id][1]) and r.n_removed >= len(planted[0].encode())
