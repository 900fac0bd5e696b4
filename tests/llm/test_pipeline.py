"""The pipeline's stages on given documents."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import sentencepiece

import corpus_pipeline
from comandix.llm import common, minhash, quality_rules
from tests.llm.test_documents import groups, removed


def test_stages(spark, edges, nothing, tmp_path):
    docs = edges
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        if name != "sentencepiece":
            assert out.columns == edges.columns
        docs = spark.read.parquet(path)
        assert stage(spark, nothing, str(tmp_path)).collect() == []
    assert docs.columns[0] == "doc_id" and docs.where("not round_trip").count() == 0


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.round_trip and len(r.piece_ids) == r.n_pieces for r in rows)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(*values, sep="\x1f") -> str:
    return hashlib.md5(sep.join("-" if v is None else f"={v}" for v in values).encode()).hexdigest()


def by_rules(rows):
    """Documents (id, source, text) that the quality rules keep, without lines of more than 20 documents of their source."""
    lines = lambda t: [x for x in t.split("\n") if WORD.search(x)]
    plain = lambda x: " ".join(WORD.findall(x)).lower()
    holders = defaultdict(set)
    for i, source, text in rows:
        for x in lines(text or ""):
            holders[source, plain(x)].add((i is None, i, key(i, source, text)))
    often = {h: min(d) for h, d in holders.items() if len(d) > quality_rules.LEAST_DOCUMENTS}
    out = []
    for i, source, text in rows:
        words = WORD.findall(text or "")
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        count = Counter(grams)
        cover = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        me = (i is None, i, key(i, source, text))
        gone = [x for x in lines(text or "") if often.get((source, plain(x)), me) != me]
        left = len(words) - sum(len(WORD.findall(x)) for x in gone)
        failed = len(words) < 10 or 100 * len(cover) > 20 * len(words)
        if not failed and not (gone and (left < quality_rules.LEAST_WORDS or left < quality_rules.LEAST_PART * len(words))):
            out.append((i, source, "\n".join(x for x in text.split("\n") if x not in gone) if gone else text))
    return out


def one_of_each(rows):
    """One document of each group of near-duplicates."""
    to = groups([(i, text) for i, _, text in rows], 5)
    first = {}
    for at, (i, _, text) in enumerate(rows):
        first.setdefault((to[at]), []).append(at)
    return [rows[at] for at in range(len(rows)) if rows[at][0] == to[at]]


def cut(rows, length):
    """Texts without bytes that ``length`` bytes found elsewhere cover; emptied texts go."""
    raw = [text.encode() for *_, text in rows]
    out = []
    for (i, source, _), t, cover in zip(rows, raw, removed(raw, length)):
        left = bytes(b for b, c in zip(t, cover) if not c).decode()
        if left:
            out.append((i, source, left))
    return out


def mix(rows):
    """Each source up to its target of words, in the order of hashes, the last document in part."""
    size = Counter()
    for _, source, text in rows:
        size[source] += len(WORD.findall(text))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else share[s]
            left -= 3.0 * size[s] if over else 0
        free = free - over if over else set()
    out = []
    for s in names:
        times, rest = divmod(round(target[s]), size[s]) if size[s] else (0, 0)
        own = sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5((key(*r) + ":1").encode()).hexdigest())
        for i, source, text in own:
            words = len(WORD.findall(text))
            take = min(words, rest)
            rest -= take
            out += [(i, source, text)] * (times if words else 0)
            if take:
                out.append((i, source, text if take == words else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)[:take])))
    return out


def test_run_is_the_plain_chain_of_the_stages(spark, tmp_path):
    """Every document and piece of run() on planted documents against plain Python over the same rows."""
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdefghijklm"), int(rng.integers(2, 8)))) for _ in range(900)]
    passage = " ".join(rng.choice(vocabulary, 51))
    short = " ".join(f"{chr(97 + k % 20)}{chr(97 + k % 7)}x" for k in range(52))  # 51 words and more of three letters
    rows = []
    for n in range(260):
        words = rng.choice(vocabulary, int(rng.integers(12, 90))).tolist()
        text = " ".join(words[:9]) + "\n" + " ".join(words[9:])
        source = ["a", "a", "a", "b", "c", None][n % 6]
        if n % 13 == 0:
            text += "\n" + (passage if n % 2 else short)
        if n % 4 == 0:
            text += "\nAll rights RESERVED here" if n % 8 else "\nall  rights reserved here"
        if n % 17 == 0:
            text = "few words"
        if n % 19 == 0:
            text = " ".join(words[:6] * 12)
        rows.append((n, source, text))
    for n in range(30):  # exact and near copies
        i, source, text = rows[100 + n]
        rows.append((1000 + n, source, text if n % 2 else text + " tail"))
    rows += [(2000, "a", None), (2001, "b", ""), (2002, None, "the shortest of all sources has ten words or so here in it")]
    docs = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    chain = mix(cut(one_of_each(by_rules(rows)), corpus_pipeline.PASSAGE_BYTES))
    assert all(" ".join(short.split()[:51]) not in t and passage not in t for _, _, t in cut(one_of_each(by_rules(rows)), corpus_pipeline.PASSAGE_BYTES))
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    expected = Counter((i, tuple(library.encode(t))) for i, _, t in chain)
    got = Counter((r.doc_id, tuple(r.piece_ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == expected


def test_near_duplicates_start_few_plans(spark, monkeypatch):
    """Each table stored is a plan of the driver's, with threads and figures that stay; a chain of three copies needs ten."""
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join([*words[: 400 - 30 * n], *(f"x{n}{i}" for i in range(30 * n))]) for n in range(2)]
    rows = [(3, chain[0]), (1, chain[1]), (2, chain[0]), (7, "lone text of six words"), (None, None), (8, None)]
    docs, made, real = spark.createDataFrame(rows, "doc_id long, text string"), [], common.stored
    monkeypatch.setattr(common, "stored", lambda df: made.append(1) or real(df))
    got = minhash.without_near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got if r.doc_id is not None) == [(False, 1, chain[1]), (False, 7, rows[3][1]), (False, 8, None)]
    assert len(got) == 4 and len(made) <= 10
