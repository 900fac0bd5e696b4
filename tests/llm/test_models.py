"""Fitted models against dense arithmetic in plain numpy, and their features against one text at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from comandix.llm import language, ordinal

WORDS = "good fine clear plain words about many things stupid trash idiot $$$ Click HERE now the of and".split()


def texts(n: int = 200) -> list[str]:
    random = np.random.default_rng(11)
    made = []
    for i in range(n):
        pool = WORDS[:8] + WORDS[15:] if i % 3 else WORDS[8:]
        made.append(" ".join(random.choice(pool, int(random.integers(1, 40)))))
    return made


def buckets(rows: list[str]) -> list[np.ndarray]:
    raw = [r.encode() for r in rows]
    return ordinal.features(np.frombuffer(b"".join(raw) or b"\0", np.uint8)[: sum(map(len, raw))], np.concatenate([[0], np.cumsum([len(r) for r in raw])]))


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    rows = ["some foo", "foo bar", "bar bar", "", "bar", "bar", *texts(60), "x " * 5000]
    alone = [buckets([r])[0] for r in rows]
    for order in (range(len(rows)), range(len(rows) - 1, -1, -1), np.random.default_rng(1).permutation(len(rows)).tolist()):
        together = buckets([rows[i] for i in order])
        assert all(np.array_equal(alone[i], got) for i, got in zip(order, together))


def test_grades_are_those_of_a_dense_fit():
    """The same steps on the whole matrix of texts and buckets, written out for each threshold."""
    rows = texts()
    grade = np.array([0 if i % 3 == 0 and i % 2 else 1 if i % 3 == 0 else 2 for i in range(len(rows))])
    lists = buckets(rows)
    used = np.unique(np.concatenate(lists))
    dense = np.zeros((len(rows), len(used)))
    for i, f in enumerate(lists):
        dense[i, np.searchsorted(used, f)] = 1
    above = np.stack([grade >= 1, grade >= 2], axis=1).astype(float)
    share = above.mean(axis=0)
    count = dense.sum(axis=0)
    lean = np.max([np.abs(dense.T @ above[:, j] - count * p) / np.sqrt(count * p * (1 - p)) for j, p in enumerate(share)], axis=0)
    scale = np.where((count >= ordinal.LEAST_TEXTS) & (lean >= ordinal.LEAST_LEAN), 1 / np.sqrt(1 + count), 0)
    weights, steps, thresholds = np.zeros(len(used)), np.full(len(used), 1e-8), -np.log(share / (1 - share))
    for _ in range(ordinal.ROUNDS):
        slope, error = np.zeros(len(used)), []
        for j, p in enumerate(share):
            chance = 1 / (1 + np.exp(-(dense @ weights - thresholds[j])))
            off = np.where(above[:, j] == 1, 0.5 / p, 0.5 / (1 - p)) * (chance - above[:, j])
            slope += dense.T @ off
            error.append(off.mean())
        slope = slope * scale / len(rows) * 100 + ordinal.DECAY * weights
        steps += slope**2
        weights = weights - ordinal.RATE * scale * slope / np.sqrt(steps)
        thresholds = np.maximum.accumulate(thresholds + ordinal.RATE * np.array(error))
    model = ordinal.solved((), pa.table({"_y": pa.array(grade), "_f": pa.array([f.tolist() for f in lists], pa.list_(pa.int32()))}))
    found = np.frombuffer(model["weights"][0].as_py(), np.float32)
    assert (weights != 0).sum() >= 5 and np.abs(found[used] - weights).max() < 1e-5 and (found != 0).sum() == (weights != 0).sum()
    assert np.abs(np.array(model["thresholds"][0].as_py()) - thresholds).max() < 1e-9
    run = ordinal.scored(found, thresholds)
    batch = next(run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["_id", "_t"])])))
    tails = 1 / (1 + np.exp(-(dense @ weights[:, None] - thresholds[None, :])))
    assert np.abs(batch["expected_grade"].to_numpy() - tails.sum(axis=1)).max() < 1e-5
    assert np.abs(batch["p_top"].to_numpy() - tails[:, -1]).max() < 1e-5


def test_repeated_rows_and_ties_are_graded_alike(spark):
    rows = [(i, t) for i, t in enumerate(texts(120))]
    rows += [(rows[7][0], rows[7][1]), (500, rows[7][1]), (501, rows[7][1] * 3000)]
    known = [(i, 0 if i % 3 == 0 else 1) for i in range(120)] + [(7, 0), (9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame(known, "id long, grade int")
    got = ordinal.graded(docs, ratings).collect()
    assert len(got) == len(rows)
    same = {(r.expected_grade, r.p_top, r.kept) for r in got if r.doc_id in (7, 500)}
    assert len(same) == 1
    again = {r.doc_id: r.expected_grade for r in ordinal.graded(docs.repartition(7), ratings).collect()}
    assert all(abs(again[r.doc_id] - r.expected_grade) < 1e-12 for r in got)


def presence(text: str) -> np.ndarray:
    row = np.zeros(language.BUCKETS, np.uint8)
    language.mark(row, text)
    return row


def test_languages_are_those_of_a_dense_kernel_ridge(monkeypatch):
    """The kernel, its landmarks and the ridge systems written out text by text."""
    monkeypatch.setattr(language, "LANDMARKS", 24)
    samples = {"en": "the quick brown fox and the lazy dog of that house", "de": "der schnelle braune fuchs und der faule hund im haus", "fr": "le renard brun et le chien paresseux de la maison"}
    random = np.random.default_rng(2)
    rows = [(kind, " ".join(random.choice(sample.split(), int(random.integers(3, 20))))) for kind, sample in samples.items() for _ in range(67)]
    bits = [presence(t) for _, t in rows]
    table = pa.table({"_y": [k for k, _ in rows], "_bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})
    model = language.solved((), table)
    kinds = model["kinds"][0].as_py()
    matrix = np.frombuffer(model["matrix"][0].as_py(), np.float32).reshape(language.BUCKETS, 3)

    def kernel(a, b):
        return float((a & b).sum()) / np.sqrt(float(a.sum()) * float(b.sum()))

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], np.packbits(bits[i]).tobytes()))
    marks = []
    for kind in kinds:
        own = [i for i in order if rows[i][0] == kind]
        marks += own[:: max(1, len(own) // 8)][:8]
    k = np.array([[kernel(bits[i], bits[m]) for m in marks] for i in order])
    among = np.array([[kernel(bits[a], bits[m]) for m in marks] for a in marks])
    held_out = [presence(t) for t in ("the dog and the fox", "der hund und das haus", "le chien de la maison")]
    for at, kind in enumerate(kinds):
        target = np.array([1.0 if rows[i][0] == kind else -1.0 for i in order])
        weights = np.linalg.solve(k.T @ k + language.RIDGE * len(rows) * among + 1e-6 * np.eye(len(marks)), k.T @ (target - target.mean()))
        assert abs(model["offset"][0].as_py()[at] - target.mean()) < 1e-12
        for x in held_out:
            dense = sum(w * kernel(x, bits[m]) for w, m in zip(weights, marks)) + target.mean()
            folded = float(x.astype(np.float64) @ matrix[:, at]) / np.sqrt(x.sum()) + target.mean()
            assert abs(dense - folded) < 1e-3
    run = language.scored(kinds, np.array(model["offset"][0].as_py()), matrix)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([False] * 3), pa.array(["the dog and the fox", "der hund und das haus", "le chien de la maison"])], ["_id", "held_out", "_t"])
    assert next(run(iter([batch])))["lang_pred"].to_pylist() == ["en", "de", "fr"]


@pytest.mark.parametrize("text", ["the lazy dog", "der faule hund " * 30_000])
def test_a_text_is_named_alike_wherever_it_stands(spark, text):
    rows = [(i, t, "de" if "hund" in t or "der" in t else "en") for i, t in enumerate(["der hund im haus und der fuchs", "the dog of that house and the fox"] * 40)]
    rows += [(100, text, None), (100, text, None), (103, text, "xx"), (None, text, "zz"), (105, "12 34", "en")]
    got = language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (100, None)}) == 1
    assert next(r.lang_pred for r in got if r.doc_id == 105) == "und"
