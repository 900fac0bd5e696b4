"""The language of whole texts by string kernels.

Two texts are compared by the character n-grams of 1 to ``LONGEST`` that both hold: a blended spectrum
of presence, hashed to ``BUCKETS``, divided by the root of both counts. ``LANDMARKS`` of the fitted
texts span the kernel (Nyström), and one ridge regression per language is solved on them. As the kernel is
a product of presence vectors, landmarks and coefficients fold into one matrix, so a batch of texts
is scored by one matrix product.

Fitted on a bounded sample: the ``FITTED`` labelled texts with the smallest hash, in one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, LONGEST = 1 << 15, 4
FITTED, LANDMARKS, RIDGE = 3000, 160, 1e-3
NONE = "und"
PART = 1 << 20
_TABLE = np.array([chr(i).isalpha() for i in range(0x250)])


def _letters(text: str) -> np.ndarray:
    """Lower-case code points with everything that is no letter as one space between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    near = codes < 0x250
    letter = np.zeros(len(codes), bool)
    letter[near] = _TABLE[codes[near]]
    if not near.all():
        far, back = np.unique(codes[~near], return_inverse=True)
        letter[~near] = np.array([chr(c).isalpha() for c in far.tolist()])[back]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[keep]
    if not len(codes):
        return codes
    return np.concatenate([[32], codes, [] if codes[-1] == 32 else [32]]).astype(np.uint32)


def mark(row: np.ndarray, text: str | None) -> bool:
    """Sets the buckets of the text's n-grams in ``row``; false if it has no letter."""
    codes = _letters(text or "")
    if len(codes) < 3:
        return False
    for lo in range(0, len(codes), PART):
        part = codes[lo : lo + PART + LONGEST - 1]
        hashed = np.full(len(part), 1, np.uint32)
        for n in range(1, LONGEST + 1):
            hashed = hashed[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
            row[(hashed * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)] = 1
    return True


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: (language, text) to (language, presence bits)."""
    for batch in batches:
        names, bits = [], []
        for name, text in zip(*(column.to_pylist() for column in batch.columns)):
            row = np.zeros(BUCKETS, np.uint8)
            if mark(row, text):
                names.append(name)
                bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bits, pa.binary())], ["_y", "_bits"])


def solved(key: tuple, table: pa.Table) -> pa.Table:
    """Code of one task over the sample: the folded matrix and the languages."""
    names = table.column("_y").to_pylist()
    kinds = sorted(set(names))
    bits = [np.frombuffer(b, np.uint8) for b in table.column("_bits").to_pylist()]
    by = sorted(range(len(names)), key=lambda i: (names[i], bits[i].tobytes()))
    chosen = []
    for kind in kinds:
        own = [i for i in by if names[i] == kind]
        share = max(1, LANDMARKS // len(kinds))
        chosen += own[:: max(1, len(own) // share)][:share]
    rows = lambda which: np.stack([np.unpackbits(bits[i]) for i in which]).astype(np.float32)
    marks = rows(chosen)
    scale = np.sqrt(marks.sum(axis=1))
    kernel = np.concatenate(
        [((x := rows(by[lo : lo + 256])) @ marks.T) / np.sqrt(x.sum(axis=1))[:, None] / scale for lo in range(0, len(by), 256)]
    ).astype(np.float64)
    among = (marks @ marks.T / scale[:, None] / scale).astype(np.float64)
    target = np.where(np.array([names[i] for i in by])[:, None] == np.array(kinds)[None, :], 1.0, -1.0)
    offset = target.mean(axis=0)
    system = kernel.T @ kernel + RIDGE * len(by) * among + 1e-6 * np.eye(len(chosen))
    weights = np.linalg.solve(system, kernel.T @ (target - offset))
    folded = (marks / scale[:, None]).T.astype(np.float64) @ weights
    return pa.table({"kinds": pa.array([kinds], pa.list_(pa.string())), "offset": pa.array([offset.tolist()], pa.list_(pa.float64())), "matrix": pa.array([folded.astype(np.float32).tobytes()], pa.binary())})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, offsets and the matrix, from rows with a text and a language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("_y"), F.col(text_col).alias("_t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_r"))
    # Drawn by hash without the texts: at most FITTED numbers, so the broadcast is bounded. Equal rows count once.
    drawn = rows.select(F.col("_r").alias("_d")).orderBy("_d").limit(FITTED).distinct()
    bits = rows.join(F.broadcast(drawn), F.col("_r") == F.col("_d")).select("_y", "_t").mapInArrow(packed, "_y string, _bits binary")
    sample = bits.distinct()
    model = sample.withColumn("_all", F.lit(1)).groupBy("_all").applyInArrow(solved, "kinds array<string>, offset array<double>, matrix binary").first()  # the only row
    if model is None:
        return [], np.zeros(0), np.zeros((BUCKETS, 0), np.float32)
    kinds = list(model["kinds"])
    return kinds, np.array(model["offset"]), np.frombuffer(model["matrix"], np.float32).reshape(BUCKETS, len(kinds))


def scored(kinds: list[str], offset: np.ndarray, matrix: np.ndarray):
    """Task code: (id, held out, text) to the predicted language and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = np.zeros((256, BUCKETS), np.float32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = batch.column(2).slice(lo, 256)
                presence[:] = 0
                told = np.array([mark(presence[i], text.as_py()) for i, text in enumerate(texts)], bool) & bool(kinds)
                n = len(told)
                names, score = np.full(n, NONE, object), np.zeros(n)
                if told.any():
                    rows = presence[:n]
                    value = rows @ matrix / np.sqrt(np.maximum(1, rows.sum(axis=1)))[:, None] + offset
                    best = value.argmax(axis=1)
                    names[told] = np.array(kinds, object)[best[told]]
                    score[told] = np.clip((value[np.arange(n), best][told] + 1) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(names.tolist(), pa.string()), pa.array(score)], ["_id", "held_out", "lang_pred", "score"])

    return run


def held_out(id_col: str) -> Column:
    """Fixed by the task: documents whose crc32 of the id as text leaves 1 are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    Fitted on rows that are not held out; a row with a NULL id is not held out and not learned from.
    A NULL text, one without letters, and every text if nothing could be learned, is ``und`` with score 0.
    Equal texts get equal predictions, whatever rows stand beside them; rows that repeat id and text are learned from once.
    Of languages with equal values the first by name counts. Texts of any length are read whole, in parts of ``PART``
    code points. Other columns are ignored.
    """
    learned = fit(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), id_col, text_col, lang_col)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held"), F.col(text_col).alias("_t"))
    out = rows.mapInArrow(scored(*learned), f"_id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("_id", id_col)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
