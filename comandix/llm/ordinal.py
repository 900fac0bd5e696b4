"""Text quality by ordinal regression on graded ratings.

One vector of weights over hashed features gives a text a score; ordered thresholds cut the score
into grades: P(grade >= j) = sigmoid(score - threshold j). From these come the expected grade and the
probability of the top grade, by which texts are selected.

Features are whether a text holds a word, a word's last two characters or its shape, hashed to ``BUCKETS``,
and in which range a few shares lie (upper case, symbols, repeated words, length).
Fitted on a bounded sample, the ``FITTED`` rated ids with the smallest hash, in one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix.llm import textbytes

BUCKETS, FITTED = 1 << 17, 20_000
ROUNDS, RATE, DECAY = 60, 0.5, 2e-4
#: Texts a feature must be in, and standard deviations by which it must lean to high or low grades, to have a weight.
LEAST_TEXTS, LEAST_LEAN = 8, 4.0
#: A text is kept if the top grade is at least this probable.
TAIL = 0.5
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97


def _bucket(hashed: np.ndarray, kind: int) -> np.ndarray:
    return (textbytes.mixed(hashed + np.uint64(kind)) >> np.uint64(64 - 17)).astype(np.int64)


def _range(value: np.ndarray, kind: int) -> np.ndarray:
    """One bucket per feature kind and tenth of a share."""
    tenth = np.clip((value * 10).astype(np.int64), 0, 10).astype(np.uint64)
    return _bucket(textbytes.mixed(tenth + np.uint64(1000)), 100 + kind)


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct buckets of each text; none without words."""
    starts, ends, first = textbytes.words(data, offsets)
    if not len(starts):
        return [np.zeros(0, np.int64)] * (len(offsets) - 1)
    lowered = textbytes.slice_hashes(textbytes.prefix_sums(data, textbytes.LOWERED), starts, ends)
    tail = textbytes.slice_hashes(textbytes.prefix_sums(data, textbytes.BYTE), np.maximum(starts, ends - 2), ends)
    shape = textbytes.slice_hashes(textbytes.prefix_sums(_CLASS[data], textbytes.BYTE), np.maximum(starts, ends - 4), ends)
    buckets = np.stack([_bucket(lowered, 1), _bucket(tail, 2), _bucket(shape, 3)])
    again = np.zeros(len(starts), bool)
    again[1:] = lowered[1:] == lowered[:-1]
    again[first[:-1][np.diff(first) > 0]] = False  # a text's first word follows nothing
    counts = np.maximum(1, np.diff(first))
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    other = np.concatenate([[0], np.cumsum(~textbytes.IS_SPACE[data] & (_CLASS[data] != 65) & (_CLASS[data] != 97) & (data != 46) & (data != 44))])
    repeats = np.concatenate([[0], np.cumsum(again)])
    size = np.maximum(1, np.diff(offsets))
    shares = [
        np.diff(upper[offsets]) / size,
        np.diff(other[offsets]) / size,
        np.diff(repeats[first]) / counts,
        np.log2(counts) / 20,
    ]
    ranges = np.stack([_range(share, kind) for kind, share in enumerate(shares)])
    out = []
    for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        out.append(np.unique(np.concatenate([buckets[:, lo:hi].ravel(), ranges[:, i]])) if hi > lo else np.zeros(0, np.int64))
    return out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: (what is known of a text, text) to the same and its buckets."""
    for batch in batches:
        for lo, hi, data, offsets in textbytes.pieces(batch.column(1)):
            lists = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([f.astype(np.int32) for f in lists], pa.list_(pa.int32()))], ["_y", "_f"])


def solved(key: tuple, table: pa.Table) -> pa.Table:
    """Code of one task over the sample: weights and thresholds by gradient steps of adaptive size."""
    lists = table.column("_f").combine_chunks()
    grade = table.column("_y").to_numpy()
    flat = lists.flatten().to_numpy().astype(np.int64)
    size = np.array([len(x) for x in lists])
    filled = size > 0
    grade, ends = grade[filled].astype(np.int64), np.cumsum(size[filled])
    begin = ends - size[filled]
    row = np.repeat(np.arange(len(grade)), size[filled])
    top = int(grade.max()) if len(grade) else 0
    if top == 0:
        return pa.table({"thresholds": pa.array([[]], pa.list_(pa.float64())), "weights": pa.array([b""], pa.binary())})
    share = np.array([(grade >= j).mean() for j in range(1, top + 1)])
    above = grade[:, None] >= np.arange(1, top + 1)[None, :]
    # Only features that occur often enough and lean to a side more than chance does take part; they
    # move at a like rate if steps are scaled by the root of their counts.
    count = np.bincount(flat, minlength=BUCKETS)
    lean = np.zeros(BUCKETS)
    for j, p in enumerate(share):
        seen = np.bincount(flat, above[row, j], BUCKETS)
        lean = np.maximum(lean, np.abs(seen - count * p) / np.sqrt(np.maximum(count * p * (1 - p), 1e-9)))
    scale = ((count >= LEAST_TEXTS) & (lean >= LEAST_LEAN)) / np.sqrt(1 + count)
    weights, steps = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    thresholds = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    balance = np.where(above, 0.5 / np.clip(share, 1e-3, 1), 0.5 / np.clip(1 - share, 1e-3, 1))
    for _ in range(ROUNDS):
        score = np.add.reduceat(weights[flat], begin)
        error = balance * (1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -30, 30))) - above)
        slope = np.bincount(flat, error.sum(axis=1)[row], BUCKETS) * scale / len(grade) * 100 + DECAY * weights
        steps += slope**2
        weights -= RATE * scale * slope / np.sqrt(steps)
        thresholds = np.maximum.accumulate(thresholds + RATE * error.mean(axis=0))
    return pa.table({"thresholds": pa.array([thresholds.tolist()], pa.list_(pa.float64())), "weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary())})


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from texts whose id has a grade from 0 on; of several grades the lowest."""
    known = ratings.select(F.col(ratings.columns[0]).alias("_rid"), F.col(ratings.columns[1]).cast("int").alias("_y"))
    known = known.where("_rid IS NOT NULL AND _y IS NOT NULL").groupBy("_rid").agg(F.min("_y").alias("_y"))
    # Drawn by id before any text is read: at most FITTED rows of an id and a grade, so the broadcast is bounded.
    known = known.orderBy(F.xxhash64("_rid"), "_rid").limit(FITTED)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t IS NOT NULL").join(F.broadcast(known), F.col("_id") == F.col("_rid"))
    lists = rows.select(F.struct("_y", "_id", F.xxhash64("_t").alias("_x")).alias("_y"), "_t").mapInArrow(gathered, f"_y struct<_y: int, _id: {dict(docs.dtypes)[id_col]}, _x: bigint>, _f array<int>")
    # An id of several rows counts once.
    once = lists.groupBy("_y._id").agg(F.min(F.struct(F.col("_y._x").alias("_x"), F.col("_y._y").alias("_y"), "_f")).alias("_r"))
    sample = once.select("_r._y", "_r._f")
    model = sample.withColumn("_all", F.lit(1)).groupBy("_all").applyInArrow(solved, "thresholds array<double>, weights binary").first()  # the only row
    if model is None or not model["thresholds"]:
        return np.zeros(BUCKETS, np.float32), np.zeros(0)
    return np.frombuffer(model["weights"], np.float32), np.array(model["thresholds"])


def scored(weights: np.ndarray, thresholds: np.ndarray):
    """Task code: (id, text) to the expected grade, the tail probability and the choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textbytes.pieces(batch.column(1)):
                lists = features(data, offsets)
                score = np.array([float(weights[f].sum(dtype=np.float64)) for f in lists])
                words = np.array([len(f) > 0 for f in lists]) & (len(thresholds) > 0)
                tails = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -30, 30)))
                expected = np.where(words, tails.sum(axis=1), 0.0)
                tail = np.where(words, tails[:, -1] if len(thresholds) else 0.0, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(expected), pa.array(tail), pa.array(tail >= TAIL)],
                    ["_id", "expected_grade", "p_top", "kept"],
                )

    return run


def graded(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, expected_grade, p_top, kept.

    ``ratings`` has (id, grade), grades from 0 on. A text without words, a NULL one, and every text if
    fewer than two grades are rated, is graded 0 and not kept. Repeated rows get equal grades, whatever rows stand
    beside them; an id of several rows is fitted once, with the text of the smallest hash, and one of several grades with the
    lowest. A tail probability of exactly ``TAIL`` is kept. Texts of any length are read whole, and each feature
    counts once. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    learned = fit(rows, ratings, "_id", "_t")
    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(scored(*learned), f"_id {kind}, expected_grade double, p_top double, kept boolean").withColumnRenamed("_id", id_col)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
