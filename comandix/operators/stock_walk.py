"""Walking sorted stock movements inside a task, batch by batch.

These functions travel to the executors by value, so the package need not be installed there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

KEY, CENTS, OPENING, SLICE = "_key", "_cents", "_opening", "_slice"


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Quantities, and the (key, slice, from, to) of every run of one key and slice in the batch."""
    names = batch.schema.names
    keys = batch.column(names.index(KEY)).to_numpy(zero_copy_only=False)
    cents = batch.column(names.index(CENTS)).to_numpy(zero_copy_only=False)
    opening = batch.column(names.index(OPENING)).to_numpy(zero_copy_only=False)
    if SLICE in names:
        cut = batch.column(names.index(SLICE)).to_numpy(zero_copy_only=False)
    else:
        cut = np.zeros(len(keys), dtype=np.int32)
    change = np.flatnonzero((keys[1:] != keys[:-1]) | (cut[1:] != cut[:-1])) + 1
    firsts = np.concatenate([[0], change])
    lasts = np.concatenate([change, [len(keys)]])
    runs = list(zip(keys[firsts].tolist(), cut[firsts].tolist(), firsts.tolist(), lasts.tolist(), strict=True))
    return cents, opening, firsts, runs


def _walk(cents: np.ndarray, balance: int, accepted: np.ndarray | None) -> int:
    """Walk one run from ``balance``; note refusals in ``accepted`` and return the end balance."""
    course = balance + np.cumsum(cents)
    if not np.any((cents < 0) & (course < 0)):
        return int(course[-1])
    for place, amount in enumerate(cents.tolist()):
        if amount < 0 and balance + amount < 0:
            if accepted is not None:
                accepted[place] = False
        else:
            balance += amount
    return balance


def walker(starts: dict[tuple[int, int], int]):
    """Batches in, the same batches with ``accepted`` out.

    A whole batch is summed at once; only runs in which an issue would go below zero are walked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run, balance = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cents, opening, firsts, runs = _runs(batch)
            begin = opening[firsts].copy()
            if starts:
                begin[:] = [starts.get(r[:2], int(o)) for r, o in zip(runs, begin, strict=True)]
            if runs[0][:2] == open_run:
                begin[0] = balance
            sums = np.cumsum(cents)
            lengths = np.diff(np.append(firsts, len(cents)))
            course = sums + np.repeat(begin - sums[firsts] + cents[firsts], lengths)
            short = np.logical_or.reduceat((cents < 0) & (course < 0), firsts)
            accepted = np.ones(len(cents), dtype=bool)
            open_run, balance = runs[-1][:2], int(course[-1])
            for place in np.flatnonzero(short).tolist():
                low, high = runs[place][2:]
                ending = _walk(cents[low:high], int(begin[place]), accepted[low:high])
                if place == len(runs) - 1:
                    balance = ending
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(accepted)], names=[*batch.schema.names, "accepted"]
            )

    return run


def end_walker(starts: dict[tuple[int, int], int]):
    """Batches in, one row per run named in ``starts`` with its end balance out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[int, int], int] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cents, _, _, runs = _runs(batch)
            for key, cut, low, high in runs:
                if (key, cut) in starts:
                    balance = ends.get((key, cut), starts[(key, cut)])
                    ends[(key, cut)] = _walk(cents[low:high], balance, None)
        yield pa.RecordBatch.from_pydict(
            {
                "key": pa.array([k for k, _ in ends], pa.int64()),
                "slice": pa.array([s for _, s in ends], pa.int32()),
                "ending": pa.array(list(ends.values()), pa.int64()),
            }
        )

    return run


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run: its sum, and the least start balance with which it refuses nothing."""
    seen: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cents, opening, _, runs = _runs(batch)
        for key, cut, low, high in runs:
            entry = seen.setdefault((key, cut), [int(opening[low]), 0, np.iinfo(np.int64).min])
            part = cents[low:high]
            course = entry[1] + np.cumsum(part)
            out = course[part < 0]
            if len(out):
                entry[2] = max(entry[2], int(-out.min()))
            entry[1] = int(course[-1])
    yield pa.RecordBatch.from_pydict(
        {
            "key": pa.array([k for k, _ in seen], pa.int64()),
            "slice": pa.array([s for _, s in seen], pa.int32()),
            "opening": pa.array([e[0] for e in seen.values()], pa.int64()),
            "total": pa.array([e[1] for e in seen.values()], pa.int64()),
            "need": pa.array([e[2] for e in seen.values()], pa.int64()),
        }
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
