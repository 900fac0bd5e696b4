"""Texts of an Arrow batch as one byte buffer, for numpy inside tasks.

A batch is cut between rows into pieces of at most ``PIECE`` bytes (a longer text is a piece of
its own), so memory follows the longest text, not the number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

PIECE = 1 << 20
_U = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A random 64-bit number for each byte value; A-Z has that of a-z in LOWERED.
BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWERED = BYTE.copy()
LOWERED[65:91] = BYTE[97:123]
STEP = _U(0x9E3779B97F4A7C15)


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of each piece; NULL counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.fill_null("")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse, modulo 2**64, at least ``n`` of them."""
    size = PIECE + 1
    while size < n:
        size *= 2
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, STEP), np.full(size, _U(pow(int(STEP), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def prefix_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any slice is one subtraction and one product away."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return sums


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    space = gaps[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``size`` lower-cased words.

    A text with fewer words is one shingle of all of them; a text without words has none.
    """
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    hashed = slice_hashes(prefix_sums(data, LOWERED), starts, ends)
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64) * STEP) | _U(1)
    whole = np.full(max(0, len(hashed) - size + 1), size, np.uint64)
    for j in range(size if len(whole) else 0):
        whole += hashed[j : j + len(whole)] * factors[j]
    whole = mixed(whole)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(whole[lo : hi - size + 1]))
        elif hi > lo:
            n = hi - lo
            out.append(mixed(np.atleast_1d((hashed[lo:hi] * factors[:n]).sum(dtype=np.uint64) + _U(n))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
