"""Byte strings that repeat anywhere in a corpus, found with run-length suffix indexes.

A string of ``length`` bytes (a window) is owned by the smallest of its grams of ``GRAM`` bytes, by
hash and then from the left. Equal windows have equal owners, so each owner's windows can be judged
by themselves. Neighbouring windows of one owner make a span of at most ``2 * length - GRAM`` bytes (grams are a
sixth of short lengths),
and the corpus gives one small row per span, about one per 170 bytes at a length of 400:

* an owner that occurs once holds nothing that repeats; a span that occurs twice repeats wholly.
  Neither needs text, and both are sums that combine before the shuffle.
* owners with different spans bring one copy of each to an index. The index is the
  Burrows-Wheeler transform of the spans, kept as runs with the text position and the length of the
  match at both ends of each run. Between those samples the matching statistics fall by one with
  each byte, so they are streamed in text order from the samples alone, and where they reach
  ``length`` a window occurs elsewhere.
* an owner whose distinct spans exceed ``GROUP`` bytes is too large for one index. Its windows
  are counted by their own hashes, spread over all tasks; nothing is left out.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix.llm import common, textbytes

GRAM = 64
#: Windows that are looked through at once, bytes in one index, and bytes of one owner's spans.
CHUNK, INDEX, GROUP = 1 << 19, 1 << 20, 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


def spans_of(length: int):
    """Task code: (row key, text) to one row per span: owner, content hash, row key, first and last window."""
    gram = min(GRAM, max(length // 6, 16), length)  # short strings have short grams, or each would have a span of its own
    width = length - gram + 1

    def windows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Spans of one chunk; ``ends`` is where the text of each byte ends."""
        sums = textbytes.prefix_sums(data, textbytes.BYTE)
        at = np.arange(len(data) - gram + 1)
        grams = textbytes.slice_hashes(sums, at, at + gram)
        valued = (grams & ~_PLACE) | at.astype(np.uint64)
        padded = np.full(-(-len(valued) // width) * width, ~np.uint64(0))
        padded[: len(valued)] = valued
        block = padded.reshape(-1, width)
        forward = np.minimum.accumulate(block, axis=1).ravel()
        backward = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(data) - length + 1
        owner = (np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
        inside = np.flatnonzero(np.arange(length, length + n) <= ends[:n])
        if not len(inside):
            return (inside,) * 4
        owner = owner[inside]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)) + 1
        first = inside[np.concatenate([[0], cut])]
        last = inside[np.concatenate([cut - 1, [len(inside) - 1]])]
        return grams[owner[np.concatenate([[0], cut])]], textbytes.slice_hashes(sums, first, last + length), first, last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in textbytes.pieces(batch.column(1), CHUNK):
                ends = np.repeat(offsets[1:], np.diff(offsets))
                for lo in range(0, len(data) - length + 1, CHUNK):
                    part = slice(lo, lo + CHUNK + length - 1)
                    owner, content, first, last = windows(data[part], ends[part] - lo)
                    if not len(first):
                        continue
                    text = np.searchsorted(offsets, first + lo, "right") - 1
                    shift = lo - offsets[text]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owner.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(pa.array(text + row)), pa.array(first + shift), pa.array(last + shift)],
                        ["_h", "_x", "_k", "_a", "_z"],
                    )

    return run


class RunIndex:
    """A run-length Burrows-Wheeler transform of distinct strings, sampled at both ends of its runs.

    ``symbols`` and ``run_lengths`` are the transform. ``heads`` and ``tails`` hold, in text order,
    the position of each run's first and last suffix and how far it matches the suffix before or
    after it. Strings end with separators that match nothing.
    """

    STEP = 7

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        n = int(self.starts[-1])
        text = np.zeros(n, np.int64)
        raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        text[:] = raw
        text += 1
        ends = self.starts[1:] - 1
        text[ends] = 0
        levels = self._ranks(text, np.repeat(ends, self.sizes + 1))
        order = np.empty(n, np.int64)
        order[levels[-1][1]] = np.arange(n)
        before = text[order - 1]
        before[order == 0] = 0
        change = (before[1:] != before[:-1]) | (before[1:] == 0)
        head = np.flatnonzero(np.concatenate([[True], change]))
        tail = np.append(head[1:], n) - 1
        self.symbols, self.run_lengths = before[head], tail - head + 1
        self.heads = self._sampled(text, levels, order, head, -1)
        self.tails = self._sampled(text, levels, order, tail, 1)

    def _ranks(self, text: np.ndarray, ends: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(depth, rank of each suffix by its first depth symbols), doubling until all differ."""
        n, step = len(text), self.STEP
        packed = np.zeros(n, np.int64)
        place = np.arange(n)
        for k in range(min(step, n)):
            inside = place[: n - k] + k <= ends[: n - k]
            packed[: n - k] |= np.where(inside, text[k:], 0) << (9 * (step - 1 - k))
        order = np.argsort(packed, kind="stable")
        sorted_ = packed[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) | (ends - place < step)[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        levels = [(step, rank)]
        depth = step
        while int(rank.max()) < n - 1:
            second = np.zeros(n, np.int64)
            second[: n - depth] = rank[depth:]
            key = (rank << 32) | second
            order = np.argsort(key)
            sorted_ = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) - 1
            depth *= 2
            levels.append((depth, rank))
        return levels

    @staticmethod
    def _sampled(text, levels, order, rows, side) -> tuple[np.ndarray, np.ndarray]:
        """Positions in text order, and the length of the match with the neighbour on that side."""
        n = len(order)
        place, other = order[rows], order[np.clip(rows + side, 0, n - 1)]
        far = np.zeros(len(rows), np.int64)
        there = (rows + side >= 0) & (rows + side < n)
        for depth, rank in reversed(levels):
            a, b = place + far, other + far
            same = there & (a < n) & (b < n)
            same &= rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
            far += depth * same
        for _ in range(levels[0][0]):
            a, b = np.minimum(place + far, n - 1), np.minimum(other + far, n - 1)
            there = there & (text[a] == text[b]) & (text[a] > 0)
            far += there
        by = np.argsort(place)
        return place[by], far[by]

    def repeated(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, first, last) runs of starts at which ``length`` bytes occur elsewhere too."""
        n = int(self.starts[-1])
        found = []
        for place, far in (self.heads, self.tails):
            until = np.minimum(np.append(place[1:], n) - 1, place + far - length)
            long = until >= place
            found.append((place[long], until[long]))
        first, last = (np.concatenate(x) for x in zip(*found))
        string = np.searchsorted(self.starts, first, "right") - 1
        return string, first - self.starts[string], last - self.starts[string]


def indexed(length: int):
    """Task code: rows sorted by owner (owner, content, copies, row key, first window, bytes) to repeated byte ranges."""

    def judged(rows: dict[tuple[int, int], tuple]) -> pa.RecordBatch:
        kept = list(rows.values())
        string, first, last = RunIndex([r[3] for r in kept]).repeated(length)
        lone = [i for i, s in enumerate(string.tolist()) if kept[s][0] == 1]  # the others repeat wholly
        key = [kept[string[i]][1] for i in lone]
        start = np.array([kept[string[i]][2] for i in lone], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(start + first[lone]), pa.array(start + last[lone] + length)], ["_k", "_f", "_e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], tuple] = {}
        held, owner = 0, None
        for batch in batches:
            for h, x, c, k, a, raw in zip(*(column.to_pylist() for column in batch.columns)):
                if h != owner and held >= INDEX:
                    yield judged(rows)
                    rows, held = {}, 0
                owner = h
                if (h, x) not in rows:
                    rows[h, x] = (c, k, a, raw)
                    held += len(raw)
        if rows:
            yield judged(rows)

    return run


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: (row key, text, list of spans) to one row per span with its bytes."""
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for k, text, wanted in zip(*(batch.column(i) for i in range(3))):
            raw = text.as_py().encode()
            for w in wanted.as_py():
                part = raw[w["_a"] : w["_a"] + w["_w"]]
                out.append((w["_h"], w["_x"], w["_c"], k.as_py(), w["_a"], part, w["_hot"]))
                held += len(part)
            if held >= 4 * INDEX:
                yield _rows(out)
                out, held = [], 0
        if out:
            yield _rows(out)


CUT = "_h long, _x long, _c long, _k binary, _a long, _b binary, _hot boolean"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in CUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), _KINDS)], names)


def window_hashes(length: int):
    """Task code: (row key, first window, bytes) to the hash and place of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, a, raw in zip(*(column.to_pylist() for column in batch.columns)):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - length + 1)
                hashed = textbytes.slice_hashes(textbytes.prefix_sums(data, textbytes.BYTE), at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array([k] * len(at), pa.binary()), pa.array(at + a)], ["_w", "_k", "_f"])

    return run


def kept_bytes(text: int, ranges: int, carried: list[int], names: list[str], with_text: bool):
    """Task code: the text without its ranges, and what is known of it, beside the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for value, found in zip(batch.column(text), batch.column(ranges)):
                raw = (value.as_py() or "").encode()
                removed = spans = at = 0
                parts = []
                if found.is_valid:
                    firsts = np.array(found.values.field(0))
                    lasts = np.array(found.values.field(1))
                    by = np.argsort(firsts, kind="stable")
                    firsts, lasts = firsts[by], np.maximum.accumulate(lasts[by])
                    opens = np.concatenate([[True], firsts[1:] > lasts[:-1]])
                    closes = lasts[np.append(np.flatnonzero(opens)[1:] - 1, len(lasts) - 1)]
                    for first, last in zip(firsts[opens].tolist(), closes.tolist()):
                        parts.append(raw[at:first])
                        removed, spans, at = removed + last - first, spans + 1, last
                parts.append(raw[at:])
                rest = b"".join(parts)
                shown = (rest.decode(errors="ignore") if value.is_valid else None) if with_text else None
                made.append((len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), shown))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            new = [pa.array(x, kind) for x, kind in zip(zip(*made), kinds)] if made else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in carried), *new], names)

    return run


def repeated_ranges(source: DataFrame, length: int) -> DataFrame:
    """(row key, array of byte ranges) of the rows of ``source`` (_k, _t) that hold a repeated window."""
    spans = source.select("_k", "_t").mapInArrow(spans_of(length), "_h long, _x long, _k binary, _a long, _z long")
    distinct = spans.groupBy("_h", "_x").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("_k", "_a", "_z")).alias("_r"))
    distinct = distinct.select("_h", "_x", "_c", "_r._k", "_r._a", (F.col("_r._z") - F.col("_r._a") + length).alias("_w"))
    owners = distinct.groupBy("_h").agg(
        F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("_c").alias("_least"), F.sum("_w").alias("_bytes")
    )
    shared = owners.where("_n > 1").select("_h", ((F.col("_d") > 1) & (F.col("_least") == 1)).alias("_differ"), (F.col("_bytes") > GROUP).alias("_hot"))
    shared = common.stored(distinct.join(shared, "_h"))
    whole = spans.join(shared.where("_c > 1").select("_h", "_x"), ["_h", "_x"])
    whole = whole.select("_k", F.col("_a").alias("_f"), (F.col("_z") + length).alias("_e"))
    wanted = shared.where("_differ").groupBy("_k").agg(F.collect_list(F.struct("_h", "_x", "_c", "_a", "_w", "_hot")).alias("_l"))
    bytes_ = common.stored(source.join(wanted, "_k").select("_k", "_t", "_l").mapInArrow(cut_out, CUT))
    plain = bytes_.where("not _hot").select("_h", "_x", "_c", "_k", "_a", "_b").repartition("_h").sortWithinPartitions("_h")
    plain = plain.mapInArrow(indexed(length), "_k binary, _f long, _e long")
    hot = bytes_.where("_hot").dropDuplicates(["_h", "_x"]).select("_k", "_a", "_b").mapInArrow(window_hashes(length), "_w long, _k binary, _f long")
    often = hot.groupBy("_w").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_w")
    hot = hot.join(often, "_w").select("_k", "_f", (F.col("_f") + length).alias("_e"))
    return whole.union(plain).union(hot).groupBy("_k").agg(F.collect_list(F.struct("_f", "_e")).alias("_l"))


def remove_repeats(
    docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Every byte covered by ``length`` bytes that also start elsewhere, in the same text or another, goes;
    texts are judged as given, as UTF-8. NULL and texts under ``length`` bytes lose nothing. Rows that
    repeat wholly are copies of each other. kept_text is filled if ``with_text``; a character of which
    only some bytes go is left out whole. Other columns of ``docs`` are ignored.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).withColumn("_k", common.row_key("_id", "_t"))
    found = source.join(repeated_ranges(source, length), "_k", "left").select("_id", "_t", "_l")
    kind = dict(docs.dtypes)[id_col]
    made = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    names = ["_id", *(c.split()[0] for c in made.split(", "))]
    return found.mapInArrow(kept_bytes(1, 2, [0], names, with_text), f"_id {kind}, {made}").withColumnRenamed("_id", id_col)


def without_repeats(docs: DataFrame, length: int, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, the texts without what repeats; see ``remove_repeats``."""
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    source = docs.toDF(*inner)
    at = docs.columns.index(text_col)
    source = source.withColumn("_k", common.row_key(*inner)).withColumn("_t", F.col(inner[at]))
    found = source.join(repeated_ranges(source, length), "_k", "left").select(*inner, "_l")
    made = "_n1 long, _n2 long, _n3 long, _n4 string, _text string"
    schema = ", ".join(f"{c} {kind}" for c, (_, kind) in zip(inner, docs.dtypes)) + ", " + made
    names = [*inner, *(c.split()[0] for c in made.split(", "))]
    out = found.mapInArrow(kept_bytes(at, len(inner), list(range(len(inner))), names, True), schema)
    return out.select(*[F.col("_text" if i == at else c).alias(name) for i, (c, name) in enumerate(zip(inner, docs.columns))])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
