"""SentencePiece ids of whole texts, and texts of ids, for byte-pair models with byte fallback.

The parts of a batch that its pieces can't cross, cut where a space mark follows another character,
are collected once each and concatenated. A suffix array of that text takes a binary search for every
piece at once; the ranges it gives are all places where a piece occurs. These edges, sorted by where
they end, are relaxed: the ids of a prefix end in one piece only, the one that is compatible with the
last piece of what stands before it. Two pieces are compatible if merging their joined characters by
score gives the two again; that is looked up once per pair.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame

SPACE = "▁"
#: Parts whose ids a process remembers, pairs of pieces it does within a task, characters that one suffix array takes, and
#: characters of texts worked on at once. A remembered part or pair is about 200 bytes, so a process holds some 80 MB.
REMEMBERED, PAIRS, ARRAY, BATCH = 150_000, 250_000, 1 << 18, 1 << 21
#: Characters up to which parts are relaxed side by side, and what tells the places of a pair's pieces apart.
SHORT, BITS, SLOTS = 64, 21, 21
_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Model:
    """A vocabulary with scores, and the compatibility of its pieces."""

    def __init__(self, raw: bytes):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=raw)
        ids = range(reader.get_piece_size())
        self.pieces = [reader.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: reader.get_score(i) for i in plain}
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in ids if reader.is_byte(i)}
        self.unknown = reader.unk_id()
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in ids:
            if reader.is_byte(i):
                self.raw[i] = bytes([int(self.pieces[i][1:-1], 16)])
            elif reader.is_control(i):
                self.raw[i] = b""
        self.raw[self.unknown] = " ⁇ ".encode()
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("this model has pieces that go on after a space mark")
        self.sorted = sorted(p for p in self.id_of)
        self.longest = max(map(len, self.sorted), default=1)
        self.sizes = np.array([len(p) for p in self.sorted], np.int64)
        self.letters = np.zeros((self.longest, len(self.sorted)), np.int64)
        for i, p in enumerate(self.sorted):
            self.letters[: len(p), i] = [ord(c) for c in p]
        # Places of pieces in their order; a character that is no piece has the place of its code after them.
        self.place = {p: i for i, p in enumerate(self.sorted)}
        self.letter_place = np.arange(0x110000, dtype=np.int64) + len(self.sorted)
        for p, i in self.place.items():
            if len(p) == 1:
                self.letter_place[ord(p)] = i
        self.id_at = np.array([self.id_of[p] for p in self.sorted], np.int64)
        # Pairs by a hash of their key, the newest in its slot; all pairs are in the dictionary.
        self.pair_keys, self.pair_fits = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, bool)
        self.pairs: dict[tuple[str, str], bool] = {}
        # Parts of late, and those of the time before, from which parts that are used again come back.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short string: the best score first, from the left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            found = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def ids(self, piece: str) -> list[int]:
        found = self.id_of.get(piece)
        if found is not None:
            return [found]
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[b] for b in piece.encode()]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, place of the piece) of every occurrence of a piece of two characters or more, by end, the longest first."""
        order, n = suffix_order(codes, self.longest), len(codes)
        low, high = np.zeros(len(self.sorted), np.int64), np.full(len(self.sorted), n, np.int64)
        padded = np.concatenate([codes, np.full(self.longest, -1)])
        for k in range(self.longest):
            live = np.flatnonzero((self.sizes > k) & (low < high))
            wanted = self.letters[k, live]
            low[live], high[live] = (self._bound(order, padded, k, wanted, low[live], high[live], after) for after in (False, True))
        count = np.where(self.sizes > 1, high - low, 0)
        found = np.flatnonzero(count)
        at = np.arange(int(count.sum())) + np.repeat(low[found] - np.cumsum(count[found]) + count[found], count[found])
        start, piece = order[at], np.repeat(found, count[found])
        end = start + self.sizes[piece]
        by = np.argsort((end << 32) | start)
        return end[by], start[by], piece[by]

    def text_at(self, place: int) -> str:
        return self.sorted[place] if place < len(self.sorted) else chr(place - len(self.sorted))

    def fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs of places at once; -1 on the left is the start of a part."""
        keys = ((left + 1) << BITS) | right
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
        fits, known = self.pair_fits[slots], self.pair_keys[slots] == keys
        if not known.all():
            new, back = np.unique(keys[~known], return_inverse=True)
            told = np.array([self.compatible(self.text_at((k >> BITS) - 1) if k >> BITS else "", self.text_at(k & ((1 << BITS) - 1))) for k in new.tolist()], bool)
            fits[~known] = told[back]
            self.pair_keys[slots[~known]], self.pair_fits[slots[~known]] = keys[~known], told[back]
        return fits

    @staticmethod
    def _bound(order, padded, k, wanted, low, high, after):
        """Where the k-th character of the sorted suffixes reaches the wanted one, or passes it; all pieces at once."""
        low, high = low.copy(), high.copy()
        while True:
            live = low < high
            if not live.any():
                return low
            middle = (low + high) // 2
            seen = padded[order[np.minimum(middle, len(order) - 1)] + k]
            right = live & ((seen <= wanted) if after else (seen < wanted))
            low = np.where(right, middle + 1, low)
            high = np.where(live & ~right, middle, high)

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of distinct parts as 4 bytes each, from the edges of their concatenation."""
        text = "\n".join(parts) + "\n"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(p) for p in parts], np.int64)
        base = np.cumsum(sizes + 1) - sizes - 1
        ends, starts, places = self.edges(codes)
        part = np.searchsorted(base, ends, "left") - 1  # an edge ends after its part's base
        inside = starts >= base[part]
        ends, starts, places, part = ends[inside], starts[inside], places[inside], part[inside]
        # What the ids of each prefix end in: the place of the last piece and where it starts.
        last, came = np.full(len(codes) + 1, -1), np.arange(-1, len(codes))
        last[1:] = self.letter_place[codes]
        last[base] = -1
        self._relax_short(ends, starts, places, part, base, sizes, last, came)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            lo, hi = np.searchsorted(ends, [base[i] + 1, base[i] + sizes[i] + 1])
            self._relax_long(ends[lo:hi].tolist(), starts[lo:hi].tolist(), places[lo:hi].tolist(), last, came)
        return self._walked(parts, base, sizes, last, came)

    def _relax_short(self, ends, starts, places, part, base, sizes, last, came) -> None:
        """All parts up to ``SHORT`` side by side, one end after the other."""
        short = np.flatnonzero(sizes[part] <= SHORT)
        reach = ends[short] - base[part[short]]
        short = short[np.argsort((reach << 40) | (starts[short] - base[part[short]]) << 32 | np.arange(len(short)))][::-1]
        reach = (ends - base[part])[short]
        for end in range(2, SHORT + 1):
            own = short[len(reach) - np.searchsorted(reach[::-1], end, "right") : len(reach) - np.searchsorted(reach[::-1], end, "left")]
            if len(own):
                fits = own[self.fitting(last[starts[own]], places[own])]
                # Sorted with the shortest first, so the longest of an end is written last.
                last[ends[fits]], came[ends[fits]] = places[fits], starts[fits]

    def _relax_long(self, ends, starts, places, last, came) -> None:
        """One part, edge by edge."""
        done = -1
        for end, start, place in zip(ends, starts, places):
            if end != done:
                left = int(last[start])
                if self.compatible(self.text_at(left) if left >= 0 else "", self.sorted[place]):
                    last[end], came[end], done = place, start, end

    def _walked(self, parts, base, sizes, last, came) -> dict[str, bytes]:
        """The ids of each part, back from its end."""
        owner, at = np.flatnonzero(sizes), (base + sizes)[sizes > 0]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        owners = []
        while len(at):
            found.append((at, last[at]))
            owners.append(owner)
            at = came[at]
            live = at > base[owner]
            owner, at = owner[live], at[live]
        if not found:
            return {p: b"" for p in parts}
        at, place = (np.concatenate(x) for x in zip(*found))
        owner = np.concatenate(owners)
        by = np.argsort(at)
        place, count = place[by], np.bincount(owner, minlength=len(parts))
        stop = np.cumsum(count)
        strange = np.zeros(len(parts), bool)
        strange[owner[by][place >= len(self.sorted)]] = True
        ids = self.id_at[np.minimum(place, len(self.sorted) - 1)].astype("<i4").tobytes()
        out = {p: ids[lo:hi] for p, lo, hi in zip(parts, (4 * (stop - count)).tolist(), (4 * stop).tolist())}
        for i in np.flatnonzero(strange).tolist():
            out[parts[i]] = np.array([x for k in place[stop[i] - count[i] : stop[i]].tolist() for x in self.ids(self.text_at(k))], "<i4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [_PART.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set(chain.from_iterable(parts))
        if len(self.known) + len(new) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        new -= self.known.keys()
        back = {p: self.older[p] for p in new & self.older.keys()}
        self.known.update(back)
        new -= back.keys()
        group, held = [], 0
        for part in new:
            group.append(part)
            held += len(part) + 1
            if held >= ARRAY:
                self.known.update(self.learn(group))
                group, held = [], 0
        if group:
            self.known.update(self.learn(group))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), "<i4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode(errors="replace").removeprefix(" ")


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` characters that follow, or more."""
    n = len(codes)
    key = codes << 42
    key[: max(0, n - 1)] |= codes[1:] << 21
    key[: max(0, n - 2)] |= codes[2:]
    step = 3
    order = np.argsort(key)
    while step < depth:
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        key = rank << 32
        key[: max(0, n - step)] |= rank[step:]
        order = np.argsort(key)
        step *= 2
    return order


def _own(name: str) -> Model:
    """The model of this Python process, with what earlier tasks of the process have looked up."""
    with open(SparkFiles.get(name), "rb") as file:
        raw = file.read()
    held = sys.modules.setdefault("_comandix_pieces", types.ModuleType("_comandix_pieces")).__dict__
    if held.get("raw") != raw:
        held.update(raw=raw, model=Model(raw))
    return held["model"]


OUTPUTS = {
    "piece_ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "n_pieces": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
    "round_trip": ("boolean", pa.bool_()),
}


def encoded(name: str, outputs: tuple[str, ...]):
    """Task code: (id, text) to the id and the named outputs."""

    def outcome(text: str | None, ids: np.ndarray, back: str) -> dict:
        if text is None:
            return {}
        made = {"piece_ids": ids, "decoded": back, "n_pieces": len(ids), "round_trip": text == back}
        made["ids_sha256"] = hashlib.sha256(ids.tobytes()).hexdigest()
        made["decoded_sha256"] = hashlib.sha256(back.encode()).hexdigest()
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _own(name)
        try:
            yield from work(model, batches)
        finally:
            model.pairs.clear()

    def work(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                hi, held = lo, 0
                while hi < batch.num_rows and held < BATCH:
                    held += len(batch.column(1)[hi].as_py() or "") + 1
                    hi += 1
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                ids = model.encode([t or "" for t in texts])
                made = [outcome(t, i, model.decode(i)) for t, i in zip(texts, ids)]
                columns = [pa.array([m.get(c) for m in made], OUTPUTS[c][1]) for c in outputs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["_id", *outputs])
                lo = hi

    return run


def encode_decode(
    docs: DataFrame, model_file: str, outputs: tuple[str, ...] = tuple(OUTPUTS), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id and the outputs that are asked for.

    ``model_file`` is a path that the driver reads; the file travels to the tasks as a Spark file.
    A NULL text gives NULL throughout and an empty one has no pieces. A text that holds the space mark
    U+2581 itself comes back with spaces in its place, and round_trip says so. Other columns are ignored.
    """
    docs.sparkSession.sparkContext.addFile(model_file)
    kind = dict(docs.dtypes)[id_col]
    schema = ", ".join([f"_id {kind}", *(f"{c} {OUTPUTS[c][0]}" for c in outputs)])
    made = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_t")).mapInArrow(encoded(model_file.rsplit("/", 1)[-1], outputs), schema)
    return made.withColumnRenamed("_id", id_col)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
