"""License notices: phrases word by word, and notice templates by an exact set-similarity join.

Texts are cut into blocks of ``2 * c`` words that begin every ``c`` words, for each template with the smallest
power of two ``c`` that its words fit in, so a run of words as long as the template lies whole in one block. A block
is found if it holds at least ``THRESHOLD`` of the template's distinct words.

The join is exact and looks at few blocks. A first pass counts the templates' words over all texts; words are
ordered by that count, the rarest first. A template of t words that must share o of them is entered under its first t - o + 1
words only (prefix filter); a block that holds none of those has no chance and is never built. A block's own
first words must meet an entered one too, it must hold o words of the templates at all (length filter), and what can
still follow the first meeting in both orders must suffice (positional filter); only then the sets are intersected.

Templates are a parameter of at most ``MOST_WORDS`` words; they and their counts travel with the task code. Texts are
scanned where they lie, in numpy, and nothing but one row per document goes on.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix.llm import textbytes

#: Phrases and labels of the contract.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public license notices, as their authors ask for them to be given.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)
THRESHOLD = Fraction(9, 10)
MOST_WORDS = 1_000_000

IS_GAP = np.ones(256, bool)
IS_GAP[0x30:0x3A] = IS_GAP[0x41:0x5B] = IS_GAP[0x61:0x7B] = IS_GAP[0x80:] = False
_LOWER = bytes(c + 32 if 0x41 <= c < 0x5B else c for c in range(256))

SPAN = "array<struct<start:long,end:long,template:int,containment:double>>"
FOUND = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}"


def words_of(text: str) -> list[str]:
    raw = text.encode()
    starts, ends, _ = textbytes.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), IS_GAP)
    return [raw[a:b].translate(_LOWER).decode() for a, b in zip(starts.tolist(), ends.tolist())]


def block_step(n_words: int) -> int:
    """Blocks of templates of so many words begin every this many words and are twice as long."""
    step = 1
    while step < n_words:
        step *= 2
    return step


class Templates:
    """Templates and phrases over one vocabulary; ``order`` is each word's rank, the rarest first."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], threshold: Fraction) -> None:
        lists = [words_of(text) for _, text in templates]
        heads = [words_of(text) for text, _ in phrases]
        if sum(map(len, lists + heads)) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words do not travel with the task code")
        if not all(lists + heads):
            raise ValueError("a template or phrase without words")
        self.vocabulary = sorted({w for words in lists + heads for w in words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({number[w] for w in words}) for words in lists]
        self.least = [math.ceil(threshold * len(s)) for s in self.sets]
        self.steps = [block_step(len(words)) for words in lists]
        self.phrases = [([number[w] for w in head], label) for head, (_, label) in zip(heads, phrases)]
        raw = [w.encode() for w in self.vocabulary]
        data = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
        ends = np.cumsum([len(w) for w in raw])
        hashes = textbytes.slice_hashes(textbytes.prefix_sums(data, textbytes.LOWERED), np.r_[0, ends[:-1]], ends) if raw else np.zeros(0, np.uint64)
        by_hash = np.argsort(hashes)
        self.hashes, self.number_of_hash = hashes[by_hash], by_hash
        self.ordered(np.zeros(len(raw), np.int64))

    def ordered(self, counts: np.ndarray) -> None:
        """Ranks words by their counts and enters each template under its prefix."""
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.ranked = [np.sort(self.rank[s]) for s in self.sets]
        self.entries: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, ranks in enumerate(self.ranked):
            for i, r in enumerate(ranks[: len(ranks) - self.least[t] + 1].tolist()):
                self.entries[self.steps[t]][r].append((t, i))
        self.entries = {step: dict(words) for step, words in self.entries.items()}

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the words that are in the vocabulary."""
        if not len(starts) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashed = textbytes.slice_hashes(textbytes.prefix_sums(data, textbytes.LOWERED), starts, ends)
        at = np.searchsorted(self.hashes, hashed)
        at[at == len(self.hashes)] = 0
        places = np.flatnonzero(self.hashes[at] == hashed)
        return places, self.number_of_hash[at[places]]

    def candidates(self, step: int, block: np.ndarray) -> list[int]:
        """Templates that pass all filters for a block with these sorted ranks."""
        out = []
        met: set[int] = set()
        for j, r in enumerate(block.tolist()):
            for t, i in self.entries[step].get(r, ()):
                if t in met:
                    continue
                least = self.least[t]
                if len(block) < least or j > len(block) - least:
                    continue  # too few words, or beyond the block's own prefix
                met.add(t)
                if 1 + min(len(self.ranked[t]) - i - 1, len(block) - j - 1) >= least:
                    out.append(t)
        return out


def counted(templates: Templates):
    """Task code: how often each word of the vocabulary occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(templates.vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offsets in textbytes.pieces(batch.column(0)):
                starts, ends, _ = textbytes.words(data, offsets, IS_GAP)
                counts += np.bincount(templates.hits(data, starts, ends)[1], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], ["word", "n"])

    return run


def _blocks(places: np.ndarray, step: int, size: int) -> set[int]:
    """The blocks of a text of ``size`` words that hold a place."""
    last = max(0, -(-(size - step) // step) - 1)
    found = np.minimum(np.concatenate([places // step, places // step - 1]), last)
    return set(found[found >= 0].tolist())


def searched(templates: Templates, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """The columns of ``FOUND`` for each text of a piece."""
    starts, ends, first = textbytes.words(data, offsets, IS_GAP)
    places, numbers = templates.hits(data, starts, ends)
    ids = np.full(len(starts) + 1, -1, np.int64)
    ids[places] = numbers

    def is_word(at: int) -> bool:
        return data[starts[at] : ends[at]].tobytes().translate(_LOWER) == templates.vocabulary[ids[at]].encode()

    text_of = np.searchsorted(first, places, "right") - 1
    base: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for head, label in templates.phrases:
        at = places[numbers == head[0]]
        texts = text_of[numbers == head[0]]
        fits = at + len(head) <= first[texts + 1]
        for k, word in enumerate(head):
            fits[fits] = ids[at[fits] + k] == word
        for p, t in zip(at[fits].tolist(), texts[fits].tolist()):
            if all(is_word(p + k) for k in range(len(head))):
                base[t].append((p - int(first[t]), label))
    spans: dict[int, list[tuple[int, int, int, float]]] = defaultdict(list)
    ranks = templates.rank[numbers] if len(numbers) else numbers
    for step, words in templates.entries.items():
        signal = np.isin(ranks, np.fromiter(words, np.int64))
        for t in np.unique(text_of[signal]).tolist():
            low, size = int(first[t]), int(first[t + 1] - first[t])
            for block in sorted(_blocks(places[signal & (text_of == t)] - low, step, size)):
                begin, end = block * step, min((block + 2) * step, size)
                lo, hi = np.searchsorted(places, [low + begin, low + end])
                held = np.unique(ranks[lo:hi])
                fitting = templates.candidates(step, held)
                if fitting:  # rare: words by their letters now, not by their hashes
                    held = np.unique([ranks[k] for k in range(lo, hi) if is_word(int(places[k]))])
                for found in fitting:
                    shared = len(np.intersect1d(held, templates.ranked[found], assume_unique=True))
                    if shared >= templates.least[found]:
                        spans[t].append((begin, end, found, shared / len(templates.ranked[found])))
    rows = []
    for t in range(len(offsets) - 1):
        at = [p for p, _ in base[t]]
        plain = sorted({label for _, label in base[t]})
        labels = sorted({*plain, *(templates.labels[s[2]] for s in spans[t])})
        score = 1.0 if at else max((s[3] for s in spans[t]), default=0.0)
        rows.append((int(first[t + 1] - first[t]), len(at), min(at, default=None), max(at, default=None), ",".join(plain), ",".join(labels), score, sorted(spans[t])))
    return rows


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("template", pa.int32()), ("containment", pa.float64())]))


def scanned(templates: Templates, id_col: str):
    """Task code: (id, text) to (id, what was found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, *(c.split()[0] for c in FOUND.split(", ")[:7]), "spans"]
        for batch in batches:
            for lo, hi, data, offsets in textbytes.pieces(batch.column(1)):
                *plain, spans = zip(*searched(templates, data, offsets))
                spans = [[dict(zip(("start", "end", "template", "containment"), s)) for s in row] for row in spans]
                arrays = [batch.column(0).slice(lo, hi - lo), *(pa.array(x, k) for x, k in zip(plain, _KINDS)), pa.array(spans, _SPAN)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def license_scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its id and the columns of ``FOUND``.

    ``base_labels`` are those of phrases that stand in the text, ``labels`` those and the labels of templates that a block
    meets; ``spans`` has each such block in words of the text. ``score`` is the largest containment, 1 where a phrase
    stands, 0 without any. A NULL text is an empty one: no words, no labels, NULL places. Repeated rows are
    scanned each by itself; a NULL id stays; other columns are ignored; an empty table gives no rows. Texts are scanned
    whole, and one of any length takes memory in proportion to its own length.
    """
    index = Templates(templates, phrases, threshold)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = rows.select("_text").mapInArrow(counted(index), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.collect()  # a row per word of the templates at most
    total = np.zeros(len(index.vocabulary), np.int64)
    for r in found:
        total[r.word] = r.n
    index.ordered(total)
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(scanned(index, id_col), f"`{id_col}` {kind}, {FOUND}")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
