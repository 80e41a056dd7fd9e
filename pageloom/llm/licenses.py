"""Licence notices in texts, by matching statistics against a suffix automaton.

The words of all templates make one generalised suffix automaton. A text is
streamed through it; at every word the automaton knows the longest run of words
ending there that stands in some template. Maximal runs are chained per template
in order, and a chain that covers enough of its template is a span with its label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.suffix import Automaton

# The phrases that always count, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Wording of well-known licence notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "apache license version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("cc0", "creative commons zero"),
)
# Lower-case letters, digits and everything beyond ASCII, in UTF-8 bytes.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The words of a text as bytes; only A to Z are lowered, as ``bytes.lower`` does."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


@dataclass
class Found:
    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)  # of phrases: first word and label
    spans: list[tuple[str, int, int, float]] = field(default_factory=list)  # label, first word, word after, coverage
    best: float = 0.0


class Scanner:
    """Automaton of the templates and what chaining needs to know about them."""

    def __init__(self, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, least: int = 3, cover: float = 0.7, slack: int = 12) -> None:
        self.least, self.cover, self.slack = least, cover, slack
        texts = [(label, words(text)) for label, text in (*templates, *((label, phrase) for phrase, label in phrases))]
        if any(len(t) < 2 for _, t in texts):
            raise ValueError("a template has two words at least")
        self.ids = {w: i for i, w in enumerate(sorted({w for _, t in texts for w in t}))}
        self.labels = [label for label, _ in texts]
        rows = [[self.ids[w] for w in t] for _, t in texts]
        self.sizes = [len(r) for r in rows]
        n = len(self.ids)
        self.automaton = Automaton(n)
        self.pairs = np.zeros(n * n, bool)
        for row in rows:
            self.automaton.add(row)
            self.pairs[[a * n + b for a, b in zip(row, row[1:], strict=False)]] = True
        a, order = self.automaton, None
        # Ends of every state's strings in the templates, shortest strings last.
        self.ends: list[set[tuple[int, int]]] = [set() for _ in a.length]
        for k, row in enumerate(rows):
            state = 0
            for i, symbol in enumerate(row, 1):
                state = a.step[state * n + symbol]
                self.ends[state].add((k, i))
        order = sorted(range(1, len(a.length)), key=a.length.__getitem__, reverse=True)
        for state in order:
            self.ends[a.link[state]] |= self.ends[state]
        # Whole templates and phrases that are suffixes of a state's strings: a run
        # of a long template may hold a short one, which it would hide.
        whole: dict[int, list[tuple[int, str, bool]]] = {}
        for k, row in enumerate(rows):
            whole.setdefault(a.walk(row), []).append((self.sizes[k], self.labels[k], k >= len(templates)))
        self.whole: list[tuple[tuple[int, str, bool], ...]] = [()] * len(a.length)
        for state in reversed(order):
            self.whole[state] = (*whole.get(state, ()), *self.whole[a.link[state]])

    def scan(self, text: str | None) -> Found:
        tokens = words(text)
        found = Found(len(tokens))
        n = len(self.ids)
        if len(tokens) < 2:
            return found
        ids = np.fromiter(map(self.ids.get, tokens, repeat(-1)), np.int64, len(tokens))
        # A run of two words or more needs adjacent words that are adjacent in a template.
        code = ids[:-1] * n + ids[1:]
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & self.pairs[np.maximum(code, 0)])
        if not len(at):
            return found
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        matches: list[tuple[int, int, int]] = []  # first word, length, state
        for a, b in zip(at[np.r_[0, cuts]].tolist(), at[np.r_[cuts - 1, len(at) - 1]].tolist(), strict=True):
            self._stream(ids[a : b + 2].tolist(), a, found, matches)
        self._chain(matches, found)
        return found

    def _stream(self, symbols: list[int], at: int, found: Found, matches: list[tuple[int, int, int]]) -> None:
        step, link, length, n, least = self.automaton.step, self.automaton.link, self.automaton.length, len(self.ids), self.least
        state = size = 0
        for i, symbol in enumerate(symbols, at):
            to = step.get(state * n + symbol)
            if to is None and size >= least:
                matches.append((i - size, size, state))
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step.get(state * n + symbol)
            if to is not None:
                state, size = to, size + 1
            for span, label, phrase in self.whole[state]:
                if span <= size and phrase:
                    found.places.append((i - span + 1, label))
                elif span <= size:
                    found.spans.append((label, i - span + 1, i + 1, 1.0))
        if size >= least:
            matches.append((at + len(symbols) - size, size, state))

    def _chain(self, matches: list[tuple[int, int, int]], found: Found) -> None:
        """Runs in order of the text, extended per template while its words go forward."""
        open_: dict[int, list[int]] = {}  # template: first word, word after, place after in template, covered

        def close(k: int) -> None:
            first, stop, _, covered = open_.pop(k)
            share = covered / self.sizes[k]
            found.best = max(found.best, share)
            if share >= self.cover:
                found.spans.append((self.labels[k], first, stop, share))

        for start, size, state in matches:
            ends: dict[int, list[int]] = {}
            for k, end in self.ends[state]:
                ends.setdefault(k, []).append(end)
            for k, places in ends.items():
                chain = open_.get(k)
                if chain and start - chain[1] > self.slack + self.sizes[k]:
                    close(k)
                    chain = None
                fits = min((e for e in places if chain and e > chain[2]), default=None)
                if chain and fits is not None:
                    chain[3] += min(size, fits - chain[2])
                    chain[1], chain[2] = start + size, fits
                else:
                    if chain:
                        close(k)
                    open_[k] = [start, start + size, min(places), size]
        for k in list(open_):
            close(k)
        found.spans = sorted(set(found.spans), key=lambda s: (s[1], s[0], s[2]))
        found.best = max([found.best, *(s[3] for s in found.spans)])


_WORKER: dict[str, Scanner] = {}

SPANS = "array<struct<label: string, start: int, stop: int, coverage: double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("coverage", pa.float64())]))


def scan_licenses(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """Per row of ``docs``: phrases, labels, score and spans. A narrow map over whole texts.

    A null or empty text has no words, no label and score 0. Rows with equal or
    null ids are kept as they are; other columns are not read. The score is the
    largest share of a template that a chain covers, 1 where a phrase stands.
    """
    key = repr((templates, phrases))
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Scanner(templates, phrases)
        scan = _WORKER[key].scan
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                got = scan(text)
                base = {label for _, label in got.places}
                starts = [at for at, _ in got.places]
                labels = base | {s[0] for s in got.spans}
                spans = [{"label": a, "start": b, "stop": c, "coverage": d} for a, b, c, d in got.spans]
                first, last = (min(starts), max(starts)) if starts else (None, None)
                rows.append((got.n_words, len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else min(1.0, got.best), spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPAN)
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[id_column, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(id_column, text_column).mapInArrow(
        run,
        f"`{id_column}` {kind.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
        f"base_labels string, labels string, score double, spans {SPANS}",
    )
