"""Licence scan with a positional index of rare words.

One pass over all texts counts in how many of them each word of the licence templates occurs.  The second pass looks up,
for every file and template, the highest-IDF words of the template that the file holds; their postings (template, position)
place the template in the file, places of several words within :data:`SLACK` words of one another intersect, and a placed
template counts when a mandatory key phrase of it stands there and the IDF weight of its words found in place reaches
:data:`COVER`.  A file whose words cannot reach that weight at any place is not looked at further, which loses nothing.

Base labels are exact phrases and are always kept.  The score is 1 where a base phrase stands, else the largest weight of
a label found.

Rows: a null, empty or wordless text has no labels, null places and score 0; rows that repeat one another are scanned one
by one; an empty table gives an empty result; further columns are ignored; labels are sorted, so ties cannot show.  Words
are compared by all their bytes.  Long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.shared import ship, text_of
from spendgrid.llm.words import chunks

# Phrases of the base labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Opening or notice lines of public licences, and the phrases one of which must stand in a copy.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
     ("except in compliance with the license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge",)),
    ("mit", "Licensed under the MIT License", ("mit license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
     ("gnu general public license",)),
    ("lgpl", "Licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "Licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla public license",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work", ("waived all copyright",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("released into the public domain",)),
)

RARE = 4  # words of a template that are looked up in a file
AGREE = 2  # of them that must stand at one relative place
SLACK = 2  # words by which places may differ
COVER = 0.7  # share of a template's IDF weight that must stand in place
TEXT_BYTES = 1 << 18  # bytes scanned at once; a longer text alone
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


class Vocabulary:
    """Numbers of known words, found by all their bytes, eight at a time."""

    def __init__(self, words: list[str]):
        self.words = words
        raw = [w.encode() for w in words]
        self.columns = max(1, -(-max(map(len, raw), default=1) // 8))
        keys = [[int.from_bytes(r[8 * k:8 * k + 8].ljust(8, b"\0"), "little") for r in raw] for k in range(self.columns)]
        self.keys, self.tables, state, n = [], [], np.zeros(len(raw), np.int64), 1
        for column in keys:
            known = np.unique(np.array(column, np.uint64))
            at = np.searchsorted(known, np.array(column, np.uint64))
            pairs = sorted(set(zip(state.tolist(), at.tolist())))
            number = {p: i for i, p in enumerate(pairs)}
            table = np.full((n, len(known)), -1, np.int64)
            for (a, b), i in number.items():
                table[a, b] = i
            state, n = np.array([number[p] for p in zip(state.tolist(), at.tolist())], np.int64), len(pairs)
            self.keys.append(known)
            self.tables.append(table)
        self.number = np.zeros(n, np.int64)
        self.number[state] = np.arange(len(raw))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every word, -1 for an unknown one."""
        found = np.full(len(starts), -1, np.int64)
        if not len(starts) or not self.words:
            return found
        padded = np.append(data, np.zeros(8, np.uint8))
        at = np.flatnonzero(ends - starts <= 8 * self.columns)
        state = np.zeros(len(at), np.int64)
        for k, (known, table) in enumerate(zip(self.keys, self.tables)):
            begin, size = starts[at] + 8 * k, ends[at] - starts[at] - 8 * k
            key = np.zeros(len(at), np.uint64)
            for j in range(8):
                byte = np.where(size > j, padded[np.minimum(begin + j, len(padded) - 1)], 0).astype(np.uint64)
                key |= byte << np.uint64(8 * j)
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            state = np.where(known[place] == key, table[state, place], -1)
            at, state = at[state >= 0], state[state >= 0]
        found[at] = self.number[state]
        return found


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, begins and ends of all words, and the word numbers at which texts begin."""
    data = _LOWER[data]
    inside = _INSIDE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    first, last = begins[:-1], np.append(begins[1:-1], True)[:len(data)]
    starts = np.flatnonzero(inside & (~np.append(False, inside[:-1])[:len(data)] | first))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False)[:len(data)] | last)) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def _places(codes: np.ndarray, text: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the words of a phrase stand one after the other in one text."""
    n = len(codes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(codes[:n] == phrase[0])
    for k, code in enumerate(phrase[1:], 1):
        at = at[(codes[at + k] == code) & (text[at + k] == text[at])]
    return at


class Index:
    """Templates, their words and the weight of each word."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.base, self.labels = [(words_of(p), label) for p, label in base], [label for label, _, _ in templates]
        texts = [words_of(t) for _, t, _ in templates]
        phrases = [[words_of(p) for p in keys] for _, _, keys in templates]
        self.vocabulary = Vocabulary(sorted({w for t in texts for w in t} | {w for ps in phrases for p in ps for w in p} | {w for p, _ in self.base for w in p}))
        number = {w: i for i, w in enumerate(self.vocabulary.words)}
        code = lambda words: [number[w] for w in words]
        self.base = [(code(p), label) for p, label in self.base]
        self.texts = [np.array(code(t)) for t in texts]
        self.phrases = [[code(p) for p in ps] for ps in phrases]
        self.weigh({}, 0)

    def weigh(self, held: dict[str, int], n_texts: int) -> "Index":
        """Set the IDF of every word from the number of texts that hold it."""
        self.idf = np.array([math.log1p(n_texts / (1 + held.get(w, 0))) + 1e-9 for w in self.vocabulary.words])
        self.ranked = [sorted(set(t.tolist()), key=lambda c: (-self.idf[c], c)) for t in self.texts]
        self.mass = [self.idf[t].sum() for t in self.texts]
        return self

    def placed(self, codes: np.ndarray, keys: list[np.ndarray]) -> list[tuple[str, int, int, float]]:
        """``(label, first word, words, weight)`` of the templates in a file; ``keys`` has the places of each template's phrases."""
        known = np.flatnonzero(codes >= 0)
        held = np.zeros(len(self.idf), bool)
        held[codes[known]] = True
        found = []
        for t, words in enumerate(self.texts):
            if not len(keys[t]) or self.idf[words[held[words]]].sum() < COVER * self.mass[t]:
                continue
            starts, which = [], []
            for code in [c for c in self.ranked[t] if held[c]][:RARE]:
                at = known[codes[known] == code]
                for position in np.flatnonzero(words == code):
                    starts.append(at - position)
                    which.append(np.full(len(at), code))
            starts, which = np.concatenate(starts), np.concatenate(which)
            order = np.lexsort((which, starts))
            starts, which = starts[order], which[order]
            need = min(AGREE, len(set(which.tolist())))
            reach = np.searchsorted(starts, starts + SLACK, "right")
            begins = np.flatnonzero(np.append(True, starts[1:] != starts[:-1]))
            end = -1
            for i in begins:
                if starts[i] < end or len(set(which[i:reach[i]].tolist())) < need:
                    continue
                low, high = int(starts[i]) - SLACK, int(starts[i]) + len(words) + 2 * SLACK
                j = np.searchsorted(keys[t], low)
                if j == len(keys[t]) or keys[t][j] >= high:
                    continue
                weight = max(self._weight(codes, words, int(s)) for s in np.unique(starts[i:reach[i]])) / self.mass[t]
                if weight >= COVER:
                    begin = max(0, int(starts[i]))
                    found.append((self.labels[t], begin, min(len(codes), int(starts[i]) + len(words)) - begin, round(float(weight), 9)))
                    end = int(starts[i]) + len(words)  # the next copy stands behind this one
        return found

    def _weight(self, codes: np.ndarray, words: np.ndarray, start: int) -> float:
        near = np.zeros(len(words), bool)
        for shift in range(-SLACK, SLACK + 1):
            at = start + shift + np.arange(len(words))
            inside = (at >= 0) & (at < len(codes))
            near[inside] |= codes[at[inside]] == words[inside]
        return float(self.idf[words[near]].sum())


def _held(index: Index):
    """Texts that hold each word of the templates, summed over a task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(index.vocabulary.words)
        sums, texts = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text"), TEXT_BYTES):
                data, starts, ends, edges = _words(data, offsets)
                codes = index.vocabulary.find(data, starts, ends)
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(edges))
                known = codes >= 0
                sums += np.bincount(np.unique(text[known] * size + codes[known]) % size, minlength=size)
                texts += len(offsets) - 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(["", *index.vocabulary.words]), "held": pa.array([texts, *sums.tolist()], pa.int64())})
    return count


_OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<label:string,first_word:long,n_words:long,weight:double>>")
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("weight", pa.float64())]))


def _scan(index: Index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text"), TEXT_BYTES):
                n = len(offsets) - 1
                data, starts, ends, edges = _words(data, offsets)
                codes = index.vocabulary.find(data, starts, ends)
                text = np.repeat(np.arange(n), np.diff(edges))
                base = [_places(codes, text, p) for p, _ in index.base]
                keys = [np.unique(np.concatenate([_places(codes, text, p) for p in ps])) for ps in index.phrases]
                places = np.sort(np.concatenate(base))
                lo, hi = np.searchsorted(places, edges[:-1]), np.searchsorted(places, edges[1:])
                labels = [set() for _ in range(n)]
                for at, (_, label) in zip(base, index.base):
                    for i in np.unique(text[at]):
                        labels[i].add(label)
                matches: list[list] = [[] for _ in range(n)]
                for i in np.unique(text[np.concatenate(keys)]) if keys else ():
                    a, b = edges[i], edges[i + 1]
                    matches[i] = index.placed(codes[a:b], [k[np.searchsorted(k, a):np.searchsorted(k, b)] - a for k in keys])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, n), "n_words": pa.array(np.diff(edges)), "n_base": pa.array(hi - lo),
                    "first_word": pa.array([int(places[a] - e) if b > a else None for a, b, e in zip(lo, hi, edges)], pa.int64()),
                    "last_word": pa.array([int(places[b - 1] - e) if b > a else None for a, b, e in zip(lo, hi, edges)], pa.int64()),
                    "base_labels": [",".join(sorted(s)) for s in labels],
                    "labels": [",".join(sorted(s | {m[0] for m in ms})) for s, ms in zip(labels, matches)],
                    "score": pa.array([1.0 if s else max([0.0, *(min(1.0, m[3]) for m in ms)]) for s, ms in zip(labels, matches)], pa.float64()),
                    "matches": pa.array([[dict(zip(("label", "first_word", "n_words", "weight"), m)) for m in ms] for ms in matches], _MATCH)})
    return scan


def weighed_index(docs: DataFrame, templates=TEMPLATES, base=BASE) -> Index:
    """An index whose words are weighed over all texts; what reaches the driver is one count a word of the templates."""
    ship(docs.sparkSession)
    index = Index(templates, base)
    counts = (docs.select(text_of().alias("text")).mapInArrow(_held(index), "word string, held long")
              .groupBy("word").agg(F.sum("held").alias("held")).collect())
    held = {r["word"]: r["held"] for r in counts}
    return index.weigh(held, held.get("", 0))


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """Per row of ``docs``: words, base places and labels, all labels, score, and where each template stands."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_scan(index), _OUT)
