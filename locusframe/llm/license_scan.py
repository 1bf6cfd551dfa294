"""Licence scans with a generalised suffix automaton over the words of licence templates.

A text's words are streamed through the automaton, which gives for each word the longest run
that ends there and stands in a template (matching statistics); the suffix links of its state give
the runs that end there and stand in other templates. Each template's own matches, as long as they
get in it, are chained along it into spans; a span that covers enough of its template gives the
template's label. A span in parts that all lie inside longer matches of other labels' spans is
dropped, as "licensed under the" of one licence inside the notice of another.
The base phrases are templates too, so their places come from the same stream.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences of public licences and notices, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "under the terms of the GNU General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Shortest match that takes part in a chain, the most words between two matches of a chain, and the share of a template that a span must cover.
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 6, 0.6

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split(b" ")


def split_words(text: bytes) -> list[bytes]:
    return [w for w in words_of(text) if w]


class Automaton:
    """Generalised suffix automaton: accepts the factors of all sequences that were added."""

    def __init__(self):
        self.move: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        #: A sequence and the place where the state's factors end in it, for the first that made the state.
        self.seen: list[tuple[int, int]] = [(-1, -1)]

    def _state(self, move: dict, link: int, size: int, seen: tuple[int, int]) -> int:
        self.move.append(move)
        self.link.append(link)
        self.size.append(size)
        self.seen.append(seen)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the factors of q that are reached from p and its suffixes."""
        new = self._state(dict(self.move[q]), self.link[q], self.size[p] + 1, self.seen[q])
        self.link[q] = new
        while p >= 0 and self.move[p].get(c) == q:
            self.move[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int], number: int) -> None:
        last = 0
        for place, c in enumerate(sequence):
            if (q := self.move[last].get(c)) is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
                continue
            new, p = self._state({}, 0, self.size[last] + 1, (number, place + 1)), last
            while p >= 0 and c not in self.move[p]:
                self.move[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.move[p][c]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
            last = new


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match=MIN_MATCH, max_gap=MAX_GAP, min_cover=MIN_COVER):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.labels = [label for label, _ in templates]
        self.codes: dict[bytes, int] = {}
        self.sequences = [[self._code(w) for w in split_words(t.encode())] for _, t in templates]
        asked = [[self._code(w) for w in split_words(t.encode())] for t in phrases]
        self.phrases, self.phrase_labels = asked, list(phrases.values())
        self.shortest = min([min_match, *map(len, asked)])
        self.automaton = a = Automaton()
        for number, s in enumerate([*self.sequences, *asked]):
            a.add(s, number)
        # for each state, the places in templates where its factors or suffixes of them end: (template, place, longest of them)
        longest: list[dict[tuple[int, int], int]] = [{} for _ in a.size]
        for number, s in enumerate(self.sequences):
            state = 0
            for place, c in enumerate(s, 1):
                up = state = a.move[state][c]
                while up > 0:
                    longest[up][number, place] = a.size[up]
                    up = a.link[up]
        self.stands: list[list[tuple[int, int, int]]] = [[] for _ in a.size]
        for s in sorted(range(1, len(a.size)), key=a.size.__getitem__):
            longest[s] = {**longest[a.link[s]], **longest[s]}
            self.stands[s] = [(*where, n) for where, n in longest[s].items() if n >= min_match]
        below: list[list[int]] = [[] for _ in a.size]
        for s, link in enumerate(a.link):
            if link >= 0:
                below[link].append(s)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in a.size]
        for k, p in enumerate(asked):
            state = 0
            for c in p:
                state = a.move[state][c]
            todo = [state]
            while todo:
                s = todo.pop()
                self.ends[s].append((k, len(p)))
                todo += below[s]

    def _code(self, word: bytes) -> int:
        return self.codes.setdefault(word, len(self.codes) + 1)

    def statistics(self, codes: list[int]):
        """(state, length) after each word of a run of known words."""
        move, link, size = self.automaton.move, self.automaton.link, self.automaton.size
        state = length = 0
        for c in codes:
            while state and c not in move[state]:
                state = link[state]
                length = size[state]
            if (to := move[state].get(c)) is not None:
                state, length = to, length + 1
            yield state, length

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Number of words, places (first word, phrase), and spans (first word, end, template, share covered) of a text."""
        words = split_words(text)
        known = self.codes.get
        codes = np.fromiter((known(w, 0) for w in words), np.int32, len(words))
        inside = np.flatnonzero(codes)
        if not inside.size:
            return len(words), [], []
        cuts = np.flatnonzero(np.diff(inside) > 1) + 1
        places, matches = [], []
        for a, b in pairwise([0, *cuts.tolist(), inside.size]):
            if b - a < self.shortest:
                continue
            first = int(inside[a])
            run = codes[first : first + b - a].tolist()
            found = list(self.statistics(run))
            for i, (state, length) in enumerate(found):
                for k, n in self.ends[state]:
                    if length >= n:
                        places.append((first + i + 1 - n, k))
                if length < self.min_match:
                    continue
                # matches that the next word doesn't lengthen within their template
                for number, end, longest in self.stands[state]:
                    s = self.sequences[number]
                    if end == len(s) or i + 1 == len(run) or s[end] != run[i + 1]:
                        n = min(length, longest)
                        matches.append((number, first + i + 1 - n, end - n, n))
        return len(words), sorted(places), self._chained(matches)

    def _chained(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Matches of one template that follow each other in the text and in it, with few words between, make a span: those that cover most of it."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for number, *m in sorted(set(matches), key=lambda m: (m[1], m[2], m[3])):
            by.setdefault(number, []).append(tuple(m))
        found = []  # (start, end, template, words covered, matches)
        for number, ms in by.items():
            size = len(self.sequences[number])
            while ms:
                taken = self._best(ms, size)
                found += [(start, end, number, covered, parts) for start, end, covered, parts in taken]
                starts, ends = [s for s, *_ in taken], [e for _, e, *_ in taken]
                # in gaps between the spans there may be others; where none was found, none is left
                ms = [m for m in ms if (k := bisect_left(ends, m[0] + 1)) == len(ends) or starts[k] >= m[0] + m[2]] if taken else []
        # spans of other labels whose matches have a part in them
        found.sort(key=lambda s: s[:3])
        wide = sorted((at, at + n, self.labels[number]) for _, _, number, _, parts in found for at, _, n in parts)
        firsts, most = [w[0] for w in wide], max((e - s for s, e, _ in wide), default=0)

        def inside(at: int, n: int, label: str) -> bool:
            near = wide[bisect_left(firsts, at + n - most) : bisect_left(firsts, at + 1)]
            return any(e >= at + n and e - s > n and other != label for s, e, other in near)

        spans = []
        for start, end, number, covered, parts in found:
            size = len(self.sequences[number])
            if parts[0][2] == size or not all(inside(at, n, self.labels[number]) for at, _, n in parts):
                spans.append((start, end, number, min(1.0, covered / size)))
        return spans

    def _best(self, ms: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(start, end, words covered, matches) of chains that cover enough of a template of a size, apart in the text, from its matches sorted by their place in it."""
        best: list[tuple[int, int, int]] = []  # words covered up to a match, start of the chain, match before
        low = 0
        for j, (at, inside, length) in enumerate(ms):
            while ms[low][0] + size + self.max_gap < at:
                low += 1
            top = (length, at, -1)
            for i in range(low, j):
                end, done = ms[i][0] + ms[i][2], ms[i][1] + ms[i][2]
                if at - end <= self.max_gap and inside + length > done and at + length > end:
                    skip = max(0, end - at, done - inside)
                    top = max(top, (best[i][0] + max(0, length - skip), best[i][1], i))
            best.append(top)
        taken, ends = [], []
        for j in sorted((j for j, b in enumerate(best) if b[0] / size >= self.min_cover), key=lambda j: (-best[j][0], ms[j][0] + ms[j][2] - best[j][1], best[j][1])):
            start, end = best[j][1], ms[j][0] + ms[j][2]
            k = bisect_left(ends, start + 1)
            if k < len(ends) and taken[k][0] < end:
                continue
            parts, i = [], j
            while i >= 0:
                parts.append(ms[i])
                i = best[i][2]
            ends.insert(k, end)
            taken.insert(k, (start, end, best[j][0], parts[::-1]))
        return taken


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, places, spans) for each row of docs.

    places: array of (word, label), a place of a base phrase each. spans: array of (first, end,
    label, cover). Words are counted from 0. A null text is an empty one; it has no words, places
    or spans. A null id stays null, repeated rows come back as often, other columns are not looked at.
    """

    def make():
        scanner = Scanner(templates, phrases)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            counts, places, spans = [], [], []
            for text in texts_of(b.column(1)):
                n, found, covered = scanner.scan(text)
                counts.append(n)
                places.append([{"word": w, "label": scanner.phrase_labels[k]} for w, k in found])
                spans.append([{"first": s, "end": e, "label": scanner.labels[k], "cover": c} for s, e, k, c in covered])
            place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, span)], ["doc_id", "n_words", "places", "spans"])

        return run

    kind = dict(docs.dtypes)[id_col]
    return by_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, n_words long, places array<struct<word: long, label: string>>, spans array<struct<first: long, end: long, label: string, cover: double>>")


def license_report(scanned: DataFrame) -> DataFrame:
    """Digest of scan_licenses: counts, first and last place, labels. score: the largest share of a template that a span covers; a base phrase is covered whole."""
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    base, more = F.col("places.label"), F.col("spans.label")
    word = F.col("places.word")
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.cover"), F.lit(0.0))).alias("score"),
    )
