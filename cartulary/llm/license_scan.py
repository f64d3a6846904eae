"""Operator 10, licence scans: matching statistics of every file against a generalised suffix automaton of licence tokens.

The templates are token sequences; one automaton over all of them (built with a restart at each template) recognises every run of words that
occurs in a template. A file streams through it word by word: after each word the automaton knows the longest run, ending here,
that occurs in a template (the matching statistic) and one template place where it ends. Maximal runs of ``min_match`` words or more are
the anchors; anchors of one template are chained when template and file places both move on with gaps of at most ``max_gap`` words.
A chain's covered template words over the template's length is the coverage; a template counts as found from ``min_cover`` on.

The contract's base phrases are templates too: their places are found by the same stream (a run that ends in a state where
a phrase is complete), whatever stands around them.

Words are runs of digits, letters a-z after lower-casing A-Z, and all non-ASCII characters. Places are word numbers from 0.

Nulls and edges: a null text counts as empty: no words, no labels, score 0, null places; repeated rows give repeated results; a null doc_id is
returned as null; extra columns are ignored; long texts take memory in proportion to their words only.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame

from cartulary.llm.batches import map_texts, worker_tables

#: The contract's phrases and labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public licence wordings, by label.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
}
MIN_MATCH = 4
MAX_GAP = 12
MIN_COVER = 0.8

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word sequences; each state knows one (sequence, end) place."""

    def __init__(self, sequences: list[list[bytes]]):
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.len, self.place = [-1], [0], [(-1, -1)]
        self.ends: dict[int, list[int]] = defaultdict(list)  # state -> sequences that end there as a whole
        for k, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._add(last, w, (k, i))
            state = 0
            for w in seq:
                state = self.go[state][w]
            self.ends[state].append(k)

    def _state(self, length: int, link: int, go: dict, place: tuple[int, int]) -> int:
        self.go.append(go)
        self.len.append(length)
        self.link.append(link)
        self.place.append(place)
        return len(self.len) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.go[q]), self.place[q])
        self.link[q] = clone
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: bytes, place: tuple[int, int]) -> int:
        q = self.go[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        new = self._state(self.len[last] + 1, 0, {}, place)
        p = last
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return new


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], min_match: int, max_gap: int, min_cover: float):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.labels = list(phrases.values()) + [label for label, texts in templates.items() for _ in texts]
        self.sequences = [words(p.encode()) for p in phrases] + [words(t.encode()) for texts in templates.values() for t in texts]
        self.n_base = len(phrases)
        self.auto = Automaton(self.sequences)
        self.known = {w for s in self.sequences for w in s}
        # phrases complete in a state, or in any shorter run that ends with it
        self.complete: list[tuple[int, ...]] = [()] * len(self.auto.len)
        for s in sorted(range(len(self.auto.len)), key=self.auto.len.__getitem__):
            own = tuple(k for k in self.auto.ends.get(s, ()) if k < self.n_base)
            up = self.complete[self.auto.link[s]] if s else ()
            self.complete[s] = tuple(dict.fromkeys(own + up))
        self.shortest = min((len(s) for s in self.sequences[: self.n_base]), default=1)

    def statistics(self, seq: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Maximal runs as (end, length, state), and base phrase places as (start, phrase)."""
        auto, known = self.auto, self.known
        go, link, length = auto.go, auto.link, auto.len
        runs, places = [], []
        state = n = 0
        hits = [i for i, w in enumerate(seq) if w in known]
        before = -2
        for i in hits:
            w = seq[i]
            if i != before + 1:
                if n >= self.min_match:
                    runs.append((before, n, state))
                state = n = 0
            before = i
            if w not in go[state]:
                if n >= self.min_match:
                    runs.append((i - 1, n, state))
                while state and w not in go[state]:
                    state = link[state]
                n = length[state]
            state = go[state].get(w, 0)
            n = n + 1 if state else 0
            if n >= self.shortest and self.complete[state]:
                for k in self.complete[state]:
                    size = len(self.sequences[k])
                    if n >= size:
                        places.append((i - size + 1, k))
        if n >= self.min_match:
            runs.append((before, n, state))
        return runs, places

    def scan(self, data: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans ("label:start:end" in words, end exclusive)."""
        seq = words(data)
        runs, places = self.statistics(seq)
        places.sort()
        chains: dict[int, list[list]] = defaultdict(list)
        active: dict[int, list[list]] = defaultdict(list)  # those that a later run can still reach: runs begin in order
        for end, n, state in runs:
            k0, e0 = self.auto.place[state]
            # the run stands in one template for sure; other templates that hold it are tried by their own words
            run = seq[end - n + 1 : end + 1]
            for k, at in self._holders(tuple(run), (k0, e0 - n + 1)):
                lo, hi = end - n + 1, end + 1
                near = active[k] = [c for c in active[k] if lo - c[1] <= self.max_gap]
                for c in reversed(near):
                    if 0 <= lo - c[1] and 0 <= at - c[3] <= self.max_gap:
                        c[1], c[3], c[4] = hi, at + n, c[4] + n
                        break
                else:
                    near.append([lo, hi, at, at + n, n])
                    chains[k].append(near[-1])
        best, spans = 0.0, []
        for k, found in chains.items():
            for lo, hi, _, _, covered in found:
                cover = covered / len(self.sequences[k])
                if cover >= self.min_cover:
                    spans.append((lo, hi, self.labels[k]))
                best = max(best, min(1.0, cover))
        if places:
            best = 1.0
        base = sorted({self.labels[k] for _, k in places})
        labels = sorted({*base, *(x[2] for x in spans)})
        spans = sorted({*spans, *((s, s + len(self.sequences[k]), self.labels[k]) for s, k in places)})
        first, last = (places[0][0], places[-1][0]) if places else (None, None)
        return len(seq), len(places), first, last, ",".join(base), ",".join(labels), best, ",".join(f"{x}:{s}:{e}" for s, e, x in spans)

    def _holders(self, run: tuple, sure: tuple[int, int]) -> list[tuple[int, int]]:
        """(sequence, start) of the run in every template that holds it, at its first place there."""
        out = []
        for k, seq in enumerate(self.sequences):
            if k == sure[0]:
                out.append(sure)
            elif len(seq) >= len(run) and run[0] in seq:
                at = next((i for i in range(len(seq) - len(run) + 1) if seq[i] == run[0] and tuple(seq[i : i + len(run)]) == run), None)
                if at is not None:
                    out.append((k, at))
        return out


def _scanner(min_match: int, max_gap: int, min_cover: float) -> Scanner:
    return Scanner(PHRASES, TEMPLATES, min_match, max_gap, min_cover)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"

    def make():
        scanner = worker_tables(("licences", min_match, max_gap, min_cover), lambda: _scanner(min_match, max_gap, min_cover))
        return lambda texts: list(zip(*[scanner.scan(t or b"") for t in texts])) if texts else [[] for _ in range(8)]

    return map_texts(docs, make, schema, id_col, text_col, binary=True)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
