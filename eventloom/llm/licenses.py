"""License scans with a generalised suffix automaton of license tokens.

Tokens are runs of digits, lower-cased letters and all characters beyond ASCII. The automaton holds every substring of the templates
(license texts, notices and the bare phrases), some thousand tokens, whatever the corpus. Files stream through it and yield, for each token, the longest
template substring that ends there. Matches that cannot be extended are chained per template in the order of both texts, across at most
`gap` foreign tokens; a chain that covers enough of its template is a span and labels the document.

Narrow: no shuffle. Null and empty texts have no tokens. Documents are independent, so ids may be null, repeated or of any type; other columns stay out.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.suffix_automaton import SuffixAutomaton
from eventloom.llm.words import Words, slices, text_bytes

# fixed values: the phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# fixed values: texts and notices of public licenses, by label
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "released under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Bytes to themselves, lower-cased or, where they separate tokens, to a space. UTF-8 keeps bytes from 0x80 on for characters beyond ASCII.
_TOKEN = np.full(256, 32, np.uint8)
_TOKEN[48:58] = np.arange(48, 58)
_TOKEN[97:123] = _TOKEN[65:91] = np.arange(97, 123)
_TOKEN[128:] = np.arange(128, 256)


def translated(column: pa.Array, table: np.ndarray) -> pa.Array:
    """A text column with every byte replaced by table; nulls become empty."""
    data, rows = text_bytes(column)
    return pa.Array.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(table[data])])


class Scanner:
    """templates: (label, text). phrases: text to label; each occurrence of one counts, however short."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], least: int, gap: int, share: float, words: int):
        self.templates, self.phrases, self.least, self.gap, self.share, self.words = templates, phrases, least, gap, share, words
        texts = [t.split() for _, t in templates] + [p.split() for p in phrases]
        book = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        coded = [[book[w] for w in t] for t in texts]
        hashed = Words(pa.array([" ".join(book)])).hashes()
        self.order = np.argsort(hashed)
        self.hashes = hashed[self.order]
        self.automaton = SuffixAutomaton(coded, len(book))
        self.longest = max(map(len, texts))
        self.lengths = [len(t) for t in texts]
        self.labels = [label for label, _ in templates]
        self.ending = [(name, len(c), self.automaton.having_suffix(self.automaton.state_of(c))) for (name, c) in zip(phrases, coded[len(templates) :], strict=True)]

    def tokens(self, words: Words) -> np.ndarray:
        """The number of each word in the templates, or -1; rows are kept apart by the callers."""
        h = words.hashes()
        if not len(h):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)

    def chains(self, end: list[int], size: list[int], state: list[int]) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, covered words, share) of a row's spans: its matches, by end, chained per template."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for e, n, s in zip(end, size, state, strict=True):
            for number, place in self.automaton.ends[s]:
                if number < len(self.templates):
                    by.setdefault(number, []).append((e, n, place))
        found = []
        for number, matches in sorted(by.items()):
            matches.sort()
            best = [0] * len(matches)
            begin = [0] * len(matches)
            low = 0
            for j, (e, n, place) in enumerate(matches):
                best[j], begin[j] = n, e - n + 1
                while matches[low][0] < e - self.longest - self.gap:
                    low += 1
                for i in range(low, j):
                    pe, _, pp = matches[i]
                    new = min(n, e - pe, place - pp)
                    if new > 0 and e - new - pe <= self.gap and best[i] + new > best[j]:
                        best[j], begin[j] = best[i] + new, begin[i]
            # non-overlapping chains of this template, the fullest first
            taken: list[tuple[int, int]] = []
            for j in sorted(range(len(matches)), key=lambda j: (-best[j], begin[j])):
                part = best[j] / self.lengths[number]
                if not (part >= self.share or best[j] >= self.words):
                    break
                span = (begin[j], matches[j][0])
                at = bisect.bisect(taken, span)
                if (at == 0 or taken[at - 1][1] < span[0]) and (at == len(taken) or span[1] < taken[at][0]):
                    taken.insert(at, span)
                    found.append((self.labels[number], *span, best[j], part))
        return sorted(found, key=lambda f: (f[1], f[2], f[0], -f[4]))

    def scan(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(translated(batch.column(1), _TOKEN))
        token, row = self.tokens(words), words.row_of_word()
        n = len(words.count)
        # a separator of one unknown token between rows keeps matches inside a row
        shift = np.arange(len(token)) + row
        apart = np.full(len(token) + n, -1, np.int64)
        apart[shift] = token
        state, length = self.automaton.matching(apart, self.longest)
        state, length = state[shift], length[shift]
        place = np.arange(len(token)) - words.first[row]
        n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: list[set] = [set() for _ in range(n)]
        for name, size, inside in self.ending:
            hit = np.flatnonzero(inside[state] & (length >= size))
            at, start = row[hit], place[hit] - size + 1
            np.add.at(n_base, at, 1)
            np.minimum.at(first, at, start)
            np.maximum.at(last, at, start)
            for r in np.unique(at).tolist():
                labels[r].add(self.phrases[name])
        goes_on = np.zeros(len(token), bool)
        goes_on[:-1] = (length[1:] == length[:-1] + 1) & (row[1:] == row[:-1])
        match = np.flatnonzero((length >= self.least) & ~goes_on)
        cut = np.searchsorted(row[match], np.arange(n + 1))
        spans: list[list] = []
        for r in range(n):
            m = match[cut[r] : cut[r + 1]]
            spans.append(self.chains(place[m].tolist(), length[m].tolist(), state[m].tolist()) if len(m) else [])
        named = [sorted({s[0] for s in found} | base) for found, base in zip(spans, labels, strict=True)]
        score = [1.0 if base else min(1.0, max((s[4] for s in found), default=0.0)) for found, base in zip(spans, labels, strict=True)]
        none = n_base == 0
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
        keys = [f.name for f in span]
        out = [
            batch.column(0),
            pa.array(words.count.astype(np.int64)),
            pa.array(n_base),
            pa.array(first, mask=none),
            pa.array(last, mask=none),
            pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
            pa.array(named, pa.list_(pa.string())),
            pa.array(score, pa.float64()),
            pa.array([[dict(zip(keys, s, strict=True)) for s in found] for found in spans], pa.list_(span)),
        ]
        return pa.RecordBatch.from_arrays(out, ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


@functools.lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple, *limits) -> Scanner:
    return Scanner(list(templates), dict(phrases), *limits)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, least: int = 3, gap: int = 12, share: float = 0.75, words: int = 40) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per document.

    n_base, first_word, last_word: places of `phrases` and their smallest and largest start. spans: chains of matches of `least` tokens or more that cover
    `share` of a template or `words` tokens. labels: those of phrases and spans. score: 1 with a phrase, else the largest share of a span, else 0.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    fixed = (tuple(TEMPLATES if templates is None else templates), tuple((PHRASES if phrases is None else phrases).items()), least, gap, share, words)

    def run(batches):
        for batch in slices(batches, "text"):
            yield _scanner(*fixed).scan(batch)

    span = "array<struct<label:string,first_word:bigint,last_word:bigint,covered:bigint,share:double>>"
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans {span}"
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def op12_license_scans(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return out.withColumns(joined).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))
