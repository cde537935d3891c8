"""Licence scan with a generalised suffix automaton over the words of licence templates.

Documents stream through the automaton word by word, which gives their matching statistics: at each word the length
of the longest run ending there that some template holds. Runs that can't be extended are chained, template by
template, into spans; every chain that covers its template's words well enough is a span and labels the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8

# The phrases and labels of the base scan.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Public notices by which licences are usually announced.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
]

#: Runs shorter than this aren't chained; a notice counts from this share of its words; gap of words inside a chain.
MIN_RUN, MIN_COVER, MAX_GAP = 4, 0.6, 16
#: A-Z to lower case, every separator to a blank; bytes from 0x80 on belong to words.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>"


class Automaton:
    """Generalised suffix automaton over word sequences; ``places`` has, for each state, where its longest string ends in the templates."""

    def __init__(self, texts: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [set()]
        for k, words in enumerate(texts):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.places[last].add((k, at))
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.places[self.link[state]] |= self.places[state]

    def _state(self, length: int, edges: dict[str, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.places.append(set())
        return len(self.length) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """A state of its own for the strings of q that end p + word."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: str) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state


@cache
def scanner(base: tuple = tuple(BASE_PHRASES), notices: tuple = tuple(NOTICES)):
    """(words of a document) -> the row's values after doc_id."""
    labels = [label for _, label in base] + [label for label, _ in notices]
    texts = [t.encode().translate(FOLD).split() for t in (*(t for t, _ in base), *(t for _, t in notices))]
    auto, sizes, n_base = Automaton(texts), [len(t) for t in texts], len(base)
    known = {w: 1 for t in texts for w in t}
    shortest = min(sizes[:n_base])
    edges, link, length, places = auto.next, auto.link, auto.length, auto.places
    # base phrases that are suffixes of what a state stands for: its own and those of its suffix links
    ends: list[list[int]] = [[] for _ in length]
    for s in sorted(range(1, len(length)), key=length.__getitem__):
        own = {k for k, at in places[s] if k < n_base and at == sizes[k] - 1 and length[s] >= sizes[k]}
        ends[s] = sorted(own.union(ends[link[s]]))
    runs = re.compile(b"[^\0]{%d,}" % min(shortest, MIN_RUN))

    def scan(words: list[bytes]):
        base_at: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        get = known.get
        mask = bytes([get(w, 0) for w in words])
        for run in runs.finditer(mask):
            state = size = 0
            end = run.end()
            for i in range(run.start(), end):
                word = words[i]
                to = edges[state].get(word)
                if to is None:
                    if size >= MIN_RUN:
                        for k, at in places[state]:
                            matches.setdefault(k, []).append((i - size, at - size + 1, size))
                    while state and to is None:
                        state = link[state]
                        size = length[state]
                        to = edges[state].get(word)
                state, size = (to, size + 1) if to is not None else (0, 0)
                if ends[state]:
                    base_at += [(i - sizes[k] + 1, k) for k in ends[state] if size >= sizes[k]]
            if size >= MIN_RUN:
                for k, at in places[state]:
                    matches.setdefault(k, []).append((end - size, at - size + 1, size))
        spans = [(labels[k], at, at + sizes[k] - 1, 1.0) for at, k in base_at]
        for k, found in matches.items():
            if k < n_base:
                continue
            chain_start, covered, doc_end, text_end = -1, 0, -1, -1
            chain, chains = None, []
            for at, in_text, size in sorted(set(found)):
                again = text_end - in_text - max(0, doc_end - at)  # words the chain has from another place
                if chain_start < 0 or at - doc_end > MAX_GAP or in_text + size <= text_end or 2 * again > size >= MIN_COVER * sizes[k]:
                    chains.append(chain)
                    chain, chain_start, covered, doc_end, text_end = None, at, 0, at, in_text
                cut = max(0, doc_end - at, text_end - in_text)  # what the chain already covers
                covered += max(0, size - cut)
                doc_end, text_end = max(doc_end, at + size), max(text_end, in_text + size)
                share = covered / sizes[k]
                if chain is None or share > chain[3]:
                    chain = (labels[k], chain_start, doc_end - 1, min(1.0, share))
            spans += [c for c in (*chains, chain) if c and c[3] >= MIN_COVER]
        starts = [at for at, _ in base_at]
        names = sorted({labels[k] for _, k in base_at})
        every = sorted({s[0] for s in spans})
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(names), ",".join(every),
            max((s[3] for s in spans), default=0.0), [{"label": a, "first": b, "last": c, "cover": d} for a, b, c, d in sorted(set(spans))],
        )

    return scan


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, repeated rows included. Null or empty text: no words, null positions, empty labels, score 0.

    The whole text is streamed; memory is that of one document. Other columns are ignored.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scan = scanner()
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in slices(batches, 2000):
            got = [scan(x.translate(FOLD).split()) for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], t) for i, t in enumerate(kinds))], names=["doc_id", *names])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and spans of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def license_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_license_scan that SQL can say."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {"op3_license_scan": op3_license_scan, "license_base_columns": license_base_columns}
_PLACES = "list_filter(range(1, len(w) + 1), lambda i: w[i:i + {last}] = {words})"
ORACLES: dict[str, str] = {
    "license_base_columns": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {_PLACES.format(last=3, words="['under', 'the', 'mit', 'license']")} AS a, {_PLACES.format(last=3, words="['apache', 'license', 'version', '2']")} AS b, {_PLACES.format(last=2, words="['cc', 'by', 'nc']")} AS c FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(a) + len(b) + len(c))::BIGINT AS n_base, list_min(list_concat(a, b, c)) - 1 AS first_word, list_max(list_concat(a, b, c)) - 1 AS last_word,
array_to_string(list_filter([CASE WHEN len(b) > 0 THEN 'apache-2' ELSE '' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' ELSE '' END, CASE WHEN len(a) > 0 THEN 'mit' ELSE '' END], lambda x: x <> ''), ',') AS base_labels FROM p"""
}
