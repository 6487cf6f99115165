"""License scans: exact set-similarity join of text blocks with license templates, and exact phrases.

A block is a line of a text, or a window of as many words as the longest template has, which may cross line ends (so
that wrapped notices are met); both as sets of words. A template is a set of words too. A block meets a template when
it holds at least ``threshold`` of the template's words (containment). Words are ordered by how often all documents
hold them, rarest first. By the prefix filter a block that meets a template holds one of its first
``|T| - need + 1`` words; only starts of blocks that do are counted in full. Templates are few and fixed, so they are
the broadcast side.

An occurrence is a shortest run of words that meets a template. It names nothing where another template that it
resembles (all its words belong to that one) has an occurrence of a larger share on the same places, and fewer words
than needed are left beside them; a second notice of its own in the same line stays. A run that crosses line ends
mustn't draw on the words of any other template's occurrence of a larger share, or of an equal one and more words.

Defined cases: null and empty texts have no words, no places and empty label strings; ties and repeated rows are each
judged alone; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ARROW_ROWS, Scratch, batches_of, tidy
from ._text import ALNUM, U, word_hash, words

#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Notices as they are commonly worded, and their labels.
TEMPLATES = (
    ("licensed under the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3"),
    ("licensed under the gnu affero general public license version 3", "agpl-3"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0 international", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the mozilla public license version 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part may be reproduced without permission", "proprietary"),
)

OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _vocabulary(phrases, templates) -> tuple[np.ndarray, dict[int, int]]:
    found = np.unique(np.concatenate([word_hash(t, ALNUM) for t, _ in (*phrases, *templates)] or [np.zeros(0, U)]))
    return found, {int(h): k for k, h in enumerate(found)}


def token_counts(documents: DataFrame, vocabulary: np.ndarray, text: str = "text") -> np.ndarray:
    """In how many places all documents hold each word of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for _, _, _, h, _, _, _ in words(batch.column(0), ALNUM):
                total += np.bincount(_ids(h, vocabulary) + 1, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total[1:])], names=["token", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in documents.select(F.col(text).alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # a row for each word of the templates
        out[r.token] = r.n
    return out


def _ids(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashes, at, -1) if len(vocabulary) else np.full(len(hashes), -1)


class _Matcher:
    def __init__(self, vocabulary, counts, phrases, templates, threshold):
        self.vocabulary = vocabulary
        order = np.lexsort((np.arange(len(vocabulary)), counts))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids = {int(h): k for k, h in enumerate(vocabulary)}
        self.phrases = []
        for p, label in phrases:
            seq = [ids[int(h)] for h in word_hash(p, ALNUM)]
            anchor = min(range(len(seq)), key=lambda k: rank[seq[k]])
            self.phrases.append((seq, anchor, label))
        self.templates, self.window = [], 0
        for t, label in templates:
            hashes = word_hash(t, ALNUM)
            own = np.array(sorted({ids[int(h)] for h in hashes}, key=lambda k: rank[k]))
            need = max(1, ceil(threshold * len(own) - 1e-9))
            member = np.zeros(len(vocabulary), bool)
            member[own] = True
            prefix = np.zeros(len(vocabulary), bool)
            prefix[own[: len(own) - need + 1]] = True
            self.templates.append((label, own, need, member, prefix))
            self.window = max(self.window, len(hashes))

    def run(self, bounds, ids, lines):
        """Per row: places of phrases (row, word, label), and blocks that meet templates (row, label, containment)."""
        n = len(ids)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        places, met = [], []
        for seq, anchor, label in self.phrases:
            start = np.flatnonzero(ids == seq[anchor]) - anchor
            start = start[(start >= 0) & (start + len(seq) <= n)]
            for k, t in enumerate(seq):
                start = start[ids[start + k] == t]
            start = start[row[start] == row[start + len(seq) - 1]]
            places += [(int(row[s]), int(s - bounds[row[s]]), label) for s in start]
        known = np.flatnonzero(ids >= 0)
        tokens = ids[known]
        found: dict[int, list] = {}
        for k, (_, own, need, member, prefix) in enumerate(self.templates):
            for size, of, crosses in self._occurrences(known, tokens, own, need, member, prefix, bounds, row, lines):
                found.setdefault(int(row[min(of.values())]), []).append((size / len(own), k, of, crosses))
        for r, of in found.items():
            met += [(r, self.templates[k][0], share) for share, k in self._explained(of)]
        return places, met

    def _occurrences(self, known, tokens, own, need, member, prefix, bounds, row, lines):
        """(words held, their places by token, whether it crosses a line end) of the shortest runs that meet a template."""
        rare = known[prefix[tokens]]
        if not len(rare):
            return
        start = known[member[tokens]]
        to = np.maximum(np.searchsorted(lines, lines[start], "right"), np.minimum(start + self.window, bounds[row[start] + 1]))
        next_rare = np.append(rare, len(row))[np.searchsorted(rare, start)]
        start, to = start[next_rare < to], to[next_rare < to]
        place = np.empty((len(own), len(start)), np.int64)
        for k, t in enumerate(own):
            mine = known[tokens == t]
            place[k] = np.append(mine, len(row))[np.searchsorted(mine, start)]
        order = np.argsort(place, axis=0)
        place = np.take_along_axis(place, order, axis=0)
        for size in range(need, len(own) + 1):
            end = np.where(place[size - 1] < to, place[size - 1], len(row))
            after = np.append(np.minimum.accumulate(end[::-1])[::-1][1:], len(row))
            for k in np.flatnonzero((end < len(row)) & (end < after)):  # no run inside it holds as many
                yield size, dict(zip(own[order[:size, k]].tolist(), place[:size, k].tolist())), bool(lines[start[k]] != lines[end[k]])

    def _explained(self, found: list) -> list[tuple[float, int]]:
        """(share, template) of a text's occurrences, without those that others explain."""
        if len({f[1] for f in found}) == 1:
            return [f[:2] for f in found]
        drawn: dict[int, dict[int, tuple]] = {}  # for each template, the places of its disjoint occurrences, best first
        for share, k, of, _ in sorted(found, key=lambda f: (-f[0], max(f[2].values()) - min(f[2].values()), min(f[2].values()))):
            own = drawn.setdefault(k, {})
            if not any(p in own for p in of.values()):
                own.update(dict.fromkeys(of.values(), (share, len(of))))
        out = []
        for share, k, of, crosses in found:
            least = (share, len(of)) if crosses else (share, len(self.vocabulary))
            others = [d for o, d in drawn.items() if o != k and (crosses or all(self.templates[o][3][t] for t in of))]
            left = sum(not any(d.get(p, least) > least for d in others) for p in of.values())
            if left >= self.templates[k][2]:
                out.append((share, k))
        return out


def scan(documents: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each of documents."""
    spark = documents.sparkSession
    vocabulary, _ = _vocabulary(phrases, templates)
    with batches_of(spark, ARROW_ROWS):
        counts = token_counts(documents, vocabulary, text)
    shared = spark.sparkContext.broadcast((vocabulary, counts))  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(*shared.value, phrases, templates, threshold)
        for batch in batches:
            for first, last, bounds, h, starts, _, part in words(batch.column(1), ALNUM):
                row = np.repeat(np.arange(last - first), np.diff(bounds))
                lines = np.searchsorted(np.flatnonzero(part == 10), starts) + row
                places, met = matcher.run(bounds, _ids(h, matcher.vocabulary), lines)
                n = last - first
                base, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
                hits, low, high = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                for r, at, label in places:
                    base[r].add(label)
                    labels[r].add(label)
                    hits[r] += 1
                    low[r] = at if low[r] < 0 else min(low[r], at)
                    high[r] = max(high[r], at)
                    score[r] = 1.0
                for r, label, held in met:
                    labels[r].add(label)
                    score[r] = max(score[r], held)
                joined = [pa.array([",".join(sorted(s)) for s in x], pa.string()) for x in (base, labels)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(bounds).astype(np.int64)), pa.array(hits), pa.array(low, mask=low < 0), pa.array(high, mask=low < 0), *joined, pa.array(score)], names=[key, *(c.split()[0] for c in OUT.split(", "))])

    kind = dict(documents.select(key).dtypes)[key]
    with batches_of(spark, ARROW_ROWS):
        return Scratch(spark, "license-scan").put("found", documents.select(key, F.col(text).alias("text")).mapInArrow(tidy(run), f"{key} {kind}, {OUT}"))
