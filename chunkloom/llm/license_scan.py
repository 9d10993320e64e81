"""Licence scans with a positional rare-token index.

Templates (short public licence phrases) are indexed by word: word -> postings (template, position). Two passes
go over all whole texts. The first counts in how many documents each licence word stands, which gives its IDF.
The second looks up, per file and template, the template's words of highest IDF that the file holds, so many that
no alignment of the least share can miss the votes it needs; the postings of one template are intersected by
relative position (place in the file minus place in the template), and a template aligned by enough of its rare
words is accepted when every one of its mandatory key phrases stands verbatim where the alignment puts it. Base
phrases are counted at all places, whatever the index says.

Defined results: null text equals empty text, without words or labels and with score 0; places count words from
0; labels are distinct, sorted and comma-joined, empty without any; score is the best share of an aligned
template's words that stand at their places, 1 for a base phrase; repeated rows and ids are judged one by one; very
long texts are scanned whole; an empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import Texts, ascii_lower, text_slices

#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Label, words of the template, mandatory key phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("free of charge to any person", "deal in the software without restriction")),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2", "in compliance with the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "is hereby granted")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
]
#: The votes an alignment needs, how far its places may drift, and the share of the template's words that must stand at their places.
LEAST_VOTES = 2
DRIFT = 2
LEAST_SHARE = 0.6

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SIGN = np.ones(256, bool)
_SIGN[0x00:0x30] = _SIGN[0x3A:0x61] = _SIGN[0x7B:0x80] = False


def count_words(texts: Texts) -> np.ndarray:
    """Words of each row of lower-cased texts, from the bytes alone."""
    if not len(texts.data):
        return np.zeros(len(texts), np.int64)
    sign = _SIGN[texts.data]
    begins = sign.copy()
    begins[1:] &= ~sign[:-1]
    first = texts.offsets[:-1][texts.lengths > 0]
    begins[first] = sign[first]
    seen = np.concatenate([[0], np.cumsum(begins)])
    return seen[texts.offsets[1:]] - seen[texts.offsets[:-1]]


class RareTokenIndex:
    """Word -> (template, position), with the words' IDF over the corpus."""

    def __init__(self, frequency: dict[str, int], documents: int) -> None:
        self.templates = [(label, words.split(), [p.split() for p in phrases]) for label, words, phrases in TEMPLATES]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for t, (_, words, _) in enumerate(self.templates):
            for q, w in enumerate(words):
                self.postings.setdefault(w, []).append((t, q))
        self.idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in self.postings}
        self.rarest = []  # per template: the words that must stand at their places, and each word's places, rarest first
        for t, (_, words, _) in enumerate(self.templates):
            least = next(m for m in range(len(words) + 1) if m / len(words) >= LEAST_SHARE)
            order = sorted(set(words), key=lambda w: (-self.idf[w], w))
            self.rarest.append((least, [(w, [q for u, q in self.postings[w] if u == t]) for w in order]))
        self.base = [(phrase.split(), label) for phrase, label in BASE.items()]

    def scan(self, words: list[str]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, all labels, score."""
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.postings or w in BASE_WORDS:
                at.setdefault(w, []).append(i)
        starts, base = [], set()
        for phrase, label in self.base:
            rarest = min(range(len(phrase)), key=lambda i: len(at.get(phrase[i], ())))
            for p in at.get(phrase[rarest], ()):
                if p >= rarest and words[p - rarest : p - rarest + len(phrase)] == phrase:
                    starts.append(p - rarest)
                    base.add(label)
        score, found = 1.0 if base else 0.0, set(base)
        votes: dict[tuple[int, int], set[int]] = {}
        for t, (least, rarest) in enumerate(self.rarest):
            present = [(w, places) for w, places in rarest if w in at]
            wrong = sum(len(places) for _, places in present) - least  # so many of these places may not fit
            looked = 0
            for w, places in present if wrong >= 0 else ():
                if looked >= wrong + LEAST_VOTES:
                    break
                looked += len(places)
                for q in places:
                    for p in at[w]:
                        votes.setdefault((t, p - q), set()).add(q)
        for (t, shift), seen in votes.items():
            label, template, phrases = self.templates[t]
            if len(seen) < min(LEAST_VOTES, len(template)):
                continue
            share = sum(0 <= shift + q < len(words) and words[shift + q] == w for q, w in enumerate(template)) / len(template)
            if share >= LEAST_SHARE and all(self._stands(words, template, shift, phrase) for phrase in phrases):
                found.add(label)
                score = max(score, share)
        return starts, base, found, score

    @staticmethod
    def _stands(words: list[str], template: list[str], shift: int, phrase: list[str]) -> bool:
        n = len(phrase)
        q = next(q for q in range(len(template) - n + 1) if template[q : q + n] == phrase)
        return any(words[at : at + n] == phrase for at in range(max(0, shift + q - DRIFT), shift + q + DRIFT + 1))


BASE_WORDS = {w for phrase in BASE for w in phrase.split()}
VOCABULARY = sorted({w for _, words, _ in TEMPLATES for w in words.split()} | BASE_WORDS)
#: A file can hold a label only if it has one of these words: each template's longest mandatory word, and each base phrase's.
_ANCHORS = sorted({max((w for p in phrases for w in p.split()), key=len) for _, _, phrases in TEMPLATES} | {"mit", "apache", "cc"})
_ANCHOR = re.compile("|".join(re.escape(w) for w in _ANCHORS).encode())


def word_frequency(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, and the number of documents."""
    index = {w: i for i, w in enumerate(VOCABULARY)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(VOCABULARY), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for t in batch.column(0).to_pylist():
                for w in index.keys() & set(WORD.findall(t)):
                    seen[index[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(seen)), -1), pa.int32()), pa.array(np.append(seen, rows))], ["word", "n"])

    total = docs.select(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).mapInArrow(run, "word int, n long")
    n = {r["word"]: r["n"] for r in total.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row a licence word
    return {VOCABULARY[k]: v for k, v in n.items() if k >= 0}, n.get(-1, 0)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, places of base phrases, base labels, labels, score."""
    index = RareTokenIndex(*word_frequency(docs, text_col))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rows = batch.num_rows, {}
            counts = np.zeros(n, np.int64)
            for texts in text_slices(batch.column(1)):
                counts[texts.first : texts.first + len(texts)] = count_words(texts)
                for i in range(len(texts)):
                    body = texts.row(i).tobytes()
                    if _ANCHOR.search(body):
                        rows[texts.first + i] = index.scan(WORD.findall(body.decode()))
            empty = ([], set(), set(), 0.0)
            found = [rows.get(i, empty) for i in range(n)]
            columns = [
                batch.column(0),
                pa.array(counts),
                pa.array([len(f[0]) for f in found], pa.int64()),
                pa.array([min(f[0], default=None) for f in found], pa.int64()),
                pa.array([max(f[0], default=None) for f in found], pa.int64()),
                pa.array([",".join(sorted(f[1])) for f in found], pa.string()),
                pa.array([",".join(sorted(f[2])) for f in found], pa.string()),
                pa.array([f[3] for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
