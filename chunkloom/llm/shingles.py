"""Word-shingle sets of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from chunkloom.llm.common import Texts, mix64, prefix_hash, span_hash

WORDS = 5
LONG_WORD = 512
_FACTORS = mix64(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased, blanks apart), and how many words each row has."""
    data = _LOWER[texts.data]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    sign = ~_BLANK[data]
    inner = texts.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin, stop = sign.copy(), sign.copy()
    begin[1:] &= ~sign[:-1]
    begin[inner] = sign[inner]
    stop[:-1] &= ~sign[1:]
    stop[inner - 1] = sign[inner - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    hashes = span_hash(prefix_hash(data), first, last)
    for i in np.flatnonzero(last - first > LONG_WORD).tolist():  # the polynomial is for ordinary words
        hashes[i] = int.from_bytes(hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    counts = np.bincount(np.searchsorted(texts.offsets, first, "right") - 1, minlength=len(texts))
    return hashes, counts


def shingle_sets(texts: Texts, words: int = WORDS) -> Iterator[np.ndarray]:
    """The set of each row: distinct runs of `words` words; a shorter text is one run; no words, no runs."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    runs = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words):
        runs += hashes[j : j + len(runs)] * _FACTORS[j % WORDS]
    runs = mix64(runs)
    at = 0
    for c in counts.tolist():
        if c >= words:
            yield np.unique(runs[at : at + c - words + 1])
        elif c:
            short = hashes[at : at + c] * _FACTORS[:c]
            yield mix64(np.array([short.sum() ^ np.uint64(0xA5A5A5A5 + c)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += c


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
