"""Piece boundaries of the byte-level BPE pattern, found for whole arrays of characters.

The pattern (contractions, runs of letters, digits or other signs with one leading space, white space) decides
every boundary from at most three neighbouring characters, so it can be evaluated with shifted comparisons.
"""

from __future__ import annotations

import numpy as np
import regex

#: Character classes.
LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, END = range(7)

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point."""
    if not _CLASSES:
        points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
        every = points.tobytes().decode("utf-32-le")
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start() : m.end()]] = kind
        table[ord(" ")], table[ord("'")] = SPACE, QUOTE
        _CLASSES.append(table)
    return _CLASSES[0]


def codes_of(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by one separator each, their code points, and the separators' places."""
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    return joined, code, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1


def piece_starts(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start; each place in ends holds a separator, which is a piece of its own."""
    n = len(code)
    kind = classes()[code]
    kind[ends] = END
    white = (kind == SPACE) | (kind == WHITE)
    start = np.ones(n, bool)
    run = np.where(kind == QUOTE, OTHER, kind)
    same = run[1:] == run[:-1]
    start[1:] = ~(same & ~white[1:])  # inside a run of letters, digits or signs
    start[1:] &= ~((kind[:-1] == SPACE) & ~white[1:] & (kind[1:] != END))  # one space joins what follows
    both = white[1:] & white[:-1]  # white space goes together but for its last place before a sign
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & (kind[1:] != END)
    start[1:] &= ~(both & ~last[1:])
    start[ends] = True
    start[ends[:-1] + 1] = True
    # contractions: a lone apostrophe that starts a piece
    lone = np.flatnonzero((kind == QUOTE) & start)
    lone = lone[lone + 2 < n]
    a, b = code[lone + 1], code[lone + 2]
    one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for hit, size in ((lone[one], 2), (lone[two & ~one], 3)):
        start[hit + 1] = False
        after = hit + size
        start[after] |= ~(white[after] | (kind[after] == END))
    return np.flatnonzero(start)


#: Characters looked at together: the arrays of a run stay in the processor's cache.
RUN_CHARS = 1 << 17


def piece_lists(texts: list[str]) -> list[list[str]]:
    """The pieces of every text."""
    out: list[list[str]] = []
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= RUN_CHARS or i + 1 == len(texts):
            out.extend(_piece_lists(texts[first : i + 1]))
            first, size = i + 1, 0
    return out


def _piece_lists(texts: list[str]) -> list[list[str]]:
    joined, code, ends = codes_of(texts)
    at = piece_starts(code, ends)
    edges = at.tolist()
    pieces = [joined[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    out, first = [], 0
    for stop in np.searchsorted(at, ends).tolist():
        out.append(pieces[first:stop])
        first = stop + 1
    return out
