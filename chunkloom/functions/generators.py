"""Synthetic blobs for benchmarks: log lines, Zipf-like text, noise, and generations of a backup."""

from __future__ import annotations

import random
from collections.abc import Iterator


def log_lines(size: int, seed: int = 1) -> bytes:
    rng, out, total, at = random.Random(seed), [], 0, 1_700_000_000
    while total < size:
        at += rng.randrange(3)
        line = f"{at} {rng.choice(('INFO', 'WARN', 'ERROR'))} worker-{rng.randrange(8)} request {rng.getrandbits(64):016x} took {rng.randrange(2000)}ms\n"
        out.append(line)
        total += len(line)
    return "".join(out).encode()[:size]


def zipf_text(size: int, words: int = 4000, seed: int = 1) -> bytes:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    out = b""
    while len(out) < size:
        out += " ".join(rng.choices(vocabulary, weights, k=2000)).encode() + b"\n"
    return out[:size]


def noise(size: int, seed: int = 1) -> bytes:
    return random.Random(seed).randbytes(size)


def generations(base: bytes, count: int, share: float = 0.001, scattered: bool = True, seed: int = 1) -> Iterator[bytes]:
    """The base, then copies with a share of the bytes edited, all over or in one place."""
    rng, now = random.Random(seed), bytearray(base)
    for _ in range(count):
        yield bytes(now)
        edits = max(1, int(len(now) * share / 16))
        start = rng.randrange(max(1, len(now) - edits * 16))
        for e in range(edits):
            at = rng.randrange(max(1, len(now) - 16)) if scattered else start + e * 16
            now[at : at + 16] = rng.randbytes(16)
