"""Byte-level kernels that SQL can't express: content-defined chunking, sketches, compression sizes."""

from __future__ import annotations

import bz2
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import zstandard

U64 = np.uint64
#: Chunk sizes: average, a quarter of it at least, four times it at most.
AVERAGE = 4096
#: Sketch parameters: transforms, transforms in a super-feature, sampled places.
TRANSFORMS, GROUP, SAMPLE_MASK = 12, 3, 0x0F
MINHASH, SHINGLE = 4, 8


@lru_cache(maxsize=4)
def gear_table(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 pseudo-random 64-bit values from a xorshift generator."""
    out, x = [], seed
    for _ in range(256):
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        out.append(x)
    return np.array(out, U64)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Rolling gear hash at every byte: h[i] = sum of table[data[i - j]] << j over the last 64 bytes.

    Shifted partial sums are doubled: after k rounds every place covers 2 ** k bytes.
    """
    h = table[data]
    span = 1
    while span < 64:
        h[span:] += h[:-span] << U64(span)
        span *= 2
    return h


#: Bytes whose rolling hashes are computed together.
RUN_BYTES = 1 << 20


def cut_points(data: bytes, average: int = AVERAGE) -> list[int]:
    """Ends of content-defined chunks of one blob (see cut_batch)."""
    return cut_batch(np.frombuffer(data, np.uint8), np.array([0, len(data)]), average)[0]


def cut_batch(data: np.ndarray, offsets: np.ndarray, average: int = AVERAGE) -> list[list[int]]:
    """Ends of content-defined chunks of every blob data[offsets[i]:offsets[i + 1]], counted from its start.

    Normalised cutting, stricter before the average size, looser after it. The rolling value starts from zero at the
    minimum size of each chunk; a cut falls after the byte that satisfies the mask; a rest no longer than the minimum
    is one chunk. The hash of a place depends on its last 64 bytes alone, so all places are hashed once, for many blobs
    together; at the first 63 places behind a chunk's minimum, what earlier bytes gave is taken off again.
    """
    out: list[list[int]] = []
    first, n = 0, len(offsets) - 1
    while first < n:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1)
        base = int(offsets[first])
        out += _cut_run(data[base : int(offsets[stop])], (offsets[first : stop + 1] - base).tolist(), average)
        first = stop
    return out


def _cut_run(data: np.ndarray, offsets: list[int], average: int) -> list[list[int]]:
    bits = average.bit_length() - 1
    low, high = average // 4, average * 4
    strict, loose = _mask(bits + 2), _mask(bits - 2)
    h = gear_hashes(data, gear_table())
    stricts, looses = np.flatnonzero((h & strict) == 0), np.flatnonzero((h & loose) == 0)
    shifts = np.arange(1, 64, dtype=U64)

    def hit(begin: int, a: int, b: int, mask: np.uint64, places: np.ndarray) -> int:
        """The first place in [a, b) that satisfies the mask, in a chunk whose rolling value starts at begin; -1 without."""
        edge = begin + 63  # from here on the hash of all bytes is the chunk's own
        if a < edge:
            some = h[a : min(b, edge)]
            if begin:
                some = some - (h[begin - 1] << shifts[a - begin : a - begin + len(some)])
            found = np.flatnonzero((some & mask) == 0)
            if len(found):
                return a + int(found[0])
            a = edge
        k = int(np.searchsorted(places, a))
        return int(places[k]) if k < len(places) and places[k] < b else -1

    out = []
    for start, end in zip(offsets, offsets[1:], strict=False):
        ends, at = [], start
        while at < end:
            rest = end - at
            if rest <= low:
                at = end
            else:
                limit = min(rest, high)
                middle = min(average, limit)
                begin = at + low
                cut = hit(begin, begin, at + middle, strict, stricts)
                if cut < 0:
                    cut = hit(begin, at + middle, at + limit, loose, looses)
                at = cut + 1 if cut >= 0 else at + limit
            ends.append(at - start)
        out.append(ends)
    return out


def _mask(bits: int) -> np.uint64:
    """So many one bits, spread from the top of the word."""
    mask = 0
    for i in range(bits):
        mask |= 1 << (63 - i * 64 // bits)
    return U64(mask)


def super_features(data: bytes) -> list[int]:
    """Four 64-bit features; near-duplicate chunks share one with high probability. Empty for short data."""
    if len(data) < 64:
        return []
    h = gear_hashes(np.frombuffer(data, np.uint8), gear_table())[63:]
    h = h[(h >> U64(60)) & U64(SAMPLE_MASK) == 0] if len(h) > 256 else h
    if not len(h):
        return []
    k = np.arange(1, TRANSFORMS + 1, dtype=U64)
    mult, add = k * U64(0x9E3779B97F4A7C15) | U64(1), k * U64(0xC2B2AE3D27D4EB4F)
    top = (h[None, :] * mult[:, None] + add[:, None]).max(axis=1).reshape(-1, GROUP)
    out = np.full(len(top), 0xCBF29CE484222325, U64)
    for c in range(GROUP):
        out = (out ^ top[:, c]) * U64(0x100000001B3)
    return out.view(np.int64).tolist()


def min_hash(data: bytes) -> list[int] | None:
    """Four minima of linear hashes over all 8-byte shingles; None for less than one shingle."""
    if len(data) < SHINGLE:
        return None
    view = np.frombuffer(data, np.uint8).astype(U64)
    word = np.zeros(len(view) - SHINGLE + 1, U64)
    for j in range(SHINGLE):
        word |= view[j : j + len(word)] << U64(8 * j)
    k = np.arange(1, MINHASH + 1, dtype=U64)
    low = (word[None, :] * (k * U64(0xBF58476D1CE4E5B9) | U64(1))[:, None] + k[:, None] * U64(0x94D049BB133111EB)).min(axis=1)
    return low.view(np.int64).tolist()


def plain_size(data: bytes, level: int = 3) -> int:
    return len(zstandard.ZstdCompressor(level=level).compress(data))


def adaptive(data: bytes) -> tuple[str, int]:
    """Small chunks get the balanced level; larger ones a fast probe, kept raw when nothing is won, else the best level."""
    if len(data) < 128 * 1024:
        size = plain_size(data)
        return ("zstd", size) if size < len(data) else ("raw", len(data))
    fast = plain_size(data, 1)
    if fast * 10 >= len(data) * 9:
        return ("zstd", fast) if fast < len(data) else ("raw", len(data))
    return "zstd", min(fast, plain_size(data, 19))


def bcj(data: bytes, back: bool = False) -> bytes:
    """Operands of the x86 calls and jumps E8 and E9 from relative to absolute, or back; a scan goes on behind an operand."""
    out, at = bytearray(data), 0
    while m := _CALL.search(data, at):
        at = m.end()
        if at + 4 > len(data):
            break
        value = int.from_bytes(data[at : at + 4], "little")
        at += 4
        out[at - 4 : at] = ((value - at if back else value + at) & 0xFFFFFFFF).to_bytes(4, "little")
    return bytes(out)


_CALL = re.compile(b"[\xe8\xe9]")


def best_of(data: bytes) -> tuple[str, int]:
    """The smallest of the offline codecs, with calls rewritten too if it looks like machine code; bzip2 must win by 1.5 %; every winner is decoded again."""
    kinds = [("raw", data, lambda b: b), ("zlib", zlib.compress(data, 9), zlib.decompress)]
    unpack = lambda b: zstandard.ZstdDecompressor().decompress(b, max_output_size=len(data) + 1)
    pack = zstandard.ZstdCompressor(level=22).compress
    kinds.append(("zstd", pack(data), unpack))
    if looks_executable(data):
        kinds.append(("zstd-bcj", pack(bcj(data)), lambda b: bcj(unpack(b), True)))
    name, body, back = min(kinds, key=lambda x: len(x[1]))
    if len(data) <= 12 << 20:
        other = bz2.compress(data, 9)
        if len(other) * 1000 <= len(body) * 985:
            name, body, back = "bzip2", other, bz2.decompress
    if back(body) != data:
        return "raw", len(data)
    return name, len(body)


def delta_size(base: bytes, data: bytes) -> int:
    """Size of data compressed with base as dictionary."""
    if base:
        dictionary = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=dictionary).compress(data))
    return plain_size(data)


def looks_executable(data: bytes) -> bool:
    """Many zero bytes and a plausible share of call and jump opcodes in the first MiB."""
    head = np.frombuffer(data[: 1 << 20], np.uint8)
    if len(head) < 4096:
        return False
    calls = int(((head == 0xE8) | (head == 0xE9)).sum())
    return bool((head == 0).sum() * 50 >= len(head) and len(head) <= calls * 1000 and calls * 100 <= len(head) * 8)


def deflate_parameters(raw: bytes, packed: bytes, wbits: int) -> tuple[int, int, int] | None:
    """(level, memLevel, strategy) with which zlib gives exactly these bytes, likely ones first."""
    for level in (6, 9, 1, 5, 7, 8, 4, 3, 2, 0):
        for memory in (8, 9):
            for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED):
                c = zlib.compressobj(level, zlib.DEFLATED, wbits, memory, strategy)
                if c.compress(raw) + c.flush() == packed:
                    return level, memory, strategy
    return None


def gzip_members(data: bytes, most: int = 1024) -> Iterator[tuple[bytes, bytes, bytes]] | None:
    """(header, deflate stream, plain bytes) of every member, or None when the file isn't whole members."""
    out, at = [], 0
    while at < len(data):
        head = _gzip_header(data, at)
        if len(out) >= most or head is None:
            return None
        d = zlib.decompressobj(-15)
        try:
            plain = d.decompress(data[head:]) + d.flush()
        except zlib.error:
            return None
        end = len(data) - len(d.unused_data)
        trailer = data[end : end + 8]
        if not d.eof or trailer != (zlib.crc32(plain)).to_bytes(4, "little") + (len(plain) & 0xFFFFFFFF).to_bytes(4, "little"):
            return None
        out.append((data[at:head], data[head:end], plain))
        at = end + 8
    return iter(out) if out else None


def _gzip_header(data: bytes, at: int) -> int | None:
    """Where the header that starts here ends; None for another file, or a header that is cut off."""
    if data[at : at + 3] != b"\x1f\x8b\x08" or len(data) < at + 10:
        return None
    flags, head = data[at + 3], at + 10
    if flags & 4:
        head += 2 + int.from_bytes(data[head : head + 2], "little")
    for bit in (8, 16):  # file name and comment end with a zero byte
        if flags & bit:
            head = data.find(0, head) + 1
            if not head:
                return None
    head += 2 if flags & 2 else 0
    return head if head <= len(data) else None
