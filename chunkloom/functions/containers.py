"""Compressed streams inside container files: PNG image data, ZIP members, PDF streams.

Each reader yields (offset, packed bytes, plain bytes, wbits). A stream is exact when zlib, with some level, memory
level and strategy, packs the plain bytes into the same packed bytes; others stay in the skeleton untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from chunkloom.functions.kernels import deflate_parameters

Stream = tuple[int, bytes, bytes, int]


def png_streams(data: bytes, most: int = 4096) -> Iterator[Stream]:
    """The image data chunks are one zlib stream."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return
    at, parts, first = 8, [], 0
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            return
        if kind == b"IDAT":
            first = first or at + 8
            parts.append(body)
        at += 12 + size
    if parts and len(parts) <= most:
        packed = b"".join(parts)
        try:
            yield first, packed, zlib.decompress(packed), 15
        except zlib.error:
            return


def zip_streams(data: bytes) -> Iterator[Stream]:
    """Deflated members, from their local headers."""
    at = 0
    while data[at : at + 4] == b"PK\x03\x04" and len(data) >= at + 30:
        method, size = int.from_bytes(data[at + 8 : at + 10], "little"), int.from_bytes(data[at + 18 : at + 22], "little")
        body = at + 30 + int.from_bytes(data[at + 26 : at + 28], "little") + int.from_bytes(data[at + 28 : at + 30], "little")
        if data[at + 6] & 8 and not size:  # sizes follow the data: the stream says where it ends
            d = zlib.decompressobj(-15)
            try:
                d.decompress(data[body:])
            except zlib.error:
                return
            size = len(data) - body - len(d.unused_data)
        packed = data[body : body + size]
        if method == 8:
            try:
                yield body, packed, zlib.decompress(packed, -15), -15
            except zlib.error:
                pass
        at = body + size
        if data[at : at + 4] == b"PK\x07\x08":
            at += 16


_PDF_STREAM = re.compile(rb"stream\r?\n")


def pdf_streams(data: bytes) -> Iterator[Stream]:
    """Whatever inflates after a `stream` keyword."""
    if not data.startswith(b"%PDF-"):
        return
    for m in _PDF_STREAM.finditer(data):
        if data[m.end() : m.end() + 1] != b"x":
            continue
        d = zlib.decompressobj()
        try:
            plain = d.decompress(data[m.end() :])
        except zlib.error:
            continue
        if d.eof:
            packed = data[m.end() : len(data) - len(d.unused_data)]
            yield m.end(), packed, plain, 15


READERS = {"png": png_streams, "zip": zip_streams, "pdf": pdf_streams}


def exact_streams(data: bytes) -> list[tuple[str, int, int, int, bool]]:
    """(kind, offset, packed size, plain size, exact) of all streams found."""
    return [(kind, at, len(packed), len(plain), deflate_parameters(plain, packed, wbits) is not None) for kind, read in READERS.items() for at, packed, plain, wbits in read(data)]
