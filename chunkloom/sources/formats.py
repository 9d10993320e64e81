"""Structured text found by content: separated values, JSON lines, key=value lines and access logs.

Each format is a triple: parse(text) gives a Grid or None, and Grid.text() gives the exact bytes back. A grid is
columns of strings plus a skeleton: the constant text of every row with a NUL for each value.
"""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass, field


@dataclass
class Grid:
    kind: str
    skeleton: str
    columns: list[list[str]]
    rows: int
    crlf: bool = False
    closed: bool = True  # ends with a line end
    names: list[str] = field(default_factory=list)

    def text(self) -> str:
        end = "\r\n" if self.crlf else "\n"
        parts = self.skeleton.split("\0")
        lines = []
        for r in range(self.rows):
            line = [parts[0]]
            for c, column in enumerate(self.columns):
                line += (column[r], parts[c + 1])
            lines.append("".join(line))
        return end.join(lines) + (end if self.closed else "")


def _lines(text: str, least: int) -> tuple[list[str], bool, bool] | None:
    crlf = text.count("\r\n") == text.count("\n") > 0
    end = "\r\n" if crlf else "\n"
    closed = text.endswith(end)
    lines = text.split(end)
    if closed:
        lines.pop()
    if len(lines) < least or "\0" in text or (not crlf and "\r" in text):
        return None
    return lines, crlf, closed


def parse_separated(text: str, least: int = 8) -> Grid | None:
    """Rectangular values separated by `,`, tab or `;` (tried in this order); quotes have no meaning."""
    found = _lines(text, least)
    if not found:
        return None
    lines, crlf, closed = found
    for mark in (",", "\t", ";"):
        width = lines[0].count(mark) + 1
        if 2 <= width <= 4096 and all(line.count(mark) + 1 == width for line in lines):
            columns = [list(c) for c in zip(*(line.split(mark) for line in lines), strict=True)]
            return Grid("csv", mark.join("\0" * 1 for _ in range(width)), columns, len(lines), crlf, closed, columns and [c[0] for c in columns])
    return None


def _same_skeleton(kind: str, lines: list[str], split, crlf: bool, closed: bool, least: int) -> Grid | None:
    rows = [split(line) for line in lines]
    if any(r is None for r in rows):
        return None
    skeleton = rows[0][0]
    if any(r[0] != skeleton for r in rows) or not least <= len(rows[0][1]) <= 4096:
        return None
    return Grid(kind, skeleton, [list(c) for c in zip(*(r[1] for r in rows), strict=True)], len(lines), crlf, closed)


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')


def split_object(line: str) -> tuple[str, list[str]] | None:
    """A JSON object's skeleton and its top-level values as written; nested values stay opaque."""
    if not (line.startswith("{") and line.endswith("}")):
        return None
    skeleton, values, at, n = ["{"], [], 1, len(line)
    while at < n - 1:
        key = re.compile(r'\s*"(?:[^"\\]|\\.)*"\s*:\s*').match(line, at)
        if not key:
            return None
        skeleton.append(key[0])
        at = begin = key.end()
        depth = 0
        while at < n - 1 or (at < n and depth):
            c = line[at]
            if c == '"':
                s = _STRING.match(line, at)
                if not s:
                    return None
                at = s.end()
                continue
            if c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
            elif c == "," and not depth:
                break
            at += 1
        if depth or at == begin:
            return None
        values.append(line[begin:at])
        skeleton.append("\0")
        if at < n - 1:
            skeleton.append(",")
            at += 1
    return "".join(skeleton) + "}", values


def parse_json_lines(text: str, least: int = 8) -> Grid | None:
    found = _lines(text, least)
    return _same_skeleton("jsonl", found[0], split_object, found[1], found[2], 2) if found else None


_PAIR = re.compile(r'([^\s="]+=)("(?:[^"\\]|\\.)*"|[^\s"]*)')


def split_pairs(line: str) -> tuple[str, list[str]] | None:
    """key=value pairs: keys to the skeleton, values (quotes kept) to columns."""
    skeleton, values, at = [], [], 0
    for m in _PAIR.finditer(line):
        between = line[at : m.start()]
        if between.strip(" ") or (at and not between):
            return None
        skeleton += (between, m[1], "\0")
        values.append(m[2])
        at = m.end()
    return ("".join(skeleton) + line[at:], values) if values and not line[at:].strip(" ") else None


def parse_pairs(text: str, least: int = 6) -> Grid | None:
    found = _lines(text, least)
    return _same_skeleton("logfmt", found[0], split_pairs, found[1], found[2], 2) if found else None


_FIELD = re.compile(r'"(?:[^"\\]|\\.)*"|\[[^\]]*\]|[^\s"\[]\S*')


def split_fields(line: str) -> tuple[str, list[str]] | None:
    """Blank-separated fields; quoted and bracketed ones are whole."""
    skeleton, values, at = [], [], 0
    for m in _FIELD.finditer(line):
        between = line[at : m.start()]
        if between.strip(" \t") or (at and not between):
            return None
        skeleton += (between, "\0")
        values.append(m[0])
        at = m.end()
    return ("".join(skeleton) + line[at:], values) if values and not line[at:].strip(" \t") else None


def parse_access_log(text: str, least: int = 8) -> Grid | None:
    found = _lines(text, least)
    return _same_skeleton("log", found[0], split_fields, found[1], found[2], 4) if found else None


def parse_text(text: str) -> Grid | None:
    """The first format that fits: by the first byte JSON lines or separated values, then pairs, then logs."""
    tries = (parse_json_lines, parse_separated, parse_pairs, parse_access_log) if text.startswith("{") else (parse_separated, parse_pairs, parse_access_log)
    return next((g for p in tries if (g := p(text)) and g.text() == text), None)


_RUN = re.compile(rb"[A-Za-z0-9+/]{62,}={0,2}|[A-Za-z0-9_-]{62,}={0,2}")
#: Wrapped blocks are looked for where a run of 64 characters stands. Their first line has at least 24 characters; later ones may end with padding.
_LONG = re.compile(rb"[A-Za-z0-9+/_-]{64}")
_FIRST = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?=\r?\n)")
_LATER = re.compile(rb"[A-Za-z0-9+/_-]*+={0,2}")


def base64_regions(data: bytes, least: int = 64) -> list[tuple[int, int, str, bytes]]:
    """(start, end, alphabet, decoded) of canonical base64: blocks wrapped at one width, with their line ends, and unbroken runs."""
    out, at = [], 0
    for block in [*_wrapped_blocks(data), None]:
        for m in _RUN.finditer(data, at, block[0] if block else len(data)):
            found = _canonical(m[0]) if len(m[0]) >= least else None
            if found:
                out.append((m.start(), m.end(), *found))
        if block:
            out.append(block)
            at = block[1]
    return out


def _canonical(run: bytes) -> tuple[str, bytes] | None:
    """Alphabet and decoded bytes, if encoding them again gives the run."""
    if len(run) % 4 and run.endswith(b"="):
        return None
    alphabet = "url" if b"-" in run or b"_" in run else "std"
    if alphabet == "url" and (b"+" in run or b"/" in run):
        return None
    body = run.rstrip(b"=")
    if len(body) % 4 == 1:
        return None
    padded = body + b"=" * (-len(body) % 4)
    try:
        plain = base64.b64decode(padded, b"-_" if alphabet == "url" else None, validate=True)
    except binascii.Error:
        return None
    again = base64.b64encode(plain, b"-_" if alphabet == "url" else None)
    return (alphabet, plain) if again.rstrip(b"=") == body and (run == body or run == again) else None


def _wrapped_blocks(data: bytes) -> list[tuple[int, int, str, bytes]]:
    """Base64 of at least two lines (PEM, MIME): all as wide as the first, the last one perhaps narrower, with one kind of line end."""
    out, free = [], 0
    for m in _FIRST.finditer(data) if _LONG.search(data) else ():
        if m.start() < free:
            continue
        width, end = m.end() - m.start(), b"\r\n" if data[m.end()] == 13 else b"\n"
        lines, at = [m[0]], m.end()
        while True:
            at += len(end)
            line = _LATER.match(data, at)
            if not line[0]:
                break
            if line.end() - at > width:  # no later line before this one can begin a block either
                lines, free = [], at
                break
            lines.append(line[0])
            at = line.end()
            if not data.startswith(end, at):
                break
            if len(line[0]) < width or line[0].endswith(b"="):
                at += len(end)
                break
        found = _canonical(b"".join(lines)) if len(lines) > 1 else None
        if found:
            out.append((m.start(), at, *found))
            free = at
    return out


#: Bytes by which blobs are told apart, in order: format, place, bytes (none: bits are tested).
MAGIC = (
    ("gzip", 0, b"\x1f\x8b\x08"),
    ("png", 0, b"\x89PNG\r\n\x1a\n"),
    ("zip", 0, b"PK\x03\x04"),
    ("pdf", 0, b"%PDF-"),
    ("zlib", 0, None),
    ("jpeg", 0, b"\xff\xd8\xff"),
    ("gif", 0, b"GIF8"),
    ("avi", 8, b"AVI "),
    ("wav", 8, b"WAVE"),
    ("aiff", 0, b"FORM"),
    ("bmp", 0, b"BM"),
    ("tiff", 0, b"II*\x00"),
    ("tiff", 0, b"MM\x00*"),
    ("heif", 4, b"ftyp"),
    ("mp4", 4, b"ftyp"),
    ("ts", 0, None),
    ("mp3", 0, b"ID3"),
    ("aac", 0, None),
    ("mp3", 0, None),
    ("h264", 0, b"\x00\x00\x00\x01"),
    ("h264", 0, b"\x00\x00\x01"),
    ("zstd", 0, b"\x28\xb5\x2f\xfd"),
)
#: Brands after `ftyp` that make a file the given format.
BRANDS = {"heif": (b"heic", b"heix", b"hevc", b"heim", b"heis", b"mif1", b"msf1")}
#: Text that is nothing but base64 of 64 characters or more, perhaps wrapped.
BASE64_TEXT = r"^[A-Za-z0-9+/_-]{24,}[A-Za-z0-9+/_-]{40,}={0,2}\s*$|^([A-Za-z0-9+/]{64,76}\r?\n)+[A-Za-z0-9+/]*={0,2}\s*$"


def parse_keys(text: str) -> list[dict]:
    """`<key> [quota] [id=..] [@admin] [name...]` lines; # starts a comment."""
    out = []
    for line in text.splitlines():
        words = line.split("#", 1)[0].split()
        if not words:
            continue
        row = {"key": words[0], "quota": None, "id": None, "admin": False, "name": []}
        for w in words[1:]:
            m = re.fullmatch(r"(\d+)([KkMmGgTt]?)", w)
            if m and row["quota"] is None:
                row["quota"] = int(m[1]) * 1024 ** " KMGT".index(m[2].upper() or " ")
            elif w.startswith("id="):
                row["id"] = w[3:]
            elif w == "@admin":
                row["admin"] = True
            else:
                row["name"].append(w)
        out.append(row | {"name": " ".join(row["name"])})
    return out
