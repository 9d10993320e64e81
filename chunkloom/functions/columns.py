"""Codecs of one text column, each with its exact inverse."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

_CANON = re.compile(r"0|-?[1-9][0-9]{0,18}")
_DECIMAL = re.compile(r"-?(?:0|[1-9][0-9]*)\.([0-9]+)")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


def _ints(column: list[str]) -> list[int] | None:
    if not all(_CANON.fullmatch(v) for v in column):
        return None
    out = [int(v) for v in column]
    return out if all(-(2**63) <= v < 2**63 for v in out) else None


def _differences(values: list[int], rounds: int = 1) -> list[int]:
    for _ in range(rounds):
        values = [v - (values[i - 1] if i else 0) for i, v in enumerate(values)]
    return values


def _sums(values: list[int], rounds: int = 1) -> list[int]:
    for _ in range(rounds):
        out, total = [], 0
        for v in values:
            total += v
            out.append(total)
        values = out
    return values


def _join(values: list[int]) -> bytes:
    return "\n".join(map(str, values)).encode()


def _split(body: bytes) -> list[int]:
    return [int(v) for v in body.decode().split("\n")]


def encode_delta(column: list[str]) -> bytes | None:
    values = _ints(column)
    return _join(_differences(values)) if values else None


def decode_delta(body: bytes) -> list[str]:
    return [str(v) for v in _sums(_split(body))]


def encode_delta2(column: list[str]) -> bytes | None:
    values = _ints(column) if len(column) >= 3 else None
    return _join(_differences(values, 2)) if values else None


def decode_delta2(body: bytes) -> list[str]:
    return [str(v) for v in _sums(_split(body), 2)]


def encode_decimal(column: list[str]) -> bytes | None:
    """Scaled differences, if all values have the same number of decimals and neighbours are close."""
    found = [_DECIMAL.fullmatch(v) for v in column]
    if not column or not all(found) or len({len(m[1]) for m in found}) > 1 or any(len(v) > 19 or v.startswith("-0") and int(v.replace(".", "")) == 0 for v in column):
        return None
    values = [int(v.replace(".", "")) for v in column]
    moves = _differences(values)
    if sum(map(abs, moves[1:])) * 2 >= sum(map(abs, values)):
        return None
    return _join([len(found[0][1]), *moves])


def decode_decimal(body: bytes) -> list[str]:
    scale, *moves = _split(body)
    out = []
    for v in _sums(moves):
        digits = str(abs(v)).rjust(scale + 1, "0")
        out.append(("-" if v < 0 else "") + digits[:-scale] + "." + digits[-scale:])
    return out


def encode_padded(column: list[str]) -> bytes | None:
    width = len(column[0]) if column else 0
    if not 1 < width <= 19 or not all(len(v) == width and v.isascii() and v.isdigit() for v in column):
        return None
    return _join([width, *_differences([int(v) for v in column])])


def decode_padded(body: bytes) -> list[str]:
    width, *moves = _split(body)
    return [str(v).rjust(width, "0") for v in _sums(moves)]


def encode_hex(column: list[str]) -> bytes | None:
    width = len(column[0]) if column else 0
    if not width or width % 2 or width > 4096 or not all(len(v) == width and re.fullmatch("[0-9a-f]+", v) for v in column):
        return None
    return width.to_bytes(2, "little") + b"".join(bytes.fromhex(v) for v in column)


def decode_hex(body: bytes) -> list[str]:
    step = int.from_bytes(body[:2], "little") // 2
    return [body[i : i + step].hex() for i in range(2, len(body), step)]


def encode_uuid(column: list[str]) -> bytes | None:
    return b"".join(bytes.fromhex(v.replace("-", "")) for v in column) if column and all(_UUID.fullmatch(v) for v in column) else None


def decode_uuid(body: bytes) -> list[str]:
    h = [body[i : i + 16].hex() for i in range(0, len(body), 16)]
    return [f"{v[:8]}-{v[8:12]}-{v[12:16]}-{v[16:20]}-{v[20:]}" for v in h]


def encode_dictionary(column: list[str]) -> bytes | None:
    """Palette in order of appearance and ids of minimal width; refused when half of the values are distinct."""
    order = list(dict.fromkeys(column))
    if not column or len(order) >= min((len(column) + 1) // 2, 65536):
        return None
    ids = {v: i for i, v in enumerate(order)}
    width = 0 if len(order) == 1 else 1 if len(order) <= 256 else 2
    return f"{len(order)} {len(column)} {width}\n".encode() + "\n".join(order).encode() + b"\n" + b"".join(ids[v].to_bytes(width, "little") for v in column)


def decode_dictionary(body: bytes) -> list[str]:
    head, _, rest = body.partition(b"\n")
    kinds, n, width = map(int, head.split())
    order = []
    for _ in range(kinds):
        v, _, rest = rest.partition(b"\n")
        order.append(v.decode())
    return [order[int.from_bytes(rest[i * width : (i + 1) * width], "little")] for i in range(n)]


def encode_raw(column: list[str]) -> bytes:
    return "\n".join(column).encode()


def decode_raw(body: bytes) -> list[str]:
    return body.decode().split("\n")


#: In the order in which ties are won.
CODECS: dict[str, tuple[Callable, Callable]] = {
    "raw": (encode_raw, decode_raw),
    "delta": (encode_delta, decode_delta),
    "delta2": (encode_delta2, decode_delta2),
    "dict": (encode_dictionary, decode_dictionary),
    "decimal": (encode_decimal, decode_decimal),
    "zpad": (encode_padded, decode_padded),
    "hex": (encode_hex, decode_hex),
    "uuid": (encode_uuid, decode_uuid),
}


def best_codec(column: list[str]) -> tuple[str, int]:
    """The codec whose encoding compresses smallest among those that give the column back."""
    best = ("raw", len(zlib.compress(encode_raw(column), 6)))
    for name, (encode, decode) in CODECS.items():
        body = encode(column) if name != "raw" else None
        if body is not None and decode(body) == column and (size := len(zlib.compress(body, 6))) < best[1]:
            best = (name, size)
    return best
