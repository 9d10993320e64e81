"""Structured text blobs: format detection, grids, per-column codec choice, containers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import containers, kernels
from chunkloom.sources import formats


def sniff(data: Column) -> Column:
    """The first format whose bytes fit, in the order of formats.MAGIC; then base64 text, other text, or binary.

    All tests look at fixed places of the head, so the chain is one column expression.
    """
    at = lambda start, n: F.substring(data, start + 1, n)
    byte = lambda start: F.conv(F.hex(at(start, 1)), 16, 10).cast("int")
    text = F.try_validate_utf8(data.cast("binary").cast("string"))
    out = F.when(text.isNull(), "binary").when(text.rlike(formats.BASE64_TEXT), "base64").otherwise("text")
    zlib_head = (byte(0).bitwiseAND(F.lit(15)) == 8) & (byte(0) < 128) & ((byte(0) * 256 + byte(1)) % 31 == 0)
    adts = (byte(0) == 255) & (byte(1).bitwiseAND(F.lit(0xF6)) == 0xF0)
    frame = (byte(0) == 255) & (byte(1).bitwiseAND(F.lit(0xE0)) == 0xE0) & (byte(1).bitwiseAND(F.lit(0x06)) != 0)
    packets = (byte(0) == 0x47) & (byte(188) == 0x47) & (byte(376) == 0x47)
    tests = {"zlib": zlib_head, "aac": adts, "mp3": frame, "ts": packets}
    for kind, offset, magic in reversed(formats.MAGIC):
        fits = tests[kind] if magic is None else at(offset, len(magic)) == F.lit(magic)
        if kind in formats.BRANDS:
            fits &= at(8, 4).isin([F.lit(b) for b in formats.BRANDS[kind]])
        out = F.when(fits, kind).otherwise(out)
    return out


def grids(blobs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, kind, skeleton, rows, columns, exact (the text comes back byte by byte); kind is null for free text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [formats.parse_text(t) if t else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([g.kind if g else None for g in found], pa.string()),
                    pa.array([g.skeleton.replace("\0", "?") if g else None for g in found], pa.string()),
                    pa.array([g.rows if g else None for g in found], pa.int64()),
                    pa.array([len(g.columns) if g else None for g in found], pa.int64()),
                    pa.array([g.text() == t if g else None for g, t in zip(found, batch.column(1).to_pylist(), strict=True)], pa.bool_()),
                ],
                ["id", "kind", "skeleton", "n_rows", "n_columns", "exact"],
            )

    return blobs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, kind string, skeleton string, n_rows long, n_columns long, exact boolean")


def cells(blobs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Long form of the grids: id, row, col, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = formats.parse_text(text or "")
                if g:
                    n, m = g.rows, len(g.columns)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * (n * m), pa.int64()), pa.array([r for _ in range(m) for r in range(n)], pa.int64()), pa.array([c for c in range(m) for _ in range(n)], pa.int32()), pa.array([v for c in g.columns for v in c], pa.string())], ["id", "row", "col", "value"])

    return blobs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, row long, col int, value string")


def column_codecs(blobs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, col, codec, bytes: for every column the codec whose encoding compresses best; earlier ones win ties."""
    from chunkloom.functions.columns import best_codec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = formats.parse_text(text or "")
                for c, column in enumerate(g.columns if g else []):
                    codec, size = best_codec(column)
                    out.append((key, c, codec, size, len(zlib.compress("\n".join(column).encode(), 6))))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["id", "col", "codec", "bytes", "raw_bytes"])

    return blobs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, col int, codec string, bytes long, raw_bytes long")


def base64_parts(blobs: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """id, start, stop, alphabet, plain_size of every canonical base64 run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, a, b, kind, len(plain)) for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b, kind, plain in formats.base64_regions(data or b"")]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())], ["id", "start", "stop", "alphabet", "plain_size"])

    return blobs.select(F.col(id_col).cast("long"), F.col(data_col).cast("binary")).mapInArrow(run, "id long, start long, stop long, alphabet string, plain_size long")


def deflate_recipes(blobs: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """id, kind, member, plain_size, level, mem_level, strategy of gzip members and zlib streams that zlib reproduces bit by bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = data or b""
                members = kernels.gzip_members(data)
                if members:
                    rows = [(key, "gzip", i, len(plain), *(kernels.deflate_parameters(plain, body, -15) or (None,) * 3)) for i, (_, body, plain) in enumerate(members)]
                elif len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0:
                    try:
                        plain = zlib.decompress(data)
                        rows = [(key, "zlib", 0, len(plain), *(kernels.deflate_parameters(plain, data, 15) or (None,) * 3))]
                    except zlib.error:
                        rows = []
                else:
                    rows = []
                if all(r[4] is not None for r in rows):  # one member that isn't exact rejects the file
                    out += rows
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "kind", "member", "plain_size", "level", "mem_level", "strategy"])

    return blobs.select(F.col(id_col).cast("long"), F.col(data_col).cast("binary")).mapInArrow(run, "id long, kind string, member int, plain_size long, level int, mem_level int, strategy int")


def inner_grids(blobs: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """id, outer, inner, n_rows, n_columns, plain_size, exact: compressed logs and tables, unpacked and parsed again.

    outer is gzip, gzip-multi, zlib or zip; inner is the format of the plain bytes (base64 where no grid fits), null when
    none does. exact says that the grid gives the plain bytes back and that zlib packs these into the file's own streams.
    """

    def one(data: bytes) -> tuple:
        outer, streams = None, []
        members = list(kernels.gzip_members(data) or ())
        if members:
            outer, streams = ("gzip" if len(members) == 1 else "gzip-multi"), [(plain, body, -15) for _, body, plain in members]
        elif data[:4] == b"PK\x03\x04":
            outer, streams = "zip", [(plain, body, bits) for _, body, plain, bits in containers.zip_streams(data)]
        elif len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0:
            d = zlib.decompressobj()
            try:
                plain = d.decompress(data) + d.flush()
                outer, streams = ("zlib", [(plain, data, 15)]) if d.eof and not d.unused_data else (None, [])
            except zlib.error:
                pass
        if not streams or any(kernels.deflate_parameters(plain, body, bits) is None for plain, body, bits in streams):
            return outer, None, None, None, None, None
        whole = b"".join(plain for plain, _, _ in streams)
        try:
            grid = formats.parse_text(whole.decode())
        except UnicodeDecodeError:
            grid = None
        if grid:
            return outer, grid.kind, grid.rows, len(grid.columns), len(whole), grid.text().encode() == whole
        regions = formats.base64_regions(whole)
        return outer, "base64" if regions else None, len(regions) or None, None, len(whole), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(data or b"") for data in batch.column(1).to_pylist()]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "outer", "inner", "n_rows", "n_columns", "plain_size", "exact"])

    return blobs.select(F.col(id_col).cast("long"), F.col(data_col).cast("binary")).mapInArrow(run, "id long, outer string, inner string, n_rows long, n_columns long, plain_size long, exact boolean")


def _fixture(pack) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: pack(t.encode())), "binary")


def gzip_text(text: Column, members: int = 1) -> Column:
    """Gzip of a text with zlib's level 6, cut into so many members after line ends (a fixture for the container plans)."""
    import gzip

    def pack(body: bytes) -> bytes:
        cuts = [body.rfind(b"\n", 0, len(body) * i // members) + 1 for i in range(1, members)]
        edges = sorted({0, *cuts, len(body)})
        parts = [body[a:b] for a, b in zip(edges, edges[1:], strict=False)] or [b""]
        return b"".join(gzip.compress(p, 6, mtime=0) for p in parts)

    return _fixture(pack)(text)


def zlib_text(text: Column) -> Column:
    """A zlib stream of level 9 (a fixture)."""
    return _fixture(lambda body: zlib.compress(body, 9))(text)


def png_text(text: Column) -> Column:
    """A grey PNG whose rows are the bytes of the text, 64 wide, its image data in two chunks (a fixture)."""

    def pack(body: bytes) -> bytes:
        rows = max(1, -(-len(body) // 64))
        packed = zlib.compress(b"".join(b"\0" + body[64 * r : 64 * r + 64].ljust(64, b"\0") for r in range(rows)), 6)
        half = len(packed) // 2
        head = (64).to_bytes(4, "big") + rows.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
        chunks = [(b"IHDR", head), (b"IDAT", packed[:half]), (b"IDAT", packed[half:]), (b"IEND", b"")]
        return b"\x89PNG\r\n\x1a\n" + b"".join(len(c).to_bytes(4, "big") + k + c + zlib.crc32(k + c).to_bytes(4, "big") for k, c in chunks)

    return _fixture(pack)(text)


def pdf_text(text: Column) -> Column:
    """A PDF with the text in two deflated streams (a fixture)."""

    def pack(body: bytes) -> bytes:
        half = len(body) // 2
        streams = [zlib.compress(part, 6) for part in (body[:half], body[half:])]
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream endobj\n" % (i + 1, len(x), x) for i, x in enumerate(streams)) + b"%%EOF"

    return _fixture(pack)(text)


def container_streams(blobs: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """id, kind, offset, packed_size, plain_size, exact of the streams inside PNG, ZIP and PDF files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, *row) for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in containers.exact_streams(data or b"")]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "kind", "offset", "packed_size", "plain_size", "exact"])

    return blobs.select(F.col(id_col).cast("long"), F.col(data_col).cast("binary")).mapInArrow(run, "id long, kind string, offset long, packed_size long, plain_size long, exact boolean")


def zip_text(text: Column) -> Column:
    """A ZIP file with the text as its one member (a fixture for the container plans)."""
    import io
    import zipfile

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        def one(t: str) -> bytes:
            body = io.BytesIO()
            with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(zipfile.ZipInfo("a.txt"), t.encode(), zipfile.ZIP_DEFLATED)
            return body.getvalue()

        return s.map(one)

    return pack(text)
