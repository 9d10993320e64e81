"""Suffix-array dedup by bucket-pointer refinement: removes every byte of a long string that also starts elsewhere.

1. Anchors. In every WINDOW-byte string the ANCHOR-byte gram with the smallest hash is its anchor (leftmost on ties),
   so equal strings have equal anchors at equal places, and a string needs to meet only the strings of its
   anchor. Each anchor carries the hash of its context, all strings that it anchors, and is dealt by its hash.
2. Anchors that stand once are done. Where an equal context stands elsewhere, all strings of it are repeated.
   Anchors whose contexts differ are open: one occurrence of each distinct context is compared further.
3. Refinement. The open contexts are suffix-sorted to depth WINDOW: initial q-gram buckets are refined by
   sorting on the bucket identifiers of later offsets (q, 2q, ...), with the refined identifiers of one round
   used by the next, and suffixes alone in their bucket dropped. Suffixes that share a bucket at depth WINDOW are
   repeated strings. The strings of an anchor with more than HOT_CONTEXTS open contexts are refined in the same way,
   but spread: each is dealt by the identifiers of its q-gram buckets at offsets 0, q, 2q, ... and sorted on them
   where it lands, so that no task meets a frequent passage as a whole.
4. The marked bytes go back to their documents, which drop them.

Only contexts of open anchors are shuffled besides anchors and the documents that have some. Whole contexts are
told apart by 128 bits, bucket identifiers of spread strings by 64 bits for each of four q-grams, q-grams in the
refinement by 128 bits; a false match has less than one chance in 10^10 even among 10^12 anchors.

Defined results: null text equals empty text; text shorter than WINDOW keeps all bytes; equal texts of WINDOW
bytes or more lose everything, each of them; an id may be null or repeat (rows are told apart by id and text; equal
rows get equal results); very long texts are one text like any other; an empty table gives an empty result;
further columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chunkloom.llm.common import Texts, key_filter, materialize, maybe_in, mix64, partitions, prefix_hash, serve, span_hash, text_slices, trim

WINDOW = 200
ANCHOR = 64
#: First q-gram of the refinement; WINDOW is q times a power of two.
FIRST_GRAM = 50
HOT_CONTEXTS = 512
FLUSH_ANCHORS = 100_000
#: Anchors that a bucket holds on average, and the bytes of text that give one.
ANCHORS_PER_BUCKET, BYTES_PER_ANCHOR = 1_000_000, 68
#: Bytes of text whose anchors are found together, and bytes of contexts that are refined together.
SLICE_BYTES, REFINE_BYTES = 1 << 18, 1 << 20


def anchors(texts: Texts) -> tuple[np.ndarray, ...]:
    """Row, first string, last string (starts within the slice), hash, two context hashes of each anchor.

    Strings of WINDOW bytes that start at first..last (inclusive) are the ones it anchors.
    """
    none = np.zeros(0, np.int64)
    data, n = texts.data, len(texts.data)
    if n < WINDOW:
        return none, none, none, *[none.astype(np.uint64)] * 3
    h = prefix_hash(data)
    at = np.arange(n - ANCHOR + 1)
    grams = span_hash(h, at, at + ANCHOR)
    span = WINDOW - ANCHOR + 1  # grams in a string
    low = sliding_leftmost_min(grams, span)  # of the string that starts at each place
    start = np.arange(n - WINDOW + 1)
    row = np.searchsorted(texts.offsets, start, "right") - 1
    inside = start + WINDOW <= texts.offsets[row + 1]
    start, row, low = start[inside], row[inside], low[inside]
    if not len(start):
        return none, none, none, *[none.astype(np.uint64)] * 3
    new = np.ones(len(start), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    first = start[new]
    last = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
    place = low[new]
    # a context is told by its bytes and by where in it the anchor stands
    inset = (place - first).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    context = [mix64(span_hash(prefix, first, last + WINDOW) ^ inset) for prefix in (h, prefix_hash(data, 2))]
    return row[new], first, last, grams[place], *context


def sliding_leftmost_min(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost minimum of values[i:i + span] for every i, by prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
    # the leftmost place: the first place at or after i that holds the minimum
    same = np.ones(len(least), bool)
    same[1:] = least[1:] != least[:-1]
    out = np.full(len(least), -1, np.int64)
    heads = np.flatnonzero(same)
    todo = heads
    step = 0
    place = np.full(len(heads), -1, np.int64)
    alive = np.arange(len(heads))
    while len(alive):
        hit = padded[todo[alive] + step] == least[todo[alive]]
        place[alive[hit]] = todo[alive[hit]] + step
        alive = alive[~hit]
        step += 1
    out[heads] = place
    group = np.cumsum(same) - 1
    # within a run of equal minima the place moves on when the string has passed it (ties)
    out = place[group]
    passed = np.flatnonzero(out < np.arange(len(out)))
    for i in passed.tolist():
        if out[i] < i:
            out[i] = out[i - 1] if out[i - 1] >= i else i + int(np.argmax(padded[i : i + span] == least[i]))
    return out


def refine(data: np.ndarray, start: np.ndarray, room: np.ndarray, depth: int = WINDOW, first: int = FIRST_GRAM) -> np.ndarray:
    """Bucket identifiers at the given depth of the suffixes data[start:], 0 for those alone in their bucket.

    room: bytes of each suffix; those with fewer than depth take no part in a bucket. depth is first times a
    power of two.
    """
    n = len(data)
    # initial buckets: q-grams, told apart by two independent hashes
    bucket = np.zeros(n + 1, np.int64)
    usable = np.zeros(n + 1, np.int64)  # bytes of context from here on
    usable[start] = room
    here = start[room >= first]
    if not len(here):
        return np.zeros(len(start), np.int64)
    a, b = span_hash(prefix_hash(data, 1), here, here + first), span_hash(prefix_hash(data, 2), here, here + first)
    order = np.lexsort((b, a))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    bucket[here[order]] = np.cumsum(fresh)
    size = first
    while size < depth:
        # only suffixes that share a bucket, and whose later offset does, are sorted again
        here = here[usable[here] >= 2 * size]
        here = here[(bucket[here] > 0) & (bucket[here + size] > 0)]
        a, b = bucket[here], bucket[here + size]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        name = np.cumsum(fresh)
        shared = np.bincount(name, minlength=2)[name] > 1
        bucket[:] = 0
        bucket[here[order[shared]]] = name[shared]
        size *= 2
    return bucket[start]


#: One anchor as it is exchanged, and one that has a verdict. first is a place in the text, extent the strings after it.
ANCHOR_ROW = np.dtype([("id", "<i8"), ("hash", "<i8"), ("first", "<u4"), ("extent", "u1"), ("anchor", "<i8"), ("context", "<i8"), ("other", "<i8")])
JUDGED_ROW = np.dtype([("id", "<i8"), ("hash", "<i8"), ("first", "<u4"), ("extent", "u1"), ("anchor", "<i8"), ("verdict", "u1")])


def _blobs(table: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
    """Each field of a structured table as one blob per stretch between edges."""
    cuts = list(zip(edges.tolist(), edges[1:].tolist(), strict=False))
    return [pa.array([column[a:b].tobytes() for a, b in cuts], pa.binary()) for column in (np.ascontiguousarray(table[name]) for name in table.dtype.names)]


def _table(rows: pa.Table, dtype: np.dtype) -> np.ndarray:
    """The structured table of all blobs of these rows."""
    columns = [np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype[name]) for name in dtype.names]
    out = np.empty(len(columns[0]), dtype)
    for name, column in zip(dtype.names, columns, strict=True):
        out[name] = column
    return out


def _schema(key: str, dtype: np.dtype) -> str:
    return ", ".join([f"{key} int", *(f"{name} binary" for name in dtype.names)])


def _dealt(table: np.ndarray, place: np.ndarray, key: str) -> pa.Table:
    """Rows packed by place."""
    order = np.argsort(place, kind="stable")
    full, first = np.unique(place[order], return_index=True)
    return pa.Table.from_arrays([pa.array(full, pa.int32()), *_blobs(table[order], np.append(first, len(order)))], names=[key, *table.dtype.names])


def _place_of(ids: np.ndarray, hashes: np.ndarray, places: int) -> np.ndarray:
    return (mix64(np.ascontiguousarray(ids).view(np.uint64) ^ np.ascontiguousarray(hashes).view(np.uint64)) % np.uint64(places)).astype(np.int64)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and hash, which tell a row, its text, and the whole row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.col(text_col).isNull().alias(_flag(docs)))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"), row.alias("row"))


def _flag(docs: DataFrame) -> str:
    """A name that no column has, for whether the text is null."""
    return "null" + "_" * max([len(c) for c in docs.columns if c.lower().startswith("null")], default=0)


def anchor_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors by bucket."""

    def pack(held: list[np.ndarray]) -> pa.Table:
        table = np.concatenate(held) if held else np.zeros(0, ANCHOR_ROW)
        # anchors are minima, so their own high bits would crowd the first bucket
        place = (mix64(np.ascontiguousarray(table["anchor"]).view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return _dealt(table, place.astype(np.int64), "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("strings")
        held, size = [], 0
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for texts in text_slices(batch.column(2), SLICE_BYTES):
                row, first, last, anchor, context, other = anchors(texts)
                table = np.empty(len(row), ANCHOR_ROW)
                at = row + texts.first
                table["id"], table["hash"], table["first"], table["extent"] = ids[at], hashes[at], first - texts.offsets[row], last - first
                table["anchor"], table["context"], table["other"] = anchor.view(np.int64), context.view(np.int64), other.view(np.int64)
                held.append(table)
                size += len(row)
                if size >= FLUSH_ANCHORS:
                    yield from pack(held).to_batches()
                    held, size = [], 0
            trim()
        yield from pack(held).to_batches()

    return rows.select("id", "hash", "text").mapInArrow(run, _schema("bucket", ANCHOR_ROW))


#: What an anchor's occurrence needs: all its strings are repeated; its context is compared; or its strings are, by hash.
REPEATED, COMPARE, HOT = 1, 2, 4


def judged_anchors(packed: DataFrame, places: int) -> DataFrame:
    """Packed occurrences of anchors that stand more than once, with their verdict, by document."""

    def run(rows: pa.Table) -> pa.Table:
        trim()
        table = _table(rows, ANCHOR_ROW)
        table = table[np.lexsort((table["first"], table["hash"], table["id"], table["other"], table["context"], table["anchor"]))]
        n = len(table)
        new_anchor, new_context = np.ones(n, bool), np.ones(n, bool)
        new_anchor[1:] = table["anchor"][1:] != table["anchor"][:-1]
        new_context[1:] = new_anchor[1:] | (table["context"][1:] != table["context"][:-1]) | (table["other"][1:] != table["other"][:-1])
        of_anchor, of_context = np.cumsum(new_anchor) - 1, np.cumsum(new_context) - 1
        copies = np.bincount(of_context)[of_context] if n else of_context
        kinds = np.bincount(of_anchor[new_context])[of_anchor] if n else of_anchor
        # a context that isn't shipped has the fate of the one that is, which is repeated already
        ship = new_context & (kinds > 1)
        verdict = np.where(copies > 1, REPEATED, 0) + np.where(ship, np.where(kinds > HOT_CONTEXTS, HOT, COMPARE), 0)
        keep = np.flatnonzero(verdict)
        out = np.empty(len(keep), JUDGED_ROW)
        for name in ("id", "hash", "first", "extent", "anchor"):
            out[name] = table[name][keep]
        out["verdict"] = verdict[keep]
        return _dealt(out, _place_of(out["id"], out["hash"], places), "place")

    return packed.groupBy("bucket").applyInArrow(run, _schema("place", JUDGED_ROW))


def by_document(judged: DataFrame) -> DataFrame:
    """One row a document: its judged anchors as blobs."""

    def run(rows: pa.Table) -> pa.Table:
        trim()
        table = _table(rows, JUDGED_ROW)
        table = table[np.lexsort((table["first"], table["hash"], table["id"]))]
        new = np.ones(len(table), bool)
        new[1:] = (table["id"][1:] != table["id"][:-1]) | (table["hash"][1:] != table["hash"][:-1])
        edges = np.append(np.flatnonzero(new), len(table))
        blobs = _blobs(table[["first", "extent", "anchor", "verdict"]], edges)
        return pa.Table.from_arrays([pa.array(table["id"][edges[:-1]]), pa.array(table["hash"][edges[:-1]]), *blobs], names=["f_id", "f_hash", "first", "extent", "anchor", "verdict"])

    return judged.groupBy("place").applyInArrow(run, "f_id long, f_hash long, first binary, extent binary, anchor binary, verdict binary")


def open_contexts(found: DataFrame, buckets: int) -> DataFrame:
    """Contexts to compare, packed by bucket; those of hot anchors as hashes of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        bodies: list[bytes] = []
        hashed: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out: list[tuple] = []
            if held:
                table = np.array(held, np.int64)
                place = (table[:, 4].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(place).tolist():
                    at = np.flatnonzero(place == b)
                    out.append((b, 0, table[at].astype("<i8").tobytes(), b"".join(bodies[i] for i in at)))
            if hashed:
                table = np.concatenate(hashed)
                place = (np.bitwise_xor.reduce(mix64(table[:, 3:].view(np.uint64) + np.arange(table.shape[1] - 3, dtype=np.uint64)), axis=1) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                edges = np.searchsorted(place[order], np.arange(buckets + 1))
                for b in range(buckets):
                    if edges[b + 1] > edges[b]:
                        out.append((b, 1, table[order[edges[b] : edges[b + 1]]].astype("<i8").tobytes(), b""))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["bucket", "kind", "table", "bytes"])

        for batch in batches:
            for doc, other, text, *blobs in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                first, extent, anchor, verdict = (np.frombuffer(b, JUDGED_ROW[c]) for b, c in zip(blobs, ("first", "extent", "anchor", "verdict"), strict=True))
                first = first.astype(np.int64)
                last = first + extent
                body = text.encode()
                for i in np.flatnonzero(verdict & COMPARE).tolist():
                    held.append(np.array([doc, other, first[i], last[i], anchor[i]], np.int64))
                    bodies.append(body[first[i] : last[i] + WINDOW])
                    size += len(bodies[-1]) + 40
                hot = np.flatnonzero(verdict & HOT)
                if len(hot):
                    start = np.concatenate([np.arange(first[i], last[i] + 1) for i in hot])
                    prefix = prefix_hash(np.frombuffer(body, np.uint8))
                    grams = [span_hash(prefix, start + q, start + q + FIRST_GRAM).view(np.int64) for q in range(0, WINDOW, FIRST_GRAM)]
                    hashed.append(np.column_stack([np.full(len(start), doc), np.full(len(start), other), start, *grams]))
                    size += hashed[-1].nbytes
                if size >= 8 << 20:
                    yield flush()
                    held, bodies, hashed, size = [], [], [], 0
            trim()
        yield flush()

    return found.select("id", "hash", "text", "first", "extent", "anchor", "verdict").mapInArrow(run, "bucket int, kind int, table binary, bytes binary")


def repeated_strings(contexts: DataFrame, places: int) -> DataFrame:
    """Starts of repeated strings, packed by document place."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        tables, bodies = table.column("table").to_pylist(), table.column("bytes").to_pylist()
        plain = [i for i in range(len(kind)) if kind[i] == 0]
        found: list[np.ndarray] = []
        if plain:
            rows = np.concatenate([np.frombuffer(tables[i], "<i8").reshape(-1, 5) for i in plain])
            data = np.frombuffer(b"".join(bodies[i] for i in plain), np.uint8)
            length = rows[:, 3] - rows[:, 2] + WINDOW
            offset = np.cumsum(length) - length
            order = np.argsort(rows[:, 4], kind="stable")
            # whole anchors together, about REFINE_BYTES at a time
            edge = np.flatnonzero(np.diff(rows[order, 4], prepend=rows[order[0], 4] - 1, append=rows[order[-1], 4] + 1))
            total = np.concatenate([[0], np.cumsum(length[order])])[edge]
            a = 0
            while a + 1 < len(edge):
                b = max(a + 1, int(np.searchsorted(total, total[a] + REFINE_BYTES, "right")) - 1)
                part = order[edge[a] : edge[b]]
                found.append(_repeated(rows[part], data, offset[part], length[part]))
                a = b
            trim()
        hot = [i for i in range(len(kind)) if kind[i] == 1]
        if hot:
            rows = np.concatenate([np.frombuffer(tables[i], "<i8").reshape(-1, 3 + WINDOW // FIRST_GRAM) for i in hot])
            rows = rows[np.lexsort(rows[:, :2:-1].T)]  # by the identifiers of all their q-grams, the first one first
            same = np.zeros(len(rows) + 1, bool)
            same[1:-1] = (rows[1:, 3:] == rows[:-1, 3:]).all(1)
            found.append(rows[same[1:] | same[:-1], :3])
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        place = _place_of(rows[:, 0], rows[:, 1], places)
        order = np.argsort(place, kind="stable")
        full = np.unique(place)
        edges = np.searchsorted(place[order], np.append(full, places))
        return pa.Table.from_arrays([pa.array(full, pa.int32()), pa.array([rows[order[a:b]].astype("<i8").tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], names=["place", "rows"])

    return contexts.groupBy("bucket").applyInArrow(run, "place int, rows binary")


def _repeated(rows: np.ndarray, data: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """id, hash, start of the strings that stand in two of these contexts of whole anchors."""
    n = int(length.sum())
    base = np.cumsum(length) - length
    within = np.arange(n) - np.repeat(base, length)
    local = data[np.repeat(offset, length) + within]
    bucket = refine(local, np.arange(n), np.repeat(length, length) - within)
    hit = np.flatnonzero(bucket)
    row = np.searchsorted(base, hit, "right") - 1
    return np.column_stack([rows[row, 0], rows[row, 1], rows[row, 2] + within[hit]])


def strings_of(repeated: DataFrame) -> DataFrame:
    """One row a document: the starts of its repeated strings."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), "<i8").reshape(-1, 3)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        edge = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1), [True]])) if len(rows) else np.zeros(1, np.int64)
        return pa.Table.from_arrays([pa.array(rows[edge[:-1], 0]), pa.array(rows[edge[:-1], 1]), pa.array([rows[a:b, 2].astype("<i8").tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())], names=["s_id", "s_hash", "starts"])

    return repeated.groupBy("place").applyInArrow(run, "s_id long, s_hash long, starts binary")


def covered(n: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """True for the bytes inside any [first, stop)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge[:-1]) > 0


def sized(spark: SparkSession, docs: DataFrame, text_col: str) -> int:
    """Buckets for the anchors of docs: as many as keep each at ANCHORS_PER_BUCKET on average."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    return max(12, partitions(spark), -(-size // (BYTES_PER_ANCHOR * ANCHORS_PER_BUCKET)))


def marked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and row (the other columns) of all rows, with first, extent, verdict of judged anchors and starts of repeated strings (null without).

    Documents without judged anchors, told by a bitmap, are not exchanged; nor are those without repeated strings a second time.
    """
    spark = docs.sparkSession
    rows = _narrow(docs, id_col, text_col)
    buckets = sized(spark, docs, text_col)
    found = materialize(by_document(judged_anchors(anchor_rows(rows, buckets), buckets)), "suffix-marks", free=True)
    marked = maybe_in(rows, F.xxhash64("id", "hash"), key_filter(found, F.xxhash64("f_id", "f_hash")), "maybe")
    names = ["text", "row", "first", "extent", "verdict", "starts"]
    nothing = [F.lit(None).cast("binary").alias(c) for c in names[2:]]
    plain = marked.where("not maybe").select("text", "row", *nothing)
    same = (F.col("id") == F.col("f_id")) & (F.col("hash") == F.col("f_hash"))
    held = materialize(marked.where("maybe").join(found, same, "left").select("id", "hash", "text", "row", "first", "extent", "anchor", "verdict"), "suffix-judged", free=True)
    strings = materialize(strings_of(repeated_strings(open_contexts(held.where("verdict is not null"), buckets), buckets)), "suffix-strings", free=True)
    again = maybe_in(held, F.xxhash64("id", "hash"), key_filter(strings, F.xxhash64("s_id", "s_hash")), "maybe")
    same = (F.col("id") == F.col("s_id")) & (F.col("hash") == F.col("s_hash"))
    joined = again.where("maybe").join(strings, same, "left").select(*names)
    whole = again.where("not maybe").select(*names[:-1], nothing[-1])
    return joined.unionByName(whole).unionByName(plain)


def cut_bytes(text: bytes, first: bytes | None, extent: bytes | None, verdict: bytes | None, starts: bytes | None) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    if verdict is None:
        return text, 0, 0
    whole = np.frombuffer(verdict, JUDGED_ROW["verdict"]) & REPEATED > 0
    begin = np.frombuffer(first, JUDGED_ROW["first"])[whole].astype(np.int64)
    end = begin + np.frombuffer(extent, JUDGED_ROW["extent"])[whole] + WINDOW
    one = np.frombuffer(starts or b"", "<i8")
    gone = covered(len(text), np.concatenate([begin, one]), np.concatenate([end, one + WINDOW]))
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, digest = [], [], [], []
            for text, *marks in zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True):
                body = text.encode()
                kept, gone, runs = cut_bytes(body, *marks)
                size.append(len(body)), removed.append(gone), spans.append(runs), digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = marked_documents(narrow, "doc_id", "text").select("row.doc_id", "text", "first", "extent", "verdict", "starts")
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the repeated bytes cut out of their texts (a character cut in two goes whole); lengths follow.

    A null text stays null, an emptied one is empty; every row stays, repeated ones and null ids too; an empty table
    stays empty; columns may have any names.
    """
    row_type = _narrow(docs, id_col, text_col).schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_bytes(text.encode(), *marks)[0].decode(errors="ignore") for text, *marks in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(5)], ["text", "row"])
            trim()

    marked = marked_documents(docs, id_col, text_col).select("text", "first", "extent", "verdict", "starts", "row")
    cut = marked.mapInArrow(run, StructType([StructField("text", StringType()), StructField("row", row_type)]))
    row = lambda c: F.col("row").getField(c)
    text = F.when(~row(_flag(docs)), F.col("text"))
    out = {c: text if c == text_col else row(c) for c in docs.columns}
    if length_col in out:
        out[length_col] = F.coalesce(F.length(text).cast(docs.schema[length_col].dataType), out[length_col])
    return cut.select(*(out[c].alias(c) for c in docs.columns))
