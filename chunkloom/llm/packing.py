"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

Each partition is packed on its own while it streams by, in groups of a bounded number of tokens, so there is
no shuffle. Documents above MAX_PIECE tokens are cut: whole windows first (those are full), the rest into
pieces of at most MAX_PIECE. The pieces of a group are dealt over k = ceil(tokens / capacity) windows by
largest differencing: every piece starts as a partial partition, the two partial partitions with the largest
imbalance are merged with opposing loads until one is left. Where its largest window exceeds the capacity, k
rises by one and the group is partitioned again.

Defined results: a null or empty text is one end-of-document id; repeated rows and null ids are packed each on its
own; sequence ids are unique but not dense; very long texts fill whole windows first; pieces of equal size are dealt in
the order of their documents; an empty table packs to no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import serve, trim
from chunkloom.llm.tokenfst import compiled

CAPACITY = 2048
END_OF_DOCUMENT = 1
#: Longest piece that takes part in the differencing, and the tokens of a group.
MAX_PIECE = 512
GROUP_TOKENS = 128 * CAPACITY


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items over k sets with nearly equal sums: Karmarkar-Karp for k-way partitions.

    A partial partition is a pair (loads ascending, members of each load), shifted so that its smallest load
    is zero; its imbalance is its largest load.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]  # only non-zero loads are kept, descending
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # opposing imbalances: a's largest load meets b's smallest
        room = k - len(a)
        merged = list(a)
        if len(b) <= room:
            merged += b
        else:
            merged += b[:room]
            for j, (load, members) in enumerate(b[room:]):
                at = len(a) - 1 - j
                merged[at] = (merged[at][0] + load, merged[at][1] + members)
        merged.sort(key=lambda x: -x[0])
        if len(merged) == k and merged[-1][0]:
            low = merged[-1][0]
            merged = [(load - low, members) for load, members in merged]
        heapq.heappush(heap, (-merged[0][0], serial, merged))
        serial += 1
    found = [members for _, members in heap[0][2]] if heap else []
    return found + [[] for _ in range(k - len(found))]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of item numbers, each of at most capacity; the number of windows rises until all fit."""
    if not sizes:
        return []
    total = sum(sizes)
    k = -(-total // capacity)
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += 1


def cut(n: int, capacity: int = CAPACITY, piece: int = MAX_PIECE) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of the full windows of a document, and of the pieces of the rest, nearly equal in length."""
    full = [(s, capacity) for s in range(0, n - n % capacity, capacity)]
    rest = n % capacity
    parts = -(-rest // piece)
    edges = [n - rest + rest * i // parts for i in range(parts + 1)] if parts else []
    return full, [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class Packer:
    """Collects the documents of one partition and hands out packed pieces group by group."""

    COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, first_sequence: int, capacity: int) -> None:
        self.next, self.capacity = first_sequence, capacity
        self.open: list[tuple] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        full, rest = cut(n, self.capacity, min(MAX_PIECE, self.capacity))
        view = memoryview(ids)
        for start, length in full:
            self.rows.append((doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n, self.next, 0))
            self.next += 1
        for start, length in rest:
            self.open.append((doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n))
            self.tokens += length
        if self.tokens >= GROUP_TOKENS:
            self.close()

    def close(self) -> None:
        """Pack the open pieces."""
        for window in pack([p[2] for p in self.open], self.capacity):
            at = 0
            for i in window:
                self.rows.append((*self.open[i], self.next, at))
                at += self.open[i][2]
            self.next += 1
        self.open, self.tokens = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(self.COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(self.COLUMNS))


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, place and checksum, and its sequence and offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("tokens")
        tokenizer = compiled(tokenizer_file)
        end = END_OF_DOCUMENT.to_bytes(4, "little")
        packer = Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, capacity)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                packer.add(doc_id, ids + end)
            yield packer.take()
            trim()
        packer.close()
        yield packer.take()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, ", ".join(f"{c} long" for c in Packer.COLUMNS))
