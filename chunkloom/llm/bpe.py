"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

A text is cut into pieces by a pattern; the distinct pieces not seen before are encoded together. Pieces are
bucketed by length into padded integer matrices, one row per piece. In each round every unfinished row merges
its leftmost pair of minimum rank, found with one hashed lookup of all adjacent pairs, and is compacted by one
place; rows without a mergeable pair leave the matrix. Ids are vocabulary ranks, so decoding is a
concatenation of the vocabulary's byte strings.

A piece above WINDOW bytes would need as many rounds as bytes: it becomes several rows, windows that overlap. Where two
windows have the same token at the same place of their overlap, the first one's tokens up to there and the second
one's from there on are joined. That is exact: a sequence of tokens is the encoding of its bytes when every two
neighbours are neighbours in some encoding, and here all are neighbours in one window. Where an overlap has no such
place, the piece is cut into wider windows, at last into one.

Defined results: null text equals empty text and has no ids; every UTF-8 text decodes to its own bytes; text
that looks like a special token is ordinary text unless the caller cuts it out first; repeated rows and null ids are
encoded one by one; very long texts and pieces are encoded whole; an empty table gives an empty result; further
columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.pretoken import piece_lists

#: Bytes of a window of a long piece, and bytes that neighbouring windows share.
WINDOW, OVERLAP = 512, 128
NO_RANK = np.uint32(0xFFFFFFFF)
FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
PAD = np.uint32(0xFFFFFFFE)
#: Encoded pieces are remembered up to so many, then forgotten together: bounded memory.
CACHE_PIECES = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merge, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(merged) * 4).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, FREE, np.uint64)
        self.values = np.full(1 << self.bits, NO_RANK, np.uint32)
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 1
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == FREE
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]] = key[todo[put]]
            self.values[at[put]] = merged[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            self.probes += bool(len(todo))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right
        slot = self._slot(key)
        at = self.keys[slot]
        out = np.where(at == key, self.values[slot], NO_RANK)
        miss = np.nonzero((at != key) & (at != FREE))
        for _ in range(self.probes):
            if not len(miss[0]):
                break
            step = (slot[miss] + np.uint64(1)) & self.mask
            slot[miss] = step
            at = self.keys[step]
            hit = at == key[miss]
            out[tuple(m[hit] for m in miss)] = self.values[step[hit]]
            miss = tuple(m[~hit & (at != FREE)] for m in miss)
        return out


class MatrixBPE:
    """Encoder and decoder for one rank vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        find = regex.compile(pattern).findall
        self.split = piece_lists if pattern == public_tokenizers.PATTERN else lambda texts: [find(t) for t in texts]
        size = max(ranks.values()) + 1
        self.vocab = [b""] * size
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left, np.uint32), np.array(right, np.uint32), np.array(merged, np.uint32))
        self.lengths = np.array([len(t) for t in self.vocab], np.int64)
        self.flat = np.frombuffer(b"".join(self.vocab), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.known: dict[str, bytes] = {}

    def _matrix(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode the rows of a byte matrix (row i holds sizes[i] bytes): padded ids and their number."""
        width = raw.shape[1]
        cols = np.arange(width)
        ids = self.byte_ids[raw]
        ids[cols[None, :] >= sizes[:, None]] = PAD
        done, count, rows = np.full(ids.shape, PAD, np.uint32), sizes.copy(), np.arange(len(sizes))
        rank = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        while True:
            best = rank.argmin(axis=1)
            at = np.arange(len(rows))
            low = rank[at, best]
            stop = low == NO_RANK
            if stop.any():
                done[rows[stop], : ids.shape[1]] = ids[stop]
                count[rows[stop]] = sizes[stop]
                go = ~stop
                rows, ids, rank, sizes, best, low = rows[go], ids[go], rank[go], sizes[go], best[go], low[go]
                at = at[: len(rows)]
            if not len(rows):
                return done, count
            later = cols[None, : ids.shape[1] - 1] > best[:, None]
            ids = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[at, best] = low
            sizes = sizes - 1
            width = ids.shape[1] - 1
            if not width:
                rank = np.full((len(rows), 1), NO_RANK)
                continue
            rank = np.where(later[:, :width], rank[:, 1:], rank[:, :-1])
            here = np.maximum(best - 1, 0)
            rank[at, here] = self.pairs.lookup(ids[at, here], ids[at, here + 1])
            here = np.minimum(best, width - 1)
            rank[at, here] = self.pairs.lookup(ids[at, here], ids[at, here + 1])

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out = [b"" if (r := rank) is None else r.to_bytes(4, "little") for rank in map(self.ranks.get, pieces)]
        todo = [i for i, ids in enumerate(out) if not ids]
        short = [i for i in todo if len(pieces[i]) <= WINDOW]
        for i, ids in zip(short, self._rows([pieces[i] for i in short]), strict=True):
            out[i] = ids
        for i in todo:
            if len(pieces[i]) > WINDOW:
                out[i] = self._long(pieces[i])
        return out

    def _rows(self, pieces: list[bytes]) -> list[bytes]:
        """encode_pieces by padded matrices, one row a piece."""
        out = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = np.where(size <= 16, size, np.where(size <= 32, (size + 3) // 4 * 4, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)))
        offset = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(pieces) + b"\0" * int(width.max(initial=0)), np.uint8)
        order = np.argsort(width, kind="stable")
        edges = np.flatnonzero(np.diff(width[order], prepend=-1, append=-2))
        for a, b in zip(edges, edges[1:], strict=False):
            w = int(width[order[a]])
            if w == 0:
                continue
            step = max(16, (1 << 16) // w)
            for first in range(a, b, step):
                part = order[first : min(first + step, b)]
                ids, count = self._matrix(flat[offset[part][:, None] + np.arange(w)], size[part])
                buffer, stride = ids.astype("<u4").tobytes(), w * 4
                for j, (k, n) in enumerate(zip(part.tolist(), (count * 4).tolist(), strict=True)):
                    out[k] = buffer[j * stride : j * stride + n]
        return out

    def _long(self, piece: bytes) -> bytes:
        """Ids of a piece of any length, from windows that overlap."""
        width, shared = WINDOW, OVERLAP
        while True:
            starts = range(0, max(1, len(piece) - shared), width - shared)
            rows = [np.frombuffer(ids, "<u4") for ids in self._rows([piece[s : s + width] for s in starts])]
            joined = self._joined(rows, list(starts))
            if joined is not None:
                return joined.astype("<u4").tobytes()
            width, shared = 4 * width, 4 * shared

    def _joined(self, rows: list[np.ndarray], starts: list[int]) -> np.ndarray | None:
        """One sequence of the windows' ids, or None where two windows have no token in common."""
        places = [s + np.cumsum(self.lengths[ids]) - self.lengths[ids] for s, ids in zip(starts, rows, strict=True)]
        out, begin = [], 0
        for i, (ids, at) in enumerate(zip(rows, places, strict=True)):
            if i + 1 == len(rows):
                out.append(ids[begin:])
                break
            _, mine, theirs = np.intersect1d(at[begin:], places[i + 1], assume_unique=True, return_indices=True)
            same = np.flatnonzero(ids[begin:][mine] == rows[i + 1][theirs])
            same = same[mine[same] > 0]  # the token before it is this window's too
            if not len(same):
                return None
            middle = same[len(same) // 2]  # far from both windows' ends
            out.append(ids[begin : begin + mine[middle]])
            begin = int(theirs[middle])
        return np.concatenate(out)

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces (all of them, even where older ones must be forgotten)."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = list(pieces)
        self.known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))

    def encode_batch(self, texts: list[str], cut_bytes: int = 1 << 20) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers. Pieces are gathered over runs of texts."""
        run: list[str] = []
        size = 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= cut_bytes:
                yield from self._emit(self.split(run))
                run, size = [], 0
        yield from self._emit(self.split(run))

    def _emit(self, run: list[list[str]]) -> Iterator[bytes]:
        self.learn({p for pieces in run for p in pieces})
        get = self.known.__getitem__
        for pieces in run:
            yield b"".join(map(get, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, gathered from the flat vocabulary."""
        if not len(ids):
            return b""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = np.repeat(self.starts[ids] - (end - size), size) + np.arange(end[-1])
        return self.flat[at].tobytes()


_ENCODERS: dict[tuple[str, str], MatrixBPE] = {}


def encoder(path: str, pattern: str) -> MatrixBPE:
    """One encoder per worker process and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = MatrixBPE(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


#: Texts handled at once, in characters.
RUN_CHARS = 1 << 20


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, digest of its ids, digest of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for batch in batches:
            counts, id_hex, text_hex = [], [], []
            for ids in bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids) // 4)
                id_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
