"""Exact n-gram Jaccard join by set-relation skipping, reported as connected components.

1. Every text becomes its set of word shingles (64-bit tokens); equal sets are one node (a 128-bit digest). Sets
   are numbered inside blocks of at most BLOCK_SETS, so that a token costs about eight bytes in the one exchange
   that all tokens take, however many buckets there are.
2. A token table, dealt by token, finds the tokens that stand in two sets or more; copies of an equal set in other
   blocks are taken off again once the sets are gathered by node. Only shared tokens can be in an intersection,
   so a set lives on if at least three quarters of its tokens are shared, and only those tokens of it are kept
   (rarest first) together with its full size.
3. Linking: every live set goes, with its tokens, to a few of its prefix tokens' lists; lists longer than
   GROUP_SETS are dealt over salted parts. Inside a part the join is exact and skips: index lists are cut by
   position (sets in order of size), sets in one component are not compared again, a set's overlaps are
   derived from those of a highly similar set by the tokens in which the two differ, and the triangle
   inequality of the Jaccard distance skips sets that a common leader tells apart.
4. What remains: sets that share a prefix token, pass the size and position filters, stand in different
   components and met in no part. Prefix tokens whose holders are all in one component drop out first. The set
   in the smaller component visits the larger component, whose members are dealt over parts of bounded size; a
   visitor counts its overlaps with a whole part in one pass. On a token that more than GROUP_SETS sets hold
   every set outside the token's largest component visits that one, and the rest meet block by block. Pairs
   are never emitted. No link between different texts is lost, because two linked sets share a prefix
   token, and two sets that do are either compared, or already connected, or shown to be unlinked by an exact
   bound.

Tokens are told apart by 64 bits and compared only between two sets at a time: with sets of 500 tokens that
goes wrong once in about 10^14 comparisons. A clash of tokens over the whole corpus makes a token look shared,
which costs time and changes nothing.

Defined results: null or empty text, or text without words, has an empty set, no links and its own id as
component; text with fewer than five words is one shingle; equal texts share a component; a null id takes the
smallest id it is linked with; repeated rows are reported once each; very long texts are one set like any
other; an empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import drop_table, key_filter, materialize, maybe_in, mix64, serve, text_slices, trim
from chunkloom.llm.components import components
from chunkloom.llm.shingles import set_digest, shingle_sets

#: Jaccard threshold NUMERATOR / DENOMINATOR: 0.75.
NUMERATOR, DENOMINATOR = 3, 4
#: Tokens handled together by one task of the token table and of the later steps, sets of a block, and tokens after which a block is closed early.
BUCKET_TOKENS = 3_000_000
GROUP_TOKENS = 1_000_000
BLOCK_SETS = 256
BLOCK_TOKENS = 500_000
#: Bytes of text whose shingles are made together.
SLICE_BYTES = 1 << 19
#: Bytes of text that give one token at least, to size the token table; buckets that small inputs have.
TOKEN_BYTES = 6
LEAST_BUCKETS = 12
#: Sets that are linked together in one part, parts each set goes to, and count vectors kept as leaders.
GROUP_SETS = 2048
ROUTES = 3
LEADERS = 8
#: Digests remembered in a partition to send equal sets once.
SEEN_SETS = 400_000
#: Rows up to which a narrow table (under 64 bytes a row) is broadcast; larger ones are joined by an exchange.
BROADCAST_ROWS = 100_000

TOKENS, SETS, ROWS = 0, 1, 2


def least_overlap(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Smallest intersection of two sets of these sizes that makes a link: 100 * i >= 75 * (a + b - i)."""
    return -(-(NUMERATOR * (a + b)) // (NUMERATOR + DENOMINATOR))


def least_shared(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of size n shares with any partner at least."""
    return -(-(NUMERATOR * n) // DENOMINATOR)


def pack_tokens(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending tokens as their low 48 bits and the steps of their high 16 bits (mostly 0 or 1, so they compress)."""
    high = (tokens >> np.uint64(48)).astype(np.int64)
    low = (tokens & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((tokens >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes()
    return low, np.diff(high, prepend=0).astype("<u2").tobytes()


def unpack_tokens(low: bytes, steps: bytes) -> np.ndarray:
    n = len(low) // 6
    tokens = np.frombuffer(low, "<u4", n).astype(np.uint64) | np.frombuffer(low, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)
    return tokens | np.cumsum(np.frombuffer(steps, "<u2"), dtype=np.uint64) << np.uint64(48)


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


BLOCK_SCHEMA = "place int, kind int, block long, a binary, b binary, c binary, d binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(BLOCK_NAMES)
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]


def token_rows(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Packed rows of three kinds, all from one pass over the texts.

    TOKENS: of one block and bucket, the tokens in order with the set's number in the block. SETS: digest and
    size of a block's sets, each set once a partition. ROWS: id, mark (hash of the text), size and digest of every row.
    """

    def close(held: list[tuple[bytes, np.ndarray]], seen_rows: list[tuple]) -> list[tuple]:
        nodes = b"".join(node for node, _ in held)
        block = int.from_bytes(hashlib.blake2b(nodes, digest_size=8).digest(), "little", signed=True)
        home = block % buckets
        out: list[tuple] = []
        if held:
            counts = np.array([len(t) for _, t in held], np.int64)
            tokens = np.concatenate([t for _, t in held])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], np.repeat(np.arange(len(held)), counts)[order].astype(np.uint8)
            edges = np.searchsorted(_bucket(tokens, buckets), np.arange(buckets + 1)).tolist()
            for b, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                if e > s:
                    out.append((b, TOKENS, block, owner[s:e].tobytes(), *pack_tokens(tokens[s:e]), b""))
            out.append((home, SETS, block, nodes, counts.astype("<u4").tobytes(), b"", b""))
        if seen_rows:
            ids, marks, sizes, digests = zip(*seen_rows, strict=True)
            known = np.array([i is not None for i in ids], np.uint8)
            out.append((home, ROWS, block, np.array([i or 0 for i in ids], "<i8").tobytes() + known.tobytes(), np.array(marks, "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), b"".join(d or bytes(16) for d in digests)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("sets")
        seen: set[bytes] = set()
        held: list[tuple[bytes, np.ndarray]] = []
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for texts in text_slices(batch.column(2), SLICE_BYTES):
                for i, tokens in enumerate(shingle_sets(texts), texts.first):
                    node = set_digest(tokens) if len(tokens) else None
                    rows.append((ids[i], marks[i], len(tokens), node))
                    if node is None or node in seen:
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(node)
                    held.append((node, tokens))
                    size += len(tokens)
                    if size >= BLOCK_TOKENS or len(held) == BLOCK_SETS:
                        yield pa.RecordBatch.from_arrays(_batch(close(held, rows)), BLOCK_NAMES)
                        held, rows, size = [], [], 0
            trim()
        yield pa.RecordBatch.from_arrays(_batch(close(held, rows)), BLOCK_NAMES)

    mark = F.xxhash64(F.col(text_col))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, BLOCK_SCHEMA)


def _first_of(blocks: np.ndarray, rows: np.ndarray) -> list[int]:
    """Of these rows the first of each block: blocks of equal content are one block."""
    return rows[np.sort(np.unique(blocks[rows], return_index=True)[1])].tolist()


def shared_tokens(rows: DataFrame, buckets: int) -> DataFrame:
    """Tokens that stand in two sets of the blocks or more, with their frequency, dealt by block; other rows pass through."""

    def run(table: pa.Table) -> pa.Table:
        trim()  # what the task before left
        kind, block = table.column("kind").to_numpy(), table.column("block").to_numpy()
        a, b, c, d = (table.column(x).to_pylist() for x in "abcd")
        out = [(int(block[i]) % buckets, int(kind[i]), int(block[i]), a[i], b[i], c[i], d[i]) for i in np.flatnonzero(kind != TOKENS).tolist()]
        mine = _first_of(block, np.flatnonzero(kind == TOKENS))
        if mine:
            tokens = np.concatenate([unpack_tokens(b[i], c[i]) for i in mine])
            counts = np.array([len(a[i]) for i in mine])
            owner = np.repeat(np.arange(len(mine), dtype=np.int32), counts) << 8 | np.frombuffer(b"".join(a[i] for i in mine), np.uint8)
            del a, b, c, d
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            del order
            edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
            frequency = np.repeat(np.diff(edge), np.diff(edge))
            keep = frequency > 1
            tokens, owner, frequency = tokens[keep], owner[keep], frequency[keep]
            order = np.argsort(owner >> 8, kind="stable")  # by block, tokens in order
            tokens, owner, frequency = tokens[order], owner[order], frequency[order]
            edges = np.searchsorted(owner >> 8, np.arange(len(mine) + 1)).tolist()
            for i, s, e in zip(mine, edges, edges[1:], strict=False):
                if e > s:
                    out.append((int(block[i]) % buckets, TOKENS, int(block[i]), (owner[s:e] & 255).astype(np.uint8).tobytes(), *pack_tokens(tokens[s:e]), frequency[s:e].astype("<u4").tobytes()))
        return pa.Table.from_arrays(_batch(out), BLOCK_NAMES)

    return rows.groupBy("place").applyInArrow(run, BLOCK_SCHEMA)


def gathered_sets(shared: DataFrame) -> DataFrame:
    """Rows of docs (kind ROWS: doc_id, mark, n, node) and sets that can have a partner (kind SETS: node, n, tokens, frequency)."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        kind, block = table.column("kind").to_numpy(), table.column("block").to_numpy()
        a, b, c, d = (table.column(x).to_pylist() for x in "abcd")
        parts: list[pa.Table] = []
        names = ["kind", "doc_id", "mark", "n", "node", "tokens", "frequency"]
        for i in np.flatnonzero(kind == ROWS).tolist():
            m = len(a[i]) // 9
            ids = pa.array(np.frombuffer(a[i], "<i8", m), mask=np.frombuffer(a[i], np.uint8, m, 8 * m) == 0)
            sizes = np.frombuffer(c[i], "<u4").astype(np.int64)
            nodes = pa.array([d[i][16 * j : 16 * j + 16] if sizes[j] else None for j in range(m)], pa.binary())
            nothing = pa.nulls(m, pa.binary())
            parts.append(pa.Table.from_arrays([pa.array(np.full(m, ROWS, np.int32)), ids, pa.array(np.frombuffer(b[i], "<i8")), pa.array(sizes), nodes, nothing, nothing], names))
        sets = _first_of(block, np.flatnonzero(kind == SETS))
        found: dict[int, list[int]] = {}
        for i in np.flatnonzero(kind == TOKENS).tolist():
            found.setdefault(int(block[i]), []).append(i)
        for s in sets:
            rows = found.get(int(block[s]), [])
            if not rows:
                continue
            sizes = np.frombuffer(b[s], "<u4").astype(np.int64)
            owner = np.frombuffer(b"".join(a[i] for i in rows), np.uint8)
            tokens = np.concatenate([unpack_tokens(b[i], c[i]) for i in rows])
            frequency = np.frombuffer(b"".join(d[i] for i in rows), "<u4")
            order = np.lexsort((tokens, frequency, owner))
            tokens, owner, frequency = tokens[order], owner[order], frequency[order]
            edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
            live = np.flatnonzero(np.diff(edges) >= least_shared(sizes))
            cut = [slice(edges[i], edges[i + 1]) for i in live]
            m = len(live)
            columns = [
                pa.array(np.full(m, SETS, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(sizes[live]),
                pa.array([a[s][16 * i : 16 * i + 16] for i in live.tolist()], pa.binary()),
                pa.array([tokens[x].astype("<u8").tobytes() for x in cut], pa.binary()),
                pa.array([frequency[x].astype("<u4").tobytes() for x in cut], pa.binary()),
            ]
            parts.append(pa.Table.from_arrays(columns, names))
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("tokens", pa.binary()), ("frequency", pa.binary())])
        return pa.concat_tables([p.cast(schema) for p in parts]) if parts else schema.empty_table()

    return shared.groupBy("place").applyInArrow(run, "kind int, doc_id long, mark long, n long, node binary, tokens binary, frequency binary")


def prefix_of(n: int, shared: int) -> int:
    """How many of the shared tokens (rarest first) are in the prefix of a set of size n: all others of it stand before them."""
    return shared - least_shared(n) + 1


def routes_of(node: bytes, n: int, tokens: np.ndarray, frequency: np.ndarray) -> list[int]:
    """Parts in which a set is linked: its most frequent prefix tokens, long lists dealt by the set's hash."""
    length = prefix_of(n, len(tokens))
    picks = dict.fromkeys((length - 1, (length - 1) // 2, 0))
    seed = int.from_bytes(node[:8], "little")
    out = []
    for r, i in enumerate(list(picks)[:ROUTES]):
        parts = -(-int(frequency[i]) // GROUP_SETS)
        salt = int(mix64(np.array([(seed + 0x9E3779B9 * (r + 1)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] % np.uint64(parts)) if parts > 1 else 0
        out.append(int(mix64(np.array([(int(tokens[i]) + 0x51ED27 * salt) & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0]))
    return list(dict.fromkeys(out))


def live_sets(gathered: DataFrame, groups: int) -> DataFrame:
    """node, n, tokens (rarest first), heavy (prefix tokens in more than GROUP_SETS sets), routes: each set once.

    A set that came from several blocks counted its own copies as holders of its tokens; they are taken off, and
    the set lives only if enough of its tokens stand in other sets.
    """

    def run(table: pa.Table) -> pa.Table:
        trim()
        nodes, sizes = table.column("node").to_pylist(), table.column("n").to_numpy()
        tokens, frequency = table.column("tokens").to_pylist(), table.column("frequency").to_pylist()
        copies: dict[bytes, int] = {}
        first: dict[bytes, int] = {}
        for i, node in enumerate(nodes):
            copies[node] = copies.get(node, 0) + 1
            first.setdefault(node, i)
        out = []
        for node, i in first.items():
            t, f = np.frombuffer(tokens[i], "<u8"), np.frombuffer(frequency[i], "<u4")
            others = f > copies[node]
            t, f = t[others], f[others]
            if len(t) < least_shared(int(sizes[i])):
                continue
            m = prefix_of(int(sizes[i]), len(t))
            out.append((node, int(sizes[i]), t.tobytes(), int((f[:m] > GROUP_SETS).sum()), routes_of(node, int(sizes[i]), t, f)))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "tokens", "heavy", "routes"])

    dealt = gathered.select("node", "n", "tokens", "frequency").groupBy(F.pmod(F.xxhash64("node"), F.lit(groups)).alias("g"))
    return dealt.applyInArrow(run, "node binary, n long, tokens binary, heavy int, routes array<long>")


class Part:
    """Exact links inside one list of sets, with skipping."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray]) -> None:
        order = np.argsort(sizes, kind="stable")
        self.order, self.size = order, sizes[order]
        lengths = np.array([len(sets[i]) for i in order])
        _, dense = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        self.edges = np.concatenate([[0], np.cumsum(lengths)])
        self.tokens = dense
        owner = np.repeat(np.arange(len(order)), lengths)
        by = np.argsort(dense, kind="stable")  # within a token: sets in order of size
        self.lists = owner[by]
        self.starts = np.searchsorted(dense[by], np.arange(int(dense.max()) + 2 if len(dense) else 1))
        self.root = np.arange(len(order))
        self.leaders: list[tuple[int, np.ndarray]] = []
        self.derived = 0

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.edges[i] : self.edges[i + 1]]

    def tally(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        first, n = self.starts[tokens], self.starts[tokens + 1] - self.starts[tokens]
        total = int(n.sum())
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
        return np.bincount(self.lists[at], minlength=len(self.size))

    def overlaps(self, i: int) -> np.ndarray:
        """Overlap of set i with every set: derived from a similar leader, else counted from the lists."""
        best = max(self.leaders, key=lambda leader: leader[1][i], default=None)
        if best is not None and 2 * best[1][i] >= len(self.of(i)):
            mine, theirs = self.of(i), self.of(best[0])
            plus, minus = np.setdiff1d(mine, theirs, True), np.setdiff1d(theirs, mine, True)
            if len(plus) + len(minus) < len(mine):
                self.derived += 1
                return best[1] + self.tally(plus) - self.tally(minus)
        return self.tally(self.of(i))

    def links(self) -> list[tuple[int, int]]:
        """Links that connect what all links connect, as pairs of the caller's numbers."""
        g, size = len(self.size), self.size
        out: list[tuple[int, int]] = []
        # window of sizes: partners of i stand in [low[i], high[i])
        high = np.searchsorted(size, size * DENOMINATOR // NUMERATOR, "right")
        low = np.searchsorted(size, least_shared(size), "left")
        near = np.zeros((0, g))
        for i in range(g):
            window = np.arange(low[i], high[i])
            open_ = window[self.root[window] != self.root[i]]
            for far in near:  # the triangle inequality
                if not len(open_):
                    break
                open_ = open_[np.abs(far[open_] - far[i]) <= 0.25 + 1e-9]
            if not len(open_):
                continue
            both = self.overlaps(i)
            union = size + size[i] - both
            if len(self.leaders) < LEADERS:
                self.leaders.append((i, both))
                near = np.vstack([near, 1 - both / union])
            hit = open_[both[open_] >= least_overlap(size[open_], int(size[i]))]
            for j in hit.tolist():
                if self.root[j] != self.root[i]:
                    self.root[self.root == self.root[j]] = self.root[i]
                    out.append((int(self.order[i]), int(self.order[j])))
        return out


def part_links(live: DataFrame, groups: int) -> DataFrame:
    """Edges a, b found inside the parts."""

    def link(table: pa.Table) -> pa.Table:
        trim()
        part = table.column("part").to_numpy()
        nodes, sizes, blobs = table.column("node").to_pylist(), table.column("n").to_numpy(), table.column("tokens").to_pylist()
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order], prepend=part[order[0]] - 1 if len(order) else 0, append=part[order[-1]] + 1 if len(order) else 0))
        a, b = [], []
        for s, e in zip(edges, edges[1:], strict=False):
            rows = order[s:e]
            if len(rows) > 1:
                for i, j in Part(sizes[rows], [np.frombuffer(blobs[r], "<u8") for r in rows]).links():
                    a.append(nodes[rows[i]])
                    b.append(nodes[rows[j]])
        return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    sent = live.select(F.explode("routes").alias("part"), "node", "n", "tokens")
    return sent.withColumn("g", F.pmod("part", F.lit(groups))).repartition(groups, "g").groupBy("g").applyInArrow(link, "a binary, b binary")


def postings(live: DataFrame, heavy: bool) -> DataFrame:
    """token, place, node, label of every prefix token (held by more than GROUP_SETS sets, or by fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, token, place = [], [], []
            for i, (n, tokens, many) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 4)), strict=True)):
                t = np.frombuffer(tokens, "<u8")
                m = prefix_of(n, len(t))
                span = slice(m - many, m) if heavy else slice(0, m - many)
                token.append(t[span])
                row.append(np.full(len(token[-1]), i))
                place.append(n - len(t) + np.arange(m)[span])
            rows = np.concatenate(row) if row else np.zeros(0, np.int64)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(token) if token else np.zeros(0, np.uint64)).view(np.int64)), pa.array(np.concatenate(place) if place else rows, pa.int64()), batch.column(0).take(take), batch.column(4).take(take)], ["token", "place", "node", "label"])

    narrow = live.where("heavy > 0") if heavy else live
    return narrow.select("node", "n", "tokens", "heavy", "label").mapInArrow(run, "token long, place long, node binary, label binary")


VISIT = "visitor binary, host binary"


def _visits(table: pa.Table) -> pa.Table:
    """visitor, host of the sets on the same key that could be linked, stand in different components and met in no part."""
    key, n, place, members = (table.column(c).to_numpy() for c in ("key", "n", "place", "members"))
    labels_, nodes = (table.column(c).combine_chunks().dictionary_encode() for c in ("label", "node"))
    known = labels_.dictionary.to_pylist()
    rank = np.empty(len(known), np.int64)
    rank[sorted(range(len(known)), key=known.__getitem__)] = np.arange(len(known))
    label, node = labels_.indices.to_numpy(zero_copy_only=False), nodes.indices.to_numpy(zero_copy_only=False)
    met = np.array([(r + [0] * ROUTES)[:ROUTES] for r in table.column("routes").to_pylist()], np.int64).reshape(-1, ROUTES)
    order = np.lexsort((n, key))
    key, n, place, label, node, met, members = key[order], n[order], place[order], label[order], node[order], met[order], members[order]
    strong = members * len(known) + rank[label]  # the larger component is the host
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    found: list[np.ndarray] = []
    held = 0
    for s, e in zip(edges, edges[1:], strict=False):
        if e - s < 2 or (label[s:e] == label[s]).all():
            continue
        size = n[s:e]
        high = s + np.searchsorted(size, size * DENOMINATOR // NUMERATOR, "right")  # skip by position: sizes are in order
        for i in range(s, e - 1):
            j = np.arange(i + 1, high[i - s])
            j = j[label[j] != label[i]]
            room = 1 + np.minimum(n[i] - place[i] - 1, n[j] - place[j] - 1)
            j = j[room >= least_overlap(n[j], int(n[i]))]
            if len(j):
                together = np.zeros(len(j), bool)
                for x in range(ROUTES):
                    for y in range(ROUTES):
                        together |= (met[j, x] == met[i, y]) & (met[i, y] != 0)
                j = j[~together]
                goes = strong[i] < strong[j]
                out = np.unique(np.column_stack([np.where(goes, node[i], node[j]), np.where(goes, label[j], label[i])]), axis=0)
                found.append(out)
                held += len(out)
        if held > 1_000_000:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = len(found[0])
    both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), int)
    return pa.Table.from_arrays([nodes.dictionary.take(pa.array(both[:, 0])).cast(pa.binary()), labels_.dictionary.take(pa.array(both[:, 1])).cast(pa.binary())], names=["visitor", "host"])


def narrow_join(wide: DataFrame, narrow: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join a written narrow table: broadcast while it has few rows, by an exchange beyond that."""
    return wide.join(F.broadcast(narrow) if narrow.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else narrow, on, how)


def open_visits(live: DataFrame, groups: int) -> DataFrame:
    """visitor, host: sets that must still meet a component."""
    sets = live.select(F.col("node").alias("s_node"), "n", "members", "routes")
    # tokens held in one component alone are settled; what is sent to find them is the token and a label
    light = postings(live, False)
    several = light.groupBy(F.col("token").alias("t")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("t")
    several = materialize(several, "jaccard-open")
    still = narrow_join(light, several, F.col("token") == F.col("t"), "left_semi")
    full = still.join(sets, F.col("node") == F.col("s_node")).withColumnRenamed("token", "key").drop("s_node")
    full = full.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups))).repartition(groups, "g")
    out = full.groupBy("g").applyInArrow(_visits, VISIT)
    heavy = live.where("heavy > 0")
    if not heavy.isEmpty():
        out = out.union(_heavy_visits(postings(live, True), sets, groups))
    return out.distinct()


def _heavy_visits(held: DataFrame, sets: DataFrame, groups: int) -> DataFrame:
    """Visits on tokens of long lists: all to the token's largest component, the others among each other by blocks of the list."""
    counts = held.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy(F.col("token").alias("t")).agg(F.max_by("label", F.struct("c", "label")).alias("top"), (F.sum("c") - F.max("c")).alias("rest"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    top = materialize(top.select("t", "top", F.ceil(F.col("rest") / GROUP_SETS).alias("chunks"), "kinds"), "jaccard-heavy")
    outside = narrow_join(held, top, F.col("token") == F.col("t")).where("label <> top")
    first = outside.select(F.col("node").alias("visitor"), F.col("top").alias("host"))
    rest = outside.where("kinds > 2").join(sets, F.col("node") == F.col("s_node"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    rest = rest.withColumn("chunk", chunk).withColumn("other", other)
    rest = rest.withColumn("key", F.xxhash64("token", F.least("chunk", "other"), F.greatest("chunk", "other")))
    rest = rest.select("key", "place", "node", "label", "n", "members", "routes")
    return first.union(rest.groupBy(F.pmod("key", F.lit(groups)).alias("g")).applyInArrow(_visits, VISIT))


def met_links(visits: DataFrame, live: DataFrame, tasks: int) -> DataFrame:
    """Edges a, b between visitors and members of their hosts; large components and crowds of visitors are dealt over parts."""
    crowd = visits.groupBy("host").agg(F.count(F.lit(1)).alias("crowd"))
    sizes = live.groupBy("label").agg(F.max("members").alias("members"))  # counted before they are exchanged
    hosts = sizes.join(crowd, F.col("label") == F.col("host"))
    hosts = hosts.select("host", F.ceil(F.col("members") / GROUP_SETS).alias("parts"), F.ceil(F.col("crowd") / GROUP_SETS).alias("crowds"))
    hosts = materialize(hosts, "jaccard-hosts")
    every = lambda column: F.explode(F.sequence(F.lit(0).cast("long"), F.col(column) - 1))
    here = narrow_join(live, hosts, F.col("label") == F.col("host")).select("host", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), every("crowds").alias("crowd"), F.lit(False).alias("visits"), "node", "n", "tokens")
    guests = visits.join(hosts, "host").select("host", "visitor", "parts", F.pmod(F.xxhash64("visitor"), F.col("crowds")).alias("crowd"))
    guests = narrow_join(live.select("node", "n", "tokens"), materialize(guests, "jaccard-guests"), F.col("visitor") == F.col("node"))
    guests = guests.select("host", every("parts").alias("part"), "crowd", F.lit(True).alias("visits"), "node", "n", "tokens")

    def meet(table: pa.Table) -> pa.Table:
        trim()
        host = table.column("host").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        part, crowd, guest, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("part", "crowd", "visits", "n"))
        nodes, blobs = table.column("node").to_pylist(), table.column("tokens").to_pylist()
        order = np.lexsort((guest, crowd, part, host))
        new = np.ones(len(order), bool)
        key = np.column_stack([host, part, crowd])[order]
        new[1:] = (key[1:] != key[:-1]).any(1)
        edges = np.append(np.flatnonzero(new), len(order))
        a, b = [], []
        for s, e in zip(edges, edges[1:], strict=False):
            rows = order[s:e]
            split = int(np.searchsorted(guest[rows], True))
            members, visitors = rows[:split], rows[split:]
            if not len(members) or not len(visitors):
                continue
            sets_ = [np.frombuffer(blobs[r], "<u8") for r in members]
            known, dense = np.unique(np.concatenate(sets_), return_inverse=True)
            owner = np.repeat(np.arange(len(members)), [len(t) for t in sets_])[np.argsort(dense, kind="stable")]
            starts = np.concatenate([[0], np.cumsum(np.bincount(dense, minlength=len(known)))])
            size = n[members]
            for v in visitors.tolist():
                mine = np.frombuffer(blobs[v], "<u8")
                at = np.searchsorted(known, mine)
                at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == mine)]
                count = starts[at + 1] - starts[at]
                pick = np.repeat(starts[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                both = np.bincount(owner[pick], minlength=len(members))
                hit = np.flatnonzero(both >= least_overlap(size, int(n[v])))
                if len(hit):  # one link joins the components
                    a.append(nodes[v])
                    b.append(nodes[members[hit[0]]])
        return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    keyed = here.unionByName(guests).withColumn("g", F.pmod(F.xxhash64("host", "part", "crowd"), F.lit(tasks)))
    return keyed.repartition(tasks, "g").groupBy("g").applyInArrow(meet, "a binary, b binary")


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, mark (hash of the text), n_shingles, node, and first: id and mark of the smallest row linked with it."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    buckets = max(LEAST_BUCKETS, -(-size // (TOKEN_BYTES * BUCKET_TOKENS)))
    gathered = materialize(gathered_sets(shared_tokens(token_rows(docs, id_col, text_col, buckets), buckets)), "jaccard-sets", free=True)
    rows = gathered.where(F.col("kind") == ROWS).select("doc_id", "mark", F.col("n").alias("n_shingles"), "node")
    sets = gathered.where(F.col("kind") == SETS)
    tokens = (sets.agg(F.sum(F.length("tokens")).alias("b")).first()["b"] or 0) // 8
    groups = max(LEAST_BUCKETS, -(-ROUTES * tokens // GROUP_TOKENS))
    live = materialize(live_sets(sets, groups), "jaccard-live", free=True)
    edges = materialize(part_links(live, groups), "jaccard-parts", free=True)
    labels = components(edges)
    named = live.select("node").join(labels.select(F.col("node").alias("l_node"), "label"), F.col("node") == F.col("l_node"), "left").select(F.col("node").alias("l_node"), F.coalesce("label", "node").alias("label"))
    named = materialize(named, "jaccard-labels")
    members = named.groupBy(F.col("label").alias("m_label")).agg(F.count(F.lit(1)).alias("members"))
    named = materialize(named.join(members, F.col("label") == F.col("m_label")).drop("m_label"), "jaccard-members")
    named = materialize(narrow_join(live, named, F.col("node") == F.col("l_node")).drop("l_node"), "jaccard-named")
    drop_table(live)
    visits = materialize(open_visits(named, groups), "jaccard-visits", free=True)
    more = materialize(met_links(visits, named, groups), "jaccard-more", free=True)
    if not more.isEmpty():
        labels = components(edges.union(more))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    nodes = rows.where("node is not null").groupBy("node").agg(first)
    nodes = materialize(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first"), "jaccard-nodes")
    least = nodes.groupBy(F.col("label").alias("c_label")).agg(F.min("first").alias("first"))
    of_node = materialize(nodes.select("node", "label").join(least, F.col("label") == F.col("c_label")).select(F.col("node").alias("of"), "first"), "jaccard-components")
    return rows.join(of_node, F.col("node") == F.col("of"), "left").drop("of")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    return linked_rows(docs, id_col, text_col).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row, that of the smallest id, of every component.

    Rows without words are in no component and stay. Of rows with the same id and text one stays; of rows with the
    same smallest id and different texts the one with the smallest hash of its text; a null id stays only
    where no row linked with it has one. Columns may have any names; an empty table stays empty.
    """
    found = linked_rows(docs, id_col, text_col)
    none = F.lit(-(2**63))
    stays = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    judged = found.select(F.coalesce("doc_id", none).alias("id"), F.coalesce("mark", none).alias("mark"), stays.alias("stays"))
    judged = judged.groupBy("id", "mark").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("copies"))
    judged = materialize(judged.where("not stays or copies > 1"), "jaccard-judged", free=True)
    # rows that a bitmap shows to stay pass without an exchange; only the others are joined with the decisions
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(id_col).cast("long"), none).alias("row_id"), F.coalesce(F.xxhash64(F.col(text_col)), none).alias("row_mark"))
    marked = maybe_in(whole, F.xxhash64("row_id", "row_mark"), key_filter(judged, F.xxhash64("id", "mark")), "maybe")
    hits = marked.where("maybe").join(judged, (F.col("row_id") == F.col("id")) & (F.col("row_mark") == F.col("mark")), "left")
    left = hits.where(F.coalesce("stays", F.lit(True))).dropDuplicates(["row_id", "row_mark"])
    return marked.where("not maybe").select("row.*").unionByName(left.select("row.*"))
