"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers are cascaded, both run over chunks whose state maps compose by a parallel prefix scan.

1. The boundary transducer reads character classes. It is compiled from the piece pattern: its states are the
   contexts that can matter for a boundary, its transitions emit "a piece starts here" for the place DELAY
   characters back. A text is cut into fixed chunks; every chunk gets its state map (entry state -> exit
   state), the maps are composed by the scan, and with its true entry state every chunk then emits its boundaries.
2. The merge transducer reads bytes. It is compiled from the merge list alone: a sequence of tokens is the encoding
   of its bytes exactly when every token encodes itself and no merge crosses a border of two neighbours, so the last
   token of every prefix is the one suffix token that fits the last token before it. A state holds what later
   bytes can still depend on: the longest suffix that begins some token, and, for every place in it, the last token
   that ends there and the count relative to the count now. A transition is annotated with the change of the
   token count; a piece start leads back to the root. States and transitions are compiled on first use, and compiled
   anew beyond MOST_STATES: their number is bounded however long a piece is.
   Chunks start at piece starts, so they are entered in the root; only a piece longer than a chunk is cut inside. There
   a chunk's map holds the states that WARM bytes of its past lead to, and the exit states of the chunk before; the
   scan composes (state, count) maps, and an entry that no map has is followed byte by byte.

Literal special tokens are cut out first and count one token each.

Defined results: a null or empty text has zero bytes and zero tokens; an id may be null or repeat, and repeated
rows are counted one by one; very long texts and pieces are counted whole, in blocks of bounded size; an empty
table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.bpe import MatrixBPE
from chunkloom.llm.common import CACHES, serve
from chunkloom.llm.pretoken import END, LETTER, NUMBER, OTHER, QUOTE, SPACE, WHITE, classes, codes_of

#: Symbols of the boundary transducer: classes, with the letters of contractions apart.
S_T_M_D, R_V, E_, L_ = 7, 8, 9, 10
SYMBOLS = 11
DELAY = 2


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Symbol of every code point. The contraction's r and v, e, l stay letters for every other purpose."""
    table = classes().copy()
    for letters, symbol in (("stmd", S_T_M_D), ("rv", R_V), ("e", E_), ("l", L_)):
        for c in letters:
            table[ord(c)] = symbol
    return table


def _class(symbol: int) -> int:
    return LETTER if symbol >= S_T_M_D else symbol


class BoundaryTransducer:
    """Compiled transition table: step[state, symbol] and emit[state, symbol].

    A state is (context of the place to decide, its symbol, the next symbol): reading one more symbol decides
    whether a piece starts at that place. The context is the class before it, and how many more places a
    contraction that began earlier still covers.
    """

    def __init__(self) -> None:
        first = ((END, 0), END, END)
        index, queue = {first: 0}, [first]
        step, emit = [], []
        while queue:
            state = queue.pop(0)
            row, out = [], []
            for symbol in range(SYMBOLS):
                after, starts = self._decide(*state, symbol)
                if after not in index:
                    index[after] = len(index)
                    queue.append(after)
                row.append(index[after])
                out.append(starts)
            step.append(row)
            emit.append(out)
        self.step, self.emit = minimal(np.array(step, np.int32), np.array(emit, bool))

    @staticmethod
    def _decide(context: tuple[int, int], here: int, after: int, last: int) -> tuple[tuple, bool]:
        before, inside = context
        kind, following = _class(here), _class(after)
        white = kind in (SPACE, WHITE)
        if inside:
            return ((kind if inside > 1 else -1, inside - 1), after, last), False
        if kind == END or before in (END, -1):
            starts = True
        elif white:
            starts = before not in (SPACE, WHITE) or following not in (SPACE, WHITE, END)
        elif before == SPACE:
            starts = False
        else:
            starts = (OTHER if before == QUOTE else before) != (OTHER if kind == QUOTE else kind)
        more = 0
        if kind == QUOTE and starts:
            more = 1 if after == S_T_M_D else 2 if (after == R_V and last == E_) or (after == L_ and last == L_) else 0
        return ((kind, more), after, last), starts

    def starts(self, symbol: np.ndarray, chunk: int = 512) -> np.ndarray:
        """True where a piece starts. The last DELAY symbols must be END."""
        n = len(symbol)
        rows = -(-n // chunk)
        padded = np.full(rows * chunk, END, np.uint8)
        padded[:n] = symbol
        columns = np.ascontiguousarray(padded.reshape(rows, chunk).T)
        entry = self.scan(self.state_maps(columns))
        flat, width = self.step.reshape(-1), SYMBOLS
        emit = self.emit.reshape(-1)
        state, out = entry, np.zeros((chunk, rows), bool)
        for j in range(chunk):
            key = state * width + columns[j]
            out[j] = emit[key]
            state = flat[key]
        found = np.ascontiguousarray(out.T).reshape(-1)[DELAY:n]
        return np.concatenate([found, np.ones(n - len(found), bool)])

    def state_maps(self, columns: np.ndarray) -> np.ndarray:
        """maps[c, s]: the state in which chunk c is left when it is entered in state s.

        Entry states merge after a few symbols; from then on one column stands for all of them.
        """
        flat, rows = self.step.reshape(-1), columns.shape[1]
        state = np.broadcast_to(np.arange(len(self.step), dtype=np.int32), (rows, len(self.step)))
        for j, column in enumerate(columns):
            if state.shape[1] > 1 and j >= DELAY and j < 16 and (state == state[:, :1]).all():
                state = state[:, :1]
            state = flat[state * SYMBOLS + column[:, None]]
        return np.broadcast_to(state, (rows, len(self.step)))

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Entry state of every chunk: exclusive prefix composition of the maps, in log2 rounds."""
        done = np.array(maps)
        shift = 1
        while shift < len(done):
            later = np.take_along_axis(done[shift:], done[:-shift], 1)
            done = np.concatenate([done[:shift], later])
            shift *= 2
        return np.concatenate([[0], done[:-1, 0]]).astype(np.int32)


def minimal(step: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge equivalent states by partition refinement; state 0 stays state 0."""
    block = np.unique(emit, axis=0, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first, kind="stable")
    name = np.empty(len(order), np.int32)
    name[order] = np.arange(len(order), dtype=np.int32)
    keep = first[order]
    return name[block][step[keep]], emit[keep]


#: Bytes of a chunk, of past that is read to guess a cut chunk's entry state, and of chunks that are stepped together.
CHUNK, WARM, BLOCK = 128, 64, 1 << 18
#: With more states the merge transducer is compiled anew.
MOST_STATES = 200_000
MIX = 0x9E3779B97F4A7C15


class MergeTransducer:
    """Token counts of byte strings, from a list of merges (left, right, result) in order of rank."""

    def __init__(self, byte_ids: list[int], merges: list[tuple[int, int, int]], vocabulary: dict[int, bytes]) -> None:
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.made = {t: (r, a, b) for r, (a, b, t) in enumerate(merges)}
        self.fits_known: dict[tuple[int, int], bool] = {}
        whole = set(byte_ids)  # tokens that encode themselves
        for r, (a, b, t) in enumerate(merges):
            if a in whole and b in whole and not self._crossed(a, b, r):
                whole.add(t)
        self._compile_trie({vocabulary[t]: t for t in whole})
        self._reset()

    # -- tokens -----------------------------------------------------------------------------------------------

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that stand at one end (1 left, 2 right) while this one is built: token, rank it is made at, rank it goes at."""
        out, gone = [], 1 << 60
        while token in self.made:
            made = self.made[token]
            out.append((token, made[0], gone))
            token, gone = made[side], made[0]
        return [*out, (token, -1, gone)]

    def _crossed(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether some merge joins the end of a with the start of b before both are whole (and before a given rank)."""
        for x, x_made, x_gone in self._spine(a, 2):
            for y, y_made, y_gone in self._spine(b, 1):
                r = self.rank.get((x, y))
                if r is not None:
                    r = max(r, x_made, y_made)
                    if r < before and r < x_gone and r <= y_gone:  # of two equal merges the left one comes first
                        return True
        return False

    def _fits(self, a: int, b: int) -> bool:
        known = self.fits_known.get((a, b))
        if known is None:
            known = self.fits_known[a, b] = not self._crossed(a, b)
        return known

    def _compile_trie(self, tokens: dict[bytes, int]) -> None:
        """Token prefixes with links to their longest suffix that is a prefix too, and to the longest that is a token."""
        self.child: dict[int, int] = {}
        self.depth, self.token = [0], [-1]
        for body, t in tokens.items():
            node = 0
            for byte in body:
                key = node << 8 | byte
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.depth)
                    self.depth.append(self.depth[key >> 8] + 1)
                    self.token.append(-1)
            self.token[node] = t
        n = len(self.depth)
        self.inner, self.back, self.shorter = [False] * n, [0] * n, [0] * n
        for key, node in sorted(self.child.items(), key=lambda e: self.depth[e[1]]):
            up, byte = key >> 8, key & 255
            self.inner[up] = True
            if up:
                back = self.back[up]
                while back and (back << 8 | byte) not in self.child:
                    back = self.back[back]
                self.back[node] = self.child[back << 8 | byte]
            back = self.back[node]
            self.shorter[node] = back if self.token[back] >= 0 else self.shorter[back]

    # -- states -----------------------------------------------------------------------------------------------

    def _reset(self, keep: int = 0) -> int:
        """Forget all states but the root and one other, whose new number is returned."""
        record = self.records[keep] if keep else None
        root = (0, (-1,), (0,))
        self.records, self.number = [root], {root: 0}
        self.bits, self.used = 18, 0
        self.table = np.full((1 << self.bits, 2), -1, np.int64)  # state << 8 | byte, and next state << 16 | change + 2 ** 15
        return self._number(record) if record else 0

    def _number(self, record: tuple) -> int:
        at = self.number.get(record)
        if at is None:
            at = self.number[record] = len(self.records)
            self.records.append(record)
        return at

    def follow(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the count; compiled on first use."""
        key = state << 8 | byte
        slot = (key * MIX & (1 << 64) - 1) >> 64 - self.bits
        while (at := int(self.table[slot, 0])) >= 0:
            if at == key:
                value = int(self.table[slot, 1])
                return value >> 16, (value & 0xFFFF) - (1 << 15)
            slot = slot + 1 & (1 << self.bits) - 1
        found = self._compile(state, byte)
        self._insert(np.array([key]), np.array([found[0] << 16 | found[1] + (1 << 15)]))
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        node, last, count = self.records[state]
        while (node << 8 | byte) not in self.child and node:
            node = self.back[node]
        node = self.child[node << 8 | byte]
        at = node if self.token[node] >= 0 else self.shorter[node]
        while True:  # the one suffix token that fits what stands before it
            token, before = self.token[at], self.depth[at] - 1
            if last[before] < 0 or self._fits(last[before], token):
                break
            at = self.shorter[at]
        change = count[before] + 1
        while not self.inner[node]:
            node = self.back[node]
        d = self.depth[node]
        record = (node, (token, *last[:d]), (0, *(c - change for c in count[:d])))
        return self._number(record), change

    def _insert(self, key: np.ndarray, value: np.ndarray) -> None:
        self.used += len(key)
        if 3 * self.used > 1 << self.bits:
            old = self.table[self.table[:, 0] >= 0]
            self.bits, self.used = self.bits + max(1, int(3 * self.used >> self.bits).bit_length()), len(key)
            self.table = np.full((1 << self.bits, 2), -1, np.int64)
            self._insert(old[:, 0], old[:, 1])
        slot, todo = self._slot(key), np.arange(len(key))
        mask = (1 << self.bits) - 1
        while len(todo):
            free = todo[self.table[slot[todo], 0] < 0]
            self.table[slot[free], 0] = key[free]
            won = free[self.table[slot[free], 0] == key[free]]
            self.table[slot[won], 1] = value[won]
            todo = todo[self.table[slot[todo], 0] != key[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(MIX) >> np.uint64(64 - self.bits)).view(np.int64)

    def advance(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the counts, for all lanes at once."""
        key = state << 8 | byte
        slot = self._slot(key)
        rows = self.table[slot]
        value = rows[:, 1]
        todo = np.flatnonzero(rows[:, 0] != key)
        mask = (1 << self.bits) - 1
        new = []
        while len(todo):
            at = self.table[slot[todo]]
            hit = at[:, 0] == key[todo]
            value[todo[hit]] = at[hit, 1]
            new.append(todo[at[:, 0] < 0])
            todo = todo[~hit & (at[:, 0] >= 0)]
            slot[todo] = (slot[todo] + 1) & mask
        missing = np.concatenate(new) if new else todo
        if len(missing):
            fresh, which = np.unique(key[missing], return_inverse=True)
            found = np.array([to << 16 | change + (1 << 15) for to, change in (self._compile(k >> 8, k & 255) for k in fresh.tolist())], np.int64)
            self._insert(fresh, found)
            value[missing] = found[which]
        return value >> 16, (value & 0xFFFF) - (1 << 15)

    # -- chunks -----------------------------------------------------------------------------------------------

    def run(self, data: np.ndarray, fresh: np.ndarray, start: np.ndarray, end: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each chunk data[start:end] from its entry state; fresh marks piece starts."""
        order = np.argsort(start - end, kind="stable")  # longest first: the unfinished ones stay in front
        size, at, state = (end - start)[order], start[order], entry[order].astype(np.int64)
        total = np.zeros(len(order), np.int64)
        depth, alive = 0, int(np.searchsorted(-size, 0, "left"))
        while alive:
            place = at[:alive] + depth
            to, emit = self.advance(np.where(fresh[place], 0, state[:alive]), data[place])
            state[:alive] = to
            total[:alive] += emit
            depth += 1
            alive = int(np.searchsorted(-size, -depth, "left"))
        out, counts = np.empty_like(state), np.empty_like(total)
        out[order], counts[order] = state, total
        return out, counts

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner and tokens of each chunk, the chunks made of pieces data[start:end] of one owner each."""
        if not len(start):
            return owner, np.zeros(0, np.int64)
        long = end - start > CHUNK
        new = np.ones(len(start), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] // CHUNK != start[:-1] // CHUNK) | long[1:] | long[:-1]
        first, last = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
        parts = np.where(long[new], -(-(last - first) // CHUNK), 1)
        which = np.repeat(np.arange(len(first)), parts)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        a = first[which] + CHUNK * inside
        b = np.where(inside + 1 < parts[which], a + CHUNK, last[which])
        fresh = np.zeros(len(data) + 1, bool)
        fresh[start] = True
        out, carry, at = [], 0, 0
        while at < len(a):
            if len(self.records) > MOST_STATES:
                carry = self._reset(carry)
            stop = max(at + 1, int(np.searchsorted(b, a[at] + BLOCK, "right")))
            counts, carry = self._block(data, fresh, a[at:stop], b[at:stop], carry)
            out.append(counts)
            at = stop
        return owner[new][which], np.concatenate(out)

    def _block(self, data: np.ndarray, fresh: np.ndarray, a: np.ndarray, b: np.ndarray, carry: int) -> tuple[np.ndarray, int]:
        """Counts of consecutive chunks, and the state after the last; carry is the state before the first."""
        n = len(a)
        cut = ~fresh[a]
        entry = np.zeros((1, n), np.int64)
        guess = np.flatnonzero(cut[1:]) + 1
        if len(guess):
            entry[0, guess] = self.run(data, fresh, a[guess] - WARM, a[guess], np.zeros(len(guess), np.int64))[0]
        entry[0, 0] = 0 if not cut[0] else carry
        exit_, count = (x[None, :] for x in self.run(data, fresh, a, b, entry[0]))
        if len(guess):  # the maps of cut chunks get the exit states of the chunks before them as further entries
            other = np.where(cut, np.concatenate([[0], exit_[0, :-1]]), -1)
            other[0] = -1
            other[other == entry[0]] = -1
            todo = np.flatnonzero(other >= 0)
            more, counts = np.full(n, -1, np.int64), np.zeros(n, np.int64)
            if len(todo):
                more[todo], counts[todo] = self.run(data, fresh, a[todo], b[todo], other[todo])
            entry, exit_, count = np.vstack([entry, other]), np.vstack([exit_, more]), np.vstack([count, counts])
        column, total = scan_counts(entry, exit_, count, cut)
        while (column < 0).any():  # an entry that no map has: follow it until the maps take over
            i = int(np.argmax(column < 0))
            entry, exit_, count = (np.vstack([x, np.full(n, fill)]) for x, fill in ((entry, -1), (exit_, -1), (count, 0)))
            state = int(exit_[column[i - 1], i - 1])
            while i < n and cut[i] and not (entry[:, i] == state).any():
                entry[-1, i] = state
                for byte in data[a[i] : b[i]].tolist():
                    state, change = self.follow(state, byte)
                    count[-1, i] += change
                exit_[-1, i] = state
                i += 1
            column, total = scan_counts(entry, exit_, count, cut)
        return np.diff(total, prepend=0), int(exit_[column[-1], -1])


def scan_counts(entry: np.ndarray, exit_: np.ndarray, count: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entry of its map each chunk is entered by (-1: none it has), and the count from the first chunk on.

    Maps are rows entry -> (exit, count); they are composed by an inclusive prefix scan in log2 rounds.
    """
    k, n = entry.shape
    nowhere = k  # an absorbing column
    to = np.full((n, k + 1), nowhere, np.int64)
    weight = np.zeros((n, k + 1), np.int64)
    to[0], weight[:, :k] = 0, count.T
    for c in range(k):
        for d in range(k):
            to[1:, c][(to[1:, c] == nowhere) & cut[1:] & (exit_[c, :-1] == entry[d, 1:]) & (entry[d, 1:] >= 0)] = d
    to[1:][~cut[1:]] = 0  # a piece start is entered in the root, wherever the chunk before was left
    # element i maps the entry of chunk i - 1 to that of chunk i, and adds the count of chunk i under the latter
    added = np.take_along_axis(weight, to, 1)
    shift = 1
    while shift < n:
        late, early = to[shift:], to[:-shift]
        sums = added[:-shift] + np.take_along_axis(added[shift:], early, 1)
        to = np.concatenate([to[:shift], np.take_along_axis(late, early, 1)])
        added = np.concatenate([added[:shift], sums])
        shift *= 2
    return np.where(to[:, 0] == nowhere, -1, to[:, 0]), added[:, 0]


class CompiledTokenizer:
    """A byte-level BPE tokenizer file (.json) compiled to transducers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE tokenizers can be compiled")
        bytes_of = byte_alphabet()
        ranks = {bytes(bytes_of[c] for c in token): rank for token, rank in model["vocab"].items() if all(c in bytes_of for c in token)}
        special = [t for t in spec.get("added_tokens", []) if t.get("special")]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("special tokens that strip their surroundings can't be compiled")
        self.special = [t["content"] for t in special]
        self.special_ids = {t["content"]: t["id"] for t in special}
        self.bpe = MatrixBPE(ranks, public_tokenizers.PATTERN)
        plain = {token: bytes(bytes_of[c] for c in token) for token in model["vocab"] if all(c in bytes_of for c in token)}
        ids, result = {body: ranks[body] for body in plain.values()}, []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            result.append((ids[plain[left]], ids[plain[right]], ids[plain[left] + plain[right]]))
        self.boundaries = BoundaryTransducer()
        self.merges = MergeTransducer([ranks[bytes([b])] for b in range(256)], result, {rank: body for body, rank in ranks.items()})

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers; special tokens in a text get their own ids."""
        marked = {i for i, t in enumerate(texts) if any(token in t for token in self.special)}
        for i, ids in enumerate(self.bpe.encode_batch(["" if i in marked else t for i, t in enumerate(texts)])):
            yield b"".join(self._marked(texts[i])) if i in marked else ids

    def _marked(self, text: str) -> Iterator[bytes]:
        first = min(self.special, key=lambda token: at if (at := text.find(token)) >= 0 else len(text))
        before, found, after = text.partition(first)
        yield from self.bpe.encode_batch([before])
        while found:
            yield self.special_ids[found].to_bytes(4, "little")
            first = min(self.special, key=lambda token: at if (at := after.find(token)) >= 0 else len(after))
            before, found, after = after.partition(first)
            yield from self.bpe.encode_batch([before])

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        parts, owner = texts, np.arange(len(texts))
        for token in self.special:
            if any(token in t for t in parts):
                split = [t.split(token) for t in parts]
                sizes = [len(s) for s in split]
                np.add.at(total, owner, np.array(sizes) - 1)
                parts, owner = [p for s in split for p in s], np.repeat(owner, sizes)
        if not parts:
            return total
        joined, code, ends = codes_of(parts)
        symbol = symbols()[code]
        symbol[ends] = END
        starts = np.flatnonzero(self.boundaries.starts(np.concatenate([symbol, np.full(DELAY, END, np.uint8)]))[: len(symbol)])
        stop = np.append(starts[1:], len(code))
        real = symbol[starts] != END
        place = np.concatenate([[0], np.cumsum(1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))])
        first, tokens = self.merges.counts(np.frombuffer(joined.encode(), np.uint8), place[starts[real]], place[stop[real]], np.searchsorted(ends, starts[real]))
        np.add.at(total, owner[first], tokens)
        return total


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def compiled(path: str) -> CompiledTokenizer:
    return CompiledTokenizer(path)


CACHES.append(compiled.cache_clear)


#: Characters counted together, and the number of tokens beyond which a document is over the limit.
RUN_CHARS = 1 << 18
TOKEN_LIMIT = 1024


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes (UTF-8), n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("tokens")
        tokenizer = compiled(tokenizer_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, first, size = [np.zeros(0, np.int64)], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= RUN_CHARS or i + 1 == len(texts):
                    counts.append(tokenizer.count(texts[first : i + 1]))
                    first, size = i + 1, 0
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
