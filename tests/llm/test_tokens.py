"""Tokenizer operators against the public libraries, and packing against its rules."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chunkloom.llm import packing
from chunkloom.llm.bpe import bpe_round_trip, encoder
from chunkloom.llm.pretoken import piece_lists
from chunkloom.llm.tokenfst import BoundaryTransducer, END, compiled, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)
PARTS = ["a", "b", "E", " ", "  ", "é", "'s", "'re", "'ll", "'v", "'", "''", "r", "e", "l", "\n", "\t", "😀", "漢", "١", "3", "\x85", "\xa0", "\x1c", ".", "<|endoftext|>", "the", "ing"]


def odd_texts(n=400):
    rng = random.Random(1)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)] + ["", " ", "a" * 3000, "ab" * 1500, "é" * 900, " " * 3000, "the " * 400, "\0 \0", "'" * 600]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=30))
def test_pieces_are_the_patterns(text):
    assert piece_lists([text, "x", text]) == [PATTERN.findall(text), ["x"], PATTERN.findall(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS[:-3]), max_size=30).map("".join), st.sampled_from([3, 5, 64]))
def test_boundaries_do_not_depend_on_chunks(text, chunk):
    from chunkloom.llm.tokenfst import symbols

    code = np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32)
    symbol = symbols()[code].copy()
    symbol[-1] = END
    found = BoundaryTransducer().starts(np.concatenate([symbol, np.full(2, END, np.uint8)]), chunk)
    edges = np.flatnonzero(found[: len(text)]).tolist() + [len(text)]
    assert [text[a:b] for a, b in zip(edges, edges[1:])] == PATTERN.findall(text)


def test_encoding_is_the_librarys(tik):
    bpe = encoder(RANKS, public_tokenizers.PATTERN)
    texts = odd_texts()
    for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        found = np.frombuffer(ids, "<u4")
        assert found.tolist() == tik.encode_ordinary(text)
        assert bpe.decode(found) == text.encode()


def test_long_pieces_are_joined_from_windows(tik, monkeypatch):
    from chunkloom.llm import bpe as module

    bpe = encoder(RANKS, public_tokenizers.PATTERN)
    pieces = ["ionationtion" * 300, "thethe" * 600, "a" * 9001, "\u00e9" * 2000, "abcdefg" * 701, "=" * 5000, *(t for t in long_texts() if " " not in t and "\n" not in t)]
    for window, shared in ((512, 128), (64, 16), (24, 8)):
        monkeypatch.setattr(module, "WINDOW", window)
        monkeypatch.setattr(module, "OVERLAP", shared)
        for piece in pieces:
            assert np.frombuffer(bpe.encode_pieces([piece.encode()])[0], "<u4").tolist() == tik.encode_ordinary(piece)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abtheionl", min_size=65, max_size=900))
def test_windows_of_any_letters(tik, text):
    from chunkloom.llm import bpe as module

    old = module.WINDOW, module.OVERLAP
    module.WINDOW, module.OVERLAP = 64, 24
    try:
        assert np.frombuffer(encoder(RANKS, public_tokenizers.PATTERN).encode_pieces([text.encode()])[0], "<u4").tolist() == tik.encode_ordinary(text)
    finally:
        module.WINDOW, module.OVERLAP = old


def test_forgetting_changes_nothing(tik, monkeypatch):
    from chunkloom.llm import bpe as module

    monkeypatch.setattr(module, "CACHE_PIECES", 50)
    bpe = module.MatrixBPE(module.load_ranks(RANKS), public_tokenizers.PATTERN)
    texts = odd_texts(60)
    assert [np.frombuffer(i, "<u4").tolist() for i in bpe.encode_batch(texts, 200)] == [tik.encode_ordinary(t) for t in texts]


def test_counts_are_the_librarys(library):
    texts = odd_texts()
    assert compiled(JSON).count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in compiled(JSON).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def long_texts():
    rng = random.Random(5)
    return ["a" * 9001, "-" * 4000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6000)), "".join(rng.choices("ab", k=3000)), "x " + "\u00e9\u6f22" * 900 + " y", "".join(rng.choices("tionment", k=5000)) + " end", "\n" * 700 + "z"]


@pytest.mark.parametrize(("chunk", "warm", "block", "states"), [(128, 64, 1 << 18, 10**6), (16, 8, 300, 10**6), (5, 1, 64, 200)])
def test_chunks_of_any_size_count_alike(library, monkeypatch, chunk, warm, block, states):
    """Cut pieces, wrong guesses, blocks with a carried state and forgotten states change no count."""
    from chunkloom.llm import tokenfst

    for name, value in (("CHUNK", chunk), ("WARM", warm), ("BLOCK", block), ("MOST_STATES", states)):
        monkeypatch.setattr(tokenfst, name, value)
    monkeypatch.setattr(tokenfst.MatrixBPE, "encode_pieces", None)  # counts come from the transducer alone
    texts = long_texts() + odd_texts(60)
    machine = tokenfst.CompiledTokenizer(JSON)
    assert machine.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(machine.merges.records) <= max(states, 200) + 30_000


def test_transitions_carry_the_counts(library):
    """Summed along any path, the changes on the transitions are the number of tokens read so far."""
    machine = compiled(JSON).merges
    for text in ("internationalisation", "aaaaaaaaaaa", "zxqjkvbp", "\u6f22\u5b57"):
        state, total, body = 0, 0, text.encode()
        for i, byte in enumerate(body):
            state, change = machine.follow(state, byte)
            total += change
            prefix = body[: i + 1]
            try:
                assert total == len(library.encode(prefix.decode(), add_special_tokens=False).ids)
            except UnicodeDecodeError:
                pass


def test_scan_composes_maps():
    from chunkloom.llm.tokenfst import scan_counts

    rng = np.random.default_rng(1)
    n, states = 50, 4
    exits, counts = rng.integers(0, states, (states, n)), rng.integers(0, 9, (states, n))
    entry = np.repeat(np.arange(states)[:, None], n, 1)
    cut = rng.random(n) < 0.7
    cut[0] = False
    column, total = scan_counts(entry, exits, counts, cut)
    at, done = 0, 0
    for i in range(n):
        at = 0 if not cut[i] else int(exits[at, i - 1])
        done += counts[at, i]
        assert column[i] == at and total[i] == done
    entry[:, 30] = -1  # a map that knows no entry: everything behind is unknown until the next piece start
    cut[30] = True
    column, _ = scan_counts(entry, exits, counts, cut)
    after = next((i for i in range(31, n) if not cut[i]), n)
    assert (column[30:after] == -1).all() and (column[:30] >= 0).all() and (column[after:] >= 0).all()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(odd_texts(80))] + [(500, None, "x", 1), (None, "null id", "x", 1), (3, "again", "x", 1), (501, "long text " * 9000, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int").repartition(3)


def test_round_trip_query(docs, tik):
    got = collections.Counter(tuple(r) for r in bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN).collect())
    want = collections.Counter()
    for r in docs.collect():
        ids = tik.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert got == want


def test_count_query(docs, library):
    got = collections.Counter(tuple(r) for r in token_counts(docs, JSON).collect())
    want = collections.Counter()
    for r in docs.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want[(r["doc_id"], len((r["text"] or "").encode()), n, n > 1024)] += 1
    assert got == want


def test_packing(docs, library):
    rows = packing.pack_documents(docs, JSON).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.defaultdict(list)
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"], len(ids)].append(ids)
    assert {k: sum(n for _, n, _ in v) for k, v in pieces.items()} == {k: sum(map(len, v)) for k, v in want.items()}
    for key, texts in want.items():
        if len(texts) == 1:
            at = 0
            for start, length, crc in sorted(pieces[key]):
                assert start == at and crc == zlib.crc32(np.array(texts[0][start : start + length], "<u4").tobytes())
                at += length
            assert at == len(texts[0])
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= 2048


def test_nothing_packs_to_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, JSON).count() == 0 and token_counts(empty, JSON).count() == 0 and bpe_round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 512), max_size=200))
def test_windows_hold_every_item_once_and_fit(sizes):
    windows = packing.pack(sizes)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= 2048 for w in windows)


def test_differencing_balances():
    rng = random.Random(2)
    sizes = [rng.randint(1, 512) for _ in range(600)]
    loads = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 75)]
    assert max(loads) - min(loads) < 20
    assert len(packing.pack(sizes)) <= -(-sum(sizes) // 2048) + 1


def test_window_count_rises_until_all_fit():
    assert len(packing.pack([1500] * 5)) == 5
    assert packing.pack([]) == []
