"""The engine's kernels and the plans without a SQL oracle, against plain loops over the same documents."""

import bz2
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.functions import kernels
from chunkloom.plans import REGISTRY
from tests.conftest import SF

WORD = 2**64 - 1
TABLE = [int(x) for x in kernels.gear_table()]


def plain_cuts(data, average):
    """Content-defined cutting byte by byte, as its rule says."""
    bits = average.bit_length() - 1
    strict, loose = int(kernels._mask(bits + 2)), int(kernels._mask(bits - 2))
    out, at = [], 0
    while at < len(data):
        rest = len(data) - at
        if rest <= average // 4:
            out.append(len(data))
            break
        limit, value, cut = min(rest, average * 4), 0, None
        for i in range(average // 4, limit):
            value = ((value << 1) + TABLE[data[at + i]]) & WORD
            if value & (strict if i < min(average, limit) else loose) == 0:
                cut = i + 1
                break
        at += cut or limit
        out.append(at)
    return out


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"].encode() for r in rows if r["text"] is not None}


def chunks_of(texts, average):
    out = {}
    for k, body in texts.items():
        at = 0
        for pos, end in enumerate(plain_cuts(body, average)):
            out[k, pos] = body[at:end]
            at = end
    return out


@pytest.fixture(scope="module")
def small(texts):
    return chunks_of(texts, 1024)


@pytest.fixture(scope="module")
def distinct(small):
    return {hashlib.sha256(c).hexdigest(): c for c in small.values()}


def plain_features(data):
    if len(data) < 64:
        return []
    value, hashes = 0, []
    for i, byte in enumerate(data):
        value = ((value << 1) + TABLE[byte]) & WORD
        if i >= 63:
            hashes.append(value)
    if len(hashes) > 256:
        hashes = [h for h in hashes if h >> 60 & kernels.SAMPLE_MASK == 0]
    if not hashes:
        return []
    tops = []
    for k in range(1, kernels.TRANSFORMS + 1):
        mult, add = (k * 0x9E3779B97F4A7C15 & WORD) | 1, k * 0xC2B2AE3D27D4EB4F & WORD
        tops.append(max((h * mult + add) & WORD for h in hashes))
    out = []
    for g in range(0, len(tops), kernels.GROUP):
        mixed = 0xCBF29CE484222325
        for t in tops[g : g + kernels.GROUP]:
            mixed = ((mixed ^ t) * 0x100000001B3) & WORD
        out.append(mixed - 2**64 if mixed >= 2**63 else mixed)
    return out


def plain_min_hash(data):
    if len(data) < kernels.SHINGLE:
        return None
    words = [int.from_bytes(data[i : i + 8], "little") for i in range(len(data) - 7)]
    out = []
    for k in range(1, kernels.MINHASH + 1):
        mult, add = (k * 0xBF58476D1CE4E5B9 & WORD) | 1, k * 0x94D049BB133111EB & WORD
        low = min((w * mult + add) & WORD for w in words)
        out.append(low - 2**64 if low >= 2**63 else low)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700) | st.integers(0, 3).map(lambda b: bytes([b]) * 900), max_size=6), st.sampled_from([16, 64, 256]))
def test_cuts_are_those_of_the_plain_loop(blobs, average):
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    got = kernels.cut_batch(np.frombuffer(b"".join(blobs), np.uint8), offsets, average)
    assert got == [plain_cuts(b, average) for b in blobs]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80) | st.binary(max_size=40).map(lambda b: b"\x1f\x8b\x08" + b))
def test_gzip_reader_survives_any_bytes(data):
    import gzip

    found = kernels.gzip_members(data)
    assert found is None or b"".join(plain for *_, plain in found) == gzip.decompress(data)
    whole = gzip.compress(data) + gzip.compress(b"more")
    for end in range(len(whole)):
        kernels.gzip_members(whole[:end])
    assert [plain for *_, plain in kernels.gzip_members(whole)] == [data, b"more"]


def test_cdc_dedup(spark, small):
    sizes = collections.Counter(hashlib.sha256(c).hexdigest() for c in small.values())
    unique = {hashlib.sha256(c).hexdigest(): len(c) for c in small.values()}
    row = REGISTRY["cdc_dedup"].run(spark, SF).first()
    assert tuple(row) == (len(unique), len(small), sum(unique.values()), sum(map(len, small.values()))) and sum(sizes.values()) == len(small)


def plain_pairs(distinct):
    holders = collections.defaultdict(list)
    for h in sorted(distinct):
        for f in set(plain_features(distinct[h])):
            holders[f].append(h)
    return {(b, a) for hs in holders.values() for a, b in zip(hs, hs[1:])}


def test_superfeature_candidates(spark, distinct):
    got = {(r["hash"], r["base"]) for r in REGISTRY["superfeature_candidates"].run(spark, SF).collect()}
    assert got == plain_pairs(distinct) and got


def test_minhash_clusters(spark, distinct):
    groups = collections.defaultdict(list)
    for c in distinct.values():
        groups[(plain_min_hash(c) or [None])[0]].append(len(c))
    got = {(r["m0"], r["n"], r["bytes"]) for r in REGISTRY["minhash_clusters"].run(spark, SF).collect()}
    assert got == {(m, len(s), sum(s)) for m, s in groups.items() if len(s) > 1}


def test_delta_sizes(spark, distinct):
    def delta(base, data):
        d = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packed = zstandard.ZstdCompressor(level=3, dict_data=d).compress(data)
        assert zstandard.ZstdDecompressor(dict_data=d).decompress(packed) == data
        return len(packed)

    best = {}
    for h, base in plain_pairs(distinct):
        size = delta(distinct[base], distinct[h])
        best[h] = min(best.get(h, (size, base)), (size, base))
    plain = {h: len(zstandard.ZstdCompressor(level=3).compress(distinct[h])) for h in best}
    want = {(h, base, plain[h], size) for h, (size, base) in best.items() if size * 10 < plain[h] * 9}
    assert {(r["hash"], r["base"], r["plain_size"], r["delta_size"]) for r in REGISTRY["delta_sizes"].run(spark, SF).collect()} == want != set()


def test_region_pack(spark, distinct):
    regions = collections.defaultdict(list)
    for r in REGISTRY["region_pack"].run(spark, SF).collect():
        regions[r["region"]].append((r["place"], r["offset"], r["size"], r["hash"]))
    assert sorted(h for rows in regions.values() for *_, h in rows) == sorted(distinct)
    for first, rows in regions.items():
        rows.sort()
        assert [p for p, *_ in rows] == list(range(len(rows))) and rows[0][3] == first and len(rows) <= 256
        at = 0
        for _, offset, size, h in rows:
            assert offset == at and size == len(distinct[h])
            at += size
        assert at <= 4 << 20
        keys = [(m is None, [x & WORD for x in m or []], h) for *_, h in rows for m in [plain_min_hash(distinct[h])]]
        assert keys == sorted(keys)


@pytest.fixture(scope="module")
def medium(texts):
    return {hashlib.sha256(c).hexdigest(): c for c in chunks_of(texts, 4096).values()}


def test_adaptive_compress(spark, medium):
    got = {r["hash"]: (r["size"], r["codec"], r["stored_size"]) for r in REGISTRY["adaptive_compress"].run(spark, SF).collect()}
    want = {}
    for h, c in medium.items():
        packed = len(zstandard.ZstdCompressor(level=3).compress(c))
        want[h] = (len(c), "zstd", packed) if packed < len(c) else (len(c), "raw", len(c))
    assert got == want


def test_offline_best_of(spark, medium):
    for r in REGISTRY["offline_best_of"].run(spark, SF).collect():
        c = medium[r["hash"]]
        sizes = {"raw": len(c), "zlib": len(zlib.compress(c, 9)), "zstd": len(zstandard.ZstdCompressor(level=22).compress(c)), "bzip2": len(bz2.compress(c, 9))}
        least = min(v for k, v in sizes.items() if k != "bzip2")
        want = sizes["bzip2"] if sizes["bzip2"] * 1000 <= least * 985 else least
        assert r["stored_size"] == want == sizes[r["codec"]] and r["size"] == len(c)


def test_column_codecs_give_the_columns_back(spark):
    from chunkloom.functions import columns
    from chunkloom.plans.physical import rendered
    from chunkloom.sources import formats

    blobs = {r["id"]: r["text"] for r in rendered(spark, SF).collect()}
    got = collections.defaultdict(dict)
    for r in REGISTRY["column_codecs"].run(spark, SF).collect():
        got[r["id"]][r["col"]] = (r["codec"], r["bytes"], r["raw_bytes"])
    for k, text in blobs.items():
        grid = formats.parse_text(text)
        assert len(got[k]) == (len(grid.columns) if grid else 0)
        for c, column in enumerate(grid.columns if grid else []):
            raw = len(zlib.compress("\n".join(column).encode(), 6))
            codec, size = columns.best_codec(column)
            assert got[k][c] == (codec, size, raw) and size <= raw + 8
    assert len({codec for cols in got.values() for codec, *_ in cols.values()}) >= 3


def test_optimize_report(spark):
    rows = {r["pass"]: r for r in REGISTRY["optimize_report"].run(spark, SF).collect()}
    assert set(rows) >= {"deltas", "codecs", "regions"}
    for r in rows.values():
        assert r["chunks"] >= 0 and r["after"] <= r["before"]


def test_bcj_goes_back():
    r = random.Random(3)
    for _ in range(50):
        data = bytes(r.choice([0xE8, 0xE9, 0, 1, 255]) for _ in range(r.randrange(200)))
        assert kernels.bcj(kernels.bcj(data), True) == data
