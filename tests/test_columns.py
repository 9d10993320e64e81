from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.functions.columns import CODECS, best_codec

cells = st.one_of(
    st.lists(st.integers(-(2**63), 2**63 - 1).map(str), min_size=1, max_size=40),
    st.lists(st.integers(0, 10**6).map(lambda v: f"{v:08d}"), min_size=1, max_size=40),
    st.lists(st.tuples(st.integers(-(10**6), 10**6), st.integers(0, 99)).map(lambda v: f"{v[0]}.{v[1]:02d}"), min_size=1, max_size=40),
    st.lists(st.uuids().map(str), min_size=1, max_size=20),
    st.lists(st.sampled_from(["INFO", "WARN", ""]), min_size=1, max_size=60),
    st.lists(st.binary(min_size=4, max_size=4).map(bytes.hex), min_size=1, max_size=30),
    st.lists(st.text(st.characters(blacklist_characters="\n", blacklist_categories=["Cs"]), max_size=8), min_size=1, max_size=20),
)


@settings(max_examples=150, deadline=None)
@given(cells)
def test_every_codec_that_accepts_a_column_gives_it_back(column):
    for encode, decode in CODECS.values():
        body = encode(column)
        assert body is None or decode(body) == column


def test_the_expected_codec_wins():
    assert best_codec([str(1_700_000_000 + 3 * i + i % 2) for i in range(2000)])[0] == "delta"
    assert best_codec([str(3 * i * i) for i in range(400)])[0] == "delta2"
    assert best_codec(["INFO", "WARN", "ERROR", "INFO"] * 500)[0] == "dict"
    assert best_codec([f"{i:08d}" for i in range(3000)])[0] == "zpad"


def test_edges_of_fixed_decimals():
    encode, decode = CODECS["decimal"]
    column = ["0.00", "0.50", "1.05", "1.00", "1.34", "1.01", "1.99", "1.99"]
    assert decode(encode(column)) == column
    assert encode(["-0.00", "1.00"]) is None
    assert encode(["1.0", "1.00"]) is None
