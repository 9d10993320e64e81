import base64
import gzip
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.functions import kernels
from chunkloom.sources import formats

CSV = "\n".join(f"{1700000000 + i},user{i % 7},get,{i * 13 % 2000},{i % 2}" for i in range(20)) + "\n"
JSON = "\n".join('{"ts": %d, "m": {"a": [1, "}"]}, "s": "x\\"y", "n": null}' % i for i in range(20))
PAIRS = "\n".join(f'ts={i} level=info msg="a \\"b\\" c" empty=""' for i in range(20)) + "\n"
LOG = "\r\n".join(f'10.0.0.{i} - - [01/Jan/2024:00:00:{i:02d} +0000] "GET /a b HTTP/1.1" 200 {i} "-" "agent x"' for i in range(20)) + "\r\n"


def test_each_format_is_found_and_given_back():
    for text, kind, columns in ((CSV, "csv", 5), (JSON, "jsonl", 4), (PAIRS, "logfmt", 4), (LOG, "log", 9)):
        g = formats.parse_text(text)
        assert (g.kind, len(g.columns), g.text()) == (kind, columns, text)


def test_separators_are_tried_in_order_and_ragged_rows_are_refused():
    assert formats.parse_separated("\n".join("a\tb;c" for _ in range(8))).skeleton == "\0\t\0"
    assert formats.parse_separated("a,b\n" * 7) is None
    assert formats.parse_separated("a,b\n" * 8 + "a\n") is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab,\t; =\"{}:[]\r\n", max_size=12), max_size=14))
def test_a_grid_always_gives_the_text_back(lines):
    text = "\n".join(lines)
    g = formats.parse_text(text)
    assert g is None or g.text() == text


def test_base64_regions():
    raw = bytes(range(256))
    std, url = base64.b64encode(raw), base64.urlsafe_b64encode(raw[100:220]).rstrip(b"=")
    found = formats.base64_regions(b"x " + std + b" y " + url + b" z " + b"A" * 65)
    assert [f[3] for f in found] == [raw, raw[100:220]]


def test_keys():
    rows = formats.parse_keys("# all\nk1 10G id=a @admin Ann B\n\nk2\n")
    assert rows == [{"key": "k1", "quota": 10 * 1024**3, "id": "a", "admin": True, "name": "Ann B"}, {"key": "k2", "quota": None, "id": None, "admin": False, "name": ""}]


def test_gzip_members_and_parameters():
    a, b = gzip.compress(b"hello " * 100, 9, mtime=0), gzip.compress(b"world", 1, mtime=0)
    members = list(kernels.gzip_members(a + b))
    assert [m[2] for m in members] == [b"hello " * 100, b"world"]
    assert kernels.deflate_parameters(members[0][2], members[0][1], -15) is not None
    assert kernels.gzip_members(a[:-1]) is None and kernels.gzip_members(b"") is None
    packed = zlib.compress(b"abc" * 50, 9)
    assert kernels.deflate_parameters(b"abc" * 50, packed, 15) is not None


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=20_000), st.sampled_from([64, 256, 1024]))
def test_cut_points_cover_the_data_within_bounds(data, average):
    ends = kernels.cut_points(data, average)
    assert (ends[-1] if ends else 0) == len(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert all(s <= average * 4 for s in sizes) and all(s > average // 4 for s in sizes[:-1])


def test_chunks_survive_an_insertion():
    import random

    data = random.Random(1).randbytes(200_000)
    def pieces(d):
        ends = kernels.cut_points(d, 1024)
        return {d[a:b] for a, b in zip([0, *ends], ends)}
    assert len(pieces(data) & pieces(data[:50_000] + b"17 bytes inserted" + data[50_000:])) > 0.9 * len(pieces(data))


def test_sketches_of_near_copies():
    import random

    base = random.Random(2).randbytes(32_768)
    edited = base[:9000] + b"edit" + base[9004:]
    other = random.Random(3).randbytes(32_768)
    assert set(kernels.super_features(base)) & set(kernels.super_features(edited))
    assert not set(kernels.super_features(base)) & set(kernels.super_features(other))
    same = sum(a == b for a, b in zip(kernels.min_hash(base), kernels.min_hash(edited)))
    assert same >= 2 and kernels.min_hash(b"short") is None
    assert kernels.delta_size(base, edited) < kernels.plain_size(edited) // 10


def test_codecs_never_expand():
    import random

    noise = random.Random(4).randbytes(5000)
    assert kernels.adaptive(noise) == ("raw", 5000) and kernels.best_of(noise) == ("raw", 5000)
    assert kernels.adaptive(b"log line\n" * 20_000)[1] < 2000


def test_wrapped_base64_is_one_region():
    raw = bytes(range(256)) * 3
    for width, end, code in ((76, b"\r\n", base64.b64encode), (64, b"\n", base64.urlsafe_b64encode), (64, b"\n", lambda x: base64.b64encode(x).rstrip(b"="))):
        for plain in (raw, raw[:-1], raw[:-2], raw[:96], raw[:144]):
            body = code(plain)
            lines = end.join(body[i : i + width] for i in range(0, len(body), width))
            for head, trail in ((b"-----BEGIN X-----" + end, end + b"-----END X-----"), (b"", b""), (b"x: ", b" y"), (b"\n", end * 2)):
                if trail.startswith(end + b"-") and len(body) % width == 0:
                    continue  # dashes are characters of the url alphabet: the line after a full one belongs to the block, in the reference too
                stop = len(head) + len(lines) + (len(end) if trail.startswith(end) else 0)
                found = formats.base64_regions(head + lines + trail)
                assert found == [(len(head), stop, "url" if b"-" in body or b"_" in body else "std", plain)]


def test_uneven_lines_are_single_runs():
    raw = bytes(range(96))
    a, b = base64.b64encode(raw[:48]), base64.b64encode(raw)
    assert formats.base64_regions(a + b"\n" + b + b"\n") == [(0, 64, "std", raw[:48]), (65, 193, "std", raw)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"\xe8", b"\xe9", b"\0", b"\xff", b"abc"]), max_size=60))
def test_calls_are_rewritten_and_given_back(parts):
    data = b"".join(parts)
    assert kernels.bcj(kernels.bcj(data), True) == data


def test_machine_code_is_packed_with_absolute_calls():
    import random

    assert kernels.bcj(b"\x90\xe8\x01\x00\x00\x00\xe9\xff") == b"\x90\xe8\x07\x00\x00\x00\xe9\xff"
    r, code = random.Random(5), bytearray()
    for _ in range(3000):
        code += r.randbytes(24) + bytes(4)
        code += b"\xe8" + ((r.choice((64, 4096, 9000)) - len(code) - 5) & 0xFFFFFFFF).to_bytes(4, "little")
    assert kernels.looks_executable(bytes(code)) and kernels.best_of(bytes(code))[0] == "zstd-bcj"
