import io
import zipfile
import zlib

from chunkloom.functions import generators
from chunkloom.functions.containers import exact_streams
from chunkloom.functions.kernels import cut_points
from chunkloom.operators import optimize
from chunkloom.operators.store import Store


def png(raw: bytes, pieces: int) -> bytes:
    packed = zlib.compress(raw, 9)
    step = -(-len(packed) // pieces)
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + b"".join(chunk(b"IDAT", packed[i : i + step]) for i in range(0, len(packed), step)) + chunk(b"IEND", b"")


def test_png_zip_and_pdf_streams():
    raw = b"scanline " * 300
    assert [(k, p, e) for k, _, _, p, e in exact_streams(png(raw, 3))] == [("png", len(raw), True)]
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", raw)
        z.writestr("b", b"stored", zipfile.ZIP_STORED)
        z.writestr("c", raw * 2)
    assert [(k, p, e) for k, _, _, p, e in exact_streams(body.getvalue())] == [("zip", len(raw), True), ("zip", 2 * len(raw), True)]
    pdf = b"%PDF-1.4\n1 0 obj\nstream\r\n" + zlib.compress(raw, 6) + b"\nendstream\n2 0 obj\nstream\nplain\nendstream\n"
    assert [(k, p, e) for k, _, _, p, e in exact_streams(pdf)] == [("pdf", len(raw), True)]
    assert exact_streams(png(raw, 1)[:-20]) == [] or all(e for *_, e in exact_streams(png(raw, 1)[:-20]))
    assert exact_streams(b"") == [] and exact_streams(b"PK\x03\x04") == []


def test_generations_share_most_chunks():
    base = generators.zipf_text(300_000)
    seen, total = {}, 0
    for g in generators.generations(base, 5, scattered=False):
        ends = cut_points(g, 2048)
        total += len(g)
        seen |= {g[a:b]: b - a for a, b in zip([0, *ends], ends)}
    assert total > 3.5 * sum(seen.values())
    assert len(generators.log_lines(5000)) == 5000 and len(generators.noise(100)) == 100


def test_optimisation_finds_deltas_and_skips_what_was_tried(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", 4096)
    base = generators.noise(60_000)
    rows = [(i, f"g{i}", "o", g) for i, g in enumerate(generators.generations(base, 3, 0.01))]
    s.put(spark.createDataFrame(rows, "id long, name string, owner string, data binary"), 1)
    first = {r["pass"]: r for r in optimize.report(s).collect()}
    assert first["deltas"]["chunks"] > 0 and first["deltas"]["after"] < first["deltas"]["before"] / 2
    tried = optimize.plan(s)["tried"]
    assert {r["chunks"] for r in optimize.report(s, tried).collect()} == {0}


def test_new_chunks_find_stored_ones_and_regions_are_reported(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", 4096)
    rows = [(i, f"g{i}", "o", g) for i, g in enumerate(generators.generations(generators.noise(60_000), 2, 0.01))]
    s.put(spark.createDataFrame(rows[:1], "id long, name string, owner string, data binary"), 1)
    tried = spark.createDataFrame([tuple(r) for r in optimize.plan(s)["tried"].collect()], "hash string")
    s.put(spark.createDataFrame(rows[1:], "id long, name string, owner string, data binary"), 2)
    new = s.read("chunks").select("hash").join(tried, "hash", "left_anti").count()
    deltas = optimize.plan(s, tried)["deltas"].collect()
    stored = {r["hash"] for r in tried.collect()}
    assert new and len(deltas) > new / 2 and all(r["hash"] not in stored for r in deltas) and stored & {r["base"] for r in deltas}
    report = {r["pass"]: r for r in optimize.report(s).collect()}
    assert report["regions"]["chunks"] == report["codecs"]["chunks"] > 0 and report["regions"]["before"] == report["codecs"]["before"] >= report["regions"]["after"] > 0
