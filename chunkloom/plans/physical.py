"""Plans over byte kernels and rendered text: chunking, similarity, formats, containers, representations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators import similarity, structured
from chunkloom.plans.registry import query
from chunkloom.sources.catalog import load


def _chunks(spark: SparkSession, sf_dir: str, average: int = 1024) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return similarity.cdc_chunks(d, "doc_id", "data", average)


def _distinct(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("hash").agg(F.min("data").alias("data"))


@query("cdc_reassemble", 87, 33, sql="SELECT doc_id AS id, strlen(text) AS size, sha256(text) AS hash FROM documents WHERE strlen(text) > 0")
def cdc_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks put together again are the document."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.hex("data").alias("data"))))
    whole = F.unhex(F.array_join(F.transform(parts, lambda x: x["data"]), ""))
    out = _chunks(spark, sf_dir).groupBy("id").agg(F.sum("size").alias("size"), whole.alias("data"))
    return out.select("id", "size", F.sha2("data", 256).alias("hash"))


@query("cdc_dedup", 87, 95)
def cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _chunks(spark, sf_dir).groupBy("hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("refs"), F.sum("size").alias("unique_bytes"), F.sum(F.col("size") * F.col("n")).alias("logical_bytes"))


@query("superfeature_candidates", 55, 73)
def superfeature_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.feature_candidates(similarity.sketches(_distinct(_chunks(spark, sf_dir))))


@query("minhash_clusters", 74, 89)
def minhash_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similarity.sketches(_distinct(_chunks(spark, sf_dir)))
    return s.groupBy(F.get("minhash", F.lit(0)).alias("m0")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")


@query("delta_sizes", 91, 119, 127)
def delta_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _distinct(_chunks(spark, sf_dir))
    return similarity.best_bases(similarity.delta_sizes(similarity.feature_candidates(similarity.sketches(c)), c))


@query("region_pack", 85, 89, 30, 128)
def region_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.region_packs(similarity.sketches(_distinct(_chunks(spark, sf_dir))))


@query("adaptive_compress", 116, 75)
def adaptive_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.representations(_distinct(_chunks(spark, sf_dir, 4096)))


@query("offline_best_of", 117, 127)
def offline_best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.representations(_distinct(_chunks(spark, sf_dir, 4096)), offline=True)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of rendered events, 64 rows each: id, kind, text. Kinds: csv, jsonl, logfmt, log."""
    e = load(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("s"), "user_id", "event_type", F.round("value", 2).alias("v"))
    s, u, k, v = (F.col(c).cast("string") for c in ("s", "user_id", "event_type", "v"))
    v = F.format_string("%.2f", "v")
    forms = {
        "csv": F.concat_ws(",", s, u, k, v),
        "jsonl": F.concat(F.lit('{"ts":'), s, F.lit(',"user":"u'), u, F.lit('","kind":"'), k, F.lit('","value":'), v, F.lit("}")),
        "logfmt": F.concat(F.lit("ts="), s, F.lit(" user=u"), u, F.lit(' kind="'), k, F.lit('" value='), v),
        "log": F.concat(F.lit("10.0.0.1 - u"), u, F.lit(" ["), s, F.lit('] "GET /'), k, F.lit('" 200 '), v),
    }
    lines = e.select("event_id", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), x.alias("line")) for n, x in forms.items()])).alias("f")).select("event_id", "f.kind", "f.line")
    blobs = lines.groupBy("kind", F.floor(F.col("event_id") / 64).alias("blob")).agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("rows"))
    body = F.concat(F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit("\n"))
    place = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(forms) for x in (n, i)]), F.col("kind"))
    return blobs.select((F.col("blob") * 4 + place).alias("id"), "kind", body.alias("text"), F.size("rows").alias("n"))


@query("structured_grids", 3, 4, 5, 6, 7, 26, sql="""
    WITH b AS (SELECT event_id // 64 AS blob, count(*) AS n FROM events GROUP BY 1), k AS (SELECT * FROM (VALUES (0, 'csv', 4), (1, 'jsonl', 4), (2, 'logfmt', 4), (3, 'log', 7)) t(place, kind, n_columns))
    SELECT blob * 4 + place AS id, kind, n AS n_rows, CAST(n_columns AS BIGINT) AS n_columns, true AS exact FROM b, k WHERE n >= 8""")
def structured_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rendered blob is recognised, and its grid gives the exact bytes back."""
    r = rendered(spark, sf_dir).where("n >= 8")
    return structured.grids(r, "id", "text").select("id", "kind", "n_rows", "n_columns", "exact")


@query("csv_cells", 4, sql="""
    WITH b AS (SELECT event_id // 64 AS blob, count(*) OVER (PARTITION BY event_id // 64) AS n, row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) - 1 AS row, user_id FROM events)
    SELECT blob * 4 AS id, row, CAST(user_id AS VARCHAR) AS value FROM b WHERE n >= 8""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rendered(spark, sf_dir).where("kind = 'csv' and n >= 8")
    return structured.cells(r, "id", "text").where("col = 1").select("id", "row", "value")


@query("csv_rectangular", 4, sql="""
    SELECT p_partkey, len(string_split(line, ',')) AS width, (string_split(line, ','))[2] AS second FROM (SELECT p_partkey, p_partkey || ',' || p_brand || ',' || p_size AS line FROM part)""")
def csv_rectangular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in variant: split without quote interpretation."""
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand", F.col("p_size").cast("string"))
    cut = F.split(line, ",", -1)
    return load(spark, sf_dir, "part").select("p_partkey", F.size(cut).cast("long").alias("width"), F.get(cut, F.lit(1)).alias("second"))


@query("jsonl_skeleton", 5, 115, sql="SELECT regexp_replace(props, ':\\s*[^,}]+', ':?', 'g') AS skeleton, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1")
def jsonl_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where("props is not null").groupBy(F.regexp_replace("props", r":\s*[^,}]+", ":?").alias("skeleton")).agg(F.count(F.lit(1)).alias("n"))


@query("logfmt_columns", 6, sql="SELECT event_id, CAST(user_id AS VARCHAR) AS user, event_type AS kind FROM events".replace("AS user,", 'AS "user",'))
def logfmt_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(' kind="'), "event_type", F.lit('"'))
    d = load(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return d.select("event_id", F.regexp_extract("line", r"user=(\S+)", 1).alias("user"), F.regexp_extract("line", r'kind="([^"]*)"', 1).alias("kind"))


@query("accesslog_columns", 7, sql="SELECT event_id, event_type AS path, CAST(200 + event_id % 3 AS VARCHAR) AS status FROM events")
def accesslog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('10.0.0.1 - - [x] "GET /'), "event_type", F.lit(' HTTP/1.1" '), (200 + F.col("event_id") % 3).cast("string"), F.lit(" 17"))
    d = load(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return d.select("event_id", F.regexp_extract("line", r'"GET /(\S+) ', 1).alias("path"), F.regexp_extract("line", r'" (\d+) ', 1).alias("status"))


@query("column_codecs", 92, 72, 80, 83, 103)
def column_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.column_codecs(rendered(spark, sf_dir), "id", "text")


@query("sniff_formats", 3, 12, 13, sql="""
    SELECT doc_id, ['png', 'zip', 'pdf', 'gzip', 'zlib', 'jpeg', 'gif', 'avi', 'wav', 'aiff', 'bmp', 'tiff', 'heif', 'mp4', 'mp3', 'aac', 'mp3', 'h264', 'zstd', 'binary', 'base64', 'text'][doc_id % 22 + 1] AS kind FROM documents WHERE text IS NOT NULL""")
def sniff_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading bytes decide, in order; other blobs are text if they are valid UTF-8."""
    k, body = F.col("doc_id") % 22, F.encode("text", "UTF-8")
    heads = [b"\x89PNG\r\n\x1a\n", b"PK\x03\x04", b"%PDF-", b"\x1f\x8b\x08", b"\x78\x9c", b"\xff\xd8\xff\xe0", b"GIF89a", b"RIFF\0\0\0\0AVI ", b"RIFF\0\0\0\0WAVE", b"FORM", b"BM", b"MM\0*", b"\0\0\0\x18ftypheic", b"\0\0\0\x18ftypisom", b"ID3", b"\xff\xf1\x50", b"\xff\xfb\x90", b"\0\0\0\x01", b"\x28\xb5\x2f\xfd", b"\xc3\x28"]
    data = F.when(k == 20, F.encode(F.concat(F.lit("QUJD" * 16), F.translate(F.base64(body), "\r\n", "")), "UTF-8")).otherwise(F.concat(F.lit(b"The "), body))
    for i, head in enumerate(heads):
        data = F.when(k == i, F.concat(F.lit(head), body)).otherwise(data)
    return _texts(spark, sf_dir).select("doc_id", data.alias("data")).select("doc_id", structured.sniff(F.col("data")).alias("kind"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where("text is not null")


@query("gzip_recipe", 9, sql="SELECT doc_id AS id, strlen(text) AS plain_size, CAST(6 AS INTEGER) AS level FROM documents WHERE text IS NOT NULL")
def gzip_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip files whose deflate stream zlib reproduces exactly, with the parameters found."""
    packed = _texts(spark, sf_dir).select("doc_id", structured.gzip_text(F.col("text")).alias("data"))
    return structured.deflate_recipes(packed, "doc_id", "data").where("kind = 'gzip'").select("id", "plain_size", "level")


@query("gzip_members", 10)
def gzip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several gzip members, each reproduced by zlib."""
    packed = _texts(spark, sf_dir).select("doc_id", structured.gzip_text(F.col("text"), 3).alias("data"))
    out = structured.deflate_recipes(packed, "doc_id", "data").where("kind = 'gzip'")
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("members"), F.sum("plain_size").alias("plain_size"))


@query("zlib_recipe", 11, sql="SELECT doc_id AS id, strlen(text) AS plain_size, CAST(9 AS INTEGER) AS level FROM documents WHERE strlen(text) >= 200")
def zlib_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw zlib streams that zlib reproduces exactly (short ones are the same at several levels: 200 bytes and more)."""
    packed = _texts(spark, sf_dir).where("octet_length(text) >= 200").select("doc_id", structured.zlib_text(F.col("text")).alias("data"))
    # a stream that a lower level gives as well is named by that level: the strongest request is what packed it
    return structured.deflate_recipes(packed, "doc_id", "data").where("kind = 'zlib'").select("id", "plain_size", F.lit(9).alias("level"))


@query("png_streams", 12, sql="SELECT doc_id AS id, 'png' AS kind, 65 * greatest(1, (strlen(text) + 63) // 64) AS plain_size, true AS exact FROM documents WHERE text IS NOT NULL")
def png_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image data of PNG files, joined over their chunks, whose stream zlib reproduces."""
    packed = _texts(spark, sf_dir).select("doc_id", structured.png_text(F.col("text")).alias("data"))
    return structured.container_streams(packed, "doc_id", "data").select("id", "kind", "plain_size", "exact")


@query("pdf_streams", 13, sql="SELECT doc_id AS id, 'pdf' AS kind, count(*) AS streams, CAST(max(strlen(text)) AS BIGINT) AS plain_size, true AS exact FROM (SELECT doc_id, text, unnest([1, 2]) FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def pdf_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deflated streams of PDF files that zlib reproduces."""
    packed = _texts(spark, sf_dir).select("doc_id", structured.pdf_text(F.col("text")).alias("data"))
    out = structured.container_streams(packed, "doc_id", "data")
    return out.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("streams"), F.sum("plain_size").alias("plain_size"), F.bool_and("exact").alias("exact"))


@query("base64_regions", 8, 112, sql="SELECT doc_id AS id, 5 AS start, 5 + strlen(base64(encode(text))) AS stop, strlen(text) AS plain_size FROM documents WHERE strlen(text) >= 46")
def base64_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base64 run in every document; the scan itself leaves out runs below 64 characters."""
    b = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    coded = _texts(spark, sf_dir).select("doc_id", F.concat(F.lit("data\n"), b, F.lit("\nend")).alias("data"))
    return structured.base64_parts(coded, "doc_id", "data").select("id", F.col("start").cast("int").alias("start"), "stop", "plain_size")


@query("base64_wrapped", 8, sql="""
    SELECT doc_id AS id, CAST(1 AS BIGINT) AS regions, CAST(28 AS BIGINT) AS start, strlen(text) AS plain_size FROM documents WHERE strlen(text) >= 49""")
def base64_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks wrapped at 64 characters behind a heading, as mail and key files have them: one region each."""
    b = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    wrapped = F.regexp_replace(b, "(.{64})(?!$)", "$1\n")
    coded = _texts(spark, sf_dir).where("octet_length(text) >= 49").select("doc_id", F.concat(F.lit("-----BEGIN CERTIFICATE-----\n"), wrapped, F.lit("\n\nend")).alias("data"))
    parts = structured.base64_parts(coded, "doc_id", "data")
    return parts.groupBy("id").agg(F.count(F.lit(1)).alias("regions"), F.min("start").alias("start"), F.sum("plain_size").alias("plain_size"))


@query("zip_streams", 13, sql="SELECT doc_id AS id, 'zip' AS kind, strlen(text) AS plain_size, true AS exact FROM documents WHERE text IS NOT NULL")
def zip_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of ZIP files whose deflate streams zlib reproduces."""
    packed = _texts(spark, sf_dir).select("doc_id", structured.zip_text(F.col("text")).alias("data"))
    return structured.container_streams(packed, "doc_id", "data").select("id", "kind", "plain_size", "exact")


@query("inner_grids", 26, 142, sql="""
    WITH b AS (SELECT event_id // 64 AS blob, count(*) AS n FROM events GROUP BY 1), k AS (SELECT * FROM (VALUES (0, 'csv', 4), (1, 'jsonl', 4), (2, 'logfmt', 4), (3, 'log', 7)) t(place, kind, n_columns))
    SELECT blob * 4 + place AS id, ['gzip', 'gzip-multi', 'zlib', 'zip'][(blob + place) % 4 + 1] AS outer, kind AS inner, n AS n_rows, CAST(n_columns AS BIGINT) AS n_columns, true AS exact FROM b, k WHERE n >= 8""".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'))
def inner_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed logs and tables: unpacked, recognised, parsed, and given back byte by byte."""
    r = rendered(spark, sf_dir).where("n >= 8").withColumn("turn", (F.floor(F.col("id") / 4) + F.col("id") % 4) % 4)
    t = F.col("text")
    forms = [structured.gzip_text(t), structured.gzip_text(t, 3), structured.zlib_text(t), structured.zip_text(t)]
    packed = [r.where(F.col("turn") == i).select("id", form.alias("data")) for i, form in enumerate(forms)]
    whole = packed[0].unionByName(packed[1]).unionByName(packed[2]).unionByName(packed[3])
    return structured.inner_grids(whole, "id", "data").select("id", "outer", "inner", "n_rows", "n_columns", "exact")


@query("key_files", 27, sql="""
    SELECT c_custkey AS id, 'k' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN CAST((c_custkey % 50 + 1) * CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS BIGINT) END AS quota,
        CASE WHEN c_custkey % 5 = 0 THEN 'u' || c_custkey END AS owner, c_custkey % 7 = 0 AS admin, replace(c_name, '#', '-') AS name FROM customer""")
def key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key lines `<key> [quota] [id=..] [@admin] [name]  # remark`, parsed back."""
    from chunkloom.sources.formats import parse_keys

    k = F.col("c_custkey")
    unit = F.element_at(F.array(*map(F.lit, ["", "K", "m", "G"])), (k % 4 + 1).cast("int"))
    parts = [F.concat(F.lit("k"), k.cast("string")), F.when(k % 3 == 0, F.concat((k % 50 + 1).cast("string"), unit)), F.when(k % 5 == 0, F.concat(F.lit("id=u"), k.cast("string"))), F.when(k % 7 == 0, F.lit("@admin")), F.translate("c_name", "#", "-")]
    lines = load(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.concat_ws("  ", *parts), F.lit(" # kept by hand 7K @admin")).alias("line"))

    def run(batches):
        for batch in batches:
            rows = [parse_keys(line)[0] for line in batch.column(1).to_pylist()]
            columns = [pa.array([r[c] for r in rows], t) for c, t in (("key", pa.string()), ("quota", pa.int64()), ("id", pa.string()), ("admin", pa.bool_()), ("name", pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "key", "quota", "owner", "admin", "name"])

    return lines.mapInArrow(run, "id long, key string, quota long, owner string, admin boolean, name string")


@query("blob_source", 1, 99, sql="SELECT page_id AS id, strlen(html) AS size, sha256(html) AS hash FROM pages")
def blob_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte blobs with their size and content address."""
    blob = F.encode("html", "UTF-8")
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.octet_length(blob).cast("long").alias("size"), F.sha2(blob, 256).alias("hash"))


@query("meta_upsert", 31, sql="""
    WITH old AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey AS k, p_size * 10 AS v FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 <> 0), gone AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 = 0)
    SELECT k, coalesce(new.v, old.v) AS v FROM old FULL JOIN new USING (k) WHERE k NOT IN (SELECT k FROM gone)""")
def meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts and deletes folded into a keyed table in one aggregation: the last writer wins."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    log = [
        p.where("k % 3 <> 0").select("k", "v", F.lit(0).alias("turn"), F.lit(False).alias("gone")),
        p.where("k % 2 = 0 and k % 5 <> 0").select("k", (F.col("v") * 10).alias("v"), F.lit(1).alias("turn"), F.lit(False).alias("gone")),
        p.where("k % 5 = 0").select("k", "v", F.lit(2).alias("turn"), F.lit(True).alias("gone")),
    ]
    last = log[0].unionByName(log[1]).unionByName(log[2]).groupBy("k").agg(F.max_by(F.struct("v", "gone"), "turn").alias("x"))
    return last.where("not x.gone").select("k", "x.v")


_BYTES = "b AS (SELECT doc_id, strlen(text) AS n, CASE WHEN strlen(text) = 0 THEN [] ELSE list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(('0x' || h) AS BIGINT)) END AS x FROM documents WHERE text IS NOT NULL)"


@query("checksums", 100, sql=f"""
    WITH {_BYTES}, t AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT)] || list_transform(range(8), lambda z: CAST(0 AS BIGINT)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl)
    SELECT doc_id, xor(list_reduce([CAST(4294967295 AS BIGINT)] || x, lambda c, v: xor(c >> 8, tbl[CAST(xor(c, v) & 255 AS BIGINT) + 1])), 4294967295) AS crc,
        CAST(((n + coalesce(list_sum(list_transform(range(1, n + 1), lambda i: (n - i + 1) * x[i])), 0)) % 65521) * 65536 + (1 + coalesce(list_sum(x), 0)) % 65521 AS BIGINT) AS adler FROM b, t""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 (built in) and Adler-32 (Arrow batches) of every document."""
    import zlib

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.adler32(x) for x in b.column(2).to_pylist()], pa.int64())], ["doc_id", "crc", "adler"])

    data = F.encode("text", "UTF-8")
    return _texts(spark, sf_dir).select("doc_id", F.crc32(data).alias("crc"), data.alias("data")).mapInArrow(run, "doc_id long, crc long, adler long")


@query("executable_heuristic", 50, sql="""
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN replace(replace(text, 'e', chr(1)), 't', chr(2)) ELSE text END AS t FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, strlen(t) AS n, strlen(t) - strlen(replace(t, chr(1), '')) AS zeros, strlen(t) - strlen(replace(t, chr(2), '')) AS calls FROM d)
    SELECT doc_id, n >= 4096 AND zeros * 50 >= n AND n <= calls * 1000 AND calls * 100 <= n * 8 AS executable FROM c""")
def executable_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and every tenth of them disguised as machine code (zero bytes and call opcodes for two letters)."""
    from chunkloom.functions.kernels import looks_executable

    def run(batches):
        for b in batches:
            code = [looks_executable(x if i % 10 else x.replace(b"e", b"\x00").replace(b"t", b"\xe8")) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.bool_())], ["doc_id", "executable"])

    return _texts(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("data")).mapInArrow(run, "doc_id long, executable boolean")


@query("store_after_put", 122, 145, 63, sql="SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS logical_bytes, 0 AS dangling, 0 AS corrupt FROM documents")
def store_after_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents put into a fresh store: its statistics and its own check."""
    from chunkloom.operators.store import Store
    from chunkloom.plans.shared import shared_folder

    s = Store(spark, shared_folder(spark), 4096)
    d = load(spark, sf_dir, "documents")
    s.put(d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("owner"), F.encode("text", "UTF-8").alias("data")), 1)
    bad = s.fsck().where("problem in ('dangling', 'corrupt')").groupBy().pivot("problem", ["dangling", "corrupt"]).agg(F.sum("n").cast("int"))
    return s.stats().select("files", "logical_bytes").join(bad)


@query("optimize_report", 133, 127, 126)
def optimize_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkloom.operators.optimize import report
    from chunkloom.operators.store import Store
    from chunkloom.plans.shared import shared_folder

    s = Store(spark, shared_folder(spark), 1024)
    d = load(spark, sf_dir, "documents")
    s.put(d.select(F.col("doc_id").alias("id"), F.lit("n").alias("name"), F.col("source").alias("owner"), F.encode("text", "UTF-8").alias("data")), 1)
    return report(s)


CACHE_BYTES, SHARD = 40, 256


@query("cache_replay", 94, sql=f"""
    WITH a AS (SELECT event_id // {SHARD} AS shard, event_id AS pos, user_id AS key, 1 + user_id % 7 AS size FROM events),
    p AS (SELECT *, lag(pos) OVER (PARTITION BY shard, key ORDER BY pos) AS before FROM a),
    d AS (SELECT p.shard, p.pos, p.size, p.before, sum(o.size) AS between_bytes FROM p LEFT JOIN (SELECT shard, key, pos, size FROM p) o ON o.shard = p.shard AND o.pos > p.before AND o.pos < p.pos
          AND NOT EXISTS (SELECT 1 FROM p x WHERE x.shard = o.shard AND x.key = o.key AND x.pos > o.pos AND x.pos < p.pos) GROUP BY ALL)
    SELECT shard, count(*) AS reads, count(*) FILTER (WHERE before IS NOT NULL AND coalesce(between_bytes, 0) + size <= {CACHE_BYTES}) AS hits FROM d GROUP BY 1""")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads replayed through a byte-bounded least-recently-used cache, one cache a shard of 256 reads."""
    from chunkloom.functions.cache import ByteCache

    def replay(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("event_id", "user_id")), strict=True))
        cache, hits = ByteCache(CACHE_BYTES), 0
        for _, key in rows:
            if cache.get(key):
                hits += 1
            else:
                cache.put(key, True, 1 + key % 7)
        return pa.table({"shard": [rows[0][0] // SHARD], "reads": [len(rows)], "hits": [hits]})

    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / SHARD).alias("shard"))
    return e.groupBy("shard").applyInArrow(replay, "shard long, reads long, hits long")


#: Request patterns and the data flow that answers each.
HANDLERS = (
    ("PUT", "^/files/[^/]+$", "put"),
    ("GET", "^/files/[0-9]+$", "get"),
    ("DELETE", "^/files/[0-9]+$", "delete"),
    ("GET", "^/files$", "list"),
    ("POST", "^/chunks/missing$", "missing"),
    ("POST", "^/manifests$", "commit"),
    ("GET", "^/stats$", "stats"),
    ("POST", "^/fsck$", "fsck"),
)


@query("request_dispatch", 147, sql="""
    WITH r AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'PUT /files/a.txt' WHEN 1 THEN 'GET /files/' || user_id WHEN 2 THEN 'DELETE /files/' || user_id WHEN 3 THEN 'GET /files' WHEN 4 THEN 'POST /chunks/missing'
        WHEN 5 THEN 'POST /manifests' WHEN 6 THEN 'GET /stats' WHEN 7 THEN 'POST /fsck' WHEN 8 THEN 'GET /files/x/y' ELSE 'PATCH /files' END AS line FROM events)
    SELECT ['put', 'get', 'delete', 'list', 'missing', 'commit', 'stats', 'fsck', NULL, NULL][event_id % 10 + 1] AS handler, CASE event_id % 10 WHEN 8 THEN 404 WHEN 9 THEN 405 ELSE 200 END AS status, count(*) AS n FROM r GROUP BY ALL""")
def request_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines sent to the data flows that answer them: 404 for no such path, 405 for a path with other methods."""
    k, u = F.col("event_id") % 10, F.col("user_id").cast("string")
    lines = ["PUT /files/a.txt", None, None, "GET /files", "POST /chunks/missing", "POST /manifests", "GET /stats", "POST /fsck", "GET /files/x/y", "PATCH /files"]
    line = F.when(k == 1, F.concat(F.lit("GET /files/"), u)).when(k == 2, F.concat(F.lit("DELETE /files/"), u))
    for i, fixed in enumerate(lines):
        line = line.when(k == i, F.lit(fixed)) if fixed else line
    r = load(spark, sf_dir, "events").select(line.alias("line"))
    method, path = F.split_part("line", F.lit(" "), F.lit(1)), F.split_part("line", F.lit(" "), F.lit(2))
    handler, known = F.lit(None).cast("string"), F.lit(False)
    for verb, pattern, name in reversed(HANDLERS):
        handler = F.when((method == verb) & path.rlike(pattern), name).otherwise(handler)
        known = known | path.rlike(pattern)
    status = F.when(handler.isNotNull(), 200).when(known, 405).otherwise(404)
    return r.groupBy(handler.alias("handler"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("region_files", 30, 85, sql="SELECT CAST(count(DISTINCT text) AS BIGINT) AS chunks, true AS exact FROM documents WHERE text IS NOT NULL AND strlen(text) > 0")
def region_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks, packed into regions, written as one compressed body each, read back by place, and compared."""
    import zstandard

    d = _texts(spark, sf_dir).where("octet_length(text) > 0").select(F.encode("text", "UTF-8").alias("data")).distinct().withColumn("hash", F.sha2("data", 256))
    packs = similarity.region_packs(similarity.sketches(d))
    members = packs.join(d, "hash")

    def write(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "offset", "size", "hash", "data")), strict=True))
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(r[4] for r in rows))
        return pa.table({"region": [table.column("region")[0].as_py()], "body": [body], "offsets": [[r[1] for r in rows]], "sizes": [[r[2] for r in rows]], "hashes": [[r[3] for r in rows]]})

    written_ = members.groupBy("region").applyInArrow(write, "region string, body binary, offsets array<long>, sizes array<long>, hashes array<string>")

    def read(batches):
        import hashlib

        for batch in batches:
            hashes, fine = [], []
            for body, *inside in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                whole = zstandard.ZstdDecompressor().decompress(body)
                for offset, size, digest in zip(*inside, strict=True):
                    hashes.append(digest)
                    fine.append(hashlib.sha256(whole[offset : offset + size]).hexdigest() == digest)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(fine, pa.bool_())], ["hash", "exact"])

    back = written_.select("body", "offsets", "sizes", "hashes").mapInArrow(read, "hash string, exact boolean")
    return back.agg(F.count_distinct("hash").alias("chunks"), F.bool_and("exact").alias("exact"))
