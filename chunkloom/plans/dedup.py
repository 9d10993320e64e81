"""Dedup analytics: statistics, counters, reference counts, ownership and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.operators.ranges import running_sum
from chunkloom.plans.registry import query
from chunkloom.plans.shared import written
from chunkloom.sources.catalog import INDEPENDENT, META_SQL, MODES, SQL, chunk_meta, chunks, files, load, refs


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 1 where there is nothing to divide by."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a.cast("double") / b.cast("double"))


@query("exact_dedup_stats", 63, 95, 99, sql=f"""
    WITH {SQL} SELECT (SELECT count(*) FROM files) AS n_files, count(*) AS n_chunks, CAST(sum(ref_count) AS BIGINT) AS n_refs,
        CAST(sum(raw_size * ref_count) AS BIGINT) AS logical_bytes, CAST(sum(raw_size) AS BIGINT) AS unique_bytes,
        CAST(sum(raw_size * ref_count) - sum(raw_size) AS BIGINT) AS saved_bytes,
        CAST(sum(raw_size * ref_count) AS DOUBLE) / CAST(sum(raw_size) AS DOUBLE) AS dedup_ratio
    FROM chunks""")
def exact_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = files(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_files"))
    c = chunks(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("ref_count").alias("n_refs"),
        F.sum(F.col("raw_size") * F.col("ref_count")).alias("logical_bytes"),
        F.sum("raw_size").alias("unique_bytes"),
    )
    both = n.join(c)  # one row each
    return both.select("*", (F.col("logical_bytes") - F.col("unique_bytes")).alias("saved_bytes"), ratio(F.col("logical_bytes"), F.col("unique_bytes")).alias("dedup_ratio"))


@query("store_stats", 63, sql=f"""
    WITH {META_SQL} SELECT compression, count(*) AS n, CAST(sum(raw_size * ref_count) AS BIGINT) AS logical_bytes, CAST(sum(raw_size) AS BIGINT) AS unique_bytes,
        CAST(sum(stored_size) AS BIGINT) AS physical_bytes,
        CASE WHEN sum(stored_size) = 0 THEN 1.0 ELSE CAST(sum(raw_size) AS DOUBLE) / CAST(sum(stored_size) AS DOUBLE) END AS compression_ratio,
        count(*) FILTER (WHERE region IS NOT NULL) AS in_regions, count(*) FILTER (WHERE base IS NOT NULL) AS deltas
    FROM meta GROUP BY compression""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_meta(spark, sf_dir).groupBy("compression").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("raw_size") * F.col("ref_count")).alias("logical_bytes"),
        F.sum("raw_size").alias("unique_bytes"),
        F.sum("stored_size").alias("physical_bytes"),
        ratio(F.sum("raw_size"), F.sum("stored_size")).alias("compression_ratio"),
        F.count("region").alias("in_regions"),
        F.count("base").alias("deltas"),
    )


def counters(r: DataFrame) -> DataFrame:
    """The maintained counters, recomputed from manifest rows: a partial aggregate by chunk, then one row."""
    per = r.groupBy("hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("refs"), F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("logical_bytes"))


_COUNTERS = "count(*) AS chunks, CAST(coalesce(sum(n), 0) AS BIGINT) AS refs, CAST(coalesce(sum(size), 0) AS BIGINT) AS unique_bytes, CAST(coalesce(sum(size * n), 0) AS BIGINT) AS logical_bytes"


@query("counter_scan", 64, sql=f"WITH {SQL}, p AS (SELECT hash, max(size) AS size, count(*) AS n FROM refs GROUP BY hash) SELECT {_COUNTERS} FROM p")
def counter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(refs(spark, sf_dir))


@query("incremental_counters", 65, sql=f"""
    WITH {SQL}, p AS (SELECT hash, max(size) AS size, count(*) AS n, count(*) FILTER (WHERE id % 2 = 0) AS before FROM refs GROUP BY hash)
    SELECT count(*) FILTER (WHERE before = 0) AS new_chunks, CAST(sum(n - before) AS BIGINT) AS new_refs,
        CAST(coalesce(sum(size) FILTER (WHERE before = 0), 0) AS BIGINT) AS new_unique_bytes, CAST(sum(size * (n - before)) AS BIGINT) AS new_logical_bytes FROM p""")
def incremental_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second batch (odd documents) adds to the counters of the first (even documents), in one aggregation."""
    per = refs(spark, sf_dir).groupBy("hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % 2 == 0).alias("before"))
    new = F.col("before") == 0
    return per.agg(
        F.count_if(new).alias("new_chunks"),
        F.sum(F.col("n") - F.col("before")).alias("new_refs"),
        F.coalesce(F.sum(F.when(new, F.col("size"))), F.lit(0)).alias("new_unique_bytes"),
        F.sum(F.col("size") * (F.col("n") - F.col("before"))).alias("new_logical_bytes"),
    )


@query("dup_groups", 95, sql="SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, CAST(sum(strlen(text)) - max(strlen(text)) AS BIGINT) AS wasted FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    out = d.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), (F.sum("size") - F.max("size")).alias("wasted"))
    return out.where("n > 1")


@query("keep_first_per_hash", 95, sql="SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY 2")
def keep_first_per_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "hash")


@query("page_dedup", 95, sql="SELECT sha256(html) AS hash, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def page_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").groupBy(F.sha2("html", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("bytes"))


@query("line_refcounts", 66, sql=f"WITH {SQL} SELECT hash, ref_count, raw_size FROM chunks WHERE ref_count > 1")
def line_refcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("ref_count > 1").select("hash", "ref_count", "raw_size")


@query("refcount_reconcile", 66, sql=f"""
    WITH {META_SQL}, used AS (SELECT l_partkey AS chunk, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT base, count(*) FROM meta WHERE base IS NOT NULL GROUP BY 1),
    expected AS (SELECT chunk, CAST(sum(n) AS BIGINT) AS expected FROM used GROUP BY 1)
    SELECT m.chunk, m.ref_count AS stored, coalesce(e.expected, 0) AS expected FROM meta m LEFT JOIN expected e USING (chunk)
    WHERE m.ref_count <> coalesce(e.expected, 0) AND m.staged = 0""")
def refcount_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest occurrences plus delta children against the stored count; staged rows are exempt."""
    m = chunk_meta(spark, sf_dir)
    manifest = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    children = m.where("base is not null").groupBy(F.col("base").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    expected = manifest.unionByName(children).groupBy("chunk").agg(F.sum("n").alias("expected"))
    out = m.join(expected, "chunk", "left").select("chunk", F.col("ref_count").alias("stored"), F.coalesce("expected", F.lit(0)).alias("expected"), "staged")
    return out.where((F.col("stored") != F.col("expected")) & (F.col("staged") == 0)).drop("staged")


@query("owner_usage", 67, sql=f"WITH {SQL} SELECT owner, greatest(CAST(sum(size) AS BIGINT), 0) AS used_bytes, count(*) AS n_files FROM files GROUP BY owner")
def owner_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy("owner").agg(F.greatest(F.sum("size"), F.lit(0)).alias("used_bytes"), F.count(F.lit(1)).alias("n_files"))


@query("owner_chunk_counts", 68, sql=f"WITH {SQL} SELECT owner, hash, count(*) AS cnt FROM refs GROUP BY ALL")
def owner_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs(spark, sf_dir).groupBy("owner", "hash").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 0")


@query("owner_chunk_release", 68, sql=f"""
    WITH {SQL} SELECT owner, hash, CAST(sum(CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS cnt FROM refs GROUP BY ALL HAVING sum(CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END) > 0""")
def owner_chunk_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after every third document is deleted; rows at zero go."""
    return refs(spark, sf_dir).groupBy("owner", "hash").agg(F.sum(F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("cnt")).where("cnt > 0")


@query("owner_shared_bytes", 68, 42, sql=f"""
    WITH {SQL}, o AS (SELECT hash, max(size) AS size, count(DISTINCT owner) AS owners FROM refs GROUP BY hash)
    SELECT owners, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes FROM o GROUP BY owners""")
def owner_shared_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = refs(spark, sf_dir).groupBy("hash", "owner").agg(F.max("size").alias("size")).groupBy("hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("owners"))
    return per.groupBy("owners").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"))


QUOTA = 100_000


@query("owner_quota_reject", 51, 122, sql=f"""
    WITH RECURSIVE {SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY id) AS k FROM files),
    run(owner, k, id, size, used, accepted) AS (
        SELECT owner, k, id, size, CASE WHEN size <= {QUOTA} THEN size ELSE 0 END, size <= {QUOTA} FROM f WHERE k = 1
        UNION ALL
        SELECT f.owner, f.k, f.id, f.size, run.used + CASE WHEN run.used + f.size <= {QUOTA} THEN f.size ELSE 0 END, run.used + f.size <= {QUOTA}
        FROM run JOIN f ON f.owner = run.owner AND f.k = run.k + 1)
    SELECT owner, id, size, CAST(used AS BIGINT) AS used, accepted FROM run""")
def owner_quota_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads in order per owner; a rejected one doesn't consume quota.

    Rounds of prefix sums instead of one pass an owner: of the files that fit what is left of a quota, all before the first
    overflow are accepted; what is left then shrinks below the file that overflowed, and the next round looks at the
    files behind that still fit. No owner is one task, and a round is written before the next.
    """
    f = files(spark, sf_dir).select("owner", "id", "size").where("owner is not null")
    room = f.select("owner").distinct().withColumn("room", F.lit(QUOTA).cast("long"))
    todo, taken = f.where(F.col("size") <= QUOTA), []
    while True:
        fits = todo.join(room.withColumnRenamed("owner", "of"), F.col("owner") == F.col("of")).where("size <= room").drop("of")
        run = written(running_sum(fits, ["owner"], F.col("id"), F.col("size"), "upto"))
        if run.isEmpty():
            break
        taken.append(run.where("upto <= room").select("owner", "id"))
        used = run.where("upto <= room").groupBy(F.col("owner").alias("of")).agg(F.max("upto").alias("used"))
        room = written(room.join(used, F.col("owner") == F.col("of"), "left").select("owner", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")))
        todo = run.where("upto > room").select("owner", "id", "size")
    accepted = f.select("owner", "id").limit(0)
    for ids in taken:
        accepted = accepted.union(ids)
    judged = f.join(accepted.select(F.col("owner").alias("a_owner"), F.col("id").alias("a_id")), (F.col("owner") == F.col("a_owner")) & (F.col("id") == F.col("a_id")), "left")
    judged = judged.select("owner", "id", "size", F.col("a_id").isNotNull().alias("accepted"))
    return running_sum(judged, ["owner"], F.col("id"), F.when(F.col("accepted"), F.col("size")).otherwise(0), "used").select("owner", "id", "size", "used", "accepted")


@query("owner_first_overflow", 51, sql=f"""
    WITH {SQL}, r AS (SELECT owner, id, CAST(sum(size) OVER (PARTITION BY owner ORDER BY id) AS BIGINT) AS running FROM files)
    SELECT owner, min(id) AS id, min(running) AS running FROM r WHERE running > {QUOTA} GROUP BY owner""")
def owner_first_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = running_sum(files(spark, sf_dir).select("owner", "id", "size"), ["owner"], F.col("id"), F.col("size"), "running")
    return r.where(F.col("running") > QUOTA).groupBy("owner").agg(F.min("id").alias("id"), F.min("running").alias("running"))


@query("upload_guards", 51, 2, sql="""
    SELECT doc_id, strlen(text) AS size, CASE WHEN strlen(text) > 8192 THEN 'too_large' WHEN strlen(text) = 0 THEN 'empty' ELSE 'ok' END AS verdict FROM documents""")
def upload_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return load(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.when(size > 8192, "too_large").when(size == 0, "empty").otherwise("ok").alias("verdict"))


@query("owner_isolation", 42, sql=f"WITH {SQL} SELECT id, name, size FROM files WHERE owner = 'src1'")
def owner_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("owner = 'src1'").select("id", "name", "size")


@query("owner_has_chunk", 42, sql=f"WITH {SQL} SELECT DISTINCT r.hash FROM refs r WHERE r.owner = 'src2' AND EXISTS (SELECT 1 FROM refs o WHERE o.owner = 'src3' AND o.hash = r.hash)")
def owner_has_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = refs(spark, sf_dir)
    return r.where("owner = 'src2'").select("hash").join(r.where("owner = 'src3'").select("hash"), "hash", "left_semi").distinct()


@query("valid_chunk_hash", 43, sql="""
    WITH h AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN left(sha256(text), 63) ELSE 'g' || left(sha256(text), 63) END AS hash FROM documents)
    SELECT doc_id, regexp_full_match(hash, '[0-9a-fA-F]{64}') AS valid FROM h""")
def valid_chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, k = F.sha2("text", 256), F.col("doc_id") % 4
    shown = F.when(k == 0, h).when(k == 1, F.upper(h)).when(k == 2, F.left(h, F.lit(63))).otherwise(F.concat(F.lit("g"), F.left(h, F.lit(63))))
    return load(spark, sf_dir, "documents").select("doc_id", shown.rlike("^[0-9a-fA-F]{64}$").alias("valid"))


@query("representation_checks", 44, 45, sql=f"""
    WITH {META_SQL} SELECT chunk, compression IN ('', 'auto', 'fast', 'balanced', 'max') AS valid_mode,
        compression IN ('zstd', 'raw', 'br', 'zstd-bcj', 'br-bcj', 'bz2') AS independent FROM meta""")
def representation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("compression")
    return chunk_meta(spark, sf_dir).select("chunk", c.isin(*MODES).alias("valid_mode"), c.isin(*INDEPENDENT).alias("independent"))


@query("maintenance_candidates", 46, 47, 48, 49, sql=f"""
    WITH {META_SQL} SELECT chunk,
        region IS NULL AND compression <> 'delta' AND ref_count > 0 AS region_eligible,
        region IS NULL AND NOT tried AND compression NOT IN ('delta', 'raw') AND ref_count > 0 AND raw_size > 0 AND raw_size <= 524288 AS small_chunk,
        NOT tried AND region IS NULL AND compression <> 'delta' AND ref_count > 0 AS recompress,
        NOT tried AND compression <> 'delta' AND ref_count > 0 AS try_delta
    FROM meta""")
def maintenance_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    independent, live, free = F.col("compression").isin(*INDEPENDENT), F.col("ref_count") > 0, F.col("region").isNull()
    return chunk_meta(spark, sf_dir).select(
        "chunk",
        (free & independent & live).alias("region_eligible"),
        (free & ~F.col("tried") & independent & (F.col("compression") != "raw") & live & F.col("raw_size").between(1, 524288)).alias("small_chunk"),
        (~F.col("tried") & free & independent & live).alias("recompress"),
        (~F.col("tried") & (F.col("compression") != "delta") & live).alias("try_delta"),
    )


@query("list_page_newest", 35, 40, 88, sql="""
    SELECT o_orderkey AS id, o_custkey AS owner, o_orderdate AS created_at FROM orders
    WHERE (o_orderdate < TIMESTAMP '1997-01-01' OR (o_orderdate = TIMESTAMP '1997-01-01' AND o_orderkey > 100))
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def list_page_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyset page after the cursor (1997-01-01, 100): newest first, ids ascending, cursor exclusive."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("created_at"))
    at = F.lit("1997-01-01").cast(T.TimestampNTZType())
    after = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > 100))
    return o.where(after).orderBy(F.desc("created_at"), "id").limit(100)


@query("list_page_owner", 88, 42, sql=f"WITH {SQL}, p AS (SELECT id, name, size FROM files WHERE owner = 'src0' ORDER BY id DESC LIMIT 11) SELECT id, name, size, (SELECT count(*) FROM p) > 10 AS more FROM p ORDER BY id DESC LIMIT 10")
def list_page_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of ten of one owner, and whether there is a next cursor."""
    p = files(spark, sf_dir).where("owner = 'src0'").select("id", "name", "size").orderBy(F.desc("id")).limit(11)
    more = p.agg((F.count(F.lit(1)) > 10).alias("more"))
    return p.join(more).orderBy(F.desc("id")).limit(10)


@query("manifest_view", 36, 37, sql="""
    SELECT doc_id AS id, CASE WHEN lang <> 'en' THEN 'server' ELSE '' END AS encoding, CASE WHEN lang = 'en' THEN len(string_split(text, chr(10))) END AS n_chunks,
        CASE WHEN n_chars > 2000 THEN n_chars ELSE strlen(text) END AS chunked FROM documents""")
def manifest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, en = load(spark, sf_dir, "documents"), F.col("lang") == "en"
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(~en, "server").otherwise("").alias("encoding"),
        F.when(en, F.size(F.split("text", "\n", -1)).cast("long")).alias("n_chunks"),
        F.when(F.col("n_chars") > 2000, F.col("n_chars")).otherwise(F.octet_length("text").cast("long")).alias("chunked"),
    )


@query("user_view", 38, sql="""
    SELECT c_custkey AS id, c_name AS name, coalesce(u.used, 0) AS used_bytes, CAST(floor(c_acctbal) AS BIGINT) AS quota_bytes, c_mktsegment = 'BUILDING' AS admin
    FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS used FROM orders GROUP BY 1) u ON u.o_custkey = c_custkey""")
def user_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).alias("used"))
    c = load(spark, sf_dir, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.coalesce("used", F.lit(0)).alias("used_bytes"), F.floor("c_acctbal").alias("quota_bytes"), (F.col("c_mktsegment") == "BUILDING").alias("admin"))


@query("stats_json", 34, sql=f"""WITH {SQL} SELECT owner, '{{"owner":"' || owner || '","files":' || count(*) || ',"bytes":' || CAST(sum(size) AS BIGINT) || '}}' AS json FROM files GROUP BY owner""")
def stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = files(spark, sf_dir).groupBy("owner").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return s.select("owner", F.to_json(F.struct("owner", "files", "bytes")).alias("json"))


@query("prometheus_lines", 34, 76, sql="""
    SELECT 'requests_total{method="' || event_type || '",class="' || (CASE WHEN value < 50 THEN '2xx' WHEN value < 80 THEN '4xx' ELSE '5xx' END) || '"} ' || count(*) AS line FROM events GROUP BY event_type, CASE WHEN value < 50 THEN '2xx' WHEN value < 80 THEN '4xx' ELSE '5xx' END""")
def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("value") < 50, "2xx").when(F.col("value") < 80, "4xx").otherwise("5xx")
    n = load(spark, sf_dir, "events").groupBy("event_type", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.concat(F.lit('requests_total{method="'), "event_type", F.lit('",class="'), "class", F.lit('"} '), F.col("n").cast("string")).alias("line"))


BUCKETS = (0.005, 0.025, 0.1, 0.5, 2.0, 10.0)


@query("request_histogram", 76, 39, sql="SELECT event_type AS method, " + ", ".join(f"CAST(sum(CASE WHEN value / 20 <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS le_{i}" for i, b in enumerate(BUCKETS)) + ", count(*) AS n FROM events GROUP BY 1")
def request_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("value") / 20
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(*[F.sum(F.when(seconds <= b, 1).otherwise(0)).alias(f"le_{i}") for i, b in enumerate(BUCKETS)], F.count(F.lit(1)).alias("n"))


@query("status_class", 39, sql="""
    SELECT event_id, CASE WHEN s >= 500 THEN '5xx' WHEN s >= 400 THEN '4xx' WHEN s >= 300 THEN '3xx' WHEN s >= 200 THEN '2xx' ELSE 'other' END AS class
    FROM (SELECT event_id, 100 + event_id * 37 % 500 AS s FROM events)""")
def status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = 100 + F.col("event_id") * 37 % 500
    out = F.when(s >= 500, "5xx").when(s >= 400, "4xx").when(s >= 300, "3xx").when(s >= 200, "2xx").otherwise("other")
    return load(spark, sf_dir, "events").select("event_id", out.alias("class"))


@query("content_ids", 41, 99, sql="SELECT doc_id, left(md5(CAST(doc_id AS VARCHAR)), 32) AS id, sha256(text) AS hash FROM documents")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("id"), F.sha2("text", 256).alias("hash"))
