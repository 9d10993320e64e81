"""Joins, reconciliation and maintenance dataflows of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.operators.ranges import running_sum
from chunkloom.plans.registry import query
from chunkloom.plans.shared import shared_folder, written
from chunkloom.sources.catalog import META_SQL, SQL, chunk_meta, chunks, files, load, refs


@query("missing_chunks", 53, 96, 143, sql="""
    SELECT l_orderkey, l_linenumber, l_partkey AS hash FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size <= 25)""")
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested hashes that aren't stored; the request's order and duplicates are kept by its keys."""
    wanted = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("hash"))
    stored = load(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("hash"))
    return wanted.join(stored, "hash", "left_anti").select("l_orderkey", "l_linenumber", "hash")


@query("dedup_lookup", 54, 144, sql="""
    SELECT l_orderkey, l_linenumber, l_partkey AS chunk, p_partkey IS NOT NULL AS hit FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON l_partkey = p_partkey""")
def dedup_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = load(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey")
    out = load(spark, sf_dir, "lineitem").join(stored, F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("chunk"), F.col("p_partkey").isNotNull().alias("hit"))


@query("manifest_resolve", 56, 33, sql="""
    SELECT l_orderkey AS id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS chunks, CAST(sum(CAST(p_size AS BIGINT)) AS BIGINT) AS bytes
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def manifest_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("c"))))
    return m.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(ordered, lambda x: x["c"].cast("string")), ",").alias("chunks"), F.sum(F.col("p_size").cast("long")).alias("bytes"))


@query("file_reconstruct", 33, 56, 132, sql="SELECT doc_id AS id, sha256(text) AS hash, strlen(text) AS size FROM documents")
def file_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in order, concatenated and hashed: the digest must be the whole text's."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    whole = F.array_join(F.transform(parts, lambda x: x["line"]), "\n")
    out = refs(spark, sf_dir).groupBy("id").agg(whole.alias("text"))
    return out.select("id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))


@query("conversation_reconstruct", 33, sql="SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY 1")
def conversation_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"), F.count(F.lit(1)).alias("turns"))


DEPTH = 32


@query("chain_depth", 57, sql=f"""
    WITH RECURSIVE {META_SQL}, walk(chunk, onto, depth) AS (
        SELECT chunk, base, 1 FROM meta WHERE base IS NOT NULL
        UNION ALL SELECT w.chunk, m.base, w.depth + 1 FROM walk w JOIN meta m ON m.chunk = w.onto WHERE m.base IS NOT NULL AND w.depth < {DEPTH})
    SELECT chunk, CAST(max(depth) AS INTEGER) AS depth FROM walk GROUP BY chunk""")
def chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of every delta chain, by pointer doubling: each written round squares the step and drops what has arrived."""
    walk = written(chunk_meta(spark, sf_dir).where("base is not null").select("chunk", F.col("base").alias("at"), F.lit(1).alias("depth")))
    for _ in range(DEPTH.bit_length()):
        jump = walk.select(F.col("chunk").alias("j_chunk"), F.col("at").alias("j_at"), F.col("depth").alias("j_depth"))
        step = walk.join(jump, F.col("at") == F.col("j_chunk"), "left")
        # a chunk whose pointer has left the table may still be met by the pointers of others
        step = written(step.select("chunk", F.coalesce("j_at", "at").alias("at"), (F.col("depth") + F.coalesce("j_depth", F.lit(0))).alias("depth"), F.col("j_chunk").isNull().alias("ended")))
        walk = step.drop("ended")
        if step.where("not ended").isEmpty():
            break
    return walk.select("chunk", F.least("depth", F.lit(DEPTH)).alias("depth"))


@query("files_referencing_bad", 58, 132, sql=f"WITH {SQL} SELECT DISTINCT id, owner FROM refs WHERE hash LIKE '00%'")
def files_referencing_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = chunks(spark, sf_dir).where("hash like '00%'").select("hash")
    r = refs(spark, sf_dir).select("id", "owner", "hash")
    return r.join(bad, "hash", "left_semi").select("id", "owner").distinct()


@query("fsck_index_reconcile", 59, sql="""
    WITH e AS (SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderkey % 10 <> 3),
    s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS owner FROM orders WHERE o_orderkey % 10 <> 5)
    SELECT count(*) FILTER (WHERE e.id IS NULL) AS orphan, count(*) FILTER (WHERE s.id IS NULL) AS missing,
        count(*) FILTER (WHERE e.id IS NOT NULL AND s.id IS NOT NULL AND e.owner IS DISTINCT FROM s.owner) AS differing
    FROM e FULL JOIN s ON e.id = s.id""")
def fsck_index_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    e = o.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("e_id"), F.col("o_custkey").alias("e_owner"))
    s = o.where("o_orderkey % 10 <> 5").select(F.col("o_orderkey").alias("s_id"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("s_owner"))
    both = e.join(s, F.col("e_id") == F.col("s_id"), "full_outer")
    here = F.col("e_id").isNotNull() & F.col("s_id").isNotNull()
    return both.agg(F.count_if(F.col("e_id").isNull()).alias("orphan"), F.count_if(F.col("s_id").isNull()).alias("missing"), F.count_if(here & ~F.col("e_owner").eqNullSafe(F.col("s_owner"))).alias("differing"))


@query("fsck_usage_reconcile", 60, sql="""
    WITH stored AS (SELECT c_custkey AS owner, CAST(c_custkey % 3 AS BIGINT) AS used FROM customer WHERE c_custkey % 5 <> 0),
    actual AS (SELECT o_custkey AS owner, count(*) AS used FROM orders GROUP BY 1)
    SELECT s.owner, s.used AS stored, coalesce(a.used, 0) AS actual FROM stored s LEFT JOIN actual a USING (owner) WHERE s.used <> coalesce(a.used, 0)""")
def fsck_usage_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = load(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") % 3).alias("stored"))
    actual = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    out = stored.join(actual, "owner", "left").select("owner", "stored", F.coalesce("n", F.lit(0)).alias("actual"))
    return out.where("stored <> actual")


@query("dangling_refs", 61, sql=f"""
    WITH {META_SQL}, live AS (SELECT chunk FROM meta WHERE ref_count > 0)
    SELECT 'manifest' AS kind, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT chunk FROM live)
    UNION ALL SELECT 'base', count(*) FROM meta WHERE base IS NOT NULL AND base NOT IN (SELECT chunk FROM live)
    UNION ALL SELECT 'region', count(*) FROM meta WHERE region IS NOT NULL AND region NOT IN (SELECT 'r' || x FROM (SELECT unnest(range(50)) AS x))""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = chunk_meta(spark, sf_dir)
    live = m.where("ref_count > 0").select("chunk")
    regions = spark.range(50).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("region"))
    cases = {
        "manifest": load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk")).join(live, "chunk", "left_anti"),
        "base": m.where("base is not null").select(F.col("base").alias("chunk")).join(live, "chunk", "left_anti"),
        "region": m.where("region is not null").select("region").join(regions, "region", "left_anti"),
    }
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in cases.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("orphan_chunks", 96, sql="SELECT p_partkey AS chunk FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = load(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk"))
    return p.join(used, F.col("chunk") == F.col("l_partkey"), "left_anti")


#: Delta children of the stars: five to a base, with their plain and stored sizes.
STARS_SQL = f"{META_SQL}, kids AS (SELECT chunk // 40 * 40 AS base, chunk, raw_size, stored_size FROM meta WHERE compression = 'delta')"


def _kids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_meta(spark, sf_dir).where("compression = 'delta'").select((F.floor(F.col("chunk") / 40) * 40).alias("base"), "chunk", "raw_size", "stored_size")


@query("star_groups", 69, 126, sql=f"""
    WITH {STARS_SQL} SELECT base, count(*) AS n, min(stored_size) AS smallest, CAST(sum(stored_size) AS BIGINT) AS bytes, string_agg(CAST(chunk AS VARCHAR), ',' ORDER BY stored_size, chunk) AS children FROM kids GROUP BY 1 HAVING count(*) >= 4""")
def star_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases with at least four delta children, the children in order of what they take (runs of CHAIN of them: see star_chain)."""
    inside = F.array_sort(F.collect_list(F.struct("stored_size", "chunk")))
    out = _kids(spark, sf_dir).groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("stored_size").alias("smallest"), F.sum("stored_size").alias("bytes"), inside.alias("c")).where("n >= 4")
    return out.select("base", "n", "smallest", "bytes", F.array_join(F.transform("c", lambda x: x["chunk"].cast("string")), ",").alias("children"))


#: Children of a star are chained in runs of so many, twice the depth limit.
CHAIN = 2 * DEPTH


@query("star_chain", 86, 126, sql=f"""
    WITH RECURSIVE {STARS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY stored_size, chunk) - 1 AS k FROM kids WHERE base IN (SELECT base FROM kids GROUP BY 1 HAVING count(*) >= 4)),
    c AS (SELECT *, k // {CHAIN} AS run, k % {CHAIN} AS i FROM o),
    walk(base, run, i, chunk, onto, size, ok, last, last_raw) AS (
        SELECT base, run, i, chunk, CAST(NULL AS BIGINT), stored_size, true, chunk, raw_size FROM c WHERE i = 0
        UNION ALL SELECT c.base, c.run, c.i, c.chunk, w.last,
            least(c.stored_size, abs(c.raw_size - w.last_raw) // 4 + 4096), abs(c.raw_size - w.last_raw) // 4 + 4096 < c.stored_size,
            CASE WHEN abs(c.raw_size - w.last_raw) // 4 + 4096 < c.stored_size THEN c.chunk ELSE w.last END,
            CASE WHEN abs(c.raw_size - w.last_raw) // 4 + 4096 < c.stored_size THEN c.raw_size ELSE w.last_raw END
        FROM walk w JOIN c ON c.base = w.base AND c.run = w.run AND c.i = w.i + 1)
    SELECT base, chunk, CASE WHEN ok THEN onto END AS onto, CAST(size AS BIGINT) AS size FROM walk""")
def star_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children in order of stored size, each tried against the previous child that moved with success.

    A move succeeds where the delta against the neighbour (a quarter of the difference in plain size and a header, in this
    model) is smaller than what is stored; otherwise the child stays on its base and the next one tries the same
    neighbour. Chains start anew every CHAIN children, so a group is never larger; numbering is a sort, not a gather.
    """
    kids = _kids(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("base").orderBy("stored_size", "chunk")) - 1
    stars = kids.groupBy("base").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("base")
    runs = kids.join(stars, "base", "left_semi").withColumn("run", F.floor(k / CHAIN))
    row = F.struct("stored_size", "chunk", "raw_size")
    grouped = runs.groupBy("base", "run").agg(F.array_sort(F.collect_list(row)).alias("kids"))
    empty = F.struct(F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("raw"), F.expr("cast(array() as array<struct<chunk: bigint, onto: bigint, size: bigint>>)").alias("out"))

    def step(state, kid):
        size = F.floor(F.abs(kid["raw_size"] - state["raw"]) / 4) + 4096
        first, fits = state["last"].isNull(), F.coalesce(size < kid["stored_size"], F.lit(False))
        moved = F.struct(kid["chunk"].alias("chunk"), F.when(fits, state["last"]).alias("onto"), F.when(fits, size).otherwise(kid["stored_size"]).alias("size"))
        return F.struct(F.when(first | fits, kid["chunk"]).otherwise(state["last"]).alias("last"), F.when(first | fits, kid["raw_size"]).otherwise(state["raw"]).alias("raw"), F.concat(state["out"], F.array(moved)).alias("out"))

    return grouped.select("base", F.explode(F.aggregate("kids", empty, step, lambda s: s["out"])).alias("m")).select("base", "m.*")


@query("zombie_chunks", 70, sql=f"""
    WITH {META_SQL}, kids AS (SELECT base AS chunk, count(*) AS n FROM meta WHERE base IS NOT NULL GROUP BY 1)
    SELECT m.chunk, k.n AS kids FROM meta m JOIN kids k USING (chunk) WHERE m.compression = 'delta' AND m.ref_count = k.n""")
def zombie_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zombies(chunk_meta(spark, sf_dir))


def _zombies(m: DataFrame) -> DataFrame:
    kids = m.where("base is not null").groupBy(F.col("base").alias("chunk")).agg(F.count(F.lit(1)).alias("kids"))
    return m.where("compression = 'delta'").join(kids, "chunk").where("ref_count = kids").select("chunk", "kids")


@query("zombie_rescue", 125, sql=f"""
    WITH {META_SQL}, z AS (SELECT m.chunk, m.base, m.stored_size FROM meta m JOIN (SELECT base, count(*) AS n FROM meta WHERE base IS NOT NULL GROUP BY 1) k ON k.base = m.chunk WHERE m.compression = 'delta' AND m.ref_count = k.n),
    g AS (SELECT z.chunk, CAST(sum(c.stored_size / 8) AS BIGINT) AS growth, any_value(z.stored_size) AS freed, any_value(z.base) AS onto, count(*) AS children FROM z JOIN (SELECT base, stored_size // 8 * 8 AS stored_size FROM meta) c ON c.base = z.chunk GROUP BY 1)
    SELECT chunk, onto, children, growth, freed FROM g WHERE growth < freed""")
def zombie_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children move to the grandparent where their growth (an eighth of each here) is less than what the zombie takes."""
    return _rescues(chunk_meta(spark, sf_dir))


def _rescues(m: DataFrame) -> DataFrame:
    child = m.where("base is not null").select(F.col("base").alias("of"), F.floor(F.col("stored_size") / 8).alias("more"))
    grown = child.groupBy("of").agg(F.count(F.lit(1)).alias("children"), F.sum("more").alias("growth"))
    z = m.where("compression = 'delta'").join(grown, (F.col("chunk") == F.col("of")) & (F.col("ref_count") == F.col("children")))
    return z.where("growth < stored_size").select("chunk", F.col("base").alias("onto"), "children", "growth", F.col("stored_size").alias("freed"))


@query("region_liveness", 71, 128, sql=f"""
    WITH {META_SQL} SELECT region, count(*) AS members, count(*) FILTER (WHERE ref_count > 0) AS live, count(*) FILTER (WHERE ref_count > 0) * 2 < count(*) AS dissolve FROM meta WHERE region IS NOT NULL GROUP BY 1""")
def region_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chunk_meta(spark, sf_dir).where("region is not null").groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("ref_count") > 0).alias("live"))
    return r.select("*", (F.col("live") * 2 < F.col("members")).alias("dissolve"))


@query("pack_live_ratio", 71, 129, 29, sql=f"""
    WITH {META_SQL}, p AS (SELECT chunk // 64 AS pack, CAST(sum(stored_size) AS BIGINT) AS total, CAST(coalesce(sum(stored_size) FILTER (WHERE ref_count > 0), 0) AS BIGINT) AS live FROM meta GROUP BY 1)
    SELECT pack, total, live, live = 0 OR (total >= 4194304 AND live * 2 < total) AS compact FROM p""")
def pack_live_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = chunk_meta(spark, sf_dir)
    p = m.groupBy(F.floor(F.col("chunk") / 64).alias("pack")).agg(F.sum("stored_size").alias("total"), F.coalesce(F.sum(F.when(F.col("ref_count") > 0, F.col("stored_size"))), F.lit(0)).alias("live"))
    return p.select("*", ((F.col("live") == 0) | ((F.col("total") >= 4194304) & (F.col("live") * 2 < F.col("total")))).alias("compact"))


@query("pack_placement", 28, 29, sql=f"""
    WITH {META_SQL}, s AS (SELECT chunk, stored_size, CAST(sum(stored_size) OVER (PARTITION BY chunk % 16 ORDER BY chunk) - stored_size AS BIGINT) AS before FROM meta WHERE stored_size < 131072)
    SELECT chunk, chunk % 16 AS writer, before // 67108864 AS pack, before % 67108864 AS pack_off FROM s""")
def pack_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small representations appended to 64 MiB packs by 16 writers: pack number and offset by running sums."""
    s = chunk_meta(spark, sf_dir).where("stored_size < 131072").select("chunk", "stored_size", (F.col("chunk") % 16).alias("writer"))
    s = running_sum(s, ["writer"], F.col("chunk"), F.col("stored_size"), "upto").withColumn("before", F.col("upto") - F.col("stored_size"))
    return s.select("chunk", "writer", F.floor(F.col("before") / 67108864).alias("pack"), (F.col("before") % 67108864).alias("pack_off"))


@query("gap_runs", 84, sql="""
    WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island, l_returnflag <> 'R' AS eligible FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, island ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM e WHERE eligible)
    SELECT l_orderkey, island, k // 16 AS piece, count(*) AS members, min(l_linenumber) AS first_line FROM r GROUP BY ALL""")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eligible rows, broken by ineligible ones and cut at 16."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    broken = F.col("l_returnflag") == "R"
    e = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sum(F.when(broken, 1).otherwise(0)).over(w).alias("island"), (~broken).alias("eligible")).where("eligible")
    k = F.row_number().over(Window.partitionBy("l_orderkey", "island").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return e.withColumn("piece", F.floor(k / 16)).groupBy("l_orderkey", "island", "piece").agg(F.count(F.lit(1)).alias("members"), F.min("l_linenumber").alias("first_line"))


@query("scrub_batch", 90, 132, sql=f"WITH {SQL} SELECT hash, raw_size FROM chunks WHERE hash > '4' ORDER BY hash LIMIT 200")
def scrub_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("hash > '4'").select("hash", "raw_size").orderBy("hash").limit(200)


@query("scrub_verify", 77, 132, sql=f"""
    WITH {SQL}, d AS (SELECT hash, any_value(line) AS line, max(size) AS size FROM refs GROUP BY hash), b AS (SELECT hash, CASE WHEN hash LIKE '0%' THEN line || 'x' ELSE line END AS line, size FROM d)
    SELECT count(*) AS checked, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE sha256(line) <> hash) AS corrupt FROM b""")
def scrub_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk decoded and hashed again; chunks whose hash starts with 0 were damaged first."""
    d = refs(spark, sf_dir).groupBy("hash").agg(F.min("line").alias("line"), F.max("size").alias("size"))
    damaged = d.withColumn("line", F.when(F.col("hash").startswith("0"), F.concat("line", F.lit("x"))).otherwise(F.col("line")))
    return damaged.agg(F.count(F.lit(1)).alias("checked"), F.sum("size").alias("bytes"), F.count_if(F.sha2("line", 256) != F.col("hash")).alias("corrupt"))


@query("best_base", 91, sql="""
    WITH c AS (SELECT l_partkey AS chunk, l_suppkey AS base, CAST(sum(l_quantity) AS BIGINT) AS delta_len FROM lineitem GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY delta_len, base) AS k FROM c)
    SELECT chunk, base, delta_len FROM b JOIN part ON p_partkey = chunk WHERE k = 1 AND delta_len * 10 < p_size * 9""")
def best_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate with the smallest delta, accepted below nine tenths of the plain size."""
    c = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("chunk"), F.col("l_suppkey").alias("base")).agg(F.sum("l_quantity").cast("long").alias("delta_len"))
    best = c.groupBy("chunk").agg(F.min(F.struct("delta_len", "base")).alias("b")).select("chunk", F.col("b.base").alias("base"), F.col("b.delta_len").alias("delta_len"))
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    return best.join(p, F.col("chunk") == F.col("p_partkey")).where("delta_len * 10 < p_size * 9").select("chunk", "base", "delta_len")


@query("retention_keep", 93, 32, sql="""
    SELECT o_custkey AS owner, o_orderkey AS snapshot FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3""")
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return load(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("snapshot"))


NOW, TTL = 3_000_000, 86_400


@query("staged_expired", 130, 138, sql=f"WITH {META_SQL} SELECT chunk, staged FROM meta WHERE ref_count = 0 AND staged > 0 AND staged < {NOW - TTL}")
def staged_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_meta(spark, sf_dir).where(f"ref_count = 0 and staged > 0 and staged < {NOW - TTL}").select("chunk", "staged")


@query("client_commit", 123, 143, sql="""
    WITH have AS (SELECT p_partkey FROM part WHERE p_size > 5), m AS (SELECT l_orderkey AS id, count(*) AS n, count(p_partkey) AS found FROM lineitem LEFT JOIN have ON l_partkey = p_partkey GROUP BY 1)
    SELECT id, n, found, n = found AS committed FROM m""")
def client_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest commits when every chunk it names exists."""
    have = load(spark, sf_dir, "part").where("p_size > 5").select("p_partkey")
    m = load(spark, sf_dir, "lineitem").join(have, F.col("l_partkey") == F.col("p_partkey"), "left")
    out = m.groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count("p_partkey").alias("found"))
    return out.select("*", (F.col("n") == F.col("found")).alias("committed"))


@query("delete_cascade", 124, sql=f"""
    WITH {SQL}, r AS (SELECT hash, count(*) AS n, count(*) FILTER (WHERE owner = 'src1') AS gone, max(size) AS size FROM refs GROUP BY hash)
    SELECT count(*) FILTER (WHERE gone > 0) AS touched, count(*) FILTER (WHERE gone = n) AS released, CAST(coalesce(sum(size) FILTER (WHERE gone = n), 0) AS BIGINT) AS freed_bytes, CAST(sum(n - gone) AS BIGINT) AS refs_left FROM r""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One owner's files are deleted: references go by occurrence, chunks at zero are released."""
    r = refs(spark, sf_dir).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("owner") == "src1").alias("gone"), F.max("size").alias("size"))
    dead = F.col("gone") == F.col("n")
    return r.agg(F.count_if(F.col("gone") > 0).alias("touched"), F.count_if(dead).alias("released"), F.coalesce(F.sum(F.when(dead, F.col("size"))), F.lit(0)).alias("freed_bytes"), F.sum(F.col("n") - F.col("gone")).alias("refs_left"))


@query("cascade_to_bases", 124, 57, sql=f"""
    WITH RECURSIVE {META_SQL}, dead(chunk) AS (
        SELECT chunk FROM meta WHERE ref_count = 0
        UNION SELECT m.base FROM dead d JOIN meta m ON m.chunk = d.chunk JOIN meta b ON b.chunk = m.base WHERE m.base IS NOT NULL AND b.ref_count <= 1)
    SELECT DISTINCT chunk FROM dead""")
def cascade_to_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released deltas release a base that only they held; repeated to a fixpoint."""
    return _dead(chunk_meta(spark, sf_dir))


def _dead(m: DataFrame) -> DataFrame:
    """Rounds until no further chunk dies, however deep the chains; each round's chunks are written to the shared folder."""
    spark, at, rounds = m.sparkSession, shared_folder(m.sparkSession), []
    m = m.select("chunk", "base", "ref_count")
    weak = m.where("ref_count <= 1").select(F.col("chunk").alias("b_chunk"))
    step = m.where("base is not null").join(weak, F.col("base") == F.col("b_chunk")).select("chunk", "base")
    frontier = m.where("ref_count = 0").select("chunk").distinct()
    while True:
        rounds.append(f"{at}/{len(rounds)}")
        frontier.write.parquet(rounds[-1])
        frontier, dead = spark.read.parquet(rounds[-1]), spark.read.parquet(*rounds)
        if frontier.isEmpty():
            return dead
        frontier = frontier.join(step, "chunk").select(F.col("base").alias("chunk")).distinct().join(dead, "chunk", "left_anti")


#: What fsck compares. present: chunks that exist; wanted: what manifests and deltas refer to; counters kept with the data.
FSCK_SQL = f"""{META_SQL}, present AS (SELECT * FROM meta WHERE chunk % 50 <> 7),
    manifest AS (SELECT l_orderkey AS id, l_partkey AS chunk, CAST(l_quantity AS BIGINT) AS size FROM lineitem),
    wanted AS (SELECT chunk, count(*) AS n FROM (SELECT chunk FROM manifest UNION ALL SELECT base FROM present WHERE compression = 'delta' AND base IS NOT NULL) GROUP BY 1)"""


def _fsck_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    present = chunk_meta(spark, sf_dir).where("chunk % 50 <> 7")
    manifest = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("chunk"), F.col("l_quantity").cast("long").alias("size"))
    bases = present.where("compression = 'delta' and base is not null").select(F.col("base").alias("chunk"))
    wanted = manifest.select("chunk").union(bases).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return present, manifest, wanted


@query("fsck_report", 131, sql=f"""
    WITH {FSCK_SQL}, pair AS (SELECT p.chunk AS here, w.chunk AS there, p.ref_count, w.n, p.staged FROM present p FULL JOIN wanted w ON w.chunk = p.chunk),
    used AS (SELECT o_custkey AS owner, CAST(sum(o_orderkey % 9) AS BIGINT) AS used FROM orders GROUP BY 1), kept AS (SELECT c_custkey AS owner, CAST(c_custkey % 13 AS BIGINT) AS used FROM customer),
    e AS (SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderkey % 10 <> 3), s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS owner FROM orders WHERE o_orderkey % 10 <> 5),
    scan AS (SELECT count(*) AS chunks, sum(raw_size) AS raw, sum(stored_size) AS stored, count(*) FILTER (WHERE compression = 'delta') AS deltas FROM present),
    counter AS (SELECT count(*) AS chunks, sum(raw_size) AS raw, sum(stored_size) AS stored, count(*) FILTER (WHERE compression = 'delta') AS deltas FROM meta)
    SELECT 'refcount' AS problem, count(*) AS n FROM pair WHERE here IS NOT NULL AND ref_count <> coalesce(n, 0)
    UNION ALL SELECT 'orphan', count(*) FROM pair WHERE here IS NOT NULL AND n IS NULL AND staged = 0
    UNION ALL SELECT 'dangling', CAST(coalesce(sum(n), 0) AS BIGINT) + (SELECT count(*) FROM present WHERE region IS NOT NULL AND CAST(region[2:] AS BIGINT) >= 90) FROM pair WHERE here IS NULL
    UNION ALL SELECT 'usage', count(*) FROM kept FULL JOIN used ON used.owner = kept.owner WHERE coalesce(kept.used, 0) <> coalesce(used.used, 0)
    UNION ALL SELECT 'index', count(*) FROM e FULL JOIN s ON e.id = s.id WHERE e.owner IS DISTINCT FROM s.owner
    UNION ALL SELECT 'counter', (SELECT CAST(scan.chunks <> counter.chunks AS BIGINT) + CAST(scan.raw <> counter.raw AS BIGINT) + CAST(scan.stored <> counter.stored AS BIGINT) + CAST(scan.deltas <> counter.deltas AS BIGINT) FROM scan, counter)""")
def fsck_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six counts: wrong reference counts, orphans, dangling references, usage, owner index, kept counters."""
    present, _, wanted = _fsck_inputs(spark, sf_dir)
    both = present.select(F.col("chunk").alias("here"), "ref_count", "staged").join(wanted.select(F.col("chunk").alias("there"), "n"), F.col("here") == F.col("there"), "full_outer")
    here = F.col("here").isNotNull()
    counts = both.agg(
        F.count_if(here & (F.col("ref_count") != F.coalesce("n", F.lit(0)))).alias("refcount"),
        F.count_if(here & F.col("n").isNull() & (F.col("staged") == 0)).alias("orphan"),
        F.coalesce(F.sum(F.when(~here, F.col("n"))), F.lit(0)).alias("dangling"),
    )
    lost = present.where(F.col("region").isNotNull() & (F.substring("region", 2, 9).cast("long") >= 90)).agg(F.count(F.lit(1)).alias("lost"))
    counts = counts.join(lost).select("refcount", "orphan", (F.col("dangling") + F.col("lost")).alias("dangling"))
    o = load(spark, sf_dir, "orders")
    used = o.groupBy(F.col("o_custkey").alias("owner")).agg(F.sum(F.col("o_orderkey") % 9).alias("used"))
    kept = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") % 13).alias("kept"))
    usage = kept.join(used, "owner", "full_outer").agg(F.count_if(F.coalesce("kept", F.lit(0)) != F.coalesce("used", F.lit(0))).alias("usage"))
    e = o.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("e_id"), F.col("o_custkey").alias("e_owner"))
    s = o.where("o_orderkey % 10 <> 5").select(F.col("o_orderkey").alias("s_id"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("s_owner"))
    index = e.join(s, F.col("e_id") == F.col("s_id"), "full_outer").agg(F.count_if(~F.col("e_owner").eqNullSafe(F.col("s_owner"))).alias("index"))
    tally = lambda df, mark: df.agg(*[x.alias(f"{mark}{i}") for i, x in enumerate((F.count(F.lit(1)), F.sum("raw_size"), F.sum("stored_size"), F.count_if(F.col("compression") == "delta")))])
    kept_counts = tally(present, "a").join(tally(chunk_meta(spark, sf_dir), "b"))
    counter = kept_counts.select(sum(((F.col(f"a{i}") != F.col(f"b{i}")).cast("long") for i in range(4)), F.lit(0).cast("long")).alias("counter"))
    return counts.join(usage).join(index).join(counter).unpivot([], ["refcount", "orphan", "dangling", "usage", "index", "counter"], "problem", "n")  # single rows


@query("fsck_repair", 131, sql=f"""
    WITH {FSCK_SQL} SELECT p.chunk, p.ref_count AS before, coalesce(w.n, 0) AS after, w.n IS NULL AND p.staged = 0 AS released
    FROM present p LEFT JOIN wanted w ON w.chunk = p.chunk WHERE p.ref_count <> coalesce(w.n, 0) OR (w.n IS NULL AND p.staged = 0)""")
def fsck_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repair changes: reference counts set to the references found, orphans that aren't staged released."""
    present, _, wanted = _fsck_inputs(spark, sf_dir)
    both = present.join(wanted.select(F.col("chunk").alias("there"), "n"), F.col("chunk") == F.col("there"), "left")
    released = F.col("n").isNull() & (F.col("staged") == 0)
    out = both.select("chunk", F.col("ref_count").alias("before"), F.coalesce("n", F.lit(0)).alias("after"), released.alias("released"))
    return out.where("before <> after or released")


@query("fsck_broken_files", 131, 58, sql=f"WITH {FSCK_SQL} SELECT DISTINCT id FROM manifest WHERE chunk NOT IN (SELECT chunk FROM present)")
def fsck_broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    present, manifest, _ = _fsck_inputs(spark, sf_dir)
    return manifest.join(present.select("chunk"), "chunk", "left_anti").select("id").distinct()


@query("pack_compaction", 129, sql=f"""
    WITH {META_SQL}, p AS (SELECT chunk // 64 AS pack, sum(stored_size) AS total, coalesce(sum(stored_size) FILTER (WHERE ref_count > 0), 0) AS live FROM meta GROUP BY 1)
    SELECT m.chunk, m.chunk // 64 AS pack, m.stored_size FROM meta m JOIN p ON p.pack = m.chunk // 64 WHERE m.ref_count > 0 AND p.live * 4 < p.total * 3""")
def pack_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live representations that are copied forward out of packs less than three quarters live."""
    m = chunk_meta(spark, sf_dir).withColumn("pack", F.floor(F.col("chunk") / 64))
    p = m.groupBy(F.col("pack").alias("p")).agg(F.sum("stored_size").alias("total"), F.coalesce(F.sum(F.when(F.col("ref_count") > 0, F.col("stored_size"))), F.lit(0)).alias("live"))
    return m.where("ref_count > 0").join(p.where("live * 4 < total * 3"), F.col("pack") == F.col("p")).select("chunk", "pack", "stored_size")


@query("union_candidates", 97, 98, sql=f"""
    WITH {SQL}, a AS (SELECT DISTINCT hash FROM refs WHERE owner = 'src4'), b AS (SELECT DISTINCT hash FROM refs WHERE owner = 'src5')
    SELECT (SELECT count(*) FROM (SELECT hash FROM a UNION SELECT hash FROM b)) AS in_either, (SELECT count(*) FROM (SELECT hash FROM a INTERSECT SELECT hash FROM b)) AS in_both,
        (SELECT count(*) FROM (SELECT hash FROM a EXCEPT SELECT hash FROM b)) AS only_first""")
def union_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of two owners' chunk sets from one aggregation."""
    r = refs(spark, sf_dir).where("owner in ('src4', 'src5')").groupBy("hash").agg(F.bool_or(F.col("owner") == "src4").alias("a"), F.bool_or(F.col("owner") == "src5").alias("b"))
    return r.agg(F.count(F.lit(1)).alias("in_either"), F.count_if(F.col("a") & F.col("b")).alias("in_both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"))


@query("owner_index_rebuild", 134, 40, sql=f"WITH {SQL} SELECT owner, id, name, size, row_number() OVER (PARTITION BY owner ORDER BY id DESC) AS rank FROM files")
def owner_index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = running_sum(files(spark, sf_dir).select("owner", "id", "name", "size"), ["owner"], -F.col("id"), F.lit(1).cast("long"), "rank")
    return out.select("owner", "id", "name", "size", "rank")


@query("benchmark_overlap", 55, 58, sql="""
    WITH b AS (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)
    SELECT item_id, count(DISTINCT d.doc_id) AS docs FROM (SELECT DISTINCT item_id, w FROM b WHERE strlen(w) >= 12) b JOIN d USING (w) GROUP BY 1""")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a long word with each benchmark item: an inverted-list candidate join."""
    b = load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("w")).where(F.octet_length("w") >= 12)
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("w")).where(F.octet_length("w") >= 12)
    return d.join(b, "w").select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))
