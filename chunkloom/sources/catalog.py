"""The store's relations, derived from the corpus tables.

files: one row a document; refs: one row a line of it, the content-addressed chunk of the SQL-expressible
plans; chunks: one row a distinct line. The SQL texts state the same relations for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("name"), F.col("source").alias("owner"), F.octet_length("text").cast("long").alias("size"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows: (id, owner, pos, hash, size, line). Sizes are bytes."""
    d = load(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("id"), F.col("source").alias("owner"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("id", "owner", "pos", F.sha2("line", 256).alias("hash"), F.octet_length("line").cast("long").alias("size"), "line")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs(spark, sf_dir).groupBy("hash").agg(F.max("size").alias("raw_size"), F.count(F.lit(1)).alias("ref_count"))


#: The same relations for the oracles.
SQL = """
files AS (
    SELECT doc_id AS id, 'doc-' || doc_id || '.txt' AS name, source AS owner, strlen(text) AS size FROM documents
), refs AS (
    SELECT id, owner, CAST(pos AS INTEGER) AS pos, sha256(line) AS hash, strlen(line) AS size, line
    FROM (SELECT doc_id AS id, source AS owner, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
), chunks AS (
    SELECT hash, max(size) AS raw_size, count(*) AS ref_count FROM refs GROUP BY hash
)
"""


def chunk_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk metadata table with every state the maintenance plans meet, derived from `part`."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kinds = ["zstd", "raw", "br", "delta", "zstd-bcj", "bz2", "br-bcj", "zstd"]
    return p.select(
        k.alias("chunk"),
        F.sha2(k.cast("string"), 256).alias("hash"),
        F.element_at(F.array(*map(F.lit, kinds)), (k % 8 + 1).cast("int")).alias("compression"),
        (F.col("p_size").cast("long") * 16384).alias("raw_size"),
        (F.col("p_size").cast("long") * 16384 * (k % 5 + 1) / 8).cast("long").alias("stored_size"),
        (F.floor(k / 8) % 4).alias("ref_count"),  # of every representation some are dead
        F.when(k % 8 == 3, F.floor(k / 3)).alias("base"),
        F.when(k % 9 == 0, F.concat(F.lit("r"), (k % 97).cast("string"))).alias("region"),
        F.when(k % 6 == 0, k * 3600).otherwise(F.lit(0).cast("long")).alias("staged"),
        (k % 11 == 0).alias("tried"),
    )


META_SQL = """
meta AS (
    SELECT p_partkey AS chunk, sha256(CAST(p_partkey AS VARCHAR)) AS hash,
           ['zstd', 'raw', 'br', 'delta', 'zstd-bcj', 'bz2', 'br-bcj', 'zstd'][p_partkey % 8 + 1] AS compression,
           CAST(p_size AS BIGINT) * 16384 AS raw_size,
           CAST(floor(CAST(p_size AS BIGINT) * 16384 * (p_partkey % 5 + 1) / 8.0) AS BIGINT) AS stored_size,
           p_partkey // 8 % 4 AS ref_count,
           CASE WHEN p_partkey % 8 = 3 THEN CAST(floor(p_partkey / 3.0) AS BIGINT) END AS base,
           CASE WHEN p_partkey % 9 = 0 THEN 'r' || (p_partkey % 97) END AS region,
           CASE WHEN p_partkey % 6 = 0 THEN p_partkey * 3600 ELSE 0 END AS staged,
           p_partkey % 11 = 0 AS tried
    FROM part
)
"""

#: Representations that don't depend on another chunk.
INDEPENDENT = ("zstd", "raw", "br", "zstd-bcj", "br-bcj", "bz2")
MODES = ("", "auto", "fast", "balanced", "max")
