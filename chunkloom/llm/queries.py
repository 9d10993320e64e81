"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm.bpe import bpe_round_trip
from chunkloom.llm.common import table
from chunkloom.llm.exact_dedup import exact_dedup
from chunkloom.llm.jaccard_join import jaccard_components
from chunkloom.llm.langid import language_id
from chunkloom.llm.license_scan import license_scan
from chunkloom.llm.packing import pack_documents
from chunkloom.llm.suffix_dedup import suffix_dedup
from chunkloom.llm.tokenfst import token_counts
from chunkloom.llm.url_filter import url_filter
from chunkloom.llm.voronoi_knn import knn_join


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_token_counts": op2_token_counts,
        "op3_voronoi_knn": op3_voronoi_knn,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_bpe": op6_bpe,
        "op7_packing": op7_packing,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_language_id": op9_language_id,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_voronoi_knn": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
                FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id,
                       CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id
                WHERE q.vec_id % 100 = 0
            ), r AS (
                SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
                FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
        """,
        "op4_jaccard_join": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a
                FROM documents
            ), s AS (
                SELECT DISTINCT doc_id, CASE WHEN len(a) < 5 THEN array_to_string(a, ' ') ELSE array_to_string(a[i:i + 4], ' ') END AS g
                FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS i FROM w WHERE len(a) > 0)
            ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
            ), p AS (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
            ), l AS (
                SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)
            ), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
            ), r(doc_id, reach) AS (SELECT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
            SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
            FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY 1) m USING (doc_id)
        """,
        "op5_exact_dedup": """
            WITH d AS (
                SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
                FROM documents
            )
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
            FROM d WINDOW w AS (PARTITION BY h)
        """,
    }
