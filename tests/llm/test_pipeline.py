"""The stages against brute force, one after the other, each on what its predecessor kept."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chunkloom.llm.common import BATCH_BYTES, serve
from chunkloom.llm.tokenfst import compiled
from tests.llm.test_similarity import LOW, brute_components, brute_cut, long_corpus


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", s, len(t or "")) for i, t, _, s in long_corpus() if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language_id"](spark, at, str(tmp_path))
    assert kept.schema == at.schema
    seen = [tuple(r) for r in kept.collect()]
    assert {r[0] for r in rows} - {r[0] for r in seen} == {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}

    one = stages["exact_dedup"](spark, kept, str(tmp_path))
    assert one.columns == at.columns
    best = {}
    for r in seen:
        best[r[1].translate(LOW)] = max(best.get(r[1].translate(LOW), r[0]), r[0])
    texts = [tuple(r) for r in one.collect()]
    assert sorted(r[0] for r in texts) == sorted(best.values())

    near = stages["near_dedup"](spark, one, str(tmp_path))
    left = [tuple(r) for r in near.collect()]
    assert sorted(r[0] for r in left) == sorted({c for _, _, c in brute_components(texts)})

    cut = stages["substring_dedup"](spark, near, str(tmp_path))
    assert cut.columns == at.columns
    want = {k: b.decode(errors="ignore") for k, *_, b in brute_cut(left)}
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert found == {k: (t, len(t)) for k, t in want.items()}

    packed = stages["packing"](spark, cut, str(tmp_path))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in want.values())
    assert sum(r["length"] for r in packed.collect()) == total

    assert sum(r["length"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == total


def test_nothing_stays_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    words = "the quick brown fox jumps over the lazy dog and runs on to the next field of corn"
    rows = [(None, words, None, None, None, "a", 1), (1, words, "en", "s", len(words), "b", 2), (1, words, "en", "s", len(words), "b", 2), (2, None, "en", "s", 0, None, 3), (3, "", None, "s", 0, "c", 4), (4, words + " again", "en", None, None, "d", 5), (5, "12 34 !!", "en", "s", 8, "e", 6), (6, "word " * 30_000, "en", "s", 150_000, "f", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, kept int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "kept"]
        left.append(sorted((r["doc_id"] or 0, r["kept"]) for r in docs.collect()))
    assert left[0] == [(0, 1), (1, 2), (1, 2), (4, 5), (6, 7)]  # no letters, no document
    assert left[1] == [(1, 2), (4, 5), (6, 7)]  # equal texts: the largest id, once
    assert left[2] == [(1, 2), (6, 7)]  # near copies: the smallest id
    assert left[3] == left[2] and {r["doc_id"]: r["text"] for r in docs.collect()}[6].strip() == ""
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"doc_id": "max"}).first()[0] == 6


def test_stages_bound_what_a_worker_is_sent(spark, tmp_path):
    """Texts of 24 MB in one file don't reach a Python worker as one batch, whichever stage comes first."""
    text = F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 300)
    spark.range(8000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length(text).cast("long").alias("n_chars")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    bound, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(bound)
            assert max(r[0] for r in docs.mapInArrow(sizes, "bytes long").collect()) > 3 * BATCH_BYTES
            stage(spark, docs.limit(0), str(tmp_path))
            assert max(r[0] for r in docs.mapInArrow(sizes, "bytes long").collect()) < 1.5 * BATCH_BYTES, name
        spark.conf.set(bound, "1m")  # what a session sets itself stays
        corpus_pipeline.packing(spark, docs, str(tmp_path))
        assert spark.conf.get(bound) == "1m"
    finally:
        spark.conf.unset(bound) if before is None else spark.conf.set(bound, before)


def test_a_worker_keeps_the_tables_of_one_operator():
    serve("tokens")
    tokenizer = compiled(public_tokenizers.path("byte_bpe_50k.json"))
    serve("tokens")
    assert compiled(public_tokenizers.path("byte_bpe_50k.json")) is tokenizer
    serve("languages")
    assert compiled.cache_info().currsize == 0
