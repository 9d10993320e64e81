"""Exact dedup on disk-backed keyed streaming state (DataFrame functions only on the executors).

The corpus is turned into a narrow key table (digest, stable identifier, content locator) and streamed, in several
micro-batches, through a keyed aggregation whose state lives in RocksDB below the shared folder and never
expires: per digest it retains the largest identifier with its locator and the number of rows. Every micro-batch
meets the state of the earlier ones, and so does a later run over the same folder (DedupState). On every hit (a
digest with more than one row) the full bytes of all its rows are compared; a digest under which different texts
meet is regrouped by its full texts. A bitmap of fixed size tells which rows can be hits, so that no other text
is shuffled, and the comparison keeps two texts a digest and partition, so that a hot text stays where it is read.

Defined results: null text equals empty text; only A-Z fold; a null id ranks below every id; of several
rows with the same id and equal text one stays; very long texts are compared whole; an empty table gives an
empty result; further columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import ascii_lower, key_filter, materialize, maybe_in, scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Micro-batches that one run is streamed in, at most one more.
BATCHES = 3
KEYS = "doc_id bigint, digest string, text_sha256 string, mark bigint, row bigint, file string"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


@dataclass
class DedupState:
    """The keyed state below one folder: a later run over the folder, in this session or another, goes on from it."""

    spark: SparkSession
    folder: str
    digest: Callable[[Column], Column] = sha256

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Stream the keys of docs into the state."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm"))
        keyed = rows.select("doc_id", self.digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("text_sha256"), F.xxhash64("norm").alias("mark"), F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("file"))
        before = len(self.keys().inputFiles()) if self._has_keys() else 0
        keyed.write.mode("append").parquet(f"{self.folder}/keys")
        new = len(self.keys().inputFiles()) - before
        self._fold(max(1, new // BATCHES))

    def _has_keys(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/keys")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def keys(self) -> DataFrame:
        return self.spark.read.schema(KEYS).parquet(f"{self.folder}/keys")

    def _fold(self, files: int) -> None:
        """Fold the key files that are new, so many a micro-batch, until the source is drained.

        Every micro-batch leaves the new values of the keys it touched under its batch number, so a batch that is run
        again after a failure overwrites its own output.
        """
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in STATE_CONF}
        try:
            for k, v in STATE_CONF.items():
                conf.set(k, v)
            keys = self.spark.readStream.schema(KEYS).option("maxFilesPerTrigger", files).parquet(f"{self.folder}/keys")
            state = keys.groupBy("digest").agg(F.max(F.struct("doc_id", "row", "file")).alias("keep"), F.count(F.lit(1)).alias("n"))

            def emit(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{self.folder}/state/batch={number}")

            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/stream").trigger(availableNow=True).foreachBatch(emit).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def values(self) -> DataFrame:
        """The last value of every key: digest, keep_id, keep_row, keep_file, group_size."""
        if self.keys().isEmpty():
            return self.spark.createDataFrame([], "digest string, keep_id long, keep_row long, keep_file string, group_size long")
        rows = self.spark.read.schema("digest string, keep struct<doc_id: bigint, row: bigint, file: string>, n bigint, batch int").parquet(f"{self.folder}/state")
        last = rows.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("v"))
        return last.select("digest", F.col("v.keep.doc_id").alias("keep_id"), F.col("v.keep.row").alias("keep_row"), F.col("v.keep.file").alias("keep_file"), F.col("v.n").alias("group_size"))

    def groups(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Every row streamed so far: doc_id, keep_id, group_size, kept, text_sha256, mark. docs: all of their documents."""
        state = self.values().withColumnRenamed("digest", "of")
        same = F.col("row").eqNullSafe(F.col("keep_row")) & F.col("file").eqNullSafe(F.col("keep_file")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        out = self.keys().join(state, F.col("digest") == F.col("of"))
        out = materialize(out.select("doc_id", "keep_id", "group_size", same.alias("kept"), "text_sha256", "mark", "digest"), "dedup-groups")
        # full bytes of all rows that can be hits: the least and the greatest text of a digest are the same text
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm")).withColumn("mark", F.xxhash64("norm"))
        hits = maybe_in(rows, F.col("mark"), key_filter(out.where("group_size > 1"), F.col("mark")), "maybe").where("maybe")
        hits = hits.select("doc_id", "norm", "mark", self.digest(F.col("norm")).alias("digest"))
        texts = hits.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        differ = materialize(texts.where("low <> high").select(F.col("digest").alias("of")), "dedup-collisions")
        if differ.isEmpty():
            return out.drop("digest")
        return _regroup(out, hits, differ)


def _regroup(out: DataFrame, hits: DataFrame, differ: DataFrame) -> DataFrame:
    """Rows under digests that different texts share, grouped by their full texts instead."""
    clash = hits.join(differ, F.col("digest") == F.col("of"), "left_semi").withColumn("row", F.monotonically_increasing_id())
    clash = materialize(clash, "dedup-clash")
    groups = clash.groupBy(F.col("norm").alias("g")).agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = clash.join(groups, F.col("norm") == F.col("g")).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), sha256(F.col("norm")).alias("text_sha256"), "mark")
    return out.join(differ, F.col("digest") == F.col("of"), "left_anti").drop("digest").unionByName(again)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    state = DedupState(docs.sparkSession, scratch(docs.sparkSession, "dedup"), digest)
    state.add(docs, id_col, text_col)
    return state.groups(docs, id_col, text_col).drop("mark")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies: of equal texts the row with the largest id stays, with all its columns.

    Of rows with the same id and equal text one stays; null text equals empty text; a null id loses to any other;
    an empty table stays empty; columns may have any names. Rows that a bitmap shows to have no copy pass without an
    exchange; only the others are joined with the decisions.
    """
    spark = docs.sparkSession
    state = DedupState(spark, scratch(spark, "dedup"))
    state.add(docs, id_col, text_col)
    found = state.groups(docs, id_col, text_col).where("group_size > 1")
    found = materialize(found.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.col("text_sha256").alias("digest"), "kept", "mark"), "dedup-found")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("row_id"), normalised(text_col).alias("norm"))
    marked = maybe_in(whole, F.xxhash64("norm"), key_filter(found, F.col("mark")), "maybe")
    alone = marked.where("not maybe").select("row.*")
    hits = marked.where("maybe").select("row", "row_id", sha256(F.col("norm")).alias("row_digest"))
    same = (F.col("row_id") == F.col("id")) & (F.col("row_digest") == F.col("digest"))
    decided = found.groupBy("id", "digest").agg(F.max("kept").alias("kept"))
    left = hits.join(decided, same, "left").where(F.coalesce("kept", F.lit(True)))
    return alone.unionByName(left.dropDuplicates(["row_id", "row_digest"]).select("row.*"))
