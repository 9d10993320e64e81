"""Incremental runs: streaming ingest into the store, dirty queues from stream offsets, and periodic jobs.

A file source's checkpoint is the dirty queue: each run sees what arrived since the last one. A micro-batch that is
run again after a failure writes nothing twice, because chunks already stored and files already listed are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkloom.operators.store import Store


def ingest(store: Store, source: DataFrame, checkpoint: str, now: int, every: str | None = None) -> StreamingQuery:
    """Put a stream of blobs (id, name, owner, data) into the store; `every` keeps the query running."""

    def put(batch: DataFrame, number: int) -> None:
        fresh = batch.join(store.read("files").select("id"), "id", "left_anti")
        store.put(fresh, now + number)

    writer = source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint", files_per_batch: int = 16) -> DataFrame:
    """Parquet documents that arrive in a folder, as blobs."""
    d = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("owner"), F.encode("text", "UTF-8").alias("data"))


def running_counters(lines: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Keyed reference counts over a stream of (hash, size), handed to sink batch by batch."""
    state = lines.groupBy("hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return state.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def staged_after(events: DataFrame, now: int, ttl: int = 86_400) -> DataFrame:
    """Chunks still staged: the last touch of each within its time to live (touches refresh it)."""
    last = events.groupBy("hash").agg(F.max("touched").alias("touched"), F.max("committed").alias("committed"))
    return last.where(~F.col("committed") & (F.col("touched") >= now - ttl)).select("hash", "touched")


def due(ticks: DataFrame, jobs: dict[str, int], checkpoint: str, run: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Periodic jobs on a stream of ticks (s, seconds): run gets (job, at) of every interval that a batch's ticks open.

    An interval is a job and the second at which it begins, so a batch that is run again names the same ones, and a
    sink that is keyed by them does each once. With a rate source and a processing-time trigger this is a scheduler.
    """
    table = F.array(*(F.struct(F.lit(job).alias("job"), F.lit(every).cast("long").alias("every")) for job, every in jobs.items()))

    def batch(b: DataFrame, number: int) -> None:
        each = b.select("s", F.explode(table).alias("j"))
        run(each.select("j.job", (F.floor(F.col("s") / F.col("j.every")) * F.col("j.every")).alias("at")).distinct(), number)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
