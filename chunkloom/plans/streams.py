"""Plans that run as streams to the end of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.plans.registry import query
from chunkloom.plans.shared import shared_folder
from chunkloom.sources.catalog import load
from chunkloom.streaming.ingest import running_counters, staged_after


@query("stream_event_counts", 135, sql="SELECT event_type, user_id % 10 AS shard, count(*) AS n FROM events GROUP BY ALL")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed counts folded by micro-batches; the last value of each key is the batch result."""
    at = shared_folder(spark)
    e = load(spark, sf_dir, "events")
    e.select("event_type", "user_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("event_type string, user_id bigint").option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    lines = stream.select(F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string")).alias("hash"), F.lit(1).alias("size"))
    running_counters(lines, f"{at}/checkpoint", lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out/batch={i}")).awaitTermination()
    last = spark.read.parquet(f"{at}/out").groupBy("hash").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.split_part("hash", F.lit("/"), F.lit(1)).alias("event_type"), F.split_part("hash", F.lit("/"), F.lit(2)).cast("long").alias("shard"), "n")


@query("stream_dedup_refs", 135, 65, 95, sql="SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1")
def stream_dedup_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark)
    load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("size")).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("hash string, size int").parquet(f"{at}/in")
    running_counters(stream, f"{at}/checkpoint", lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out/batch={i}")).awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("hash").agg(F.max_by("n", "batch").alias("n"))


@query("staged_refresh", 138, 53, sql="SELECT user_id AS hash, max(epoch_us(ts) // 1000000) AS touched FROM events GROUP BY 1 HAVING NOT max(event_id % 97 = 0) AND max(epoch_us(ts) // 1000000) >= 0")
def staged_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks touched and not yet committed; every touch refreshes their time to live."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("hash"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("touched"), (F.col("event_id") % 97 == 0).alias("committed"))
    return staged_after(e, 86_400, 86_400)


@query("hourly_events", 140, sql="SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


#: Periodic jobs and their intervals in seconds.
JOBS = {"scrub": 900, "sweep": 3600, "backup": 21_600, "optimize": 86_400}


@query("job_runs", 136, sql="""
    WITH j AS (SELECT * FROM (VALUES ('scrub', 900), ('sweep', 3600), ('backup', 21600), ('optimize', 86400)) t(job, every)), e AS (SELECT epoch_us(ts) // 1000000 AS s FROM events)
    SELECT job, count(DISTINCT s // every) AS runs, CAST(min(s // every * every) AS BIGINT) AS first_due, CAST(max(s // every * every) AS BIGINT) AS last_due FROM j, e GROUP BY 1""")
def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which periodic jobs are due at the ticks of a stream: one run an interval, whatever the batches, and none twice after a restart.

    Ticks arrive as files; each micro-batch runs the jobs whose interval has begun since their last run (streaming.ingest.due).
    """
    from chunkloom.streaming.ingest import due

    at = shared_folder(spark)
    e = load(spark, sf_dir, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s"))
    e.repartitionByRange(4, "s").sortWithinPartitions("s").write.parquet(f"{at}/in")
    ticks = spark.readStream.schema("s bigint").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    due(ticks, JOBS, f"{at}/checkpoint", lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out/batch={i}")).awaitTermination()
    out = spark.read.parquet(f"{at}/out").select("job", "at").distinct()
    return out.groupBy("job").agg(F.count(F.lit(1)).alias("runs"), F.min("at").alias("first_due"), F.max("at").alias("last_due"))


@query("dirty_queue", 137, sql="""
    WITH e AS (SELECT user_id, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS round FROM events)
    SELECT user_id AS key, count(DISTINCT round) AS rounds, count(*) AS touches FROM e GROUP BY 1""")
def dirty_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys touched since the last round are taken as one snapshot and cleared: each round works a key once, however often it was touched."""
    at = shared_folder(spark)
    e = load(spark, sf_dir, "events")
    most = e.agg(F.max("event_id").alias("m")).first()["m"] + 1
    for i in range(4):  # four rounds of arrivals
        e.where(F.floor(F.col("event_id") * 4 / F.lit(most)) == i).select("user_id").coalesce(1).write.mode("append").parquet(f"{at}/in")
        touched = spark.readStream.schema("user_id bigint").parquet(f"{at}/in")
        snapshot = lambda b, n, i=i: b.groupBy("user_id").agg(F.count(F.lit(1)).alias("touches")).write.mode("overwrite").parquet(f"{at}/out/round={i}-{n}")
        touched.writeStream.foreachBatch(snapshot).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy(F.col("user_id").alias("key")).agg(F.count_distinct("round").alias("rounds"), F.sum("touches").alias("touches"))
