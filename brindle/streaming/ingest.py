"""Structured Streaming: incremental ingestion and windowed metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import store


def document_stream(spark: SparkSession, folder: str, schema: str = "id string, content string, ts timestamp", max_files: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as a stream of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def distinct_content(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of equal contents within the watermark; state beyond it is dropped."""
    return stream.withColumn("content_hash", T.sha256("content")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])


def versions(spark: SparkSession, table: str) -> list[int]:
    p, fs = store._fs(spark, table)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of an ingested table."""
    return spark.read.parquet(f"{table}/v={versions(spark, table)[-1]}")


def start_ingest(stream: DataFrame, table: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = True):
    """Upsert every micro-batch by content hash: batch n makes version n of the table from version n - 1.

    A batch that is run again after a failure writes its version anew from the same predecessor, so
    counts hold. The two last versions are kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = versions(spark, table)
        if number - 1 in before:
            old = spark.read.parquet(f"{table}/v={number - 1}")
        elif any(v < number for v in before):
            raise ValueError(f"version {number - 1} of {table} is missing, but older ones are there")
        else:
            old = spark.createDataFrame([], "id string, content string, content_hash string, access_count bigint, last_accessed timestamp")
        new = transform(batch).select("id", "content")
        store.upsert_by_hash(old, new, F.current_timestamp()).write.mode("overwrite").parquet(f"{table}/v={number}")
        for gone in (v for v in before if v < number - 1):
            p, fs = store._fs(spark, f"{table}/v={gone}")
            fs.delete(p, True)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def requests_per_minute(events: DataFrame, limit: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """(user_id, start, n) by tumbling minute; with ``limit`` only users over it. Batch or stream; ``ts`` may be without zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if timed.isStreaming else timed
    got = timed.groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
    return got if limit is None else got.where(F.col("n") > limit)


def rollups(events: DataFrame, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if timed.isStreaming else timed
    got = timed.groupBy(F.window("ts", length, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of sessions that a pause of ``gap`` ends."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if timed.isStreaming else timed
    got = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), "n")
