"""Streaming ingestion of fact files into the store, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.sources.schemas import FACTS
from quern.sources.store import FactStore


def stream_facts(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Fact files under ``path`` as they arrive."""
    return spark.readStream.schema(FACTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(facts: DataFrame, store: FactStore, checkpoint: str, fuzzy: bool = True, once: bool = True) -> StreamingQuery:
    """Runs every micro-batch through ``FactStore.ingest``.

    A batch that is replayed after a failure, wherever that was, replaces what
    it wrote itself, so the result is the same however often it runs.
    """
    writer = facts.writeStream.foreachBatch(lambda batch, n: store.ingest(batch, fuzzy, f"s{n}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of events by time; works on streams and on tables.

    Events later than ``late`` behind the newest are dropped by a stream. The
    time column is cast, as watermarks want an instant.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def first_deliveries(facts: DataFrame, late: str = "1 day") -> DataFrame:
    """Facts without repeats of a fact id; a stream forgets ids after ``late``."""
    timed = facts.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    if timed.isStreaming:
        return timed.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["fact_id"])
    return timed.dropDuplicates(["fact_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n) of event sessions parted by ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )
