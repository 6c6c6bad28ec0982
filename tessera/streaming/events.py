"""Ingestion events as a stream, and turns of timed events by session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "job_id string, file_uri string, filename string, modality string, options map<string,string>, ts timestamp"


def file_events(spark: SparkSession, path: str, schema: str = EVENT, per_batch: int = 1000) -> DataFrame:
    """Events that arrive as JSON files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def kafka_events(spark: SparkSession, servers: str, topic: str, schema: str = EVENT) -> DataFrame:
    """Events from Kafka; needs the connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def once_per_file(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each file of a job once: repeats within the watermark are dropped, state beyond it is forgotten."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "file_uri"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Turns of a key: events with less than ``gap`` between them. Batch and stream alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total")


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts per window and kind; late events up to the watermark still count."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(by, F.window("ts", size).alias("w")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(by, F.col("w.start").alias("window_start"), "n_events", "total")


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write what is there and stop; the checkpoint makes a later run go on from there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
