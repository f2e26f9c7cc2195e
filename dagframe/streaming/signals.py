"""Streams: events as signals, delivered once, and windowed counts of events with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that only the engine itself may deliver.
RESERVED = "^(__|sys[.]|[0-9a-f]{8}-[0-9a-f]{4}-)"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The event table as a stream, its time as a timestamp."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def delivered(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """First delivery of each (run, name); reserved names are refused. State is let go behind the watermark."""
    named = events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), "ts").where(~F.col("name").rlike(RESERVED))
    return named.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "name"]) if events.isStreaming else named.dropDuplicates(["run_id", "name"])


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a frame."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """One loop step a delivered micro-batch."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
