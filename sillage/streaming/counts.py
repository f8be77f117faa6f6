"""Counters, once-per-key recording and presence as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.workspace import fresh

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", schema: str = EVENTS) -> DataFrame:
    """A folder's event files as a stream, with ``ts`` as a timestamp for watermarks."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """day, event_type and count."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").count()
    return counted.select(F.to_date("window.start").alias("day"), "event_type", "count")


def once_per_key(events: DataFrame, keys: list[str], delay: str = "60 days") -> DataFrame:
    """The first event of each key within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def presence(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: start, end and events; those still open at the watermark are not given out."""
    sessions = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").count()
    return sessions.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "count")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, run through the stream into a Parquet table under the checkpoint folder, which is returned.

    Each batch is written by its number, so a repeated batch replaces itself; in
    ``complete`` mode the last batch is the whole.  The driver holds no rows.  The
    table stays until ``sillage.workspace.sweep`` or the end of the process.
    """
    spark, schema = stream.sparkSession, stream.schema
    folder = fresh(spark, "drained")
    batches: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/{batch:06d}")
        batches.append(batch)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    if not kept:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder}/rows/{b:06d}" for b in kept))


def popular(events: DataFrame, key: str, limit: int) -> DataFrame:
    """The keys with most events, for ``complete`` mode."""
    return events.groupBy(key).count().orderBy(F.desc("count"), key).limit(limit)
