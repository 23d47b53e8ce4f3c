"""Structured Streaming: daily counts with late data, and page-at-a-time ingest that replays safely."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soldlens.sources.shared import new_folder
from soldlens.sources.store import Store


def daily_counts(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """day, event_type, n and total of a stream of events (ts, event_type, value), complete once the watermark has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs the stream over what is there now; the last complete result, written in the shared folder."""
    spark, at = stream.sparkSession, new_folder(stream.sparkSession, "stream")
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def ingest_readings(readings: DataFrame, store: Store, checkpoint: str, name: str = "readings", stream: str | None = None) -> None:
    """Appends each micro-batch once. A batch is known by its stream, the checkpoint unless named, and its number within it.

    Each batch has a folder of its own, which a replay writes anew: nothing is read to find out whether it was there.
    """
    stream_id = hashlib.sha256((stream or checkpoint).encode()).hexdigest()[:16]

    def save(batch: DataFrame, number: int) -> None:
        store.put(name, batch.withColumn("batch_id", F.lit(number)), f"stream={stream_id}/batch={number}")

    readings.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_of_each(readings: DataFrame) -> DataFrame:
    """Replayed readings of one search, page, position and extractor count once."""
    return readings.dropDuplicates(["search_id", "page", "position", "extraction"])
