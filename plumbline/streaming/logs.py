"""Structured Streaming: log ingest in small batches, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema, max_files: int = 10) -> DataFrame:
    """A stream over a folder of Parquet files; timestamps without a zone are taken as UTC, so that they can carry a watermark."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def ingest(events: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append batches to ``out``; a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and level; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
