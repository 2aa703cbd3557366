"""Streaming counterparts of the resampling operators (an extension: the batch operators have none)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veranico.session import ensure_checkpoint_dir


def hourly_means(stream: DataFrame, key: str, at: str, value: str, *, late: str = "1 hour") -> DataFrame:
    """(key, hour, mean, n) of a stream; hours close when the watermark passes them."""
    marked = stream.withWatermark(at, late)
    grouped = marked.groupBy(key, F.window(at, "1 hour").alias("w"))
    return grouped.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(key, F.col("w.start").alias("hour"), "mean", "n")


def partial_sums(stream: DataFrame, key: str, at: str, value: str, folder: str):
    """Micro-batches as mergeable sums: each batch adds (key, hour, s, n) below ``folder``; the batch number makes a repeat overwrite itself."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.filter(F.col(at).isNotNull()).groupBy(key, F.date_trunc("hour", at).alias("hour")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
        sums.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()


def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per type and hour, read as a stream and merged from its micro-batches."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/event[s].parquet")
    partial_sums(stream, "event_type", "ts", "value", folder).awaitTermination()
    parts = spark.read.parquet(folder)
    return parts.groupBy("event_type", F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour")).agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean_value"), F.sum("n").alias("n"))
