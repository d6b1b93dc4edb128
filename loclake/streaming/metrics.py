"""Streams: ingestion of script files as they arrive, ids without repeats, engine metrics in event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", "64").load(folder)


def without_repeats(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Rows with a key that arrived within the watermark are dropped; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def engine_metrics(df: DataFrame, time: str, by: list[str], duration: Column, ok: Column, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, mean duration and failure rate per tumbling window; works on streams and tables alike."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    out = rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(duration).alias("mean_duration"), F.avg(F.when(ok, 0.0).otherwise(1.0)).alias("failure_rate"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "mean_duration", "failure_rate")


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append"):
    """All that has arrived, then stop; a restart goes on from the checkpoint in the shared folder."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
