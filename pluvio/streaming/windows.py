"""Sliding windows over an event stream, and the same windows in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def window_stats(df: DataFrame, ts: str, by: Sequence[str], value: str, duration: str, slide: str,
                 origin: str | None = None, delay: str | None = None) -> DataFrame:
    """Count, rms, mean absolute value, min and max per sliding window and key.

    With `delay` the input gets a watermark: late rows beyond it are dropped and closed windows are
    emitted once. Windows that start before `origin` are partial and left out.
    """
    src = df.withColumn(ts, F.col(ts).cast("timestamp"))
    src = src.withWatermark(ts, delay) if delay else src
    v = F.col(value)
    out = (src.groupBy(F.window(ts, duration, slide).alias("w"), *by)
           .agg(F.count("*").alias("n"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg(F.abs(v)).alias("mae"),
                F.min(v).alias("min"), F.max(v).alias("max"))
           .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "rms", "mae", "min", "max"))
    return out.filter(F.col("start") >= F.lit(origin).cast("timestamp")) if origin else out


def closed_before(windows: DataFrame, last: Column | str) -> DataFrame:
    """Batch twin of append mode: windows that end no later than the watermark."""
    return windows.filter(F.col("end") <= (F.col(last) if isinstance(last, str) else last))


def stream_window_stats(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, ts: str,
                        by: Sequence[str], value: str, duration: str, slide: str, delay: str, origin: str | None = None,
                        glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Read a Parquet folder as a stream, write closed windows to Parquet, stop when all files are read."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    windows = window_stats(reader.parquet(source), ts, by, value, duration, slide, origin, delay)
    query = (windows.writeStream.outputMode("append").format("parquet").option("path", target)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(windows.schema).parquet(target)
