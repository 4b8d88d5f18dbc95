"""Helpers shared by the operators: Arrow tasks, staged tables and bounded filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.session import scratch_path, ship_package

BATCH_ROWS = 256  # rows a Python worker holds at once; texts may be long
BATCH_BYTES = 32 << 20
FILTER_SLOTS = 1 << 18  # most rows of a broadcast remainder filter, whatever the input size


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` over small batches, with this package shipped to the workers."""
    spark = ship_package(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, and safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def slot(col, slots: int = FILTER_SLOTS):
    return F.pmod(F.xxhash64(col), F.lit(slots))


def prefilter(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, slots: int = FILTER_SLOTS) -> DataFrame:
    """Drop most rows whose key is not wanted, without a shuffle of `df`.

    Only distinct remainders modulo `slots` are broadcast, so the broadcast has at most `slots` rows at any
    input size; when they fill up the filter lets more rows through, and the exact join behind it decides.
    """
    remainders = wanted.select(slot(F.col(wanted_key), slots).alias("__slot")).distinct()
    return (df.withColumn("__slot", slot(F.col(key), slots))
            .join(F.broadcast(remainders), "__slot", "left_semi").drop("__slot"))
