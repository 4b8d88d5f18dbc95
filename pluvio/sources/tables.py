"""Label files, split tables, gauge exports and pass-through checkpoints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvio.functions.scalars import to_number

DAILY_SCHEMA = T.StructType([T.StructField("data", T.DateType()), T.StructField("valor", T.DoubleType())])


def read_labels(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Ground truth by suffix; a missing path raises FileNotFoundError, another suffix ValueError."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        reader = spark.read.option("header", True)
        load = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv
    elif lower.endswith(".parquet"):
        load = (spark.read.schema(schema) if schema else spark.read).parquet
    else:
        raise ValueError(f"unsupported label file {path!r}: use .csv or .parquet")
    try:
        return load(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise FileNotFoundError(path) from err
        raise


def read_splits(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One table partitioned by `split`; a filter on the split prunes folders."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_split_files(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """Separate CSV files per split, tagged and stacked."""
    out = None
    for split, path in paths.items():
        one = spark.read.schema(schema).option("header", True).csv(path).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no split files given")
    return out


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("split").parquet(path)


def save_checkpoint(df: DataFrame, path: str) -> DataFrame:
    """Write and read back, so a `transform` chain goes on from the file with its lineage cut."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_daily_rainfall(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAILY_SCHEMA).option("sep", ";").option("header", True).csv(path)


@dataclass(frozen=True)
class SheetSource:
    """One exported event sheet: path, its two column names and the date format."""

    path: str
    when: str
    amount: str
    date_format: str


def read_event_sheets(spark: SparkSession, sources: Sequence[SheetSource]) -> DataFrame:
    """Exports of event sheets as `data_hora, precipitacao`; sheets without the two columns are skipped.

    Unreadable amounts become NULL. A repeated or junk header line is a row whose date does not
    parse; such rows are left out.
    """
    out = None
    for s in sources:
        raw = spark.read.option("header", True).csv(s.path)
        if s.when not in raw.columns or s.amount not in raw.columns:
            continue
        stamp = F.try_to_timestamp(F.col(f"`{s.when}`"), F.lit(s.date_format)).cast("timestamp_ntz")
        one = raw.select(stamp.alias("data_hora"), to_number(F.col(f"`{s.amount}`")).alias("precipitacao")).filter("data_hora is not null")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "data_hora timestamp_ntz, precipitacao double")
    return out
