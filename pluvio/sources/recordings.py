"""Recordings on a file system: inventory, decoding, and the WAV and Parquet sinks for signals."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyarrow.fs import FileType
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.functions.kernels import decode_wav, encode_wav, reason
from pluvio.session import ship_package, stage
from pluvio.sources.inventory import RecordingInventory, open_path, read_file

SIGNAL_SCHEMA = "sample_rate int, n_samples long, samples array<float>, error string"


def _binary(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    suffix = "|".join(e.lstrip(".").lower() for e in extensions)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise FileNotFoundError(root) from err
        raise
    hidden = r"/\.[^/]+/"
    return files.filter(F.lower("path").rlike(rf"\.({suffix})$") & ~F.regexp_replace("path", "^[a-z0-9]+:/+", "/").rlike(hidden))


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str] = (".wav",), location: str | None = None) -> DataFrame:
    """`file_name, file_path, extension, location, bytes` of all matching files below a folder; no file is read.

    Suffixes match in any case; folders that start with `.` are left out, all other names and files of zero bytes are
    listed. The walk runs in tasks. Sort by `file_path` on output. A root that is not there raises FileNotFoundError.
    """
    system, place, _ = open_path(root)
    if system.get_file_info(place).type != FileType.Directory:
        raise FileNotFoundError(root)
    ship_package(spark).dataSource.register(RecordingInventory)
    reader = spark.read.format("recordings").option("extensions", ",".join(extensions))
    return (reader if location is None else reader.option("location", location)).load(root)


def read_content(spark: SparkSession, root: str, extensions: Sequence[str] = (".wav",)) -> DataFrame:
    """`file_path, content`."""
    return _binary(spark, root, extensions).select(F.col("path").alias("file_path"), "content")


def _decoded(read, sample_rate: int | None, duration: float | None, convert: bool):
    """A column function: what `read` gives for each value, decoded; whatever is wrong with a recording stands in `error`."""
    @F.pandas_udf(SIGNAL_SCHEMA)
    def decode(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            try:
                rate, x = decode_wav(read(value), sample_rate, duration, convert)
                rows.append((rate, len(x), x, None))
            except Exception as err:  # one bad recording must not end the job
                rows.append((None, None, None, reason(err)))
        return pd.DataFrame(rows, columns=["sample_rate", "n_samples", "samples", "error"])
    return decode


def decode_signals(files: DataFrame, content: str = "content", sample_rate: int | None = 24_000, duration: float | None = None,
                   convert: bool = True) -> DataFrame:
    """Decode WAV bytes at a target rate; an unreadable file keeps its row with a reason in `error` and NULL samples.

    Without `convert` a file of another rate is an error instead of being resampled.
    """
    rest = [c for c in files.columns if c != content]
    decode = _decoded(lambda blob: blob, sample_rate, duration, convert)
    return files.select(*rest, decode(content).alias("_d")).select(*rest, "_d.*")


def read_signals(recordings: DataFrame, sample_rate: int | None = 24_000, duration: float | None = None, convert: bool = True) -> DataFrame:
    """`decode_signals` for recordings that are read by `file_path` in the task that decodes them; all columns stay."""
    decode = _decoded(read_file, sample_rate, duration, convert)
    kept = recordings.drop("sample_rate", "n_samples", "samples", "error")
    return kept.select("*", decode("file_path").alias("_d")).select(*kept.columns, "_d.*")


def catalog_signals(catalog: DataFrame, sample_rate: int = 24_000) -> DataFrame:
    """Catalog rows with their decoded signal; unreadable files are left out."""
    return read_signals(catalog, sample_rate).filter("error is null").drop("error")


def write_contents(files: DataFrame, root: str, name: str = "file_name", content: str = "content") -> DataFrame:
    """Write each row's bytes to `root/<name>`, in the tasks that hold the rows; `file_path, bytes` per file.

    Names may have folders, which are made. A row without name or content gives no file. Writing the same rows again, as after a
    lost executor, gives the same files. The result is staged, so that files are written once.
    """
    system, place, _ = open_path(root)
    system.create_dir(place, recursive=True)

    @F.pandas_udf("file_path string, bytes long")
    def write(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        target, folder, start = open_path(root)
        rows = []
        for file, data in zip(names, contents):
            path = f"{folder.rstrip('/')}/{file}"
            if "/" in file:
                target.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with target.open_output_stream(path) as out:
                out.write(data)
            rows.append((start + path, len(data)))
        return pd.DataFrame(rows, columns=["file_path", "bytes"])

    ship_package(files.sparkSession)
    whole = files.filter(F.col(name).isNotNull() & F.col(content).isNotNull())
    return stage(whole.select(write.asNondeterministic()(name, content).alias("_w")).select("_w.*"))


def write_recordings(signals: DataFrame, root: str, name: str = "file_name", samples: str = "samples", rate: str = "sample_rate") -> DataFrame:
    """`write_contents` of each signal as a 16-bit mono WAV; samples beyond -1 and 1 are cut, a row without samples gives no file."""
    @F.pandas_udf("binary")
    def encode(signal: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([encode_wav(x, int(hertz)) for x, hertz in zip(signal, rates)], dtype=object)

    whole = signals.filter(F.col(samples).isNotNull())
    return write_contents(whole.select(name, encode(samples, rate).alias("content")), root, name)


def save_signals(df: DataFrame, path: str, file_id: str = "file_id") -> DataFrame:
    """Signals or segments as Parquet keyed by file id; returns the stored table."""
    df.filter(F.col(file_id).isNotNull()).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
