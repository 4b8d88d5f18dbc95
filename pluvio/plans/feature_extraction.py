"""The feature job: recordings and their metadata to one metric row per segment.

Only paths, draws and metadata move. Every task opens its recordings by path, and decodes, augments, cuts and summarises them in
one Arrow kernel, so neither contents nor waveforms are in a row; the output is short arrays. Copies of one
recording are handed out in chunks, so a file with very many copies is spread over tasks. Metadata travels with
the copies, so the metrics are not joined to it again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvio.functions import kernels as K
from pluvio.operators.metrics import ARRAYS, METRICS, SCALARS, SUMMARY_SCHEMA, MetricsConfig, metrics_from_summary, summarise
from pluvio.operators.segments import augment_draws, augmented, window_and_stride
from pluvio.session import scratch_path, ship_package
from pluvio.sources.inventory import read_file

# Copies of one recording that one task handles together, on average.
COPIES_PER_TASK = 64
# Segment rows handed back to the JVM at a time; one row holds about 30 KB.
ROWS_PER_BATCH = 256
# What one task reads: bytes of recordings, counted once per copy, or copies where sizes are not known.
BYTES_PER_TASK, ROWS_PER_TASK = 256 << 20, 256
SEGMENT = [("segment_idx", pa.int32()), ("offset_sec", pa.float64()), ("aug_params", pa.string()), ("error", pa.string())]
SEGMENT_SCHEMA = f"segment_idx int, offset_sec double, aug_params string, error string, {SUMMARY_SCHEMA}"


def copy_chunks(wanted: DataFrame, copy, key=None) -> DataFrame:
    """(file_path, _c, copies): each file's copies dealt out by a hash of `key` over as many rows as COPIES_PER_TASK asks for; no file is sorted."""
    counts = wanted.groupBy("file_path").agg(F.count(F.lit(1)).alias("_n"))
    chunk = F.pmod(F.xxhash64(F.col("copy_ordinal") if key is None else key), F.ceil(F.col("_n") / COPIES_PER_TASK)).alias("_c")
    dealt = wanted.join(counts, "file_path").select("file_path", chunk, copy.alias("_one"))
    return dealt.groupBy("file_path", "_c").agg(F.collect_list("_one").alias("copies"))


def _tasks(recordings: DataFrame) -> int:
    """Number of tasks by what there is to read; one aggregate over the table of recordings."""
    sized = dict(recordings.dtypes).get("bytes") in ("int", "bigint")
    row = recordings.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes" if sized else F.lit(None).cast("long")).alias("bytes")).first()
    least = min(row["n"], recordings.sparkSession.sparkContext.defaultParallelism)
    return max(1, least, math.ceil((row["bytes"] or 0) / BYTES_PER_TASK), math.ceil(row["n"] / ROWS_PER_TASK) if row["bytes"] is None else 1)


def _checked(recordings: DataFrame) -> DataFrame:
    if "file_path" not in recordings.columns:
        raise ValueError("recordings need a file_path")
    clash = sorted(set(recordings.columns) & {n for n, _ in SEGMENT} | set(recordings.columns) & set(METRICS))
    if clash:
        raise ValueError(f"columns that the job makes: {clash}")
    if "copy_ordinal" in recordings.columns:
        return recordings.withColumn("copy_ordinal", F.col("copy_ordinal").cast("long"))
    return recordings.withColumn("copy_ordinal", F.lit(0).cast("long"))


def segment_summaries(recordings: DataFrame, cfg: MetricsConfig, duration: float = 10.0, overlap: float = 0.5, seed: int = 42,
                      noise_prob: float = 0.2, cutout_prob: float = 0.3, open_file: Callable[[str], bytes] = read_file) -> DataFrame:
    """`meta` (the row of `recordings`) and the summary arrays of every segment of it; a failing file gives one `error` row per copy.

    `recordings` has `file_path` and optionally `split`, `should_augment`, `copy_ordinal`, `bytes`; all its columns are
    in `meta`. Only flagged rows of the train split are augmented. `open_file` gives the content of a path, in the task.
    A path that is null, gone or cannot be decoded is an error row, whatever is wrong with it.
    """
    window, stride = window_and_stride(duration, overlap, cfg.sample_rate)
    recordings = _checked(recordings)
    have = recordings.columns
    flagged = F.coalesce("should_augment", F.lit(False)) if "should_augment" in have else F.lit(False)
    train = F.col("split").eqNullSafe("train") if "split" in have else F.lit(True)
    draws = F.when(flagged & train, augment_draws(["file_path", "copy_ordinal"], seed, noise_prob, cutout_prob))
    wanted = recordings.select(F.coalesce("file_path", F.lit("")).alias("file_path"), "copy_ordinal", draws.alias("draws"), F.struct(*[F.col(f"`{c}`") for c in have]).alias("meta"))
    chunks = copy_chunks(wanted, F.struct("draws", "meta"), F.to_json("meta"))
    # A number of tasks by bytes: the rows here are short, and would be put into one task by their own size.
    work = chunks.select("file_path", "copies", "_c").repartition(_tasks(recordings), "file_path", "_c").drop("_c")

    def segments(x: np.ndarray | None, error: str | None, draws: dict | None) -> Iterator[dict]:
        if error is not None:
            yield {"error": error}
            return
        x, log = augmented(x, draws, cfg.sample_rate) if draws is not None else (x, "raw")
        for k, start in enumerate(range(0, len(x) - window + 1, stride)):
            yield {"segment_idx": k, "offset_sec": start / cfg.sample_rate, "aug_params": log} | summarise(np.asarray(x[start:start + window], dtype=np.float32), cfg)

    def out(meta: pa.StructArray, at: list[int], rows: list[dict]) -> pa.RecordBatch:
        kinds = SEGMENT + [(s, pa.float64()) for s in SCALARS] + [(a, pa.list_(pa.float64())) for a in ARRAYS]
        columns = {name: pa.array([r.get(name) for r in rows], kind) for name, kind in kinds}
        return pa.RecordBatch.from_pydict({"meta": meta.take(pa.array(at, pa.int64()))} | columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, rows, at = batch["copies"].flatten(), [], []
            meta, draws, ends = copies.field("meta"), copies.field("draws"), np.cumsum(batch["copies"].value_lengths())
            first = 0
            for path, end in zip(batch["file_path"].to_pylist(), ends.tolist()):
                try:
                    x, error = K.decode_wav(open_file(path), cfg.sample_rate)[1], None
                except Exception as err:  # one bad recording must not end the job
                    x, error = None, K.reason(err)
                for i in range(first, end):
                    for row in segments(x, error, draws[i].as_py()):
                        rows.append(row)
                        at.append(i)
                        if len(rows) >= ROWS_PER_BATCH:
                            yield out(meta, at, rows)
                            rows, at = [], []
                first = end
            if rows:
                yield out(meta, at, rows)

    ship_package(recordings.sparkSession)
    schema = T.StructType([T.StructField("meta", recordings.schema), *T._parse_datatype_string(SEGMENT_SCHEMA).fields])
    return work.mapInArrow(run, schema)


def _metrics(recordings: DataFrame, cfg: MetricsConfig, **options) -> DataFrame:
    """Columns of `recordings`, segment columns with `error`, and the metrics."""
    segments = segment_summaries(recordings, cfg, **options)
    keep = [n for n, _ in SEGMENT]
    metrics = metrics_from_summary(segments.select("meta", *keep, F.struct(*SCALARS, *ARRAYS).alias("_s")), ["meta", *keep], cfg)
    return metrics.select("meta.*", *[F.col(f"`{c}`") for c in metrics.columns if c != "meta"])


def extract_features(recordings: DataFrame, cfg: MetricsConfig = MetricsConfig(), **options) -> DataFrame:
    """Metadata, segment position, augmentation log and the 102 metrics, one row per segment; files that fail give none.

    `options` are those of `segment_summaries`.
    """
    return _metrics(recordings, cfg, **options).filter("error is null").drop("error")


@dataclass(frozen=True)
class FeatureRun:
    """Both sides of one pass over the recordings, and how many segments and failed copies it met."""

    features: DataFrame
    errors: DataFrame
    segments: int
    failures: int


def feature_run(recordings: DataFrame, cfg: MetricsConfig = MetricsConfig(), path: str | None = None, **options) -> FeatureRun:
    """`extract_features` written once to `path` (or a new one in the shared folder), with the failed recordings of the same pass.

    `errors` has the columns of `recordings` and the reason in `error`, one row per copy; missing files are among them.
    """
    seen = Observation()
    failed = F.col("error").isNotNull()
    tagged = _metrics(recordings, cfg, **options).observe(seen, F.count_if(~failed).alias("segments"), F.count_if(failed).alias("failures"))
    spark, place = recordings.sparkSession, path or scratch_path(recordings.sparkSession, "features")
    tagged.write.mode("errorifexists").parquet(place)
    stored = spark.read.schema(tagged.schema).parquet(place)
    own = [F.col(f"`{c}`") for c in _checked(recordings).columns]
    return FeatureRun(stored.filter("error is null").drop("error"), stored.filter("error is not null").select(*own, "error"), seen.get["segments"], seen.get["failures"])
