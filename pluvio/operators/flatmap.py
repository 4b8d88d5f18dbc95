"""Parallel flat-map: a user function turns a batch of rows into any number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


# Output rows of retried rows that are handed back together: an Arrow batch of its own for each costs more than the row.
ROWS_PER_BATCH = 10_000
# Tasks a core that share the rows where failing ones are retried; a retry is a call for every few rows.
TASKS_PER_CORE = 4


def _spread(df: DataFrame) -> DataFrame:
    """`df` over all cores: a file of a few MB is one task, and one task would retry all of its rows."""
    spark = df.sparkSession
    return df.repartition(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _joined(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of the same dtypes as one; others stay apart, since joining them would change values."""
    alike: dict[tuple, list[pd.DataFrame]] = {}
    for frame in frames:
        alike.setdefault(tuple(frame.dtypes), []).append(frame)
    for same in alike.values():
        yield pd.concat(same, ignore_index=True)


def flat_map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType,
                  on_error: str = "raise", partitions: int | None = None) -> DataFrame:
    """Apply `fn` to Arrow batches on the executors; the output schema is declared, also for empty input.

    `on_error`: `raise` fails the job, `skip` drops the rows that fail, `capture` keeps every failing
    row as an output row of NULLs with the message in `_error`. With skip and capture a failing batch
    is retried in parts, down to single rows, so one bad row costs only itself; the parts are as long as the share of
    bad rows met so far allows, and the rows are spread over all cores, or over `partitions`.
    """
    if on_error not in ("raise", "skip", "capture"):
        raise ValueError("on_error must be raise, skip or capture")
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out_schema = T.StructType(list(declared.fields))
    if on_error == "capture":
        out_schema = out_schema.add("_error", "string")
    names = declared.fieldNames()

    def applied(rows: pd.DataFrame) -> pd.DataFrame:
        out = fn(rows)
        return out if isinstance(out, pd.DataFrame) and list(out.columns) == names else out[names].assign()

    def good(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _joined(frames):
            yield frame.assign(_error=None) if on_error == "capture" else frame

    def retried(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found, held, errors = [], 0, []
        start, bad, size = 0, 0, max(1, len(rows) // 2)
        while start < len(rows):
            part = rows.iloc[start:start + size]
            try:
                out = applied(part)
            except Exception as err:
                if len(part) > 1:
                    size = len(part) // 2
                    continue
                bad += 1
                errors.append(f"{type(err).__name__}: {err}")
            else:
                if len(out):
                    found.append(out)
                    held += len(out)
            start += len(part)
            size = max(1, start // (2 * bad)) if bad else 2 * size
            if held >= ROWS_PER_BATCH:
                yield from good(found)
                found, held = [], 0
        yield from good(found)
        if errors and on_error == "capture":
            yield pd.DataFrame({**{n: [None] * len(errors) for n in names}, "_error": errors})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                try:
                    whole = applied(batch)
                except Exception:
                    if on_error == "raise":
                        raise
                    yield from retried(batch)
                else:
                    yield whole.assign(_error=None) if on_error == "capture" else whole

    if partitions:
        df = df.repartition(partitions)
    elif on_error != "raise":
        df = _spread(df)
    return df.mapInPandas(run, out_schema)
