"""Sliding segments and augmentation of signals, as arrays or as ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions import arrays as A
from pluvio.functions.kernels import add_noise
from pluvio.functions.scalars import hash_int, hash_unit, seeded_hash
from pluvio.operators.ranks import HOT_ROWS, number_rows

# Ranges of the random draws.
SHIFT_RANGE = (0.1, 0.9)
GAIN_RANGE = (0.7, 1.2)
NOISE_RANGE = (0.001, 0.02)
CUTOUT_SEC = 0.1


def window_and_stride(duration: float, overlap: float, sample_rate: int) -> tuple[int, int]:
    if duration <= 0 or sample_rate <= 0 or not 0 <= overlap < 1:
        raise ValueError("need duration > 0, sample_rate > 0 and 0 <= overlap < 1")
    window = int(duration * sample_rate)
    stride = int(window * (1 - overlap))
    if window < 1 or stride < 1:
        raise ValueError("the window or its stride is shorter than one sample")
    return window, stride


def segment_arrays(df: DataFrame, samples: str, duration: float, overlap: float, sample_rate: int) -> DataFrame:
    """One row per full window: `segment_idx, offset_sec` and the slice. Shorter signals give no row."""
    window, stride = window_and_stride(duration, overlap, sample_rate)
    size = F.size(samples)
    rest = [c for c in df.columns if c != samples]
    starts = F.sequence(F.lit(0), F.greatest(size - window, F.lit(0)), F.lit(stride))
    return (df.filter(size >= window).select(*rest, samples, F.posexplode(starts).alias("segment_idx", "_start"))
            .select(*rest, "segment_idx", (F.col("_start") / F.lit(float(sample_rate))).alias("offset_sec"),
                    F.slice(samples, F.col("_start") + 1, window).alias(samples)))


def segment_ordered_rows(df: DataFrame, by: Sequence[str], order: str, value: str, window: int, stride: int,
                         hot_rows: int = HOT_ROWS, ties: Sequence[str] = ()) -> DataFrame:
    """Windows over signals stored one sample per row: `segment_idx, n, rms, mae, min, max` per full window.

    Samples of equal `order` are taken by the columns `ties`, and then by value, so that the windows are the same in every run.
    A sample goes to each window that covers it and partial sums combine on the map side, so a key with
    a third of all samples is spread over its many windows.
    """
    if not 0 < stride <= window:
        raise ValueError("need 0 < stride <= window")
    by = list(by)
    rows = number_rows(df.select(*by, order, *ties, F.col(value).cast("double").alias("_v")), by, order, "_i", hot_rows, ties=[*ties, "_v"])
    i = F.col("_i")
    first = F.greatest(F.lit(0).cast("long"), F.floor((i - window) / F.lit(stride)) + 1)
    last = F.floor(i / F.lit(stride))
    in_window = rows.filter(first <= last).select(*by, F.explode(F.sequence(first, last)).alias("segment_idx"), "_v")
    v = F.col("_v")
    return (in_window.groupBy(*by, "segment_idx")
            .agg(F.count("*").alias("n"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg(F.abs(v)).alias("mae"),
                 F.min(v).alias("min"), F.max(v).alias("max"))
            .filter(F.col("n") == window))


def augment_draws(keys: Sequence[str | Column], seed: int = 42, noise_prob: float = 0.2, cutout_prob: float = 0.3) -> Column:
    """Random draws of one copy as a struct; a function of the keys and the seed only."""
    def unit(purpose: str) -> Column:
        return hash_unit([*keys, F.lit(purpose)], seed)
    def span(u: Column, limits: tuple[float, float]) -> Column:
        return u * (limits[1] - limits[0]) + limits[0]
    noisy, cut = unit("noise?") < noise_prob, unit("cutout?") < cutout_prob
    return F.struct(unit("shift").alias("shift_u"), span(unit("gain"), GAIN_RANGE).alias("gain"),
                    F.when(noisy, span(unit("noise"), NOISE_RANGE)).alias("noise"),
                    F.when(cut, unit("cutout")).alias("cut_u"),
                    hash_int(seeded_hash([*keys, F.lit("noise seed")], seed)).alias("noise_seed"))


def shift_amount(size: str, draws: str = "_d") -> str:
    """SQL text: shift in samples from the drawn unit number."""
    low, high = (f"floor({size} * {r}D)" for r in SHIFT_RANGE)
    return f"int(greatest(0, least({low} + floor({draws}.shift_u * ({high} - {low})), {size} - 1)))"


def cutout_length(sample_rate: int) -> int:
    return int(CUTOUT_SEC * sample_rate)


def cutout_start(size: str, sample_rate: int, draws: str = "_d") -> str:
    """SQL text: first zeroed sample, NULL without a cutout draw or for a short signal."""
    length = cutout_length(sample_rate)
    return f"if({size} > {length}, int(floor({draws}.cut_u * ({size} - {length}))), null)"


def augment_log(size: str, sample_rate: int, draws: str = "_d") -> str:
    """SQL text of the log, such as `shift=12|gain=0.95|noise=0.0100|cutout`; `empty` for an empty signal."""
    noise = f"if({draws}.noise is not null, format_string('noise=%.4f', {draws}.noise), null)"
    cut = f"if(({cutout_start(size, sample_rate, draws)}) is not null, 'cutout', null)"
    return (f"if({size} > 0, concat_ws('|', format_string('shift=%d', {shift_amount(size, draws)}), "
            f"format_string('gain=%.2f', {draws}.gain), {noise}, {cut}), 'empty')")


def augmented(x: np.ndarray, draws: dict, sample_rate: int) -> tuple[np.ndarray, str]:
    """Apply the draws of one copy to one signal; returns the signal and the log."""
    n = len(x)
    if n == 0:
        return x, "empty"
    low, high = (int(n * r) for r in SHIFT_RANGE)
    shift = max(0, min(low + int(draws["shift_u"] * (high - low)), n - 1))
    log = [f"shift={shift}", f"gain={draws['gain']:.2f}"]
    x = np.roll(x, shift).astype(np.float64) * draws["gain"]
    if not pd.isna(draws["noise"]):
        x = add_noise(x, draws["noise"], int(draws["noise_seed"]))
        log.append(f"noise={draws['noise']:.4f}")
    length = cutout_length(sample_rate)
    if not pd.isna(draws["cut_u"]) and n > length:
        start = int(draws["cut_u"] * (n - length))
        x[start:start + length] = 0.0
        log.append("cutout")
    return x, "|".join(log)


def augment(df: DataFrame, samples: str, keys: Sequence[str], sample_rate: int, seed: int = 42,
            noise_prob: float = 0.2, cutout_prob: float = 0.3) -> DataFrame:
    """Shift, gain, noise and cutout of signals held in an array column; adds `aug_params`. All of it is array expressions."""
    out = df.withColumn("_d", augment_draws(keys, seed, noise_prob, cutout_prob))
    size = f"size({samples})"
    out = out.withColumn("aug_params", F.expr(augment_log(size, sample_rate)))
    moved = A.gain(A.roll(f"cast({samples} as array<double>)", shift_amount(size)), "_d.gain")
    if noise_prob > 0:
        moved = A.noise(moved, "_d.noise", "_d.noise_seed")
    cut = A.cutout(moved, cutout_start(size, sample_rate), cutout_length(sample_rate))
    return out.withColumn(samples, F.expr(cut).cast("array<float>")).drop("_d")


def framed(df: DataFrame, samples: str, size: int, hop: int) -> DataFrame:
    """One row per full frame: `frame_idx` and the slice."""
    rest = [c for c in df.columns if c != samples]
    return df.select(*rest, F.posexplode(F.expr(A.frames(samples, size, hop))).alias("frame_idx", samples))
