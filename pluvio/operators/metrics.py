"""Acoustic metrics of signal segments: 102 columns.

A small NumPy kernel turns each segment into short arrays over frequency bins or time frames
(`signal_summary`); every metric is then a Spark SQL expression over those arrays. Band limits and
spacings are parameters. A metric that cannot be computed is NULL and does not affect the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions import arrays as A
from pluvio.functions import kernels as K


@dataclass(frozen=True)
class MetricsConfig:
    """Rates, window and band limits. Hop is half a window."""

    sample_rate: int = 24_000
    n_fft: int = 1024
    anthro_band: tuple[float, float] = (0.0, 1000.0)
    bio_band: tuple[float, float] = (1000.0, 10_000.0)
    bi_band: tuple[float, float] = (2000.0, 15_000.0)
    tfsd_band: tuple[float, float] = (2000.0, 8000.0)
    diversity_step: float = 1000.0
    diversity_max: float = 10_000.0
    active_db: float = -50.0
    peak_spacing: float = 200.0
    rolloff: float = 0.85

    def __post_init__(self):
        if self.sample_rate <= 0 or self.n_fft < 4 or self.n_fft % 2:
            raise ValueError("need sample_rate > 0 and an even n_fft >= 4")

    @property
    def hop(self) -> int:
        return self.n_fft // 2


MFCC = 20
LEVELS = 5
# The published metric names, in their order.
METRICS = (["temp_entropy", "ACI", "AGI", "EAS", "ECU", "ECV", "num_peaks", "NDSI", "ratioBA", "anthro_energy", "bio_energy",
            "BI", "ADI", "AEI", "roughness", "tfsd", "temp_skew", "temp_kurtosis", "rms_mean", "rms_std", "rms_var",
            "zcr_mean", "zcr_std", "zcr_var", "mae", "psd_mean", "psd_std", "psd_var", "spec_slope", "spec_mean", "spec_std",
            "spec_var", "spec_skew", "spec_kurtosis", "spec_centroid", "spec_flatness", "spec_rolloff", "spec_bandwidth_mean",
            "spec_bandwidth_50%", "spec_bandwidth_90%", "mfcc_mean", "mfcc_std", "mfcc_var", "wav_energy_mean",
            "wav_approx_energy", "wav_approx_std", "wav_approx_var"]
           + [f"mfcc_{i}" for i in range(1, MFCC + 1)] + [f"mfcc_delta_{i}" for i in range(1, MFCC + 1)]
           + [f"wav_detail_lvl{i}_{s}" for i in range(1, LEVELS + 1) for s in ("energy", "std", "var")])

SCALARS = ["n_frames", "mean_abs", "m2", "m3", "m4", "roughness"]
ARRAYS = ["envelope", "rms", "zcr", "bin_mean", "bin_var", "bin_flux", "bin_mag", "bin_slope", "bin_active", "bin_tfsd",
          "centroid", "bandwidth", "flatness", "rolloff", "mfcc", "mfcc_delta", "wav_energy", "wav_std"]
SUMMARY_SCHEMA = ", ".join([f"{s} double" for s in SCALARS] + [f"{a} array<double>" for a in ARRAYS])


def summarise(x: np.ndarray, cfg: MetricsConfig) -> dict:
    """Arrays over bins and frames of one segment; None when it is shorter than one window."""
    if len(x) < cfg.n_fft:
        return dict.fromkeys(SCALARS + ARRAYS)
    x = x.astype(np.float64)
    d = x - x.mean()
    d2 = d * d
    frames = K.cut_frames(x, cfg.n_fft, cfg.hop)
    p = K.power_spectrogram(x, cfg.sample_rate, cfg.n_fft, cfg.hop)
    mag, log_p, f = np.sqrt(p), np.log(p), np.arange(cfg.n_fft // 2 + 1) * cfg.sample_rate / cfg.n_fft
    level = log_p * (10 / np.log(10))
    weight = mag / mag.sum(axis=1, keepdims=True)
    centroid = weight @ f
    running = np.cumsum(weight, axis=1)
    step = np.abs(np.diff(p, axis=0)).mean(axis=0) if len(p) > 1 else np.zeros(len(f))
    cepstra = K.mfcc(p, cfg.sample_rate, cfg.n_fft, MFCC)
    bands = K.wavelet_levels(x, LEVELS)
    return {
        "n_frames": float(len(p)), "mean_abs": np.abs(x).mean(), "m2": d2.mean(), "m3": (d2 * d).mean(), "m4": (d2 * d2).mean(),
        "roughness": np.abs(p - p.mean()).mean(),
        "envelope": np.abs(x[: len(x) // cfg.hop * cfg.hop]).reshape(-1, cfg.hop).max(axis=1),
        "rms": np.sqrt(np.einsum("ij,ij->i", frames, frames) / cfg.n_fft),
        "zcr": (np.diff(np.signbit(frames), axis=1)).sum(axis=1) / cfg.n_fft,
        "bin_mean": p.mean(axis=0), "bin_var": p.var(axis=0), "bin_flux": np.abs(np.diff(mag, axis=0)).sum(axis=0),
        "bin_mag": mag.sum(axis=0), "bin_slope": step * cfg.sample_rate / cfg.hop,
        "bin_active": (level - level.max() > cfg.active_db).sum(axis=0).astype(float),
        "bin_tfsd": np.abs(np.diff(np.diff(level, axis=0), axis=1)).sum(axis=0),
        "centroid": centroid, "bandwidth": np.sqrt((weight * (f - centroid[:, None]) ** 2).sum(axis=1)),
        "flatness": np.exp(log_p.mean(axis=1)) / p.mean(axis=1),
        "rolloff": f[(running >= cfg.rolloff * (1 - 1e-12)).argmax(axis=1)],
        "mfcc": cepstra.mean(axis=0), "mfcc_delta": K.mean_delta(cepstra),
        "wav_energy": np.array([(b**2).mean() for b in bands]), "wav_std": np.array([b.std() for b in bands]),
    }


def signal_summary(samples: str | Column, cfg: MetricsConfig) -> Column:
    """The kernel as a column: a struct of `SCALARS` and `ARRAYS`, one Arrow pass."""
    @F.pandas_udf(SUMMARY_SCHEMA)
    def run(x: pd.Series) -> pd.DataFrame:
        rows = [summarise(np.asarray(v if v is not None else [], dtype=np.float64), cfg) for v in x]
        return pd.DataFrame(rows, columns=SCALARS + ARRAYS)
    return run(F.col(samples) if isinstance(samples, str) else samples)


def bin_frequencies(cfg: MetricsConfig) -> str:
    return f"transform(sequence(0, {cfg.n_fft // 2}), k -> k * {cfg.sample_rate / cfg.n_fft!r}D)"


def bioacoustic_index(psd: str, freqs: str, cfg: MetricsConfig) -> str:
    """Area in dB kHz of the mean spectrum above its minimum inside the band."""
    step = cfg.sample_rate / cfg.n_fft / 1000
    return A.let(A.decibels(A.between(psd, freqs, *cfg.bi_band)),
                 lambda level: f"({A.total(level)} - array_min({level}) * size({level})) * {step!r}D")


def diversity_shares(active: str, n_frames: str, freqs: str, cfg: MetricsConfig) -> str:
    """Share of loud cells in each band of `diversity_step` Hz that holds bins."""
    edges = np.arange(0.0, min(cfg.diversity_max, cfg.sample_rate / 2 + 1e-9), cfg.diversity_step)
    bands = [A.bind(lambda b: A.ratio(A.total(f"{b}.band"), f"size({b}.band) * {b}.n"),
                    band=A.between(active, freqs, float(e), float(e + cfg.diversity_step)), n=n_frames) for e in edges]
    return f"filter(array({', '.join(bands)}), x -> x is not null)"


def energy_bandwidth(psd: str, freqs: str, share: float) -> str:
    """Width of the centred band that holds a share of the energy."""
    return f"({A.share_frequency(psd, freqs, 0.5 + share / 2)} - {A.share_frequency(psd, freqs, 0.5 - share / 2)})"


def base_formulas(cfg: MetricsConfig) -> dict[str, str]:
    """SQL text of the quantities that are read from the summary struct `_s`."""
    f, psd = bin_frequencies(cfg), "_s.bin_mean"
    lower = f"slice({f}, 1, {cfg.n_fft // 2})"
    out = {
        "temp_entropy": f"1D - {A.evenness_gap('_s.envelope')}",
        "ACI": A.total(A.divided("_s.bin_flux", "_s.bin_mag")), "AGI": A.total(A.divided("_s.bin_slope", psd)),
        "EAS": A.evenness_gap(psd), "ECU": A.evenness_gap("_s.bin_var"),
        "ECV": A.evenness_gap(A.divided("transform(_s.bin_var, v -> sqrt(v))", psd)),
        "num_peaks": A.spaced_peaks(A.decibels(psd), f, cfg.peak_spacing),
        "anthro_energy": A.total(A.between(psd, f, *cfg.anthro_band)), "bio_energy": A.total(A.between(psd, f, *cfg.bio_band)),
        "BI": bioacoustic_index(psd, f, cfg), "_shares": diversity_shares("_s.bin_active", "_s.n_frames", f, cfg),
        "roughness": "_s.roughness",
        "tfsd": A.ratio(A.total(A.between("_s.bin_tfsd", lower, *cfg.tfsd_band)), A.total("_s.bin_tfsd")),
        "temp_skew": A.ratio("_s.m3", "power(_s.m2, 1.5D)"), "temp_kurtosis": A.ratio("_s.m4", "_s.m2 * _s.m2"),
        "mae": "_s.mean_abs", "spec_slope": A.slope(f, psd),
        "_psd_m3": A.central(psd, 3), "_psd_m4": A.central(psd, 4),
        "spec_centroid": A.mean("_s.centroid"), "spec_flatness": A.mean("_s.flatness"), "spec_rolloff": A.mean("_s.rolloff"),
        "spec_bandwidth_mean": A.mean("_s.bandwidth"),
        "spec_bandwidth_50%": energy_bandwidth(psd, f, 0.5), "spec_bandwidth_90%": energy_bandwidth(psd, f, 0.9),
        "wav_energy_mean": A.mean("_s.wav_energy"),
    }
    for name, source in (("rms", "_s.rms"), ("zcr", "_s.zcr"), ("psd", psd), ("mfcc", "_s.mfcc")):
        out |= {f"{name}_mean": A.mean(source), f"{name}_std": A.std(source)}
    for i in range(MFCC):
        out |= {f"mfcc_{i + 1}": f"get(_s.mfcc, {i})", f"mfcc_delta_{i + 1}": f"get(_s.mfcc_delta, {i})"}
    for k in range(LEVELS + 1):
        name = "wav_approx" if k == 0 else f"wav_detail_lvl{LEVELS + 1 - k}"
        out |= {f"{name}_energy": f"get(_s.wav_energy, {k})", f"{name}_std": f"get(_s.wav_std, {k})"}
    return out


def derived_formulas() -> dict[str, str]:
    """SQL text of the metrics that are read from the base quantities."""
    out = {
        "NDSI": A.ratio("bio_energy - anthro_energy", "bio_energy + anthro_energy"), "ratioBA": A.ratio("bio_energy", "anthro_energy"),
        "ADI": A.entropy("_shares"), "AEI": A.gini("_shares"), "spec_mean": "psd_mean", "spec_std": "psd_std", "spec_var": "psd_std * psd_std",
        "spec_skew": A.ratio("_psd_m3", "power(psd_std, 3)"), "spec_kurtosis": A.ratio("_psd_m4", "power(psd_std, 4)"),
    }
    for name in ["rms", "zcr", "psd", "mfcc", "wav_approx"] + [f"wav_detail_lvl{i}" for i in range(1, LEVELS + 1)]:
        out[f"{name}_var"] = f"{name}_std * {name}_std"
    return out


def metrics_from_summary(df: DataFrame, keep: list[str], cfg: MetricsConfig) -> DataFrame:
    """The 102 metric columns from a summary struct `_s`, in `METRICS` order, non-finite values as NULL.

    Three projections: quantities used by several metrics are computed once.
    """
    base, derived = base_formulas(cfg), derived_formulas()
    names = [f"`{c}`" for c in keep]
    step = df.selectExpr(*names, *[f"{e} as `{n}`" for n, e in base.items()])
    step = step.selectExpr(*names, *[f"{derived.get(n, f'`{n}`')} as `{n}`" for n in METRICS])
    return step.selectExpr(*names, *[f"if(isnan(`{n}`) or abs(`{n}`) = double('infinity'), null, double(`{n}`)) as `{n}`" for n in METRICS])


def acoustic_metrics(df: DataFrame, samples: str, cfg: MetricsConfig = MetricsConfig()) -> DataFrame:
    """Replace the signal column by the 102 metric columns."""
    rest = [c for c in df.columns if c != samples]
    return metrics_from_summary(df.select(*rest, signal_summary(samples, cfg).alias("_s")), rest, cfg)


def spectrogram(df: DataFrame, samples: str, sample_rate: int, n_fft: int) -> DataFrame:
    """`power`: frames x bins of one-sided power density per signal (NULL when shorter than one window)."""
    @F.pandas_udf("array<array<double>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([list(K.power_spectrogram(np.asarray(v), sample_rate, n_fft, n_fft // 2)) if len(v) >= n_fft else None for v in x])
    # non-deterministic to the optimizer, or an explode above it would evaluate the kernel twice
    return df.select(*[c for c in df.columns if c != samples], run.asNondeterministic()(samples).alias("power"))


def spectrogram_cells(df: DataFrame, samples: str, sample_rate: int, n_fft: int) -> DataFrame:
    """Long form `frame_idx, bin_idx, power`."""
    power = spectrogram(df, samples, sample_rate, n_fft)
    rest = [c for c in power.columns if c != "power"]
    frames = power.select(*rest, F.posexplode("power").alias("frame_idx", "_p"))
    return frames.select(*rest, "frame_idx", F.posexplode("_p").alias("bin_idx", "power"))
