"""NumPy helpers that run inside Spark tasks: WAV bytes, noise, and the transforms SQL lacks (FFT, mel, wavelet).

They turn one signal into short arrays; all statistics on those arrays are Spark SQL (`operators.metrics`).
"""

from __future__ import annotations

import io
import struct
import wave
from functools import lru_cache

import numpy as np

from pluvio.functions.arrays import MIX

# Daubechies-4 scaling filter (8 taps), decomposition order.
DB4 = np.array([-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
                -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523])
FLOOR = 1e-12


def _float_wav(content: bytes) -> tuple[int, int, int, bytes] | None:
    """(rate, sample width, channels, data) of an IEEE-float WAV, which the wave module refuses; None for any other."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, shape = 12, None
    while at + 8 <= len(content):
        name, size = content[at:at + 4], int.from_bytes(content[at + 4:at + 8], "little")
        body = content[at + 8:at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE and len(body) >= 26:  # the extensible form names the kind further on
                kind = int.from_bytes(body[24:26], "little")
            shape = (rate, bits // 8, channels) if kind == 3 and bits in (32, 64) else None
        elif name == b"data" and shape:
            return *shape, body
        at += 8 + size + size % 2
    return None


def resample(x: np.ndarray, rate: int, want: int, taps: int = 32) -> np.ndarray:
    """Windowed-sinc resampling; the band is cut at the lower of both Nyquist limits. Keeps the duration."""
    n = int(np.ceil(len(x) * want / rate))
    cut = min(1.0, want / rate)
    half = int(np.ceil(taps / cut))
    padded = np.pad(x.astype(np.float64), (half, half + 1))
    out = np.empty(n, np.float32)
    for lo in range(0, n, 1 << 14):
        at = np.arange(lo, min(n, lo + (1 << 14))) * (rate / want)
        first = np.floor(at).astype(np.int64) - half + 1
        near = first[:, None] + np.arange(2 * half)
        gap = at[:, None] - near
        weight = cut * np.sinc(cut * gap) * np.cos(np.pi * gap / (2 * half + 2)) ** 2
        out[lo:lo + len(at)] = (padded[np.clip(near + half, 0, len(padded) - 1)] * weight).sum(1)
    return out


def decode_wav(content: bytes, want_rate: int | None = None, duration: float | None = None, convert: bool = True) -> tuple[int, np.ndarray]:
    """PCM or float WAV bytes to (rate, mono float32); raises ValueError with the reason.

    Another rate than `want_rate` is resampled, or refused without `convert`.
    """
    numbers = _float_wav(content) if content is not None else None
    try:
        if numbers:
            rate, width, channels, raw = numbers
            raw = raw if duration is None else raw[:max(0, int(duration * rate) * width * channels)]
        else:
            with wave.open(io.BytesIO(content)) as w:
                rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
                n = w.getnframes() if duration is None else min(w.getnframes(), int(duration * rate))
                raw = w.readframes(n)
    except (wave.Error, EOFError) as err:
        raise ValueError(f"not a readable PCM WAV: {err}") from err
    if rate <= 0 or channels <= 0:
        raise ValueError(f"{channels} channels at rate {rate}")
    if not numbers and width not in (1, 2, 3, 4):
        raise ValueError(f"samples of {width} bytes")
    if want_rate is not None and rate != want_rate and not convert:
        raise ValueError(f"sample rate {rate}, expected {want_rate}")
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if not raw:
        raise ValueError("no samples")
    if numbers:
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    elif width == 1:
        x = (np.frombuffer(raw, "u1").astype(np.float32) - 128.0) / 128.0
    elif width == 3:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / np.float32(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / np.float32(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1, dtype=np.float32)
    return (rate, x) if want_rate in (None, rate) else (want_rate, resample(x, rate, want_rate))


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    """A signal as a 16-bit mono WAV; samples beyond -1 and 1 are cut, NaN is silence."""
    clean = np.nan_to_num(np.asarray(x, dtype=np.float64), nan=0.0, posinf=1.0, neginf=-1.0)
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as out:
        out.setnchannels(1), out.setsampwidth(2), out.setframerate(rate)
        out.writeframes(np.rint(clean.clip(-1, 1) * 32767).astype("<i2").tobytes())
    return buffer.getvalue()


def reason(err: Exception) -> str:
    """Why a recording could not be read, in one line."""
    if isinstance(err, FileNotFoundError):
        return "no such file"
    return str(err) if isinstance(err, ValueError) and str(err) else f"{type(err).__name__}: {err}"


def cut_frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        return np.empty((0, size), dtype=x.dtype)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def power_spectrogram(x: np.ndarray, rate: int, n_fft: int, hop: int) -> np.ndarray:
    """One-sided power density (frames x bins), periodic Hann window, floored."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    p = np.abs(np.fft.rfft(cut_frames(x.astype(np.float64), n_fft, hop) * hann, axis=1)) ** 2 / (rate * np.sum(hann**2))
    p[:, 1:(-1 if n_fft % 2 == 0 else None)] *= 2
    return np.maximum(p, FLOOR)


@lru_cache(maxsize=8)
def mel_weights(rate: int, n_fft: int, n_mels: int = 128) -> np.ndarray:
    """Triangular bands of equal area on the Slaney mel scale (linear to 1 kHz, then logarithmic)."""
    log_step = np.log(6.4) / 27.0
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + np.log(f / 1000) / log_step
    mels = np.linspace(0.0, to_mel(rate / 2), n_mels + 2)
    hz = np.where(mels < 15, mels * 200 / 3, 1000 * np.exp(log_step * (mels - 15)))
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    up, down = (f - hz[:-2, None]) / np.diff(hz)[:-1, None], (hz[2:, None] - f) / np.diff(hz)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2.0 / (hz[2:] - hz[:-2]))[:, None]


@lru_cache(maxsize=8)
def dct_basis(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal DCT-II rows."""
    k, n = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    scale = np.where(k == 0, np.sqrt(1 / n_in), np.sqrt(2 / n_in))
    return scale * np.cos(np.pi * k * (2 * n + 1) / (2 * n_in))


def mfcc(power: np.ndarray, rate: int, n_fft: int, n_out: int = 20, top_db: float = 80.0) -> np.ndarray:
    """Cepstral coefficients per frame (frames x n_out)."""
    mel = 10 * np.log10(np.maximum(power @ mel_weights(rate, n_fft).T, 1e-10))
    mel = np.maximum(mel, mel.max() - top_db)
    return mel @ dct_basis(n_out, mel.shape[1]).T


def mean_delta(rows: np.ndarray, width: int = 9) -> np.ndarray | None:
    """Mean over frames of the local line slope; edge frames take the slope of the first or last full window."""
    if len(rows) < width:
        return None
    k = np.arange(width) - width // 2
    inner = np.lib.stride_tricks.sliding_window_view(rows, width, axis=0) @ k / np.sum(k**2)
    edge = width // 2
    return (inner.sum(axis=0) + edge * (inner[0] + inner[-1])) / len(rows)


def wavelet_levels(x: np.ndarray, levels: int = 5) -> list[np.ndarray]:
    """Filter-and-halve with mirrored edges: [approximation, detail level N, ..., detail level 1]."""
    high = DB4[::-1] * np.where(np.arange(8) % 2 == 0, -1.0, 1.0)
    a, details = x.astype(np.float64), []
    for _ in range(levels):
        padded = np.pad(a, 7, mode="symmetric")
        details.append(np.convolve(padded, high, "valid")[1::2])
        a = np.convolve(padded, DB4, "valid")[1::2]
    return [a] + details[::-1]


def mixed(number: np.ndarray) -> np.ndarray:
    """32 well mixed bits of integers from 0 to 2 ** 32 - 1."""
    for _ in range(2):
        number = (number ^ number >> 16) * MIX % (1 << 32)
    return number ^ number >> 16


def gaussian(seed: int, n: int) -> np.ndarray:
    """Normal numbers for the places 0 to n - 1 of a seed, by the Box-Muller formula on two mixed counters."""
    one, two = ((mixed((mixed(2 * np.arange(n, dtype=np.int64) + j) + seed) % (1 << 32)) + 0.5) / (1 << 32) for j in (0, 1))
    return np.sqrt(-2 * np.log(one)) * np.cos(2 * np.pi * two)


def add_noise(x: np.ndarray, factor: float, seed: int) -> np.ndarray:
    """Gaussian noise at a share of the peak amplitude, the same as `arrays.noise`."""
    return x + factor * float(np.max(np.abs(x), initial=0.0)) * gaussian(seed, len(x))
