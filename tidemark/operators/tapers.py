"""Spectra of epochs by adaptive multitaper and by the median of overlapping segments."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

ROUNDS = 250


def _above(d, e2, x: float) -> int:
    """Number of eigenvalues above x of the symmetric tridiagonal matrix with diagonal ``d`` and squared side ``e2``."""
    count, q = 0, 1.0
    for i in range(len(d)):
        q = d[i] - x - (e2[i - 1] / q if i else 0.0)
        if q == 0.0:
            q = -1e-300
        count += q > 0
    return count


def _vector(d, e, value: float) -> np.ndarray:
    """The eigenvector of a simple eigenvalue: factors from both ends, joined where they agree best."""
    n = len(d)
    down, up = [0.0] * n, [0.0] * n
    for i in range(n):
        down[i] = (d[i] - value - (e[i - 1] ** 2 / down[i - 1] if i else 0.0)) or 1e-300
    for i in range(n - 1, -1, -1):
        up[i] = (d[i] - value - (e[i] ** 2 / up[i + 1] if i < n - 1 else 0.0)) or 1e-300
    at = min(range(n), key=lambda i: abs(down[i] + up[i] - (d[i] - value)))
    v = [0.0] * n
    v[at] = 1.0
    for i in range(at - 1, -1, -1):
        v[i] = -e[i] / down[i] * v[i + 1]
    for i in range(at + 1, n):
        v[i] = -e[i - 1] / up[i] * v[i - 1]
    out = np.array(v)
    return out / np.sqrt((out * out).sum())


@lru_cache(maxsize=8)
def tapers(n: int, half_width: float = 4.0, least: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Slepian tapers of n samples (rows, unit energy) and the share of their energy within ``half_width / n`` of frequency 0.

    Up to ``2 * half_width`` of them, without those whose share is ``least`` or less (the first always stays).
    """
    w = half_width / n
    i = np.arange(n)
    d = (((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * w)).tolist()
    e = (i[1:] * (n - i[1:]) / 2).astype(float).tolist()
    e2 = [x * x for x in e]
    # no eigenvalue lies outside the circles of the rows
    reach = [abs(a) + abs(b) for a, b in zip([0.0, *e], [*e, 0.0])]
    low, high = min(a - r for a, r in zip(d, reach)), max(a + r for a, r in zip(d, reach))
    found, shares = [], []
    lag = np.arange(1, n)
    kernel = np.sin(2 * np.pi * w * lag) / (np.pi * lag)
    for j in range(min(int(2 * half_width), n)):
        a, b = low, high
        while b - a > 4e-16 * max(abs(a), abs(b)):
            middle = (a + b) / 2
            if middle in (a, b):
                break
            a, b = (middle, b) if _above(d, e2, middle) > j else (a, middle)
        high = b
        v = _vector(d, e, (a + b) / 2)
        spread = np.fft.irfft(np.abs(np.fft.rfft(v, 2 * n)) ** 2, 2 * n)[:n]
        share = float(2 * w * spread[0] + 2 * (spread[1:] * kernel).sum())
        if j and share <= least:
            break
        found.append(v)
        shares.append(min(share, 1.0))
    return np.array(found), np.array(shares)


def _sided(power: np.ndarray, n: int) -> np.ndarray:
    """Both sides of a spectrum in one: all but frequency 0 and the highest of an even length count twice."""
    power[..., 1:(n + 1) // 2] *= 2
    return power


def adaptive_spectrum(x: np.ndarray, rate: float, half_width: float = 4.0) -> np.ndarray:
    """Thomson's adaptive multitaper density of each row of x, after its mean is taken away."""
    n = x.shape[1]
    x = x - x.mean(1, keepdims=True)
    shape, share = tapers(n, half_width)
    power = np.abs(np.fft.rfft(x[:, None, :] * shape, axis=2)) ** 2
    leak = ((1 - share)[None, :] * (x * x).mean(1)[:, None])[:, :, None]
    share = share[None, :, None]
    out = power[:, :2].mean(1)
    for _ in range(ROUNDS):
        # a taper's weight falls where what leaks from the whole band exceeds the density itself
        weight = share * (out[:, None, :] / np.maximum(share * out[:, None, :] + leak, 1e-300)) ** 2
        new = (weight * power).sum(1) / np.maximum(weight.sum(1), 1e-300)
        done = np.abs(new - out).max(initial=0.0) <= 1e-10 * new.max(initial=0.0)
        out = new
        if done:
            break
    return _sided(out / rate, n)


def median_spectrum(x: np.ndarray, rate: float, seconds: float = 5.0) -> np.ndarray:
    """Median over half-overlapping Hamming segments of ``seconds``, corrected for the median's bias; shorter rows are one segment."""
    n = x.shape[1]
    size = min(int(seconds * rate), n)
    step = size - size // 2
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::step]
    parts = (parts - parts.mean(2, keepdims=True)) * window
    power = _sided(np.abs(np.fft.rfft(parts, axis=2)) ** 2 / (rate * (window * window).sum()), size)
    even = 2.0 * np.arange(1, (power.shape[1] - 1) // 2 + 1)
    return np.median(power, axis=1) / (1 + (1 / (even + 1) - 1 / even).sum())


def _by_length(samples: pd.Series, kernel) -> pd.Series:
    """Rows of one length together; an empty or missing one, and one with a missing sample, has none."""
    lengths = samples.map(lambda s: 0 if s is None else len(s))
    out = pd.Series([None] * len(samples), index=samples.index, dtype=object)
    for n, group in samples.groupby(lengths):
        if n:
            x = np.array([np.asarray(s, dtype=float) for s in group]).reshape(-1, n)
            whole = np.isfinite(x).all(1)
            if whole.any():
                for at, row in zip(group.index[whole], kernel(x[whole]).tolist()):
                    out[at] = row
    return out


def multitaper(rate: float, half_width: float = 4.0):
    """A column function: the adaptive multitaper density of an array of samples."""

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def spectrum(samples: pd.Series) -> pd.Series:
        return _by_length(samples, lambda x: adaptive_spectrum(x, rate, half_width))

    return spectrum


def welch_median(rate: float, seconds: float = 5.0):
    """A column function: the median density of an array's overlapping segments; its step is ``rate`` over the segment's length."""

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def spectrum(samples: pd.Series) -> pd.Series:
        return _by_length(samples, lambda x: median_spectrum(x, rate, seconds))

    return spectrum
