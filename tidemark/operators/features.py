"""Features of fixed-length epochs: shape, entropy, spectrum, bands and their smoothing.

An epoch holds a fixed number of samples, so grouping or windowing by
(recording, channel, epoch) is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .quantiles import exact_quantiles
from .rangejoin import interval_join

# fixed values: band names and limits in Hz (upper limit exclusive)
BANDS = [("sdelta", 0.4, 1), ("fdelta", 1, 4), ("theta", 4, 8), ("alpha", 8, 12), ("sigma", 12, 16), ("beta", 16, 30)]
BROAD = (0.5, 35.0)


def removed_share(epochs: DataFrame, artifacts: DataFrame, keys: Sequence[str], *, first: str, length: int, start: str, end: str) -> DataFrame:
    """Percent of each epoch's samples inside artifacts, overlaps of artifacts counted twice; ``end`` exclusive."""
    spans = epochs.withColumn("_last", F.col(first) + length - 1)
    cut = artifacts.select(*keys, start, (F.col(end) - 1).alias("_end"))
    met = interval_join(spans.select(*keys, first, "_last"), cut, keys, (first, "_last"), (start, "_end"), width=length, left_longest=length)
    l, r = F.col("l"), F.col("r")
    shared = F.least(l["_last"], r["_end"]) - F.greatest(l[first], r[start]) + 1
    lost = met.groupBy(*[l[k].alias(k) for k in keys], l[first].alias(first)).agg((F.sum(shared) * 100 / length).alias("removed_pct"))
    return epochs.join(lost, [*keys, first], "left").withColumn("removed_pct", F.coalesce("removed_pct", F.lit(0.0)))


def shape_features(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Per epoch: deviation, moments, quartile range, crossings, Hjorth, area, ordinal entropy, Petrosian dimension.

    One shuffle by epoch serves the windows and the aggregation.  A null sample
    (a masked artifact) makes the epoch's features null.
    """
    x = F.col(value)
    w = Window.partitionBy(*keys).orderBy(order)
    base = df.select(*keys, order, x.alias("x"), F.lag(x).over(w).alias("p"), F.lag(x, 2).over(w).alias("q"))
    d, before = F.col("x") - F.col("p"), F.col("p") - F.col("q")
    # rank of each of three neighbours, earlier first among equals: six ordinal patterns
    q, p, c = F.col("q"), F.col("p"), F.col("x")
    first = (p < q).cast("int") + (c < q).cast("int")
    second = (q <= p).cast("int") + (c < p).cast("int")
    pattern = first * 3 + second
    n = F.count("x").cast("double")
    var, var1 = F.var_pop("x"), F.var_pop("_d")
    turns = F.sum("_turn")
    rows = base.withColumns({"_d": d, "_dd": d - before, "_pattern": pattern, "_turn": ((d < 0) != (before < 0)).cast("int"), "_cross": ((c < 0) != (p < 0)).cast("int")})
    counts = [F.count_if(F.col("_pattern") == i) for i in (1, 2, 3, 5, 6, 7)]
    total = F.count("_pattern")
    entropy = sum((F.when(k > 0, -(k / total) * F.log2(k / total)).otherwise(0.0) for k in counts), F.lit(0.0)) / F.log2(F.lit(6.0))
    mobility = F.sqrt(F.try_divide(var1, var))
    features = {
        "std": F.stddev_samp("x"), "skew": F.skewness("x"), "kurt": F.kurtosis("x"),
        "_quartiles": F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))),
        "zero_crossings": F.sum("_cross"),
        "hjorth_mobility": mobility,
        "hjorth_complexity": F.try_divide(F.sqrt(F.try_divide(F.var_pop("_dd"), var1)), mobility),
        "auc": F.sum((F.abs("x") + F.abs("p")) / 2),
        "perm_entropy": entropy,
        "petrosian": F.log10(n) / (F.log10(n) + F.log10(n / (n + 0.4 * turns))),
    }
    complete = F.count("x") == F.count(F.lit(1))
    out = rows.groupBy(*keys).agg(*[F.when(complete, f).alias(name) for name, f in features.items()])
    return out.withColumn("iqr", F.col("_quartiles")[1] - F.col("_quartiles")[0]).drop("_quartiles")


def epoch_arrays(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """One ``samples`` array per epoch, in order."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("v"))))
    return df.groupBy(*keys).agg(F.transform(cells, lambda s: s["v"]).alias("samples"))


def _batched(series: pd.Series, kernel) -> pd.Series:
    """Apply a kernel to all arrays of one length at once."""
    out = pd.Series([None] * len(series), index=series.index, dtype=object)
    lengths = series.map(len)
    for n, part in series.groupby(lengths):
        result = kernel(np.stack(part.to_numpy()))
        for i, r in zip(part.index, result):
            out[i] = r
    return out


@pandas_udf(T.ArrayType(T.DoubleType()))
def periodogram(samples: pd.Series) -> pd.Series:
    """Power by frequency bin of Hann-tapered, mean-free samples (one-sided)."""

    def kernel(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        spectrum = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * taper)) ** 2 / (taper**2).sum()
        spectrum[:, 1: (n + 1) // 2] *= 2
        return spectrum

    return _batched(samples, kernel)


@pandas_udf(T.DoubleType())
def higuchi(samples: pd.Series) -> pd.Series:
    """Slope of log curve length against log 1/k for k up to 10."""

    def kernel(x: np.ndarray) -> np.ndarray:
        n, ks = x.shape[1], np.arange(1, 11)
        lengths = np.empty((len(x), len(ks)))
        for j, k in enumerate(ks):
            parts = []
            for m in range(k):
                steps = np.abs(np.diff(x[:, m::k], axis=1))
                parts.append(steps.sum(axis=1) * (n - 1) / (((n - m - 1) // k) * k * k))
            lengths[:, j] = np.mean(parts, axis=0)
        t = np.log(1.0 / ks)
        y = np.log(lengths)
        return ((t - t.mean()) * (y - y.mean(axis=1, keepdims=True))).sum(axis=1) / ((t - t.mean()) ** 2).sum()

    return _batched(samples, kernel).astype(float)


def spectral_entropy(psd: Column) -> Column:
    """Normalised entropy of a power array."""
    total = F.aggregate(psd, F.lit(0.0), lambda a, v: a + v)
    bits = F.aggregate(psd, F.lit(0.0), lambda a, v: a - F.when(v > 0, v / total * F.log2(v / total)).otherwise(0.0))
    return bits / F.log2(F.size(psd))


def _power(psd: Column, rate: float, n: Column, lo: float, hi: float) -> Column:
    first = F.ceil(F.lit(lo) * n / rate).cast("int")
    stop = F.least(F.ceil(F.lit(hi) * n / rate), F.size(psd)).cast("int")
    return F.aggregate(F.slice(psd, first + 1, F.greatest(stop - first, F.lit(0))), F.lit(0.0), lambda a, v: a + v)


def band_features(df: DataFrame, psd: str, samples: str, rate: float, scale: float = 1.0, *, points: int | None = None) -> DataFrame:
    """Absolute and relative band powers, cumulated bands, centroid, ratios and broad-band power from a power array.

    ``points`` is the number of samples the spectrum was taken over, where that isn't the whole epoch.
    """
    p, n = F.col(psd), F.lit(points) if points else F.size(samples)
    df = df.withColumns({f"abs_{name}": _power(p, rate, n, lo, hi) * scale for name, lo, hi in BANDS})
    total = sum((F.col(f"abs_{name}") for name, _, _ in BANDS), F.lit(0.0))
    df = df.withColumn("_total", total).withColumns({f"rel_{name}": F.try_divide(F.col(f"abs_{name}"), F.col("_total")) for name, _, _ in BANDS})
    names = [name for name, _, _ in BANDS]
    more: dict[str, Column] = {}
    for i in range(1, 5):
        for kind, suffix in (("rel", ""), ("abs", "abs")):
            more[f"{names[i]}_{suffix}aa"] = sum((F.col(f"{kind}_{b}") for b in names[i:]), F.lit(0.0))
            more[f"{names[i]}_{suffix}ab"] = sum((F.col(f"{kind}_{b}") for b in names[: i + 1]), F.lit(0.0))
    delta = F.col("rel_sdelta") + F.col("rel_fdelta")
    more |= {
        "dt": F.try_divide(delta, F.col("rel_theta")), "ds": F.try_divide(delta, F.col("rel_sigma")),
        "db": F.try_divide(delta, F.col("rel_beta")), "at": F.try_divide(F.col("rel_alpha"), F.col("rel_theta")),
        "abspow": _power(p, rate, n, *BROAD) * scale,
    }
    weighted = F.aggregate(F.transform(p, lambda v, i: v * i * rate / n), F.lit(0.0), lambda a, v: a + v)
    more["centroid"] = F.try_divide(weighted, F.aggregate(p, F.lit(0.0), lambda a, v: a + v))
    return df.withColumns(more).drop("_total")


def triangular_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, points: int = 15) -> DataFrame:
    """Centred triangular mean over epochs; near the ends over those that exist (one row per epoch)."""
    half = points // 2
    w = Window.partitionBy(*keys).orderBy(order)
    top, bottom = F.lit(0.0), F.lit(0.0)
    for k in range(-half, half + 1):
        weight = 1 - abs(k) / (half + 1)
        x = F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w)
        top = top + F.coalesce(x * weight, F.lit(0.0))
        bottom = bottom + F.when(x.isNotNull(), weight).otherwise(0.0)
    return df.withColumn(name, F.try_divide(top, bottom))


def trailing_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, points: int = 4) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - points, 0)))


def robust_scale(df: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """``(x - median) / (q95 - q05)`` per recording and column."""
    out = df
    for c in columns:
        q = exact_quantiles(df, keys, c, {"_lo": 0.05, "_mid": 0.5, "_hi": 0.95})
        out = out.join(q, list(keys), "left").withColumn(c + suffix, F.try_divide(F.col(c) - F.col("_mid"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_mid", "_hi")
    return out


def null_out_unreliable(df: DataFrame, removed_pct: str, features: Sequence[str], limit: float = 50.0) -> DataFrame:
    """Features of epochs with more than ``limit`` percent removed become null; ``_norm`` columns stay."""
    return df.withColumns({c: F.when(~(F.col(removed_pct) > limit), F.col(c)) for c in features if not c.endswith("_norm")})


def raw_beside_cleaned(raw: DataFrame, cleaned: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Cleaned features with the raw ones as ``Raw_*``, on the full key (channel included)."""
    return cleaned.join(raw.select(*keys, *[F.col(c).alias(f"Raw_{c}") for c in features]), list(keys), "left")


def area_over_time(df: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Trapezoid area of a series of epochs over real time."""
    w = Window.partitionBy(*keys).orderBy(at)
    strip = (F.col(at) - F.lag(at).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    return df.withColumn("_strip", strip).groupBy(*keys).agg(F.coalesce(F.sum("_strip"), F.lit(0.0)).alias("area"))


def waveform_summaries(df: DataFrame, keys: Sequence[str], channel: str, attributes: Sequence[str]) -> DataFrame:
    """Attribute means per channel, and ``Aggregated``: the mean of the channel means."""
    per = df.groupBy(*keys, channel).agg(*[F.avg(a).alias(a) for a in attributes])
    both = per.groupBy(*keys).agg(*[F.avg(a).alias(a) for a in attributes]).withColumn(channel, F.lit("Aggregated"))
    return per.unionByName(both)
