"""K-means and normal mixtures from Spark's own starting centres, with all later rounds on packed points.

The steps are those of ``KMeans`` and ``GaussianMixture``: the same seeding, sums, limits of rounds and tests of change. A
round reads blocks of numbers instead of one vector object per row, and several numbers of clusters share it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import packed, totals

EPSILON = 2.0 ** -52
#: Points that a round of a mixture works on at once, so that what it derives from them stays in a core's cache.
SLICE = 16_384


@dataclass(frozen=True)
class Points:
    """Rows with all coordinates known, the names of these as numbers, their vectors for seeding and their blocks for rounds."""

    rows: DataFrame
    names: list[str]
    vectors: DataFrame
    blocks: RDD


@contextmanager
def points(df: DataFrame, columns: Sequence[str], *, standardise: bool = False):
    """``Points`` of ``df`` (null and NaN left out), standardised if asked; their copies are released at the end."""
    rows = df.na.drop(subset=list(columns))
    numbers = [F.col(c).cast("double") for c in columns]
    if standardise:
        # the mean and deviation that StandardScaler finds, without a vector object per row
        found = rows.agg(*[f(x).alias(f"{name}{i}") for i, x in enumerate(numbers) for name, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        numbers = [(x - F.lit(float(found[f"m{i}"]))) * F.lit(1 / float(found[f"s{i}"]) if found[f"s{i}"] else 0.0) for i, x in enumerate(numbers)]
    names = [f"_p{i}" for i in range(len(columns))]
    rows = rows.withColumns(dict(zip(names, numbers)))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features").persist()
    blocks = packed(rows, names).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Points(rows, names, vectors, blocks)
    finally:
        blocks.unpersist()
        vectors.unpersist()


# ---- K-means

def _closest(centres: dict[int, np.ndarray]):
    def part(_, x):
        out = {}
        for k, c in centres.items():
            away = sum((x[j] - c[:, j, None]) ** 2 for j in range(len(x)))
            at = away.argmin(0)
            sums = [np.bincount(at, weights=v, minlength=len(c)) for v in (None, *x)]
            out[k] = np.append(np.stack(sums).ravel(), away.min(0).sum())
        return out

    return part


def k_means(p: Points, ks: Sequence[int], seed: int) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and cost per number of clusters; a round is one job over all that still move."""
    starts = {k: KMeans(k=k, seed=seed) for k in ks}
    rounds, still = KMeans().getMaxIter(), KMeans().getTol()
    centres = {k: np.array([list(c) for c in start.setMaxIter(0).fit(p.vectors).clusterCenters()]) for k, start in starts.items()}
    costs, moving = dict.fromkeys(ks, 0.0), list(ks)
    for _ in range(rounds):
        sums = totals(p.blocks, _closest({k: centres[k] for k in moving}))
        for k in [k for k in moving if k in sums]:
            *flat, costs[k] = sums[k]
            n, *s = np.array(flat).reshape(len(p.names) + 1, -1)
            new = np.where(n[:, None] > 0, np.stack(s, 1) / np.maximum(n, 1)[:, None], centres[k])
            if (((new - centres[k]) ** 2).sum(1) <= still * still).all():
                moving.remove(k)
            centres[k] = new
        if not moving:
            break
    return {k: (centres[k], float(costs[k])) for k in ks}


def nearest(p: Points, centres: np.ndarray) -> Column:
    """Number of the nearest centre, the first of equals."""
    away = F.array(*[sum(((F.col(x) - float(v)) * (F.col(x) - float(v)) for x, v in zip(p.names, c)), F.lit(0.0)) for c in centres])
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")


# ---- mixtures

def _root(cov: np.ndarray) -> tuple[float, np.ndarray]:
    """Logarithm of a normal's peak and the root of its inverse covariance; directions without variance are left out."""
    values, vectors = np.linalg.eigh(cov)
    kept = values > EPSILON * values.max() * len(values)
    scale = np.where(kept, np.sqrt(1 / np.where(kept, values, 1.0)), 0.0)
    return -0.5 * (len(values) * math.log(2 * math.pi) + float(np.log(values[kept]).sum())), scale[:, None] * vectors.T


def _expected(state: list):
    parts = [(w, m, *_root(c)) for w, m, c in state]

    def some(x):
        p = np.empty((len(parts), x.shape[1]))
        for i, (w, m, peak, root) in enumerate(parts):
            d = x - m[:, None]
            far = sum(sum(root[a, b] * d[b] for b in range(len(d))) ** 2 for a in range(len(d)))
            p[i] = EPSILON + w * np.exp(peak - 0.5 * far)
        all_ = p.sum(0)
        p /= all_
        sums = [np.concatenate([[r.sum()], x @ r, ((x * r) @ x.T).ravel()]) for r in p]
        return np.concatenate([[np.log(all_).sum()], *sums])

    def part(_, x):
        return {"": sum(some(x[:, i:i + SLICE]) for i in range(0, x.shape[1], SLICE))}

    return part


def mixture(p: Points, k: int, seed: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Weight, mean and covariance of each normal after expectation and maximisation; a round is one job."""
    start = GaussianMixture(k=k, seed=seed)
    rounds, still = start.getMaxIter(), start.getTol()
    model = start.setMaxIter(0).fit(p.vectors)
    state = [(w, g["mean"].toArray(), g["cov"].toArray()) for w, g in zip(model.weights, model.gaussiansDF.collect())]
    d, last = len(p.names), 0.0
    for _ in range(rounds):
        likelihood, *flat = totals(p.blocks, _expected(state))[""]
        sums = np.array(flat).reshape(k, -1)
        total = sums[:, 0].sum()
        state = []
        for w, *rest in sums:
            mean = np.array(rest[:d]) / w
            cov = np.array(rest[d:]).reshape(d, d) / w - np.outer(mean, mean)
            state.append((float(w / total), mean, cov))
        if abs(likelihood - last) <= still:
            break
        last = likelihood
    return state


def likeliest(p: Points, state: list) -> Column:
    """Number of the normal that a point most likely comes from, the first of equals."""
    chances = []
    for w, m, cov in state:
        peak, root = _root(cov)
        gaps = [F.col(x) - float(v) for x, v in zip(p.names, m)]
        axes = [sum((g * float(r) for g, r in zip(gaps, line)), F.lit(0.0)) for line in root]
        far = sum((a * a for a in axes), F.lit(0.0))
        chances.append(F.lit(EPSILON) + F.lit(float(w)) * F.exp(F.lit(peak) - far * 0.5))
    every = F.array(*chances)
    return (F.array_position(every, F.array_max(every)) - 1).cast("int")
