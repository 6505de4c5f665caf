"""Whitening of embeddings by the leading principal components of their distinct vectors.

Vectors become whole numbers, packed as bytes so that equal ones meet in a plain ``distinct``. Tasks sum the distinct
vectors, then their centred products; partial matrices are added in two rounds. The one matrix, as wide as a vector, is
turned to a tridiagonal one by Householder reflections; counts of sign changes (Sturm) bisect to its largest
eigenvalues; inverse iteration gives their vectors, orthogonalised again where eigenvalues lie close. The few components
go to all tasks, which project every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SCALE, COMPONENTS = 256, 4
_WIDTHS = (2, 4, 8)


# ---- vectors as whole numbers

def _whole(column: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * component) of each vector as 64-bit numbers, or None where it takes no part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    gaps = flat.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
    # the limit of 64-bit numbers, which a component beyond about 3.6e16 passes, counts as non-finite
    fine = ~gaps & np.isfinite(x) & (np.abs(np.where(np.isfinite(x), x, 0)) < 2.0**63)
    whole = np.where(fine, x, 0).astype(np.int64)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(missing, 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~fine)])
    spoilt = bad[ends] - bad[ends - sizes]
    return [None if m or s else whole[e - n: e] for m, s, e, n in zip(missing, spoilt, ends, sizes)]


def _pack(x: np.ndarray, dim: int) -> bytes:
    """A width and the numbers, little-endian, in the smallest of 2, 4 and 8 bytes that holds all of them: equal vectors, equal bytes."""
    if len(x) < dim:
        x = np.concatenate([x, np.zeros(dim - len(x), np.int64)])
    low, high = (int(x.min()), int(x.max())) if dim else (0, 0)
    for width in _WIDTHS:
        if -(1 << (8 * width - 1)) <= low and high < 1 << (8 * width - 1):
            return bytes([width]) + x.astype(f"<i{width}").tobytes()
    raise AssertionError


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for i, packed in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(packed, f"<i{packed[0]}", dim, 1)
    return out


def _packed(scale: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _whole(b.column(0), scale)
            yield pa.RecordBatch.from_arrays([pa.array([_pack(x, dim) for x in vectors if x is not None], pa.binary())], names=["x"])

    return run


# ---- sums over the fit list

def _sums(dim: int):
    """Per task and dimension the exact sum, in two halves whose own sums fit 64 bits, and the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            x = _unpack(b.column(0), dim)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    return run


def _products(centre: np.ndarray):
    """Per task the matrix of centred products, a row of it to a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)))
        for b in batches:
            y = _unpack(b.column(0), len(centre)) - centre
            total += y.T @ y
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centre)), pa.int32()), pa.array([part] * len(centre), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part", "products"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """One row, the sum of all rows of a group."""
    total = sum(chunk.flatten().to_numpy().reshape(len(chunk), -1).sum(0) for chunk in table.column("products").chunks if len(chunk))
    return pa.table({"i": table.column("i").slice(0, 1), "part": pa.array([0], pa.int32()), "products": pa.array([total], pa.list_(pa.float64()))})


def covariance(fit: DataFrame, centre: np.ndarray, n: int) -> np.ndarray:
    """Covariance over ``fit`` (x), divisor ``n``, centred before multiplying.

    A task hands on one matrix; two rounds of sums, the first over about the root of the number of tasks at a time,
    bring them together row by row.
    """
    shape = "i int, part int, products array<double>"
    parts = fit.mapInArrow(_products(centre), shape)
    groups = max(1, math.isqrt(int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    once = parts.groupBy("i", (F.col("part") % groups).alias("g")).applyInArrow(_added, shape)
    rows = once.groupBy("i").applyInArrow(_added, shape).select("i", "products").collect()  # one row per dimension
    out = np.zeros((len(centre), len(centre)))
    for r in rows:
        out[r["i"]] = r["products"]
    return (out + out.T) / (2 * n)


# ---- eigenvalues and vectors of one symmetric matrix

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit Householder vectors, each one longer than the columns it clears."""
    a, n, mirrors = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            mirrors.append(np.zeros(n - k - 1))
            continue
        x[0] += math.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -math.copysign(size, a[k + 1, k])
        a[k + 2:, k] = a[k, k + 2:] = 0
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def sturm_count(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``x``: the negative ones among its pivots."""
    tiny = np.finfo(float).tiny ** 0.5
    q, count = None, np.zeros(len(x), int)
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0)
        # a pivot that vanishes counts as a negative one
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling: each is bisected by counts until no number lies between its bounds."""
    reach = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    margin = np.finfo(float).eps * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny) * len(d)
    low, high = low - margin, high + margin
    wanted = len(d) - np.arange(k)  # the i-th largest has all but i eigenvalues below it or at it
    for _ in range(2000):
        middle = (low + high) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        below = sturm_count(d, e, middle) >= wanted
        high, low = np.where(below, middle, high), np.where(below, low, middle)
    return (low + high) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = right by elimination with row exchanges; a vanishing pivot becomes ``least``."""
    n = len(d)
    first, second, third = d - shift, np.append(e, 0.0), np.zeros(n)
    y = right.copy()
    for i in range(n - 1):
        below = e[i]
        if abs(first[i]) >= abs(below):
            pivot = first[i] if first[i] != 0 else least
            first[i] = pivot
            m = below / pivot
            first[i + 1] -= m * second[i]
            y[i + 1] -= m * y[i]
        else:
            m = first[i] / below
            old_first, old_second = first[i + 1], second[i + 1]
            first[i], y[i], y[i + 1] = below, y[i + 1], y[i] - m * y[i + 1]
            first[i + 1], second[i], second[i + 1], third[i] = second[i] - m * old_first, old_first, -m * old_second, old_second
    if abs(first[-1]) < least:
        first[-1] = least
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            y[i] -= second[i] * y[i + 1]
        if i + 2 < n:
            y[i] -= third[i] * y[i + 2]
        y[i] /= first[i]
        if abs(y[i]) > 1e200:
            y /= abs(y[i])
    return y


def _vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors for falling ``values`` by inverse iteration; those of one cluster are kept orthogonal to each other."""
    scale = max(np.abs(d).max() + (2 * np.abs(e).max() if len(e) else 0), np.finfo(float).tiny)
    least, out = np.finfo(float).eps * scale, []
    rng = np.random.default_rng(0)
    start = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * scale:
            start = i
        # equal values take slightly different shifts, so that their iterations differ
        shift = value - (i - start) * 4 * least
        y = rng.uniform(0.5, 1.0, len(d)) * rng.choice([-1.0, 1.0], len(d))
        for _ in range(6):
            y = _solve(d, e, shift, y / np.linalg.norm(y), least)
            y /= np.abs(y).max()
            for _ in range(2):
                for other in out[start:]:
                    y -= (other @ y) * other
        out.append(y / np.linalg.norm(y))
    return np.array(out)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    Parts of the tridiagonal matrix that a zero off-diagonal separates need no care of their own: the iteration starts
    with a vector that has all of them in it.
    """
    k = min(k, len(matrix))
    if not k:
        return np.zeros(0), np.zeros((0, 0))
    # one scale for all sizes of numbers
    size = np.abs(matrix).max()
    if size == 0:
        return np.zeros(k), np.eye(len(matrix))[:k]
    d, e, mirrors = tridiagonal(matrix / size)
    values = leading_values(d, e, k)
    vectors = _vectors(d, e, values)
    for row in vectors:
        for at in range(len(mirrors) - 1, -1, -1):
            v = mirrors[at]
            row[at + 1:] -= 2 * (v @ row[at + 1:]) * v
    # turned back, and once more orthogonal to the last digit
    for i in range(k):
        for j in range(i):
            vectors[i] -= (vectors[j] @ vectors[i]) * vectors[j]
        vectors[i] /= np.linalg.norm(vectors[i])
    return values * size, vectors


# ---- projection

def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, in whole numbers; None beyond 64 bits."""
    if not len(x) or not x.shape[1]:
        return [0] * len(x)
    most = n * int(np.abs(x).max() if x.min() > -(1 << 63) else 1 << 63) + max(map(abs, sums))
    if len(sums) * most * most < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def _projected(scale: int, centre: np.ndarray, directions: np.ndarray, n: int, sums: list[int]):
    """``directions``: components divided by the root of their eigenvalues, as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _whole(b.column(1), scale)
            keep = [i for i, x in enumerate(vectors) if x is not None]
            x = np.zeros((len(keep), len(centre)), np.int64)
            for at, i in enumerate(keep):
                x[at, : len(vectors[i])] = vectors[i]
            white = (x - centre) @ directions.T
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(_deviations(x, n, sums), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "deviation", "white"])

    return run


def _white_of_fit(centre: np.ndarray, directions: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            white = (_unpack(b.column(0), len(centre)) - centre) @ directions.T
            yield pa.RecordBatch.from_arrays([pa.array(list(white), pa.list_(pa.float64()))], names=["white"])

    return run


def identity_error(white: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``white`` (array) minus the identity, measured on its rows."""
    if not k:
        return 0.0
    entries = [F.covar_pop(F.col("white")[i], F.col("white")[j]) - F.lit(float(i == j)) for i in range(k) for j in range(i, k)]
    row = white.agg(F.max(F.lit(0)).alias("none"), *[F.abs(c).alias(f"c{at}") for at, c in enumerate(entries)]).first()
    return max(float(v) for v in row[1:])


def whitened(vectors: DataFrame, *, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding) and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Components come from the distinct vectors of floor(scale * component) and number from 1 by falling eigenvalue;
    ``deviation`` is the sum over dimensions of (n x - S)^2 (null beyond 64 bits). Rows whose vector is null or holds
    null or non-finite components, or such that pass 64 bits when scaled, are left out. Shorter vectors count as padded
    with zeros. Repeated rows appear each, a null vec_id stays null. Directions without variance have no component, so
    equal vectors alone, one vector, or a table without rows give no rows; among equal eigenvalues any basis may come.
    Other columns are left out. The driver and every task hold one matrix as wide as a vector, and no vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dim = rows.agg(F.max(F.size("embedding")).alias("d")).first()["d"] or 0
    none = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in _OUT.split(", "))])
    if dim < 1:
        return none
    fit = stored(rows.select("embedding").mapInArrow(_packed(scale, dim), "x binary").distinct(), "fit-list")
    sums = fit.mapInArrow(_sums(dim), "i int, n long, high long, low long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()  # one row per dimension
    if not sums:
        return none
    n, totals = sums[0]["n"], [0] * dim
    for r in sums:
        totals[r["i"]] = (r["high"] << 32) + r["low"]
    centre = np.array([float(Fraction(s, n)) for s in totals])
    matrix = covariance(fit, centre, n)
    trace = float(np.trace(matrix))
    values, directions = leading_components(matrix, components)
    real = values > dim * np.finfo(float).eps * max(trace, np.finfo(float).tiny)
    values, directions = values[real], directions[real]
    if not len(values):
        return none
    directions = directions / np.sqrt(values)[:, None]
    error = identity_error(fit.mapInArrow(_white_of_fit(centre, directions), "white array<double>"), len(values))
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    out = rows.mapInArrow(_projected(scale, centre, directions, n, totals), "vec_id long, deviation long, white array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
