"""Exact nearest-neighbour distances in one or two dimensions, and what they tell about two columns.

The distinct points of a key are cut into strips of equal count along x, and each strip into cells of equal count along
y, so that a cell holds between half of ``per_cell`` points and all of it however the columns depend on each other. A
point's k-th distance inside its own cell bounds the true one; only the cells whose box meets that square are searched
as well, each in one task with all points that visit it. Copies of a point are one weighted point and never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.values import known
from ..session import ensure_checkpoint_dir
from .quantiles import with_value_chunk
from .stats import numbered
from .timeline import Timeline, running

PER_CELL = 64
#: Distances on one axis that agree with a radius to this share of it are as far as the radius, however they were rounded.
SAME = 1e-9


def _cells(df: DataFrame, keys: Sequence[str], x: str, y: str | None, per_cell: int) -> DataFrame:
    """Distinct points as ``x, y, w`` with the ``strip`` and ``piece`` they lie in."""
    vx = known(F.col(x).cast("double"))
    vy = known(F.col(y).cast("double")) if y else F.lit(0.0)
    rows = df.select(*keys, (vx + 0.0).alias("x"), (vy + 0.0).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    points = rows.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w"))
    total = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = F.ceil(F.sqrt(F.col("_n") * per_cell)) if y else F.lit(per_cell)
    placed = numbered(points, keys, "x", "y").join(total, list(keys)).withColumn("_strips", F.ceil(F.col("_n") / size))
    placed = placed.withColumn("strip", F.floor((F.col("pos") - 1) * F.col("_strips") / F.col("_n")))
    # a strip holds about the root of a key's points
    strip = Window.partitionBy(*keys, "strip")
    held, nth = F.count(F.lit(1)).over(strip), F.row_number().over(strip.orderBy("y", "x"))
    piece = F.floor((nth - 1) * F.ceil(held / per_cell) / held)
    return placed.select(*keys, "x", "y", "w", "strip", piece.alias("piece"))


def _distances(qx, qy, px, py, euclid: bool) -> np.ndarray:
    dx, dy = np.abs(qx[:, None] - px), np.abs(qy[:, None] - py)
    return np.sqrt(dx * dx + dy * dy) if euclid else np.maximum(dx, dy)


def _least(d: np.ndarray, w: np.ndarray, k: int) -> list[list[float]]:
    """Per row of ``d`` its k least distances, each as often as its point's weight says; infinite where there are fewer."""
    order = np.argsort(d, axis=1, kind="stable")
    sorted_, upto = np.take_along_axis(d, order, 1), np.cumsum(np.take_along_axis(w, order, 1), 1)
    out = np.full((len(d), k), np.inf)
    for j in range(k):
        has = upto[:, -1] > j
        out[has, j] = sorted_[has, (upto[has] > j).argmax(1)]
    return out.tolist()


def _own(k: int, euclid: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy() for c in ("x", "y", "w"))
        weights = np.tile(w, (len(w), 1))
        weights[np.arange(len(w)), np.arange(len(w))] -= 1  # a point is no neighbour of itself, its copies are
        return pdf.assign(near=_least(_distances(x, y, x, y, euclid), weights, k))

    return run


def _visiting(k: int, euclid: bool, names: list[str]):
    def run(points: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(visits):
            return pd.DataFrame(columns=names)
        near = []
        px, py, w = (points[c].to_numpy() for c in ("x", "y", "w"))
        for at in range(0, len(visits), 4096):
            part = visits.iloc[at: at + 4096]
            d = _distances(part["x"].to_numpy(), part["y"].to_numpy(), px, py, euclid)
            near += _least(d, np.broadcast_to(w, d.shape), k)
        return visits.assign(near=near)[names]

    return run


def _below(edges: str, value: Column, *, equal: bool) -> Column:
    """How many of the ascending ``edges`` lie below (or at) ``value``, by two short searches."""
    stride = F.greatest(F.ceil(F.sqrt(F.size(edges))).cast("int"), F.lit(1))
    low = lambda e: (e <= value) if equal else (e < value)
    steps = F.sequence(stride, F.greatest(F.size(edges), stride), stride)
    coarse = F.size(F.filter(steps, lambda i: F.coalesce(low(F.get(edges, i - 1)), F.lit(False)))) * stride
    return coarse + F.size(F.filter(F.slice(edges, coarse + 1, stride), low))


def nearest_distances(df: DataFrame, keys: Sequence[str], x: str, y: str | None = None, *, k: int = 3, euclid: bool = False, per_cell: int = PER_CELL) -> DataFrame:
    """Per distinct point of a key: ``x, y, w`` (copies) and ``near``, its k least distances to other rows, ascending.

    Distances are the larger of the two differences, or Euclidean; without ``y`` there is one dimension and ``y`` is 0.
    Copies are neighbours at distance 0; with fewer than k other rows the rest is infinite. Null and NaN take no part.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = list(keys)
    points = _cells(df, keys, x, y, max(per_cell, 2 * k)).checkpoint()
    shape = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in points.columns) + ", near array<double>"
    own = points.groupBy(*keys, "strip", "piece").applyInPandas(_own(k, euclid), shape).checkpoint()

    box = points.groupBy(*keys, "strip", "piece").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"))
    in_strip = box.groupBy(*keys, "strip").agg(F.min("x_lo").alias("x_lo"), F.max("x_hi").alias("x_hi"), *_ends("piece", "piece", "lo", "hi"))
    strips = in_strip.groupBy(*keys).agg(*_ends("strip", "strip", "x_lo", "x_hi"))

    reach = F.element_at("near", k)
    asks = own.select(*keys, "x", "y", F.col("strip").alias("s0"), F.col("piece").alias("p0"), reach.alias("r"))
    asks = asks.join(strips, keys) if keys else asks.crossJoin(F.broadcast(strips))  # one row
    # a distance and a box edge are rounded alike, so edges just out of reach are let in
    slack = F.abs("x") * 1e-12 + F.abs("y") * 1e-12 + F.col("r") * 1e-12
    asks = asks.withColumn("far", F.col("r") + slack)
    between = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    first, last = _below("strip_hi", F.col("x") - F.col("far"), equal=False), _below("strip_lo", F.col("x") + F.col("far"), equal=True) - 1
    asks = asks.select(*keys, "x", "y", "s0", "p0", "far", F.explode(between(first.cast("long"), last.cast("long"))).alias("strip"))
    asks = asks.join(in_strip.select(*keys, "strip", "piece_lo", "piece_hi"), [*keys, "strip"])
    first, last = _below("piece_hi", F.col("y") - F.col("far"), equal=False), _below("piece_lo", F.col("y") + F.col("far"), equal=True) - 1
    asks = asks.select(*keys, "x", "y", "s0", "p0", "strip", F.explode(between(first.cast("long"), last.cast("long"))).alias("piece"))
    asks = asks.filter((F.col("strip") != F.col("s0")) | (F.col("piece") != F.col("p0"))).drop("s0", "p0")

    names = [*keys, "x", "y", "near"]
    found = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in names)
    cell = [*keys, "strip", "piece"]
    visited = points.groupBy(*cell).cogroup(asks.groupBy(*cell)).applyInPandas(_visiting(k, euclid, names), found)
    every = own.select(*names, "w").unionByName(visited, allowMissingColumns=True)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    return every.groupBy(*keys, "x", "y").agg(F.max("w").alias("w"), best.alias("near"))


def _ends(name: str, order: str, lo: str, hi: str) -> list[Column]:
    """The ascending lower and upper ends of a row of boxes."""
    rows = F.sort_array(F.collect_list(F.struct(order, lo, hi)))
    return [F.transform(rows, lambda s: s[lo]).alias(f"{name}_lo"), F.transform(rows, lambda s: s[hi]).alias(f"{name}_hi")]


# ---- mutual information

def first_beyond(v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The smallest number t with t - v >= r as doubles subtract; for r = 0 the next number after v."""
    def order(a):
        b = a.view(np.int64)
        return np.where(b < 0, np.int64(-(2**63)) - b, b)

    def number(o):
        return np.where(o < 0, np.int64(-(2**63)) - o, o).view(np.float64)

    high = order(np.nextafter(v + 2 * r, np.inf))
    low = order(np.array(v))
    while (low < high - 1).any():
        # the mean without the difference, which may pass 64 bits
        middle = (low >> 1) + (high >> 1) + (low & high & 1)
        gap = number(middle) - v
        out = np.where(r > 0, gap >= r, gap > 0)
        high, low = np.where(out, middle, high), np.where(out, low, middle)
    return number(high)


@pandas_udf(T.DoubleType())
def _upper(v: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series(first_beyond(v.to_numpy(float) + 0.0, r.to_numpy(float)))


@pandas_udf(T.DoubleType())
def _lower(v: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series(-first_beyond(0.0 - v.to_numpy(float), r.to_numpy(float)))


def _within(points: DataFrame, keys: Sequence[str], axis: str) -> DataFrame:
    """Per point (x, y, r): other rows whose ``axis`` differs by less than r, or, for r = 0, by nothing.

    Rows and the two ends of each point's stretch stand in one order along the axis; running counts over value chunks
    give how many rows lie below each end.
    """
    v = F.col(axis)
    data = points.groupBy(*keys, v.alias("v")).agg(F.sum("w").alias("c")).select(*keys, "v", F.lit(1).alias("kind"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "c")
    end = lambda e, kind: points.select(*keys, e.alias("v"), F.lit(kind).alias("kind"), "x", "y", F.lit(0).cast("long").alias("c"))
    line = data.unionByName(end(_upper(v, F.col("r")), 0)).unionByName(end(_lower(v, F.col("r")), 2))
    chunked = with_value_chunk(line, keys, "v")
    counted = running(chunked, Timeline(tuple(keys), ("v", "kind", "x", "y"), F.col("_bin")), {"upto": ("sum", F.col("c"))})
    return counted.filter("kind != 1").groupBy(*keys, "x", "y").agg((F.max(F.when(F.col("kind") == 0, F.col("upto"))) - F.max(F.when(F.col("kind") == 2, F.col("upto"))) - 1).alias(f"n{axis}"))


def digamma_of_count(n: Column) -> Column:
    """Digamma of a whole number from 1: a sum of reciprocals up to 15, then its asymptotic series."""
    sums, total = [], -0.57721566490153286061
    for m in range(1, 16):
        sums.append(total)
        total += 1 / m
    m = n.cast("double")
    q = 1 / (m * m)
    series = F.log(m) - 1 / (2 * m) - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240)))
    return F.when(n < 16, F.element_at(F.array(*[F.lit(s) for s in sums]), F.least(n, F.lit(15)).cast("int"))).otherwise(series)


def neighbour_information(df: DataFrame, keys: Sequence[str], x: str, y: str, *, k: int = 3, per_cell: int = PER_CELL) -> DataFrame:
    """Mutual information (nats) of two numeric columns from nearest-neighbour distances, per key: ``n, mutual_information``.

    Columns are divided by their deviation; a row's radius is its k-th distance (the larger of the two differences);
    rows strictly nearer on each axis are counted, and rows equal on it where the radius is 0. No noise is added to
    part ties; differences within a billionth of the radius count as equal to it. Rows with a null or NaN in either column are left out; k rows or fewer give no value; never below 0.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = list(keys)
    rows = df.select(*keys, known(F.col(x).cast("double")).alias("x"), known(F.col(y).cast("double")).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    if not keys:
        return neighbour_information(rows.withColumn("_all", F.lit(0)), ["_all"], "x", "y", k=k, per_cell=per_cell).drop("_all")
    # one row per key, kept: worked out again, a deviation may differ in its last bit
    scale = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy")).checkpoint()
    over = lambda c, s: F.when(F.col(s) > 0, F.col(c) / F.col(s)).otherwise(F.col(c))
    scaled = rows.join(scale.filter(F.col("n") > k), keys).select(*keys, over("x", "_sx").alias("x"), over("y", "_sy").alias("y"))
    points = nearest_distances(scaled, keys, "x", "y", k=k, per_cell=per_cell).select(*keys, "x", "y", "w", (F.element_at("near", k) * (1 - SAME)).alias("r")).checkpoint()
    both = points.join(_within(points, keys, "x"), [*keys, "x", "y"]).join(_within(points, keys, "y"), [*keys, "x", "y"])
    mean = F.sum(F.col("w") * (digamma_of_count(F.col("nx") + 1) + digamma_of_count(F.col("ny") + 1))) / F.sum("w")
    out = scale.join(both.groupBy(*keys).agg(mean.alias("_m")), keys, "left")
    value = digamma_of_count(F.col("n")) + digamma_of_count(F.lit(k)) - F.col("_m")
    return out.select(*keys, "n", F.when(F.col("_m").isNotNull(), F.greatest(value, F.lit(0.0))).alias("mutual_information"))


def neighbour_scores(df: DataFrame, keys: Sequence[str], x: str, *, k: int = 5) -> DataFrame:
    """Per key and distinct x: mean distance to the nearest ``min(k, n - 1)`` rows of its key, itself counted as the first."""
    rows = df.withColumn("_v", known(F.col(x).cast("double"))).filter(F.col("_v").isNotNull())
    near = nearest_distances(rows, keys, "_v", k=max(k - 1, 1))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counted = F.least(F.lit(k).cast("long"), F.col("_n") - 1)
    taken = F.slice("near", F.lit(1), F.greatest(counted - 1, F.lit(0)).cast("int"))
    score = F.aggregate(taken, F.lit(0.0), lambda a, d: a + d) / counted
    return near.join(total, list(keys)).select(*keys, F.col("x").alias("_x"), score.alias("score"))
