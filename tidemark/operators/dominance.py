"""Statistics over all pairs of rows without forming them: Kendall's tau-b and distance correlation.

Both reduce to sums over pairs with ``x' < x`` and ``y' < y``.  The plane is cut
into value chunks along both axes.  Pairs in strictly lower chunks on both axes
come from prefix sums of a small grid; pairs that share an x chunk, and those
that share a y chunk only, are counted inside one chunk each.  A value frequent
enough to be a cut point is a chunk of its own, in which no pair can differ, so
a hot value is never gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import with_value_chunk
from .timeline import Timeline, running

SUMS = ["w", "wx", "wy", "wxy"]
BLOCK = 64


def dominated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per row the sums of ``w`` over rows strictly below it on both axes."""
    # equal x in falling y: then any earlier row with a smaller y also has a smaller x
    order = np.lexsort((-y, x))
    ys, ws = y[order], w[order]
    out = np.zeros_like(ws, dtype=float)
    n = len(ys)
    for i in range(0, n, BLOCK):
        b = slice(i, min(i + BLOCK, n))
        below = np.tril(ys[b][None, :] < ys[b][:, None], -1)
        out[b] += below @ ws[b]
    width = BLOCK
    while width < n:
        for i in range(0, n - width, 2 * width):
            left, right = slice(i, i + width), slice(i + width, min(i + 2 * width, n))
            rank = np.argsort(ys[left], kind="stable")
            totals = np.vstack([np.zeros(ws.shape[1]), np.cumsum(ws[left][rank], axis=0)])
            out[right] += totals[np.searchsorted(ys[left][rank], ys[right], side="left")]
        width *= 2
    result = np.empty_like(out)
    result[order] = out
    return result


def _products(rows: np.ndarray, below: np.ndarray) -> tuple[float, float]:
    w, wx, wy, wxy = rows.T
    n, sx, sy, sxy = below.T
    return float((w * n).sum()), float((wxy * n - wx * sy - wy * sx + w * sxy).sum())


def _chunked(cells: DataFrame, keys: Sequence[str], value: str, name: str, bins: int | None) -> DataFrame:
    """Even numbers for stretches between cut points, odd ones for the cut points themselves."""
    return with_value_chunk(cells, keys, value, bins, name, apart=True)


def _grid_products(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of grid cells of which one lies left of and below the other: sums over one axis, then over the other.

    A key's grid has at most as many cells as chunks on both axes; a window sees one row or column of it.
    """
    left = grid.select(*keys, "bx").distinct().join(grid.select(*keys, "by").distinct(), list(keys))
    full = left.join(grid, [*keys, "bx", "by"], "left").na.fill(0.0, SUMS)
    below = Window.partitionBy(*keys, "bx").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys, "by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    full = full.select("*", *[F.coalesce(F.sum(c).over(below), F.lit(0.0)).alias(f"_{c}") for c in SUMS])
    full = full.select("*", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0.0)).alias(f"d_{c}") for c in SUMS])
    product = F.col("wxy") * F.col("d_w") - F.col("wx") * F.col("d_wy") - F.col("wy") * F.col("d_wx") + F.col("w") * F.col("d_wxy")
    return full.groupBy(*keys).agg(F.sum(F.col("w") * F.col("d_w")).alias("concordant"), F.sum(product).alias("product"))


def pair_products(df: DataFrame, keys: Sequence[str], x: str, y: str, *, bins: int | None = None) -> DataFrame:
    """Per key: ``concordant`` pairs, and ``product``, the sum of (x - x')(y - y') over them."""
    keys = list(keys)
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    cells = df.filter(vx.isNotNull() & vy.isNotNull()).groupBy(*keys, vx.alias("x"), vy.alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    cells = cells.withColumns({"wx": F.col("w") * F.col("x"), "wy": F.col("w") * F.col("y"), "wxy": F.col("w") * F.col("x") * F.col("y")})
    placed = _chunked(_chunked(cells, keys, "x", "bx", bins), keys, "y", "by", bins)
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, concordant double, product double"

    def local(axis_x: str, axis_y: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            w = pdf[SUMS].to_numpy(float)
            c, p = _products(w, dominated(pdf[axis_x].to_numpy(float), pdf[axis_y].to_numpy(float), w))
            return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], c, p)], columns=[*keys, "concordant", "product"])
        return run

    # one column of the plane: any smaller y; one row of it: columns to the left; then the grid
    same_x = placed.filter("bx % 2 = 0").groupBy(*keys, "bx").applyInPandas(local("x", "y"), schema)
    same_y = placed.filter("by % 2 = 0").groupBy(*keys, "by").applyInPandas(local("bx", "y"), schema)
    grid = placed.groupBy(*keys, "bx", "by").agg(*[F.sum(c).alias(c) for c in SUMS])
    parts = same_x.unionByName(same_y).unionByName(_grid_products(grid, keys))
    return parts.groupBy(*keys).agg(F.sum("concordant").alias("concordant"), F.sum("product").alias("product"))


def _tied(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    counts = df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_t"))
    return counts.groupBy(*keys).agg(F.sum(F.col("_t") * (F.col("_t") - 1) / 2).alias(name))


def kendall(df: DataFrame, keys: Sequence[str], x: str, y: str, *, bins: int | None = None) -> DataFrame:
    """Kendall's tau-b per key, exact."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(_tied(rows, keys, [x], "_tx"), list(keys)).join(_tied(rows, keys, [y], "_ty"), list(keys)).join(_tied(rows, keys, [x, y], "_txy"), list(keys))
    out = out.join(pair_products(rows, keys, x, y, bins=bins), list(keys))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    score = 2 * F.col("concordant") - (pairs - F.col("_tx") - F.col("_ty") + F.col("_txy"))
    return out.select(*keys, "n", F.try_divide(score, F.sqrt((pairs - F.col("_tx")) * (pairs - F.col("_ty")))).alias("tau"))


def archimedean_parameters(taus: DataFrame) -> DataFrame:
    """Clayton and Gumbel copula parameters from tau."""
    t = F.col("tau")
    return taus.withColumns({"clayton": F.try_divide(2 * t, 1 - t), "gumbel": F.try_divide(F.lit(1.0), 1 - t)})


def _distance_sums(rows: DataFrame, keys: Sequence[str], value: str, name: str, bins: int | None) -> DataFrame:
    """Per distinct value the sum of distances to all rows of its key."""
    v = F.col(value).cast("double")
    per = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(v).alias("_s"))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum(v).alias("_all"))
    chunked = _chunked(per, keys, value, "_bin", bins)
    sums = running(chunked, Timeline(tuple(keys), (value,), F.col("_bin")), {"_cn": ("sum", F.col("_n")), "_cs": ("sum", F.col("_s"))}).drop("_bin").join(total, list(keys))
    return sums.select(*keys, value, (v * (2 * F.col("_cn") - F.col("_rows")) + F.col("_all") - 2 * F.col("_cs")).alias(name))


def distance_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, *, bins: int | None = None) -> DataFrame:
    """Distance correlation per key, exact: all double-centred sums in closed form."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = rows.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("_w"))
    with_a = cells.join(_distance_sums(rows, keys, "x", "_a", bins), [*keys, "x"]).join(_distance_sums(rows, keys, "y", "_b", bins), [*keys, "y"])
    w, a, b, vx, vy = (F.col(c) for c in ("_w", "_a", "_b", "x", "y"))

    def total(e: Column, name: str) -> Column:
        return F.sum(w * e).alias(name)

    sums = with_a.groupBy(*keys).agg(F.sum("_w").alias("n"), total(vx, "sx"), total(vy, "sy"), total(vx * vy, "sxy"), total(vx * vx, "sxx"), total(vy * vy, "syy"),
                                     total(a, "sa"), total(b, "sb"), total(a * b, "sab"), total(a * a, "saa"), total(b * b, "sbb"))
    joined = sums.join(pair_products(rows, keys, "x", "y", bins=bins), list(keys))
    n = F.col("n").cast("double")
    # sum over ordered pairs of |dx||dy|: twice (twice the concordant products minus all products)
    cross = 2 * (2 * F.col("product") - (n * F.col("sxy") - F.col("sx") * F.col("sy")))

    def centred(first: Column, p: str, q: str, pq: str) -> Column:
        return first / n**2 + F.col(p) * F.col(q) / n**4 - 2 * F.col(pq) / n**3

    cov = centred(cross, "sa", "sb", "sab")
    var_x = centred(2 * (n * F.col("sxx") - F.col("sx") * F.col("sx")), "sa", "sa", "saa")
    var_y = centred(2 * (n * F.col("syy") - F.col("sy") * F.col("sy")), "sb", "sb", "sbb")
    return joined.select(*keys, "n", F.sqrt(F.greatest(F.try_divide(cov, F.sqrt(var_x * var_y)), F.lit(0.0))).alias("distance_correlation"))
