"""Ward's clustering of two columns over a grid of mergeable sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.local import local_table
from ..functions.values import known


def _merged(n: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each of the weighted points after joining, again and again, the pair whose union adds least to the squares."""
    n, x, y = n.astype(float), x.astype(float), y.astype(float)
    owner, alive = np.arange(len(n)), np.ones(len(n), bool)

    def costs(i):
        c = n[i] * n / (n[i] + n) * ((x[i] - x) ** 2 + (y[i] - y) ** 2)
        c[~alive] = np.inf
        c[i] = np.inf
        return c

    cost = np.array([costs(i) for i in range(len(n))]).reshape(len(n), len(n))
    for _ in range(len(n) - k):
        i, j = sorted(divmod(int(cost.argmin()), len(n)))
        total = n[i] + n[j]
        x[i], y[i], n[i] = (n[i] * x[i] + n[j] * x[j]) / total, (n[i] * y[i] + n[j] * y[j]) / total, total
        owner[owner == j] = i
        alive[j] = False
        cost[j], cost[:, j] = np.inf, np.inf
        cost[i] = costs(i)
        cost[:, i] = cost[i]
    order = {c: r for r, c in enumerate(sorted(set(owner.tolist()), key=lambda c: (x[c], y[c])))}
    return np.array([order[c] for c in owner.tolist()], dtype=int)


def _nearness(centres: list[tuple[float, float]]):
    @pandas_udf(T.ArrayType(T.DoubleType()))
    def weigh(x: pd.Series, y: pd.Series) -> pd.Series:
        d = np.sqrt(sum((v.to_numpy(float)[:, None] - np.array([c[i] for c in centres])) ** 2 for i, v in enumerate((x, y))))
        e = np.exp(d.min(1, keepdims=True) - d)
        return pd.Series((e / e.sum(1, keepdims=True)).tolist())

    return weigh


def ward_clusters(df: DataFrame, x: str, y: str, k: int, *, side: int = 24) -> DataFrame:
    """Adds ``cluster``, numbered from 0 left to right by mean x, and ``nearness``, softmax of minus the distances to all centres.

    Rows are first summed in ``side`` x ``side`` cells of equal width over the range of each column, then the at most
    ``side`` squared means (all that reaches the driver) are merged by Ward's rule, raw columns as they are. A row
    stands for itself exactly where it is alone in its cell or equals its neighbours there; otherwise it lies within one
    cell's diagonal of the mean that stands for it, and rows of one cell are never parted. Fewer filled cells than ``k``
    give fewer clusters. Rows without a finite x and y have nulls.
    """
    vx, vy = (known(F.col(c).cast("double")) for c in (x, y))
    whole = vx.isNotNull() & vy.isNotNull() & (F.abs(vx) < float("inf")) & (F.abs(vy) < float("inf"))
    rows = df.withColumns({"_x": F.when(whole, vx), "_y": F.when(whole, vy)})
    low = rows.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if low[0] is None:
        return rows.drop("_x", "_y").withColumns({"cluster": F.lit(None).cast("int"), "nearness": F.lit(None).cast("array<double>")})

    def cell(value: str, lo: float, hi: float) -> Column:
        at = F.lit(0) if lo == hi else F.least(F.floor((F.col(value) - lo) * (side / (hi - lo))), F.lit(side - 1))
        return F.when(F.col(value).isNotNull(), at.cast("int"))

    rows = rows.withColumns({"_i": cell("_x", low[0], low[1]), "_j": cell("_y", low[2], low[3])})
    sums = rows.filter("_x IS NOT NULL").groupBy("_i", "_j").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_x") - low[0]).alias("x"), F.sum(F.col("_y") - low[2]).alias("y"))
    cells = sums.orderBy("_i", "_j").toPandas()
    n = cells["n"].to_numpy(float)
    labels = _merged(n, cells["x"].to_numpy() / n, cells["y"].to_numpy() / n, min(k, len(n)))
    centres = [(low[0] + cells["x"][labels == c].sum() / n[labels == c].sum(), low[2] + cells["y"][labels == c].sum() / n[labels == c].sum()) for c in range(labels.max() + 1)]
    known_cells = local_table(df.sparkSession, [(int(i), int(j), int(c)) for i, j, c in zip(cells["_i"], cells["_j"], labels)], "_i int, _j int, cluster int")
    out = rows.join(F.broadcast(known_cells), ["_i", "_j"], "left")
    near = F.when(F.col("cluster").isNotNull(), _nearness(centres)(F.coalesce("_x", F.lit(0.0)), F.coalesce("_y", F.lit(0.0))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "cluster", near.alias("nearness"))


def cluster_shapes(clusters: DataFrame, x: str, y: str) -> DataFrame:
    """Share, means and covariances of each cluster."""
    total = clusters.filter("cluster IS NOT NULL").agg(F.count(F.lit(1)).alias("_all"))
    out = clusters.filter("cluster IS NOT NULL").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.covar_samp(x, y).alias("cov"))
    return out.join(F.broadcast(total)).withColumn("weight", F.col("n") / F.col("_all")).drop("_all")
