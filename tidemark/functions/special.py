"""Tail probabilities for small result tables, from published series and continued fractions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    lg = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for numer in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numer * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numer / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    value = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.where(flip, 1 - value, value)


@pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F >= f)."""
    f, d1, d2 = (s.to_numpy(float) for s in (f, d1, d2))
    return pd.Series(beta_fraction(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


@pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|)."""
    t, df = t.to_numpy(float), df.to_numpy(float)
    return pd.Series(beta_fraction(df / 2, np.full_like(df, 0.5), df / (df + t * t)))


@pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) if v == v else None for v in z])


@pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    known = {v: inverse(v) for v in p.dropna().unique() if 0 < v < 1}
    return p.map(known)


def chi2_even_tail(x: Column, half_df: Column) -> Column:
    """P(chi2 >= x) for an even number of degrees of freedom: a finite sum."""
    y = x / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    done = F.aggregate(F.sequence(F.lit(1), half_df.cast("int")), start,
                       lambda a, k: F.struct((a["term"] * y / k).alias("term"), (a["sum"] + a["term"]).alias("sum")))
    return F.exp(-y) * done["sum"]
