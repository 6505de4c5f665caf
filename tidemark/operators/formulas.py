"""Least-squares formulas with flags, their products and gaps: all formulas from two aggregates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.local import local_table
from ..functions.special import t_two_sided
from ..functions.values import known


def with_products(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Adds the product of every two or more flags, named by them with ``_and_``; null where a flag is."""
    sets = [s for n in range(2, len(flags) + 1) for s in itertools.combinations(flags, n)]
    products = {"_and_".join(s): math.prod([F.col(f"`{c}`").cast("int") for c in s[1:]], start=F.col(f"`{s[0]}`").cast("int")) for s in sets}
    return df.withColumns(products)


def with_gap(df: DataFrame, a: str, b: str, name: str, *, where: Column | None = None) -> DataFrame:
    """Adds the distance between two columns, 0 where the condition doesn't hold."""
    gap = F.abs(F.col(a) - F.col(b))
    return df.withColumn(name, gap if where is None else F.when(where, gap).otherwise(F.lit(0.0)))


def _value(term: str) -> Column:
    """A term's value: a column or, with colons between columns, their product."""
    return known(math.prod([F.col(f"`{c}`").cast("double") for c in term.split(":")], start=F.lit(1.0)))


def linear_formulas(df: DataFrame, target: str, formulas: dict[str, Sequence[str]]) -> DataFrame:
    """One row per model and term, the intercept as ``1``: ``model, term, coefficient, std_error, p, n, r2, aic``.

    A term is a column or a product such as ``a:b``. A model takes the rows where its terms and the target are neither
    null nor NaN. Sums of products about the overall means, one aggregate for all models, give each fit; terms that depend
    on others share their effect with the least squares of coefficients. Without more rows than parameters, errors and
    p are null; a model without rows has no rows. Only sums, as many as the squares of the formulas' lengths, leave Spark.
    """
    terms = list(dict.fromkeys(t for f in formulas.values() for t in f))
    names = {t: f"t{i}" for i, t in enumerate(terms)}
    rows = df.select(known(F.col(f"`{target}`").cast("double")).alias("y"), *[_value(t).alias(names[t]) for t in terms])
    means = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in rows.columns]).first().asDict()
    sums = []
    for m, parts in enumerate(formulas.values()):
        held = [names[t] for t in parts] + ["y"]
        whole = math.prod([F.col(c).isNotNull().cast("int") for c in held], start=F.lit(1)) == 1
        moved = [F.lit(1.0)] + [F.col(c) - F.lit(means[c]) for c in held]
        sums += [F.sum(F.when(whole, a * b)).alias(f"s{m}_{i}_{j}") for i, a in enumerate(moved) for j, b in enumerate(moved) if j <= i]
    row = rows.agg(*sums).first()
    out = []
    for m, (model, parts) in enumerate(formulas.items()):
        size = len(parts) + 2
        if not row[f"s{m}_0_0"]:
            continue
        gram = np.array([[row[f"s{m}_{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)])
        n = int(gram[0, 0])
        # about the model's own means
        about = gram[1:, 1:] - np.outer(gram[1:, 0], gram[0, 1:]) / n
        scale = np.sqrt(np.maximum(np.diag(about)[:-1], 0.0))
        scale[scale == 0] = 1.0
        inverse = np.linalg.pinv(about[:-1, :-1] / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
        slopes = inverse @ about[:-1, -1]
        own = np.array([means[names[t]] for t in parts]) + gram[1:-1, 0] / n
        intercept = means["y"] + gram[-1, 0] / n - float(slopes @ own)
        rest = max(float(about[-1, -1] - slopes @ about[:-1, -1]), 0.0)
        rank = int(np.linalg.matrix_rank(about[:-1, :-1] / np.outer(scale, scale), tol=1e-10, hermitian=True)) if parts else 0
        free = n - rank - 1
        spread = rest / free if free > 0 else None
        errors = [None] * (len(parts) + 1) if spread is None else [math.sqrt(spread * max(v, 0.0)) for v in (1 / n + float(own @ inverse @ own), *np.diag(inverse))]
        r2 = 1 - rest / about[-1, -1] if about[-1, -1] > 0 else None
        aic = n * (math.log(2 * math.pi * rest / n) + 1) + 2 * (rank + 1) if rest > 0 else None
        for term, b, e in zip(("1", *parts), (intercept, *slopes), errors):
            out.append((model, term, float(b), e, None if not e else float(b) / e, float(free), n, None if r2 is None else float(r2), aic))
    table = local_table(df.sparkSession, out, "model string, term string, coefficient double, std_error double, t double, free double, n long, r2 double, aic double")
    p = F.when(F.col("t").isNotNull(), t_two_sided(F.coalesce("t", F.lit(0.0)), F.greatest("free", F.lit(1.0))))
    return table.select("model", "term", "coefficient", "std_error", p.alias("p"), "n", "r2", "aic")
