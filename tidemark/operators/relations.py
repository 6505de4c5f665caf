"""Relations between two columns per group, in closed form from a handful of sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .modeling import bucket_of
from .stats import binned_mutual_information, quantile_bins, spearman

SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy")


def line_sums(x: Column, y: Column) -> dict[str, Column]:
    """The sums that a line fit needs."""
    vx, vy = x.cast("double"), y.cast("double")
    both = vx.isNotNull() & vy.isNotNull() & ~F.isnan(vx) & ~F.isnan(vy)
    terms = {"n": F.lit(1.0), "sx": vx, "sy": vy, "sxy": vx * vy, "sxx": vx * vx, "syy": vy * vy}
    return {name: F.sum(F.when(both, t)) for name, t in terms.items()}


def _line(s: dict[str, Column]) -> tuple[Column, Column]:
    slope = F.try_divide(s["n"] * s["sxy"] - s["sx"] * s["sy"], s["n"] * s["sxx"] - s["sx"] * s["sx"])
    return slope, (s["sy"] - slope * s["sx"]) / s["n"]


def _errors(s: dict[str, Column], slope: Column, intercept: Column) -> Column:
    """Squared errors of a given line over the rows behind the sums."""
    return (s["syy"] - 2 * intercept * s["sy"] - 2 * slope * s["sxy"] + s["n"] * intercept * intercept
            + 2 * intercept * slope * s["sx"] + slope * slope * s["sxx"])


def _r_squared(s: dict[str, Column]) -> Column:
    cov = s["n"] * s["sxy"] - s["sx"] * s["sy"]
    return F.try_divide(cov * cov, (s["n"] * s["sxx"] - s["sx"] * s["sx"]) * (s["n"] * s["syy"] - s["sy"] * s["sy"]))


def cross_validated_lines(df: DataFrame, groups: Sequence[str], x: str, y: str, ids: Sequence[str], *, folds: int = 3) -> DataFrame:
    """Mean R2 over folds inside each group: a line is fitted without a fold and judged on it.

    A fold's line comes from the group's sums less its own; rows are read once.
    """
    per = df.withColumn("_fold", bucket_of(ids, buckets=folds)).groupBy(*groups, "_fold").agg(*[c.alias(n) for n, c in line_sums(F.col(x), F.col(y)).items()])
    whole = per.groupBy(*groups).agg(*[F.sum(n).alias(f"t_{n}") for n in SUMS])
    both = per.join(whole, list(groups)) if groups else per.withColumn("_one", F.lit(1)).join(whole.withColumn("_one", F.lit(1)), "_one")
    train = {n: F.col(f"t_{n}") - F.col(n) for n in SUMS}
    test = {n: F.col(n) for n in SUMS}
    slope, intercept = _line(train)
    spread = test["syy"] - test["sy"] * test["sy"] / test["n"]
    return both.withColumn("_r2", 1 - F.try_divide(_errors(test, slope, intercept), spread)).groupBy(*groups).agg(F.count("_r2").alias("folds"), F.avg("_r2").alias("r2"))


def leave_one_out(df: DataFrame, keys: Sequence[str], ids: Sequence[str], x: str, y: str) -> DataFrame:
    """How much R2 of the group's line rises when a row is left out: the group's sums less the row's."""
    whole = df.groupBy(*keys).agg(*[c.alias(f"t_{n}") for n, c in line_sums(F.col(x), F.col(y)).items()])
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    own = {"n": F.lit(1.0), "sx": vx, "sy": vy, "sxy": vx * vy, "sxx": vx * vx, "syy": vy * vy}
    rows = df.filter(vx.isNotNull() & vy.isNotNull() & ~F.isnan(vx) & ~F.isnan(vy)).join(whole, list(keys))
    rise = _r_squared({n: F.col(f"t_{n}") - own[n] for n in SUMS}) - _r_squared({n: F.col(f"t_{n}") for n in SUMS})
    return rows.select(*keys, *ids, rise.alias("rise"))


def cluster_relations(df: DataFrame, cluster: str, x: str, y: str, ids: Sequence[str], *, bins: int = 4, folds: int = 3) -> DataFrame:
    """Per cluster: Pearson, Spearman, mutual information of quartile bins and cross-validated R2."""
    ranks = spearman(df, [cluster], x, y)
    binned = quantile_bins(quantile_bins(df, [cluster], x, bins, "_bx"), [cluster], y, bins, "_by")
    shared = binned_mutual_information(binned, [cluster], "_bx", "_by")
    folded = cross_validated_lines(df, [cluster], x, y, ids, folds=folds).drop("folds")
    return ranks.join(shared, cluster).join(folded, cluster)


def partial_correlation_given(df: DataFrame, keys: Sequence[str], x: str, y: str, given: Sequence[str]) -> DataFrame:
    """Correlation of x and y given several columns: all pair correlations in one aggregate, then one column at a time is taken out."""
    names = [x, y, *given]
    complete = df
    for c in names:
        complete = complete.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    pairs = {(a, b): F.corr(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    row = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"_r_{a}_{b}") for (a, b), c in pairs.items()])
    left, r = names, {frozenset(p): F.col(f"_r_{p[0]}_{p[1]}") for p in pairs}
    for out in given:
        left = [c for c in left if c != out]
        r = {frozenset((a, b)): F.try_divide(
            r[frozenset((a, b))] - r[frozenset((a, out))] * r[frozenset((b, out))],
            F.sqrt((1 - r[frozenset((a, out))] * r[frozenset((a, out))]) * (1 - r[frozenset((b, out))] * r[frozenset((b, out))])))
            for i, a in enumerate(left) for b in left[i + 1:]}
    return row.select(*keys, "n", r[frozenset((x, y))].alias("partial_r"))


def inverse_distance_membership(df: DataFrame, keys: Sequence[str], ids: Sequence[str], value: str, centres: Sequence[float], *, power: float = 2.0) -> DataFrame:
    """Membership of every row in every centre by inverse distance, one per row; a row at a centre belongs to it alone."""
    v = F.col(value).cast("double")
    gaps = F.array(*[F.abs(v - F.lit(float(c))) for c in centres])
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).withColumn("_g", gaps)
    hit = F.exists("_g", lambda g: g == 0)
    weights = F.transform("_g", lambda g: F.when(hit, F.when(g == 0, 1.0).otherwise(0.0)).otherwise(1 / F.pow(g, F.lit(power))))
    rows = rows.withColumn("_w", weights)
    total = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w)
    return rows.withColumn("_t", total).select(*keys, *ids, F.posexplode(F.transform("_w", lambda w: w / F.col("_t"))).alias("centre", "membership"))


def uniform_bins(df: DataFrame, value: str, k: int, name: str = "bin") -> DataFrame:
    """Bins 0..k-1 of equal width, closed on the left, the largest value in the last; NaN and null have none."""
    v = F.col(value).cast("double")
    seen = F.when(~F.isnan(v), v)
    ends = df.agg(F.min(seen).alias("_lo"), F.max(seen).alias("_hi")).withColumn("_one", F.lit(1))
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one")  # one row
    at = F.floor((seen - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / k))
    return rows.withColumn(name, F.when(F.col("_hi") == F.col("_lo"), F.when(seen.isNotNull(), 0)).otherwise(F.least(at, F.lit(k - 1))).cast("int")).drop("_lo", "_hi", "_one")
