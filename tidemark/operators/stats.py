"""Bins, group tests, correlations, thresholds and trims as grouped aggregates.

Statistics are sums over groups; ordering a whole column goes through value
chunks (see ``quantiles``), never through one global window.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.values import known
from .quantiles import exact_quantiles, join_per_key, value_ranks, with_value_chunk
from .timeline import Timeline, running

MIN_GROUP = 5


# ---- bins

def quantile_edges(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Ascending distinct quantile edges per key."""
    probs = {f"_e{i}": i / k for i in range(k + 1)}
    q = exact_quantiles(df, keys, value, probs)
    return q.select(*keys, F.array_distinct(F.array(*probs)).alias("edges"))


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, k: int, name: str = "bin") -> DataFrame:
    """Right-closed quantile bins from 0 (smallest mean) up; repeated edges are dropped."""
    edges = quantile_edges(df, keys, value, k)
    v = F.col(value)
    below = F.size(F.filter("edges", lambda e: e < v))
    return join_per_key(df, edges, keys, "left").withColumn(name, F.when(v.isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("edges")


def fallback_bin_count(n: int) -> int:
    """Number of bins by the size rule."""
    return max(2, min(int((n / 2) ** 0.5), 4))


def bin_statistics(df: DataFrame, keys: Sequence[str], bin_: str, value: str) -> DataFrame:
    """Count, percent, extremes, mean, median and deviation per bin."""
    by = [*keys, bin_]
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    medians = exact_quantiles(df, by, value, {"median": 0.5})
    share = F.col("n") * 100 / F.sum("n").over(Window.partitionBy(*keys))
    # one row per bin
    return stats.withColumn("percent", share).join(medians, by)


# fixed values: upper percentile of each location word
LOCATIONS = [("Very Low", 15), ("Low", 35), ("Medium", 65), ("High", 85)]


def bin_names(stats: DataFrame, keys: Sequence[str], bin_: str, label: str) -> DataFrame:
    """Readable bin names: location by the percentile of the bin's minimum, and its range."""
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 100 / F.sum("n").over(Window.partitionBy(*keys))
    place = F.lit("Very High")
    for word, limit in reversed(LOCATIONS):
        place = F.when(below < limit, word).otherwise(place)
    return stats.withColumn("name", F.format_string("%s %s: %.2f-%.2f", place, F.lit(label), "min", "max"))


def soft_quantile_membership(df: DataFrame, keys: Sequence[str], ids: Sequence[str], value: str, k: int, bandwidth: float = 0.1) -> DataFrame:
    """Gaussian membership of every row in every quantile bin, normalised per row."""
    edges = quantile_edges(df, keys, value, k)
    v = F.col(value)
    centres = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: (F.element_at("edges", i) + F.element_at("edges", i + 1)) / 2)
    width = bandwidth * (F.element_at("edges", -1) - F.element_at("edges", 1))
    joined = df.join(edges, list(keys)).withColumns({"_c": centres, "_b": width})
    weights = F.transform("_c", lambda c: F.exp(-((v - c) * (v - c)) / (2 * F.col("_b") * F.col("_b"))))
    total = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w)
    rows = joined.withColumn("_w", weights).withColumn("_t", total)
    return rows.select(*keys, *ids, value, F.posexplode(F.transform("_w", lambda w: F.when(F.col("_t") > 0, w / F.col("_t")).otherwise(w))).alias("bin", "membership"))


def weighted_bin_statistics(members: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Weight, weighted mean and deviation per soft bin."""
    w, v = F.col("membership"), F.col(value)
    sums = members.groupBy(*keys, "bin").agg(F.sum(w).alias("weight"), F.sum(w * v).alias("_s"), F.sum(w * v * v).alias("_q"))
    mean = F.try_divide(F.col("_s"), F.col("weight"))
    return sums.select(*keys, "bin", "weight", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(F.col("_q"), F.col("weight")) - mean * mean, F.lit(0.0))).alias("std"))


# ---- group tests

def anova(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """One-way F test per key over groups of at least five values; fewer than two such groups give no F."""
    return _anova(df.groupBy(*keys, group).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v")), keys)


def _anova(per: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``anova`` from a row per group: its values ``_n``, their mean ``_m`` and population variance ``_v``."""
    big = F.col("_n") >= MIN_GROUP
    n, m = F.col("_n"), F.col("_m")
    total = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups_seen"), F.count_if(big).alias("groups"), F.sum(F.when(big, n)).alias("n"), F.sum(F.when(big, n * m)).alias("_s"),
        F.sum(F.when(big, n * m * m)).alias("_q"), F.sum(F.when(big, n * F.col("_v"))).alias("_within"))
    between = F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.when((F.col("groups") >= 2) & (d2 > 0), F.try_divide(between / d1, F.col("_within") / d2))
    return total.select(*keys, "groups_seen", "groups", "n", d1.alias("df1"), d2.alias("df2"), f.alias("f"),
                        F.try_divide(between, between + F.col("_within")).alias("eta_squared"))


def welch(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Welch's t and its degrees of freedom for keys with exactly two groups of at least five values."""
    return _welch(df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")), keys, group)


def _welch(per: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """``welch`` from a row per group: its values ``n``, their mean ``m`` and sample variance ``v``."""
    two = per.filter(F.col("n") >= MIN_GROUP).groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.min(F.struct(group, "n", "m", "v")).alias("a"), F.max(F.struct(group, "n", "m", "v")).alias("b")).filter("_k = 2")
    a, b = F.col("a.v") / F.col("a.n"), F.col("b.v") / F.col("b.n")
    t = F.try_divide(F.col("a.m") - F.col("b.m"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col("a.n") - 1) + b * b / (F.col("b.n") - 1))
    return two.select(*keys, t.alias("t"), dof.alias("dof"))


def group_test(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Welch for two groups, F for more: statistic, degrees of freedom and p."""
    return _group_test(anova(df, keys, group, value), welch(df, keys, group, value), keys)


def _group_test(f: DataFrame, t: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = f.join(t, list(keys), "left")
    two = F.col("groups") == 2
    return joined.select(
        *keys, "groups", F.when(two, "welch").when(F.col("groups") > 2, "anova").alias("test"), F.when(two, F.col("t")).otherwise(F.col("f")).alias("statistic"),
        F.when(two, sp.t_two_sided(F.coalesce("t", F.lit(0.0)), F.coalesce("dof", F.lit(1.0)))).when(
            F.col("groups") > 2, sp.f_tail(F.coalesce("f", F.lit(0.0)), F.col("df1").cast("double"), F.col("df2").cast("double"))).alias("p"))


# ---- correlations

def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman per key: equal pairs are counted first, ranks average ties; NaN counts as missing.

    All else follows from these counts, so ``df`` is read once. Values and ranks are centred before they meet the pairs.
    """
    df = df.withColumns({c: known(F.col(c).cast("double")) for c in (x, y)})
    # what the joins below imply is asked here, so that all readers of the counts have one plan and share its shuffle
    present = reduce(operator.and_, [F.col(c).isNotNull() for c in (*keys, x, y)])
    ranked = cells = df.filter(present).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_w"))
    for c, away in ((x, "x"), (y, "y")):
        ranks = value_ranks(cells.select(*keys, c, "_w"), keys, c, copies="_w").select(*keys, c, "n", "rank_avg")
        n = F.col("n")
        means = ranks.groupBy(*keys).agg((F.sum(n * F.col(c)) / F.sum(n)).alias("_m"), ((F.sum(n) + 1) / 2).alias("_mr"))
        centred = join_per_key(ranks, means, keys).select(*keys, c, (F.col(c) - F.col("_m")).alias(f"_d{away}"), (F.col("rank_avg") - F.col("_mr")).alias(f"_r{away}"))
        ranked = ranked.join(centred, [*keys, c])
    w = F.col("_w")
    dx, dy, drx, dry = (F.col(c) for c in ("_dx", "_dy", "_rx", "_ry"))
    products = {"_xy": dx * dy, "_xx": dx * dx, "_yy": dy * dy, "_rxy": drx * dry, "_rxx": drx * drx, "_ryy": dry * dry}
    sums = ranked.groupBy(*keys).agg(F.sum(w).alias("n"), *[F.sum(w * p).alias(name) for name, p in products.items()])

    def corr(ab: str, aa: str, bb: str) -> Column:
        return F.try_divide(F.col(ab), F.sqrt(F.col(aa) * F.col(bb)))

    return sums.select(*keys, "n", corr("_xy", "_xx", "_yy").alias("pearson"), corr("_rxy", "_rxx", "_ryy").alias("spearman"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation through t with n - 2 degrees of freedom."""
    t = F.coalesce(F.try_divide(F.abs(r) * F.sqrt(n - 2), F.sqrt(1 - r * r)), F.lit(1e9))
    return F.when(r.isNotNull() & (n > 2), sp.t_two_sided(t.cast("double"), F.greatest(n - 2, F.lit(1)).cast("double")))


def binned_mutual_information(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Mutual information (nats) of two binned columns from their contingency table."""
    cells = df.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    t = F.sum("_n").over(Window.partitionBy(*keys))
    a = F.sum("_n").over(Window.partitionBy(*keys, x))
    b = F.sum("_n").over(Window.partitionBy(*keys, y))
    # one row per cell of the table
    return cells.withColumn("_i", n / t * F.log(n * t / (a * b))).groupBy(*keys).agg(F.sum("_i").alias("mutual_information"))


def _pair_table(p, found: dict, bins: int) -> DataFrame:
    """Pearson, Spearman and the group test of all pairs from their ranks; quantiles of x are the edges of its bins."""
    from ..functions.local import local_table
    from .pairranks import bin_sums

    spark, by = p.pairs.sparkSession, p.by
    kinds = ", ".join(f"{c} {dict(bigint='long').get(kind, kind)}" for c, kind in ((c, p.pairs.schema[c].dataType.simpleString()) for c in by))
    edges = {key: np.unique(r.quantiles) for key, r in found.items()}
    per = [(*key, at, n, mean, squares / n, squares / (n - 1) if n > 1 else None) for key, rows in bin_sums(p, edges).items() for at, n, mean, squares in rows]
    groups = local_table(spark, per, f"{kinds}, bin int, n long, m double, v double, u double")
    tests = _group_test(_anova(groups.select(*by, F.col("n").alias("_n"), F.col("m").alias("_m"), F.col("v").alias("_v")), by), _welch(groups.select(*by, "bin", "n", "m", F.col("u").alias("v")), by, "bin"), by)
    whole = [(*key, int(r.groups[0][0][0]), r.pearson, r.groups[0][1][0]) for key, r in found.items()]
    corr = local_table(spark, whole, f"{kinds}, n long, pearson double, spearman double").withColumn("spearman_p", correlation_p(F.col("spearman"), F.col("n")))
    return corr.join(tests.select(*by, "test", F.col("statistic").alias("bin_statistic"), F.col("p").alias("bin_p")), by, "left")


def pair_statistics(pairs: DataFrame, bins: int = 4) -> DataFrame:
    """Every column pair at once: Pearson, Spearman and the group test over quantile bins of x.

    ``pairs`` is long: ``x``, ``y``, ``vx``, ``vy``; a pair's rows are those that have both values. They are packed once
    and all else is read from the packed points (see ``pairranks``).
    """
    from .pairranks import pair_points, ranked, whole

    with pair_points(pairs, ["x", "y"], "vx", "vy") as p:
        return _pair_table(p, ranked(p, [(whole, 1)], [i / bins for i in range(bins + 1)]), bins)


def pair_analysis(pairs: DataFrame, bins: int = 4, *, clusters: int = 3, at_least: int = 10) -> DataFrame:
    """``pair_statistics``, the best Spearman inside the pair's two-dimensional clusters, and the best p of all; sorted by it.

    Clusters of under five rows don't count; pairs with too few rows say so.
    """
    from .pairclusters import FEW_VALUES, best_cluster_p, clusters_of, pair_centres, rank_table
    from .pairranks import pair_points, ranked, whole

    by = ["x", "y"]
    with pair_points(pairs, by, "vx", "vy", few=FEW_VALUES) as p:
        centres = pair_centres(p, clusters, few=FEW_VALUES)
        found = ranked(p, [(whole, 1), clusters_of(centres, clusters)], [i / bins for i in range(bins + 1)])
        inside = best_cluster_p(rank_table(p, centres, found, 1), by)
        out = _pair_table(p, found, bins).join(inside, by, "left").na.fill(0, ["clusters"])
    few = F.col("n") < at_least
    best = F.when(~few, F.least("spearman_p", "bin_p", "cluster_p"))
    return out.withColumns({"best_p": best, "error": F.when(few, F.format_string("only %d shared rows", "n"))}).orderBy(F.col("best_p").asc_nulls_last(), *by)


def partial_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Correlation of x and y given z, Fisher z statistic and p; no complete rows give p = 1."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    c = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    r = F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))))
    zed = F.sqrt(F.col("n") - 4) * F.abs(0.5 * F.log((1 + r) / (1 - r)))
    out = c.select(*keys, "n", r.alias("partial_r"), zed.alias("z"))
    return out.withColumn("p", F.when(F.col("n") == 0, 1.0).otherwise(sp.normal_two_sided(F.coalesce("z", F.lit(0.0)))))


def conditional_independence(df: DataFrame, keys: Sequence[str], x: str, y: str, given_bin: str, *, alpha: float = 0.05, more_than: int = 5) -> DataFrame:
    """Direct and within-bin Spearman per key, bins combined by Fisher's method, and whether the condition mediates."""
    direct = spearman(df, keys, x, y).select(*keys, F.col("spearman").alias("direct_r"), correlation_p(F.col("spearman"), F.col("n")).alias("direct_p"))
    within = spearman(df, [*keys, given_bin], x, y).filter(F.col("n") > more_than)
    within = within.withColumn("_p", F.greatest(correlation_p(F.col("spearman"), F.col("n")), F.lit(1e-300)))
    joint = within.groupBy(*keys).agg(F.count("_p").alias("bins_used"), (-2 * F.sum(F.log("_p"))).alias("chi_square"))
    combined = F.coalesce(sp.chi2_even_tail(F.col("chi_square"), F.col("bins_used")), F.lit(1.0))
    out = direct.join(joint, list(keys), "left") if keys else direct.join(joint)
    independent = F.col("conditional_p") > alpha
    return out.withColumn("conditional_p", combined).withColumns({"independent": independent, "mediator": independent & (F.col("direct_p") < alpha)})


# ---- thresholds, trims and fits along one ordered column

def _ordered_sums(df: DataFrame, keys: Sequence[str], x: str, y: str, *, reverse: bool) -> DataFrame:
    """Per distinct x the running sums of 1, x, y, xy, xx, yy up to (or, reversed, from) it."""
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    per = df.filter(vx.isNotNull() & vy.isNotNull()).groupBy(*keys, x).agg(
        F.count(F.lit(1)).alias("n"), F.sum(vx).alias("sx"), F.sum(vy).alias("sy"), F.sum(vx * vy).alias("sxy"), F.sum(vx * vx).alias("sxx"), F.sum(vy * vy).alias("syy"))
    line = Timeline(tuple(keys), (x,), F.col("_bin"))
    names = ("n", "sx", "sy", "sxy", "sxx", "syy")
    return running(with_value_chunk(per, keys, x), line, {f"r_{c}": ("sum", F.col(c)) for c in names}, reverse=reverse).drop("_bin")


def _r_squared(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    cov = n * sxy - sx * sy
    return F.try_divide(cov * cov, (n * sxx - sx * sx) * (n * syy - sy * sy))


def best_split(df: DataFrame, keys: Sequence[str], x: str, y: str, *, each_side: int = 5) -> DataFrame:
    """The threshold on x (one of its values) whose rows at or above it are fitted best by a line."""
    sums = _ordered_sums(df, keys, x, y, reverse=True)
    total = sums.groupBy(*keys).agg(F.max("r_n").alias("_n"))
    r2 = _r_squared(*[F.col(f"r_{c}") for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    tried = sums.join(total, list(keys)).withColumn("r2", r2).filter((F.col("r_n") >= each_side) & (F.col("_n") - F.col("r_n") >= each_side) & F.col("r2").isNotNull())
    best = F.max_by(F.struct(F.col(x).alias("threshold"), F.col("r_n").alias("points_after"), "r2"), F.struct(F.round("r2", 12), -F.col(x)))
    return tried.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def binary_segmentation(df: DataFrame, x: str, y: str, order: str, *, breaks: int = 3, min_size: int = 10) -> DataFrame:
    """Repeatedly split the sequence (sorted by x) where the squared error drops most.

    Prefix sums are computed once over value chunks and written out; each round
    is one aggregate over them with the few known segments as constants.
    """
    from ..functions.local import local_table
    from ..session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = with_value_chunk(df.select(x, y, order).filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_one", F.lit(0)), ["_one"], x)
    line = Timeline(("_one",), (x, order), F.col("_bin"))
    v = F.col(y).cast("double")
    prefix = running(rows, line, {"pos": ("sum", F.lit(1).cast("long")), "s": ("sum", v), "q": ("sum", v * v)}).select(x, "pos", "s", "q").checkpoint()
    whole = prefix.agg(F.max("pos").alias("n"), F.max_by("s", "pos").alias("s"), F.max_by("q", "pos").alias("q")).first()
    # a segment is (position, sum, squares) before it and at its end
    segments = [((0, 0.0, 0.0), (whole["n"], whole["s"], whole["q"]))]
    found = []

    def sse(a, b):
        n = b[0] - a[0]
        return (b[2] - a[2]) - (b[1] - a[1]) ** 2 / n if n else 0.0

    tried: dict = {}
    for _ in range(breaks):
        for a, b in segments:
            if (a, b) in tried or b[0] - a[0] < 2 * min_size:
                continue
            nl, nr = F.col("pos") - a[0], b[0] - F.col("pos")
            left = (F.col("q") - a[2]) - (F.col("s") - a[1]) * (F.col("s") - a[1]) / nl
            right = (b[2] - F.col("q")) - (b[1] - F.col("s")) * (b[1] - F.col("s")) / nr
            gain = F.lit(sse(a, b)) - left - right
            cut = prefix.filter((nl >= min_size) & (nr >= min_size)).agg(F.max_by(F.struct("pos", "s", "q", gain.alias("gain")), F.struct(F.round(gain, 6), -F.col("pos"))).alias("c")).first()["c"]
            tried[(a, b)] = cut
        options = [(tried[s]["gain"], s) for s in segments if tried.get(s) is not None]
        if not options:
            break
        gain, seg = max(options)
        cut = tried[seg]
        mid = (cut["pos"], cut["s"], cut["q"])
        segments = sorted([s for s in segments if s != seg] + [(seg[0], mid), (mid, seg[1])])
        found.append(mid)
    edges = {r["pos"]: r[x] for r in prefix.filter(F.col("pos").isin([m[0] + 1 for m in found])).select("pos", x).collect()} if found else {}
    out = []
    for (a, b), (_, c) in zip(segments, segments[1:]):
        n1, n2 = b[0] - a[0], c[0] - b[0]
        m1, m2 = (b[1] - a[1]) / n1, (c[1] - b[1]) / n2
        pooled = ((sse(a, b) / n1 + sse(b, c) / n2) / 2) ** 0.5
        out.append((float(edges[b[0] + 1]), int(b[0]), min(1.0, abs(m1 - m2) / pooled) if pooled > 0 else 0.0))
    return local_table(spark, out, "threshold double, position long, confidence double")


def consensus_thresholds(proposals: DataFrame, value: str, *, grid: int = 1000, top: int = 3) -> DataFrame:
    """Peaks of a Gaussian kernel density over all proposed thresholds, highest first (bandwidth by Scott's rule)."""
    stats = proposals.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    h = stats["s"] * stats["n"] ** -0.2
    step = (stats["hi"] - stats["lo"]) / (grid - 1)
    # proposals fan out over a fixed grid: one row per grid point after the sum
    points = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.struct(i.alias("i"), (F.lit(stats["lo"]) + i * step).alias("x")))
    kernel = F.exp(-((F.col("x") - F.col(value)) * (F.col("x") - F.col(value))) / (2 * h * h))
    density = proposals.groupBy(value).agg(F.count(F.lit(1)).alias("_w")).select(value, "_w", F.inline(points)).groupBy("i", "x").agg(F.sum(F.col("_w") * kernel).alias("d"))
    w = Window.orderBy("i")
    peaks = density.withColumns({"_p": F.lag("d").over(w), "_n": F.lead("d").over(w)}).filter("d > _p AND d > _n")
    return peaks.orderBy(F.desc("d")).limit(top).select(F.col("x").alias("threshold"), F.col("d").alias("density"))


def numbered(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "pos") -> DataFrame:
    """1-based position in the order of (value, tie) per key, through value chunks."""
    chunked = with_value_chunk(df, keys, value)
    return running(chunked, Timeline(tuple(keys), (value, tie), F.col("_bin")), {name: ("sum", F.lit(1).cast("long"))}).drop("_bin")


def regional_errors(df: DataFrame, keys: Sequence[str], x: str, tie: str, actual: str, predicted: str, n: int) -> DataFrame:
    """RMSE and R2 in ``n`` equal-count segments along x; the last takes the remainder."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    size = F.floor(F.col("_t") / n)
    rows = numbered(df, keys, x, tie).join(total, list(keys)).withColumn("segment", F.least(F.floor((F.col("pos") - 1) / size), F.lit(n - 1)).cast("int"))
    e = F.col(actual) - F.col(predicted)
    return rows.groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("from_x"), F.max(x).alias("to_x"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(actual))).alias("r2"))


def trim_percentiles(df: DataFrame, columns: Sequence[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Rows strictly between the two percentiles on every column (one row of limits)."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    limits = {r["column"]: r for r in exact_quantiles(long, ["column"], "v", {"lo": low, "hi": high}).collect()}
    for c in columns:
        df = df.filter((F.col(c) > limits[c]["lo"]) & (F.col(c) < limits[c]["hi"]))
    return df


def trim_deviations(df: DataFrame, columns: Sequence[str], times: float = 3.0, flat: float = 1e-10) -> DataFrame:
    """Rows within ``times`` population deviations of the mean on every column that varies."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    for c in columns:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        if s is not None and s >= flat:
            df = df.filter(F.abs(F.col(c) - F.lit(m)) <= times * s)
    return df


LINE_SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy")


def _whole_lines(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(F.regr_slope(vy, vx).alias("_b"), F.regr_intercept(vy, vx).alias("_a"), F.count(F.lit(1)).alias("_t"),
                                 F.sum(vx).alias("t_sx"), F.sum(vy).alias("t_sy"), F.sum(vx * vy).alias("t_sxy"), F.sum(vx * vx).alias("t_sxx"), F.sum(vy * vy).alias("t_syy"))


def _best_prefix(scored: DataFrame, fit: DataFrame, keys: Sequence[str], x: str, y: str, tie: str, share: float) -> DataFrame:
    """The prefix in the order of ``_e`` (then ``tie``) whose removal leaves the best line: running sums give every refit in one pass."""
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    chunked = with_value_chunk(scored.select(*keys, x, y, tie, "_e"), keys, "_e")
    sums = running(chunked, Timeline(tuple(keys), ("_e", tie), F.col("_bin")), {
        "n": ("sum", F.lit(1).cast("long")), "sx": ("sum", vx), "sy": ("sum", vy), "sxy": ("sum", vx * vy), "sxx": ("sum", vx * vx), "syy": ("sum", vy * vy)})
    rest = join_per_key(sums, fit, keys).filter(F.col("n") <= F.floor(F.col("_t") * share))
    r2 = _r_squared((F.col("_t") - F.col("n")).cast("double"), *[F.col(f"t_{c}") - F.col(c) for c in LINE_SUMS[1:]])
    best = rest.withColumn("r2", r2).groupBy(*keys).agg(F.max_by(F.struct(F.col("n").alias("removed"), "r2"), F.struct(F.round("r2", 9), -F.col("n"))).alias("_best"))
    start = fit.withColumn("initial_r2", _r_squared(F.col("_t").cast("double"), *[F.col(f"t_{c}") for c in LINE_SUMS[1:]]))
    joined = start.join(best, list(keys), "left")
    better = F.coalesce(F.col("_best.r2") > F.col("initial_r2"), F.lit(False))
    return joined.select(*keys, "initial_r2", F.when(better, F.col("_best.removed")).otherwise(0).alias("removed"), F.when(better, F.col("_best.r2")).otherwise(F.col("initial_r2")).alias("best_r2"))


def improving_removals(df: DataFrame, keys: Sequence[str], x: str, y: str, tie: str, *, share: float = 0.10) -> DataFrame:
    """How many of the largest residuals to drop (up to ``share``) for the best line through the rest, ranked by the full fit."""
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    fit = _whole_lines(df, keys, x, y)
    scored = join_per_key(df, fit, keys).withColumn("_e", -F.abs(vy - F.col("_a") - F.col("_b") * vx))
    return _best_prefix(scored, fit, keys, x, y, tie, share)


def improving_removals_by_distance(df: DataFrame, keys: Sequence[str], x: str, y: str, tie: str, *, k: int = 5, share: float = 0.10) -> DataFrame:
    """How many of the rows that lie farthest from their neighbours on x to drop (up to ``share``) for the best line through the rest.

    A row's distance is the mean to the nearest ``min(k, n - 1)`` rows of its key, itself the first of them; ties go by
    ``tie``. Rows with a null or NaN in either column are left out.
    """
    from .neighbours import neighbour_scores

    rows = df.select(*keys, tie, *[known(F.col(c).cast("double")).alias(c) for c in (x, y)]).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    scores = neighbour_scores(rows, keys, x, k=k).withColumnRenamed("_x", x)
    fit = _whole_lines(rows, keys, x, y)
    # -0.0 and 0.0 are one x
    scored = rows.withColumn(x, F.col(x) + 0.0).join(scores, [*keys, x]).withColumn("_e", -F.col("score"))
    return _best_prefix(scored, fit, keys, x, y, tie, share)


def drop_low_contribution(df: DataFrame, x: str, y: str, *, times: float = 2.0) -> DataFrame:
    """Rows whose share of the fit's R2 is not below mean minus ``times`` deviations, with the refitted line."""
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.agg(F.regr_slope(vy, vx).alias("b"), F.regr_intercept(vy, vx).alias("a"), F.avg(vy).alias("m"), (F.var_pop(vy) * F.count(vy)).alias("sst")).first()
    part = 1 - (vy - (F.lit(fit["a"]) + F.lit(fit["b"]) * vx)) ** 2 / F.lit(fit["sst"])
    rows = df.withColumn("_r", part)
    s = rows.agg(F.avg("_r").alias("m"), F.stddev_samp("_r").alias("s")).first()
    return rows.filter(F.col("_r") >= s["m"] - times * s["s"]).agg(
        F.count(F.lit(1)).alias("kept"), F.regr_slope(vy, vx).alias("slope"), F.regr_intercept(vy, vx).alias("intercept"), F.regr_r2(vy, vx).alias("r2"))


# ---- clusters by label

def effect_sizes(df: DataFrame, keys: Sequence[str], cluster: str, value: str, *, meaningful: float = 0.3) -> DataFrame:
    """Pooled Cohen's d for every pair of clusters (cluster table joined to itself: clusters squared rows)."""
    per = df.groupBy(*keys, cluster).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count(value).alias("n"))
    a = per.select(*keys, F.col(cluster).alias("cluster1"), F.col("m").alias("m1"), F.col("v").alias("v1"), F.col("n").alias("n1"))
    b = per.select(*keys, F.col(cluster).alias("cluster2"), F.col("m").alias("m2"), F.col("v").alias("v2"), F.col("n").alias("n2"))
    pairs = (a.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), [*keys, "_k"])).filter("cluster1 < cluster2")
    pooled = F.when((F.col("n1") > 1) & (F.col("n2") > 1), F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))).otherwise(
        F.greatest(F.sqrt("v1"), F.sqrt("v2")))
    apart = F.abs(F.col("m1") - F.col("m2"))
    d = F.when(pooled > 0, apart / pooled).when(apart > 0, F.lit(float("inf"))).otherwise(0.0)
    return pairs.select(*keys, "cluster1", "cluster2", d.alias("effect_size")).withColumn("meaningful", F.col("effect_size") >= meaningful)


def merge_similar(df: DataFrame, cluster: str, value: str, *, below: float = 0.3) -> DataFrame:
    """Relabel clusters whose effect size is below the limit: each such pair, in order, folds the larger label into the smaller."""
    pairs = effect_sizes(df, [], cluster, value).filter(F.col("effect_size") < below).orderBy("cluster1", "cluster2").collect()
    label = {r[0]: r[0] for r in df.select(cluster).distinct().collect()}
    for r in pairs:
        keep, gone = sorted((label[r["cluster1"]], label[r["cluster2"]]))
        label = {k: keep if v == gone else v for k, v in label.items()}
    mapping = F.create_map(*[x for k, v in label.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("merged", mapping[F.col(cluster)])


def cluster_lines(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Line, R2 and correlation per cluster."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(x, y).alias("r"))


def normal_scores(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Normal quantile of ``rank / (n + 1)`` per distinct value."""
    ranks = value_ranks(df, keys, value)
    total = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    scored = ranks.join(total, list(keys)).withColumn(name, sp.normal_quantile(F.col("rank_avg") / (F.col("_n") + 1)))
    return scored.select(*keys, value, name)


def gaussian_copula(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of normal scores."""
    scored = df.join(normal_scores(df, keys, x, "_zx"), [*keys, x]).join(normal_scores(df, keys, y, "_zy"), [*keys, y])
    return scored.groupBy(*keys).agg(F.corr("_zx", "_zy").alias("rho"))


def target_against_all(df: DataFrame, target: str, columns: Sequence[str], *, at_least: int = 10) -> DataFrame:
    """Pearson of one target with every column on their shared rows, where there are enough."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), known(F.col(c).cast("double")).alias("v")) for c in columns])
    long = df.select(known(F.col(target).cast("double")).alias("t"), F.inline(cells)).filter("t IS NOT NULL AND v IS NOT NULL")
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.corr("v", "t").alias("r")).filter(F.col("n") >= at_least)
