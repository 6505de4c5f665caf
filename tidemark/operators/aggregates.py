"""Grouped summaries: buckets, conditional percentiles, profiles, streaks, rolling statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import known
from .quantiles import exact_quantiles
from .timeline import exploded_range

# fixed values: stage groups that overlap the plain stages
STAGE_GROUPS = {"Sleep": ["N1", "N2", "N3", "R"], "NonDeepSleep": ["W", "N1", "N2", "R"]}


def bucket_start(at: Column, width: int, offset: int | Column = 0) -> Column:
    """Start of the bucket of ``width`` that holds ``at``, buckets beginning at ``offset``."""
    return (F.floor((at - offset) / width) * width + offset).cast("long")


def bucket_medians(df: DataFrame, keys: Sequence[str], at: str, value: str, width: int, *, offset: int = 0, keep_empty: bool = True) -> DataFrame:
    """Exact median per series and time bucket; ``keep_empty`` adds the buckets without a row, as null."""
    rows = df.withColumn("bucket", bucket_start(F.col(at), width, offset))
    medians = exact_quantiles(rows, [*keys, "bucket"], value, {"median": 0.5})
    if not keep_empty:
        return medians
    span = rows.groupBy(*keys).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    steps = exploded_range(span, F.lit(0), (F.col("_hi") - F.col("_lo")) / width, "_k")
    grid = steps.select(*keys, (F.col("_lo") + F.col("_k") * width).alias("bucket"))
    return grid.join(medians, [*keys, "bucket"], "left")


def any_nonzero(df: DataFrame, keys: Sequence[str], value: str, ignored: Sequence[float] = (1, 2)) -> DataFrame:
    """1 when a bucket's largest value outside ``ignored`` is non-zero; a zero largest value divides to null."""
    top = F.max(F.when(~F.col(value).isin(*ignored), F.col(value)))
    return df.groupBy(*keys).agg(F.ceil(F.try_divide(top, top)).cast("int").alias("active"))


def stage_percentiles(df: DataFrame, columns: Sequence[str], stage: str) -> DataFrame:
    """P10, P90, min and max of every column overall, per stage and per stage group.

    Rows go to each group they belong to before any aggregation; percentiles
    follow the index rule (see ``exact_quantiles``).
    """
    s = F.col(stage)
    groups = F.array_compact(F.array(F.lit("All"), s, *[F.when(s.isin(*members), F.lit(name)) for name, members in STAGE_GROUPS.items()]))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(groups).alias("grp"), cells.alias("_cells"))
    long = long.select("grp", F.inline("_cells")).filter(F.col("value").isNotNull())
    shares = exact_quantiles(long, ["column", "grp"], "value", {"p10": 0.1, "p90": 0.9}, method="index", nan_counts=True)
    ends = long.groupBy("column", "grp").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return shares.join(ends, ["column", "grp"])


def coverage(df: DataFrame, by: str, day: Column) -> DataFrame:
    """Distinct days, rows, first and last day per version or phase."""
    return df.groupBy(by).agg(F.count_distinct(day).alias("days"), F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def cross_tab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0, list(values))


def relative_profile(df: DataFrame, anchors: DataFrame, keys: Sequence[str], at: str, anchor: str, value: str, *, unit: int, step: int, reach: int,
                     nearest: bool = False) -> DataFrame:
    """Mean and spread of ``value`` by time since an anchor, in steps; bands at one and two standard deviations.

    ``nearest`` rounds half to even instead of flooring.
    """
    joined = df.join(anchors.select(*keys, anchor), list(keys))
    units = (F.col(at) - F.col(anchor)) / unit
    slot = F.bround(units / step) * step if nearest else F.floor(units / step) * step
    rows = joined.withColumn("_u", units).filter((F.col("_u") >= 0) & (F.col("_u") <= reach)).withColumn("offset", slot.cast("long"))
    out = rows.groupBy("offset").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n"))
    m, s = F.col("mean"), F.col("std")
    return out.withColumns({"low_1": m - s, "high_1": m + s, "low_2": m - 2 * s, "high_2": m + 2 * s})


def against_profile(df: DataFrame, profile: DataFrame, keys: Sequence[str], offset: str, value: str) -> DataFrame:
    """Rows above and below the profile mean per group."""
    joined = df.join(profile.select(F.col("offset").alias(offset), F.col("mean").alias("_mean")), offset)
    return joined.groupBy(*keys).agg(F.count_if(F.col(value) > F.col("_mean")).alias("above"), F.count_if(F.col(value) < F.col("_mean")).alias("below"))


def longest_streak(df: DataFrame, keys: Sequence[str], order: str, flag: Column, *, any_run: bool = False) -> DataFrame:
    """Longest run of true per key on a calendar-bounded table; ``any_run`` measures all runs once one true exists."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.select(*keys, order, F.coalesce(flag, F.lit(False)).alias("_on"))
    turned = marked.withColumn("_new", F.coalesce(F.col("_on") != F.lag("_on").over(w), F.lit(True)).cast("int"))
    runs = turned.withColumn("_run", F.sum("_new").over(w)).groupBy(*keys, "_run", "_on").agg(F.count(F.lit(1)).alias("_n"))
    measured = F.max("_n") if any_run else F.max(F.when(F.col("_on"), F.col("_n")))
    return runs.groupBy(*keys).agg(F.when(F.bool_or("_on"), measured).otherwise(0).alias("streak"))


def centred_rolling(df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 7, at_least: int = 3) -> DataFrame:
    """Rolling mean and sample deviation around each day, null below ``at_least`` values (one row per day)."""
    before = window // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, window - 1 - before)
    enough = F.count(value).over(w) >= at_least
    return df.withColumns({"rolling_mean": F.when(enough, F.avg(value).over(w)), "rolling_std": F.when(enough, F.stddev_samp(value).over(w))})


def error_summary(df: DataFrame, error: Column, tolerance: float) -> DataFrame:
    """Median, mean and q90 of absolute errors and the share above the tolerance."""
    rows = df.select(F.abs(error).alias("_e")).filter(F.col("_e").isNotNull()).withColumn("_one", F.lit(1))
    q = exact_quantiles(rows, ["_one"], "_e", {"median": 0.5, "q90": 0.9})
    rest = rows.groupBy("_one").agg(F.avg("_e").alias("mean"), (F.count_if(F.col("_e") > tolerance) / F.count(F.lit(1))).alias("mismatch_share"), F.count(F.lit(1)).alias("n"))
    return q.join(rest, "_one").drop("_one")


def key_prefix_sizes(df: DataFrame, document: str) -> DataFrame:
    """Entries, key bytes and value bytes per first key segment of a map column."""
    cells = df.select(F.explode(document).alias("_k", "_v"))
    by = cells.groupBy(F.split("_k", ":")[0].alias("prefix")).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("_k")).alias("key_bytes"), F.sum(F.octet_length(F.col("_v").cast("string"))).alias("value_bytes"))
    return by.withColumn("key_share", F.col("key_bytes") / (F.col("key_bytes") + F.col("value_bytes")))


def label_correlations(df: DataFrame, columns: Sequence[str], label: Column) -> DataFrame:
    """Per feature: correlation with a 0/1 label and the mean in either state."""
    y = label.cast("double")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(y.alias("y"), F.inline(cells))
    return long.groupBy("feature").agg(F.corr("v", "y").alias("r"), F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("mean_true"),
                                       F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("mean_false"))


def exceedances(df: DataFrame, columns: Sequence[str], thresholds: Sequence[float], clips: Sequence[float | None]) -> DataFrame:
    """How many z-scores exceed each threshold per column, raw and after clipping at several IQR multiples.

    Quartiles and the clipped moments are small per-column tables, broadcast
    (as many rows as columns and clip levels).
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), known(F.col(c).cast("double")).alias("v")) for c in columns])
    long = df.select(F.inline(cells)).filter("v IS NOT NULL")
    box = exact_quantiles(long, ["column"], "v", {"q1": 0.25, "q3": 0.75})
    levels = F.array(*[F.struct(F.lit(float(c) if c is not None else -1.0).alias("clip")) for c in clips])
    spread = long.join(F.broadcast(box), "column").select("column", "v", "q1", "q3", F.inline(levels))
    reach = F.col("clip") * (F.col("q3") - F.col("q1"))
    cut = F.when(F.col("clip") < 0, F.col("v")).otherwise(F.least(F.greatest(F.col("v"), F.col("q1") - reach), F.col("q3") + reach))
    clipped = spread.select("column", "clip", cut.alias("v"))
    moments = clipped.groupBy("column", "clip").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    z = F.try_divide(F.col("v") - F.col("_m"), F.col("_s"))
    return clipped.join(F.broadcast(moments), ["column", "clip"]).groupBy("column", "clip").agg(
        *[F.count_if(z > t).alias(f"over_{str(t).replace('.', '_')}") for t in thresholds])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per column; NaN counts as missing."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), known(F.col(c).cast("double")).alias("v")) for c in columns])
    long = df.select(F.inline(cells)).filter("v IS NOT NULL")
    q = exact_quantiles(long, ["column"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")).join(q, "column")


def unpivot_numeric(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form ``(ids, column, value)`` unpacked row by row."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*ids, F.inline(cells))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
