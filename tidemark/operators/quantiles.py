"""Exact quantiles and ranks whose memory does not grow with a hot group."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import known
from .timeline import Timeline, running

FEWEST_BINS, MOST_BINS = 64, 4096
#: Rows per chunk, on average, that its cut points are chosen from.
SLOTS = 16


def bins_for(df: DataFrame, bins: int | None) -> int:
    """Value chunks per key: as many as the cluster has shuffle partitions, so a hot key spreads over all of it."""
    wanted = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted if bins else min(max(wanted, FEWEST_BINS), MOST_BINS)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


#: A key's rows are dealt to so many parts when they meet the one row of their key.
PARTS = 32


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``per_key``, which has one short row per key.

    A join on the keys alone would gather a hot key, and an aggregate by the keys would then read it in one task. Rows
    are dealt to parts by their content and ``per_key`` is repeated for each part.
    """
    if not keys:
        return rows.join(per_key, [], how)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(PARTS)).cast("int"))
    every = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(every, [*keys, "_part"], how).drop("_part")


def value_edges(df: DataFrame, keys: Sequence[str], value: str, bins: int | None = None) -> DataFrame:
    """Per key, ascending cut points that split the rows into about equal shares, from a row of each of its slots.

    A row's slot follows the hash of its columns, so the same rows give the same cut points in whatever order they
    come. A plan may work them out more than once, and rows and totals of a chunk must agree on its ends; a sketch that
    merges what other executors send would follow the order of arrival.
    """
    count = bins_for(df, bins)
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    slots = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.pmod(hashed, F.lit(count * SLOTS)).alias("_slot"))
    picked = slots.agg(F.min_by(value, hashed).alias("_v")).groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_v"))
    cuts = F.sequence(F.lit(1), F.lit(max(count - 1, 1)))
    at = lambda i: F.ceil(i * F.size("_v") / count).cast("int") - 1
    return picked.select(*keys, F.array_distinct(F.transform(cuts, lambda i: F.get("_v", at(i)))).alias("_edges"))


def with_value_chunk(df: DataFrame, keys: Sequence[str], value: str, bins: int | None = None, name: str = "_bin", *, apart: bool = False) -> DataFrame:
    """Add a chunk number that never decreases with ``value``; equal values always share a chunk.

    ``apart`` gives even numbers to stretches between cut points and odd ones to the cut points themselves.
    """
    edges = value_edges(df, keys, value, bins)
    # two short searches: which stretch of edges, then which edge in it
    stride = math.isqrt(bins_for(df, bins))
    strides = F.sequence(F.lit(stride), F.greatest(F.size("_edges"), F.lit(stride)), F.lit(stride))
    coarse = F.array_compact(F.transform(strides, lambda i: F.get("_edges", i - 1)))
    joined = df.join(edges.withColumn("_coarse", coarse), list(keys), "left")
    v = F.col(value)
    stretch = F.size(F.filter("_coarse", lambda e: e < v))
    inside = F.size(F.filter(F.slice("_edges", F.col("_stretch") * stride + 1, F.lit(stride)), lambda e: e < v))
    below = F.coalesce(F.col("_stretch") * stride + inside, F.lit(0))
    if apart:
        # the first cut point that is not below the value may be the value
        below = below * 2 + F.coalesce(F.get("_edges", below) == v, F.lit(False)).cast("int")
    out = joined.withColumn("_stretch", stretch).withColumn(name, below.cast("long"))
    return out.drop("_edges", "_coarse", "_stretch")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, *, bins: int | None = None, copies: str | None = None) -> DataFrame:
    """One row per key and distinct value: ``n`` copies, ``rank_min``, ``rank_avg`` (ties averaged), ``rank_max``.

    Copies are counted before anything is ordered, so ties cost one row; the
    distinct values are ranked chunk by chunk. Where ``copies`` is named, a row of ``df`` has a known double and stands for
    so many rows; nothing is filtered then, so that the plan up to ``df`` stays one that others may share.
    """
    if copies:
        counts = df.groupBy(*keys, value).agg(F.sum(copies).alias("n"))
    else:
        df = df.withColumn(value, known(F.col(value).cast("double")))
        counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    chunked = with_value_chunk(counts, keys, value, bins)
    line = Timeline(tuple(keys), (value,), F.col("_bin"))
    ranked = running(chunked, line, {"rank_max": ("sum", F.col("n"))}).drop("_bin")
    return ranked.select(
        *keys,
        value,
        "n",
        (F.col("rank_max") - F.col("n") + 1).alias("rank_min"),
        (F.col("rank_max") - (F.col("n") - 1) / 2).alias("rank_avg"),
        "rank_max",
    )


def _wanted(n: Column, p: float, method: str) -> tuple[Column, Column]:
    """Zero-based positions whose values are blended for probability ``p`` of ``n`` sorted values."""
    if method == "linear":
        at = (n - 1) * F.lit(p)
        return F.floor(at), F.ceil(at)
    at = n * F.lit(p)
    whole = F.floor(at)
    # the index rule: an integral p*n averages the two neighbours, otherwise the truncated index is taken
    low = F.when(at == whole, F.greatest(whole - 1, F.lit(0))).otherwise(whole)
    return low, F.least(whole, n - 1)


def _blend(low: Column, high: Column, n: Column, p: float, method: str) -> Column:
    if method == "linear":
        at = (n - 1) * F.lit(p)
        return low + (high - low) * (at - F.floor(at))
    return (low + high) / 2


def _column(p: float) -> str:
    return "_q_" + str(p).replace(".", "_")


def _picked(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], method: str, bins: int | None) -> DataFrame:
    """Copies are counted first; then only the chunks that hold a wanted rank are ordered, each on its own."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    # both readers share this shuffle; without it they would follow the join before, which gathers a key
    chunked = with_value_chunk(counted, keys, value, bins).repartition(*keys, "_bin")
    per_bin = chunked.groupBy(*keys, "_bin").agg(F.sum("_k").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_bin.select(
        *keys,
        "_bin",
        "_c",
        F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"),
    )
    n = F.col("_n")
    spots = []
    for p in probs:
        low, high = _wanted(n, p, method)
        spots += [F.struct(F.lit(float(p)).alias("_p"), F.lit(0).alias("_side"), low.cast("long").alias("_at")),
                  F.struct(F.lit(float(p)).alias("_p"), F.lit(1).alias("_side"), high.cast("long").alias("_at"))]
    spot = F.filter(F.array(*spots), lambda s: (s["_at"] >= F.col("_before")) & (s["_at"] < F.col("_before") + F.col("_c")))
    # one row per chunk that holds a wanted rank, at most 2 * len(probs) of a group
    targets = placed.select(*keys, "_bin", "_before", "_n", spot.alias("_spots")).filter(F.size("_spots") > 0)
    local = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = chunked.join(targets, [*keys, "_bin"]).withColumn("_upto", F.col("_before") + F.sum("_k").over(local))
    here = F.filter("_spots", lambda s: (s["_at"] < F.col("_upto")) & (s["_at"] >= F.col("_upto") - F.col("_k")))
    hit = ordered.select(*keys, value, "_n", F.inline(here))
    picked = hit.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[F.max(F.when((F.col("_p") == float(p)) & (F.col("_side") == s), F.col(value))).alias(f"{_column(p)}_{s}") for p in probs for s in (0, 1)],
    )
    return picked.select(
        *keys,
        *[_blend(F.col(f"{_column(p)}_0"), F.col(f"{_column(p)}_1"), F.col("_n"), p, method).alias(_column(p)) for p in probs],
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    method: str = "linear",
    bins: int | None = None,
    nan_counts: bool = False,
) -> DataFrame:
    """Exact quantiles per group as columns named by ``probs``.

    ``linear`` interpolates between neighbours; ``index`` takes the truncated
    position ``p*n`` and averages two neighbours when it is integral.  Null is
    left out, and NaN too unless ``nan_counts``.  No task sees a whole group,
    and the plan is the same at every size.
    """
    x = F.col(value).cast("double")
    rows = df.select(*keys, (x if nan_counts else known(x)).alias(value)).filter(F.col(value).isNotNull())
    constant = not keys
    if constant:
        rows = rows.withColumn("_all", F.lit(0))
        keys = ["_all"]
    both = _picked(rows, keys, value, sorted(set(probs.values())), method, bins)
    kept = [] if constant else list(keys)
    return both.select(*kept, *[F.col(_column(p)).alias(name) for name, p in probs.items()])
