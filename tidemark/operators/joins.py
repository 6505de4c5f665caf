"""Joins between epochs, events, intervals and day records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rangejoin import interval_join


def stitch(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join stage outputs on their key; columns already present win, no base row is lost."""
    out = base
    for other in others:
        fresh = [c for c in other.columns if c not in out.columns]
        out = out.join(other.select(*keys, *fresh), list(keys), "left")
    return out


def outer_chain(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of several frames on one key."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), frames)


def reviewed_or_detected(detected: DataFrame, reviewed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Outer merge where a reviewed value replaces a detected one."""
    d = detected.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in columns])
    r = reviewed.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    both = d.join(r, list(keys), "full_outer")
    return both.select(*keys, *[F.coalesce(f"_r_{c}", f"_d_{c}").alias(c) for c in columns])


def match_events(epochs: DataFrame, events: DataFrame, keys: Sequence[str], *, epoch_at: str, length: int, since: str, at: str,
                 is_long: Column, order: str, keep: Sequence[str]) -> DataFrame:
    """Epochs with the first event (in ``order``) that overlaps them, null where none does.

    Long events match on open bounds over ``[since, at]``; instantaneous ones on
    the closed epoch, so one on a boundary belongs to both epochs.
    """
    spans = epochs.select(*keys, epoch_at, (F.col(epoch_at) + length).alias("_end"))
    happened = events.select(*keys, F.when(is_long, F.col(since)).otherwise(F.col(at)).alias("_from"), F.col(at).alias("_to"),
                             is_long.alias("_long"), F.col(order).alias("_order"), F.struct(*keep).alias("_kept"))
    l, r = F.col("l"), F.col("r")
    touching = ~r["_long"] | ((l["_end"] > r["_from"]) & (l[epoch_at] < r["_to"]))
    met = interval_join(spans, happened, keys, (epoch_at, "_end"), ("_from", "_to"), width=length, where=touching, left_longest=length)
    first = met.groupBy(*[l[k].alias(k) for k in keys], l[epoch_at].alias(epoch_at)).agg(F.min_by(r["_kept"], r["_order"]).alias("_hit"))
    joined = epochs.join(first, [*keys, epoch_at], "left")
    return joined.select(*epochs.columns, *[F.col("_hit")[c].alias(c) for c in keep])


def event_type_flags(epochs: DataFrame, events: DataFrame, keys: Sequence[str], *, epoch_at: str, length: int, since: str, at: str,
                     is_long: Column, kind: str, kinds: Sequence[str]) -> DataFrame:
    """One 0/1 column per event kind; a long event counts by its start inside the closed epoch."""
    spans = epochs.select(*keys, epoch_at, (F.col(epoch_at) + length).alias("_end"))
    points = events.filter(F.col(kind).isin(*kinds)).select(*keys, kind, F.when(is_long, F.col(since)).otherwise(F.col(at)).alias("_at"))
    met = interval_join(spans, points, keys, (epoch_at, "_end"), ("_at", "_at"), width=length, left_longest=length)
    l, r = F.col("l"), F.col("r")
    hits = met.groupBy(*[l[k].alias(k) for k in keys], l[epoch_at].alias(epoch_at)).agg(
        *[F.max((r[kind] == k).cast("int")).alias(k) for k in kinds])
    return epochs.join(hits, [*keys, epoch_at], "left").select(*epochs.columns, *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in kinds])


def overlap_flags(epochs: DataFrame, intervals: DataFrame, keys: Sequence[str], *, epoch_at: str, length: int, start: str, end: str, number: str,
                  per_second: int = 1_000_000, longer_than: int = 1) -> DataFrame:
    """The last interval sharing more than ``longer_than`` whole seconds with each epoch, and here/next/previous flags.

    One row per epoch, so the neighbour window is bounded by the calendar.
    """
    spans = epochs.select(*keys, epoch_at, (F.col(epoch_at) + length).alias("_end"))
    cut = intervals.select(*keys, start, end, number)
    l, r = F.col("l"), F.col("r")
    shared = F.floor((F.least(l["_end"], r[end]) - F.greatest(l[epoch_at], r[start])) / per_second)
    met = interval_join(spans, cut, keys, (epoch_at, "_end"), (start, end), width=length, where=shared > longer_than, left_longest=length)
    last = met.groupBy(*[l[k].alias(k) for k in keys], l[epoch_at].alias(epoch_at)).agg(F.max_by(F.struct(r[number], r[start], r[end]), r[number]).alias("_hit"))
    w = Window.partitionBy(*keys).orderBy(epoch_at)
    out = epochs.join(last, [*keys, epoch_at], "left").withColumn("here", F.col("_hit").isNotNull())
    out = out.withColumns({"in_next": F.lead("here", 1, False).over(w), "in_prev": F.lag("here", 1, False).over(w)})
    return out.withColumn("nearby", F.col("here") | F.col("in_next") | F.col("in_prev")).select(
        *epochs.columns, F.col("_hit")[number].alias(number), F.col("_hit")[start].alias(start), F.col("_hit")[end].alias(end),
        "here", "in_next", "in_prev", "nearby")


def inside_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], *, identity: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Label 1 for points inside any closed interval, else 0."""
    met = interval_join(points.select(*keys, *identity, at), intervals.select(*keys, start, end), keys, (at, at), (start, end), width=width)
    hit = met.select(*[F.col("l")[c].alias(c) for c in [*keys, *identity]]).distinct().withColumn("label", F.lit(1))
    return points.join(hit, [*keys, *identity], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def pair_starts_with_ends(starts: DataFrame, ends: DataFrame, keys: Sequence[str], *, at: str, order: str, within: int) -> DataFrame:
    """For each start the first end, in ``order``, no earlier and at most ``within`` later; ends may serve twice."""
    s = starts.select(*keys, F.col(at).alias("start"), F.col(order).alias("start_order"), (F.col(at) + within).alias("_limit"))
    e = ends.select(*keys, F.col(at).alias("end"), F.col(order).alias("end_order"))
    met = interval_join(s, e, keys, ("start", "_limit"), ("end", "end"), width=within, left_longest=within)
    l, r = F.col("l"), F.col("r")
    return met.groupBy(*[l[k].alias(k) for k in keys], l["start_order"].alias("start_order")).agg(
        F.first(l["start"]).alias("start"), F.min_by(r["end"], r["end_order"]).alias("end"), F.min(r["end_order"]).alias("end_order"))


def locked_windows(samples: DataFrame, stimuli: DataFrame, keys: Sequence[str], *, sample: str, value: str, at: str, kind: str, before: int, after: int) -> DataFrame:
    """Samples in ``[at - before, at + after)`` around each stimulus, averaged by kind and offset."""
    spans = stimuli.select(*keys, kind, F.col(at).alias("_at"), (F.col(at) - before).alias("_from"), (F.col(at) + after - 1).alias("_to"))
    met = interval_join(samples.select(*keys, sample, value), spans, keys, (sample, sample), ("_from", "_to"), width=before + after, right_longest=before + after)
    l, r = F.col("l"), F.col("r")
    return met.groupBy(r[kind].alias(kind), (l[sample] - r["_at"]).alias("offset")).agg(F.avg(l[value]).alias("mean_value"), F.count(F.lit(1)).alias("n"))


def with_next_day(df: DataFrame, other: DataFrame, keys: Sequence[str], day: str, columns: Sequence[str]) -> DataFrame:
    """Attach the ``columns`` another table holds for the following calendar day (inner)."""
    shifted = other.select(*keys, F.date_sub(day, 1).alias(day), *[F.col(c).alias(f"next_{c}") for c in columns])
    return df.join(shifted, [*keys, day])


def attach_targets(df: DataFrame, targets: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left-join target columns and drop rows that miss any of them."""
    return df.join(targets.select(*keys, *columns), list(keys), "left").dropna(subset=list(columns))


def series_side_by_side(long: DataFrame, keys: Sequence[str], series: str, value: str, names: Sequence[str]) -> DataFrame:
    """Several series aligned on their time key, one column each (outer)."""
    return long.groupBy(*keys).pivot(series, list(names)).agg(F.first(value, ignorenulls=True))


def differing_counts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose row counts differ between two stores."""
    ca = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_a"))
    cb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_b"))
    both = ca.join(cb, list(keys), "full_outer").na.fill(0, ["in_a", "in_b"])
    return both.filter(F.col("in_a") != F.col("in_b"))


def column_pairs(df: DataFrame, columns: Sequence[str], *, ordered: bool = True) -> DataFrame:
    """One row per input row and column pair (``x``, ``y``, ``vx``, ``vy``), both present.

    Pairs are unpacked from the row itself, so nothing is joined or shuffled.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if (i != j if ordered else i < j)]
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("vx"), F.col(b).cast("double").alias("vy")) for a, b in pairs]
    out = df.select(F.inline(F.array(*cells))).filter("vx IS NOT NULL AND vy IS NOT NULL AND NOT isnan(vx) AND NOT isnan(vy)")
    if len(set(columns)) == len(columns):
        # operators that take all of these pairs may read the rows instead; what is made from ``out`` does not have it
        out.unpacked_from = (df, list(columns), pairs)
    return out


def last_known(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key and column the last non-null value over the union of several tables."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])
