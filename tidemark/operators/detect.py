"""Threshold runs, sound and silence sections, dips, peaks and their review."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rangejoin import interval_join
from .timeline import Timeline, framed, gap_islands


def runs_where(df: DataFrame, line: Timeline, flag: Column, *, reach: int = 1, aggs: Sequence[Column] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Runs of flagged samples no further than ``reach`` apart: ``start``, ``end`` (last sample), ``n`` and ``aggs``.

    ``carry`` names the columns the ``aggs`` read.

    The filter comes first, so only flagged samples are ordered and shuffled.
    """
    at = line.order[0]
    marked = gap_islands(df.filter(flag).select(*line.keys, *line.order, *carry), line, reach)
    return marked.groupBy(*line.keys, "island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"), *aggs).drop("island")


def merge_runs(runs: DataFrame, keys: Sequence[str], gap: int, *, chunk: int, strict: bool = False, aggs: Sequence[Column] = ()) -> DataFrame:
    """Join runs whose distance (next start minus previous end) is at most ``gap`` (below it, if ``strict``)."""
    line = Timeline.every(keys, ["start"], chunk)
    marked = gap_islands(runs, line, gap, end="end", name="_section", strict=not strict)
    return marked.groupBy(*keys, "_section").agg(F.min("start").alias("start"), F.max("end").alias("end"), *aggs).drop("_section")


def artifact_sections(df: DataFrame, line: Timeline, value: str, *, above: float, min_run: int, merge_gap: int, min_length: int, keep_above: float, chunk: int) -> DataFrame:
    """Sections of excessive amplitude, end exclusive.

    Runs above the limit of at least ``min_run`` samples, merged across gaps up
    to ``merge_gap``; kept when long enough or when any sample in the section
    (bridged short spikes included) exceeds ``keep_above``.
    """
    keys = list(line.keys)
    size = F.abs(F.col(value))
    runs = runs_where(df, line, size > above, aggs=[F.max(size).alias("peak")], carry=[value]).withColumn("end", F.col("end") + 1)
    merged = merge_runs(runs.filter(F.col("end") - F.col("start") >= min_run).select(*keys, "start", "end"), keys, merge_gap, chunk=chunk)
    met = interval_join(runs.select(*keys, F.col("start").alias("at"), "peak"), merged.withColumn("last", F.col("end") - 1), keys, ("at", "at"), ("start", "last"), width=max(min_length, 1))
    l, r = F.col("l"), F.col("r")
    sized = met.groupBy(*[r[k].alias(k) for k in keys], r["start"].alias("start"), r["end"].alias("end")).agg(F.max(l["peak"]).alias("peak"))
    return sized.filter((F.col("end") - F.col("start") >= min_length) | (F.col("peak") > keep_above))


def epochs_touched(intervals: DataFrame, keys: Sequence[str], start: str, end: str, length: int) -> DataFrame:
    """Epochs from the one holding the start to the one holding the end, both included, once each."""
    first, last = F.floor(F.col(start) / length).cast("long"), F.floor(F.col(end) / length).cast("long")
    return intervals.select(*keys, F.explode(F.sequence(first, last)).alias("epoch")).distinct()


def samples_outside(df: DataFrame, intervals: DataFrame, keys: Sequence[str], sample: str, start: str, end: str, *, width: int) -> DataFrame:
    """Samples in no interval (``end`` exclusive)."""
    met = interval_join(df.select(*keys, sample), intervals.select(*keys, start, (F.col(end) - 1).alias("_last")), keys, (sample, sample), (start, "_last"), width=width)
    inside = met.select(*[F.col("l")[c].alias(c) for c in [*keys, sample]])
    return df.join(inside, [*keys, sample], "left_anti")


def settled_predictions(df: DataFrame, line: Timeline, value: str, *, threshold: float, min_first: float, fill: int, min_last: int, chunk: int) -> DataFrame:
    """Intervals of positive prediction on a regular grid after three passes.

    Drop on-runs shorter than ``min_first``; fill off-gaps of at most ``fill``
    samples, those before the first and after the last run included; drop
    on-runs shorter than ``min_last``.  All three work on runs, not samples.
    """
    keys, at = list(line.keys), line.order[0]
    span = df.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    runs = runs_where(df, line, F.col(value) > threshold).filter(F.col("n") >= min_first).select(*keys, "start", "end")
    merged = merge_runs(runs, keys, fill + 1, chunk=chunk).join(span, keys)
    grown = merged.withColumns({
        "start": F.when(F.col("start") - F.col("_lo") <= fill, F.col("_lo")).otherwise(F.col("start")),
        "end": F.when(F.col("_hi") - F.col("end") <= fill, F.col("_hi")).otherwise(F.col("end")),
    })
    return grown.filter(F.col("end") - F.col("start") + 1 >= min_last).select(*keys, "start", "end")


def bucket_levels(df: DataFrame, keys: Sequence[str], sample: str, value: str, window: int, kind: str = "rms") -> DataFrame:
    """Loudness per complete window: root mean square or largest amplitude."""
    level = F.sqrt(F.avg(F.col(value) * F.col(value))) if kind == "rms" else F.max(F.abs(F.col(value)))
    rows = df.filter(~F.isnan(value)).withColumn("bucket", F.floor(F.col(sample) / window).cast("long"))
    return rows.groupBy(*keys, "bucket").agg(level.alias("level"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == window).drop("_n")


def loud_sections(levels: DataFrame, keys: Sequence[str], window: int, loud: Column, *, merge: int, shortest: int, chunk: int) -> DataFrame:
    """Sound events in samples from window levels.

    An event runs from the window before the first loud one to the last loud
    one; events closer than ``merge`` join; short ones go.  A series whose
    only loud run starts in its first window has no rise and yields nothing.
    """
    line = Timeline.every(keys, ["bucket"], chunk)
    runs = runs_where(levels, line, loud)
    rising = runs.filter(F.col("start") > 0).select(*keys).distinct()
    heard = runs.join(rising, list(keys), "left_semi").select(
        *keys, (F.greatest(F.col("start") - 1, F.lit(0)) * window).alias("start"), (F.col("end") * window).alias("end"))
    merged = merge_runs(heard, keys, merge, chunk=chunk * window, strict=True)
    return merged.filter(F.col("end") - F.col("start") >= shortest)


def above_mean(levels: DataFrame, keys: Sequence[str], times: float) -> DataFrame:
    """Levels with ``limit``: the series' mean level times a factor."""
    return levels.join(levels.groupBy(*keys).agg((F.avg("level") * times).alias("limit")), list(keys))


def silences(df: DataFrame, line: Timeline, value: str, *, below_db: float, shortest: int) -> DataFrame:
    """Runs quieter than ``below_db`` relative to the series' largest amplitude; end exclusive."""
    keys = list(line.keys)
    top = df.groupBy(*keys).agg(F.max(F.abs(F.col(value))).alias("_top"))
    db = 20 * F.log10(F.greatest(F.abs(F.col(value)), F.lit(1e-5)) / F.greatest(F.col("_top"), F.lit(1e-5)))
    runs = runs_where(df.join(top, keys), line, db < below_db)
    return runs.select(*keys, "start", (F.col("end") + 1).alias("end"), "n").filter(F.col("end") - F.col("start") >= shortest)


def dips(df: DataFrame, line: Timeline, value: str, *, below: float, reach: int) -> DataFrame:
    """Groups of samples below a limit with their lowest sample as the peak."""
    at = line.order[0]
    return runs_where(df, line, F.col(value) < below, reach=reach, aggs=[F.min_by(at, F.struct(value, at)).alias("peak_at"), F.min(value).alias("peak_value")], carry=[value]).withColumn(
        "length", F.col("end") - F.col("start") + 1)


def naive_maxima(df: DataFrame, line: Timeline, value: str) -> DataFrame:
    """Rows above their predecessor and not below the second row after them."""
    out = framed(df, line, {"_p": lambda w: F.lag(value).over(w), "_n": lambda w: F.lead(value, 2).over(w)}, before=1, after=2)
    return out.filter((F.col("_p") < F.col(value)) & (F.col(value) >= F.col("_n"))).drop("_p", "_n")


def _local_maxima(y: np.ndarray) -> np.ndarray:
    """Indices of strict local maxima, the middle of a flat top."""
    found, i = [], 1
    while i < len(y) - 1:
        if y[i - 1] < y[i]:
            j = i
            while j < len(y) - 1 and y[j + 1] == y[i]:
                j += 1
            if j < len(y) - 1 and y[j + 1] < y[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    return np.array(found, dtype=int)


def _spaced(peaks: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Keep the highest peaks first, dropping any closer than ``distance`` to a kept one."""
    keep = np.ones(len(peaks), dtype=bool)
    for i in np.argsort(y[peaks], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < distance
            near[i] = False
            keep &= ~near
    return peaks[keep]


def _prominence(peak: int, y: np.ndarray) -> float:
    """Height above the higher of the two lowest points before a higher sample on either side."""
    sides = []
    for part in (y[peak::-1], y[peak:]):
        higher = np.flatnonzero(part > y[peak])
        sides.append(part[: higher[0] if len(higher) else len(part)].min())
    return float(y[peak] - max(sides))


def peak_positions(y: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    peaks = _spaced(_local_maxima(y), y, distance)
    return np.array([p for p in peaks if _prominence(p, y) >= prominence], dtype=int)


def peaks_and_valleys(df: DataFrame, keys: Sequence[str], order: str, smooth: str, raw: str, *, peak: tuple[int, float] = (30, 0.05),
                      valley: tuple[int, float] = (10, 0.01), snap: int = 5) -> DataFrame:
    """Peaks and valleys of a smoothed night by distance and prominence, moved to the raw extreme within ``snap`` rows.

    ``keys`` must include the night: one row per minute bounds a group to 1,440 rows.
    """
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    kind = df.schema[order].dataType.simpleString()

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        y, x = pdf[smooth].to_numpy(float), pdf[raw].to_numpy(float)
        rows = []
        for name, sign, (distance, prominence) in (("peak", 1, peak), ("valley", -1, valley)):
            for p in peak_positions(sign * y, distance, prominence):
                lo, hi = max(0, p - snap), min(len(y), p + snap + 1)
                at = lo + int(np.nanargmax(sign * x[lo:hi]))
                rows.append((*[pdf[k].iloc[0] for k in keys], name, pdf[order].iloc[p], pdf[order].iloc[at], x[at], y[p]))
        return pd.DataFrame(rows, columns=[*keys, "feature", "smooth_at", order, raw, smooth])

    return df.select(*keys, order, smooth, raw).groupBy(*keys).applyInPandas(find, f"{schema}, feature string, smooth_at {kind}, `{order}` {kind}, `{raw}` double, `{smooth}` double")


def in_night_hours(candidates: DataFrame, at: Column, start: float, end: float, *, after: Sequence[Column] = (), before: Sequence[Column] = ()) -> DataFrame:
    """Candidates in ``[start, end)`` hours of their day (past 24 for the next date), not before ``after`` and not after ``before`` where these are known."""
    keep = (at >= start) & (at < end)
    for limit in after:
        keep = keep & F.coalesce(at >= limit, F.lit(True))
    for limit in before:
        keep = keep & F.coalesce(at <= limit, F.lit(True))
    return candidates.filter(keep)


def choose_evening_peaks(candidates: DataFrame, subject: str, day: str, hour: str, *, history: int = 3) -> DataFrame:
    """One peak per day: the last one until ``history`` days were picked, then the one nearest to the mean hour of the last picks.

    Sequential across days by nature; a subject has a few candidates per day, so
    a group is bounded by the calendar.  Days without a candidate are absent.
    """
    fields = candidates.schema

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([day, hour])
        chosen, recent = [], []
        for _, night in pdf.groupby(day, sort=True):
            if len(recent) >= history:
                target = sum(recent[-history:]) / history
                row = night.loc[(night[hour] - target).abs().idxmin()]
            else:
                row = night.iloc[-1]
            recent.append(float(row[hour]))
            chosen.append(row)
        return pd.DataFrame(chosen)[fields.names]

    return candidates.groupBy(subject).applyInPandas(pick, fields)


def first_stable(df: DataFrame, keys: Sequence[str], order: str, value: str, *, step: float = 0.1, rising: bool = False) -> DataFrame:
    """Walk a night's few valleys (or peaks) in time order and settle on one.

    Valleys: move on while the next is more than ``step`` lower, else stop.
    Peaks (``rising``): take every later one more than ``step`` higher, never stop.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("v"))))
    packed = df.groupBy(*keys).agg(items.alias("_items"))
    start = F.struct(F.get("_items", F.lit(0)).alias("pick"), F.lit(False).alias("done"))

    def walk(acc: Column, item: Column) -> Column:
        now = acc["pick"]["v"]
        better = item["v"] > now + step if rising else item["v"] < now - step
        return F.struct(F.when(~acc["done"] & better, item).otherwise(acc["pick"]).alias("pick"), (F.lit(False) if rising else acc["done"] | ~better).alias("done"))

    settled = F.aggregate(F.slice("_items", F.lit(2), F.greatest(F.size("_items") - 1, F.lit(0))), start, walk)
    return packed.select(*keys, settled["pick"].alias("_p")).select(*keys, F.col("_p.at").alias(order), F.col("_p.v").alias(value))


def against_review(detected: DataFrame, reviewed: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Detected and reviewed times side by side with their absolute difference."""
    both = detected.select(*keys, F.col(at).alias("detected")).join(reviewed.select(*keys, F.col(at).alias("reviewed")), list(keys), "full_outer")
    return both.withColumn("difference", F.abs(F.col("detected") - F.col("reviewed")))


def detection_status(df: DataFrame, usable: Column, found: Column) -> DataFrame:
    """A status row per entity instead of an exception."""
    return df.withColumns({
        "status": F.when(~usable, "Error").when(found, "Detected").otherwise("Not found"),
        "reason": F.when(~usable, "No usable input").when(~found, "No usable peaks found"),
    })


def tune_sound_detection(df: DataFrame, expected: DataFrame, keys: Sequence[str], sample: str, value: str, *, windows: Sequence[int], multipliers: Sequence[float],
                         merges: Sequence[int], shortest: Sequence[int], chunk: int) -> DataFrame:
    """Total error of every parameter combination against labelled recordings.

    Levels are computed once per window size and runs once per (window,
    multiplier); only the small run tables fan out over the other parameters.
    ``expected`` has ``exact`` and ``at_least`` (null where not labelled).
    """
    sized = df.withColumn("window", F.explode(F.array(*map(F.lit, windows)))).withColumn("bucket", F.floor(F.col(sample) / F.col("window")).cast("long"))
    levels = sized.groupBy(*keys, "window", "bucket").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("level"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == F.col("window")).drop("_n")
    limits = above_mean(levels, [*keys, "window"], 1.0)
    loud = limits.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers]))).filter(F.col("level") > F.col("limit") * F.col("multiplier"))
    group = [*keys, "window", "multiplier"]
    runs = runs_where(loud, Timeline.every(group, ["bucket"], chunk), F.lit(True))
    rising = runs.filter(F.col("start") > 0).select(*group).distinct()
    heard = runs.join(rising, group, "left_semi").select(*group, (F.greatest(F.col("start") - 1, F.lit(0)) * F.col("window")).alias("start"), (F.col("end") * F.col("window")).alias("end"))
    fanned = heard.withColumn("merge", F.explode(F.array(*map(F.lit, merges))))
    line = Timeline.every([*group, "merge"], ["start"], chunk * max(windows))
    sections = gap_islands(fanned, line, F.col("merge"), end="end", name="_section", strict=False)
    spans = sections.groupBy(*group, "merge", "_section").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    counted = spans.withColumn("shortest", F.explode(F.array(*map(F.lit, shortest)))).groupBy(*group, "merge", "shortest").agg(F.count_if(F.col("end") - F.col("start") >= F.col("shortest")).alias("_events"))
    grid = expected.withColumn("_g", F.explode(F.array(*[
        F.struct(F.lit(w).alias("window"), F.lit(float(m)).alias("multiplier"), F.lit(g).alias("merge"), F.lit(s).alias("shortest"))
        for w in windows for m in multipliers for g in merges for s in shortest]))).select(*keys, "exact", "at_least", "_g.*")
    found = F.coalesce("_events", F.lit(0))
    miss = F.coalesce(F.abs(found - F.col("exact")), F.lit(0)) + F.coalesce(F.greatest(F.col("at_least") - found, F.lit(0)), F.lit(0))
    return grid.join(counted, [*group, "merge", "shortest"], "left").groupBy("window", "multiplier", "merge", "shortest").agg(F.sum(miss).alias("total_error"))
