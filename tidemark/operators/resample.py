"""Regular grids from irregular samples: epochs, gaps, filling, smoothing, rates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import Timeline, exploded_range, framed, previous, running


def split_epochs(df: DataFrame, keys: Sequence[str], sample: str, length: int, step: int | None = None) -> DataFrame:
    """Samples with the ``epoch`` they belong to; epochs that would run past the last sample are dropped.

    With ``step`` below ``length`` epochs overlap and a sample appears once per epoch.
    """
    step = step or length
    ends = df.groupBy(*keys).agg((F.max(sample) + 1).alias("_total"))
    joined = df.join(ends, list(keys))
    s = F.col(sample)
    last = F.least(F.floor(s / step), F.floor((F.col("_total") - length) / step)).cast("long")
    if step == length:
        return joined.withColumn("epoch", F.floor(s / length).cast("long")).filter(F.col("epoch") <= last).drop("_total")
    first = F.greatest(F.ceil((s - length + 1) / step), F.lit(0)).cast("long")
    return joined.filter(first <= last).withColumn("epoch", F.explode(F.sequence(first, last))).drop("_total")


def _stretches(pdf: pd.DataFrame, columns: Sequence[str]) -> list[tuple[int, int]]:
    """Row ranges of a sorted batch over which the columns stay the same."""
    new = np.zeros(len(pdf), dtype=bool)
    for c in columns:
        x = pdf[c]
        before = x.shift()
        new |= ((x != before) & ~(x.isna() & before.isna())).to_numpy()
    starts = np.flatnonzero(new[1:]) + 1
    return list(zip([0, *starts], [*starts, len(pdf)]))


def _runs(counters: np.ndarray, modulus: int) -> Iterator[tuple[int, int]]:
    """Row ranges in which every counter follows the one before."""
    starts = np.flatnonzero(counters[1:] != (counters[:-1] + 1) % modulus) + 1
    return zip([0, *starts], [*starts, len(counters)])


def drop_out_of_order(df: DataFrame, keys: Sequence[str], arrival: str, counter: str, *, modulus: int = 256, chunk: int = 1_000_000) -> DataFrame:
    """Keep a row only when its wrapping counter follows the last *kept* row's; the first row is kept.

    The rule is sequential, but its whole state is one counter value, and runs
    of counters that follow one another are taken as one step: a run is kept
    from the value that the state waits for, if it holds it.  Each chunk of
    arrival numbers first reports where it would leave every possible state,
    those small maps are composed per key, and each chunk is then walked knowing
    the state it starts with.  Sorted partitions are streamed through Python
    batch by batch: no key and no chunk is ever held whole.
    """
    keys = list(keys)
    part = [*keys, "_part"]
    base = df.withColumn("_part", F.floor(F.col(arrival) / chunk).cast("long"))
    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # where each entry state, the last one for "nothing kept yet", stands by now
        now, state = None, None
        for pdf in batches:
            done = []
            for lo, hi in _stretches(pdf, part):
                who = tuple(pdf[k].iloc[lo] for k in part)
                if who != now:
                    if now is not None:
                        done.append((*now, state.tolist()))
                    now, state = who, np.arange(modulus + 1)
                c = pdf[counter].to_numpy()[lo:hi].astype(np.int64)
                for a, b in _runs(c, modulus):
                    caught = ((state + 1 - c[a]) % modulus < b - a) | (state == modulus)
                    state = np.where(caught, c[b - 1], state)
            if done:
                yield pd.DataFrame(done, columns=[*part, "_exits"])
        if now is not None:
            yield pd.DataFrame([(*now, state.tolist())], columns=[*part, "_exits"])

    def sorted_chunks(rows: DataFrame) -> DataFrame:
        return rows.repartition(*part).sortWithinPartitions(*part, arrival)

    maps = sorted_chunks(base.select(*part, arrival, counter)).mapInPandas(exits, f"{key_types}, _part long, _exits array<int>")

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, modulus
        for pdf in batches:
            states = []
            for who, leaves in zip(zip(*[pdf[k] for k in keys]), pdf["_exits"]):
                if who != now:
                    now, state = who, modulus
                states.append(state)
                state = int(leaves[state])
            yield pdf[part].assign(_state=states)

    # one map per chunk: a key has as many as its rows / chunk
    entry = maps.repartition(*keys).sortWithinPartitions(*part).mapInPandas(compose, f"{key_types}, _part long, _state int")
    schema = df.schema

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, modulus
        for pdf in batches:
            kept = np.zeros(len(pdf), dtype=bool)
            for lo, hi in _stretches(pdf, part):
                who = tuple(pdf[k].iloc[lo] for k in part)
                if who != now:
                    now, state = who, int(pdf["_state"].iloc[lo])
                c = pdf[counter].to_numpy()[lo:hi].astype(np.int64)
                for a, b in _runs(c, modulus):
                    skip = 0 if state == modulus else (state + 1 - int(c[a])) % modulus
                    if skip < b - a:
                        kept[lo + a + skip: lo + b] = True
                        state = int(c[b - 1])
            yield pdf.loc[kept, schema.names]

    return sorted_chunks(base.join(entry, part)).mapInPandas(keep, schema)


def find_gaps(df: DataFrame, line: Timeline, longer_than: int) -> DataFrame:
    """Pairs of neighbouring times further apart than ``longer_than`` (strictly): ``gap_start``, ``gap_end``, ``gap``."""
    at = line.order[0]
    seen = previous(df.select(*line.keys, *line.order), line, gap_start=at)
    gap = F.col(at) - F.col("gap_start")
    return seen.filter(gap > longer_than).select(*line.keys, "gap_start", F.col(at).alias("gap_end"), gap.alias("gap"))


def fill_gaps(df: DataFrame, line: Timeline, values: Sequence[str], period: int, longer_than: int) -> DataFrame:
    """Insert zero rows every ``period`` after a gap's start while the row before is still before its end.

    So ``ceil(gap / period)`` rows, the last of which may reach or pass the end;
    ``inserted`` marks them.
    """
    at = line.order[0]
    gaps = find_gaps(df, line, longer_than)
    made = exploded_range(gaps.select(*line.keys, "gap_start", "gap"), F.lit(1), F.ceil(F.col("gap") / period), "_k").select(
        *line.keys, (F.col("gap_start") + F.col("_k") * period).alias(at), *[F.lit(0.0).alias(v) for v in values], F.lit(1).alias("inserted"))
    kept = df.select(*line.keys, at, *values, F.lit(0).alias("inserted"))
    return kept.unionByName(made)


def grid_of(df: DataFrame, keys: Sequence[str], slot: str) -> DataFrame:
    """Every slot number between a series' first and last, one row each."""
    span = df.groupBy(*keys).agg(F.min(slot).alias("_lo"), F.max(slot).alias("_hi"))
    return exploded_range(span, F.col("_lo"), F.col("_hi"), slot).select(*keys, F.col(slot).cast(df.schema[slot].dataType).alias(slot))


def missing_slots(df: DataFrame, keys: Sequence[str], slot: str) -> DataFrame:
    """Slots of the expected grid that have no row."""
    return grid_of(df, keys, slot).join(df.select(*keys, slot).distinct(), [*keys, slot], "left_anti")


def zero_missing_slots(df: DataFrame, keys: Sequence[str], slot: str, value: str) -> DataFrame:
    """One value per grid slot, zero where the slot has none."""
    return grid_of(df, keys, slot).join(df, [*keys, slot], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def pad_to_multiple(df: DataFrame, keys: Sequence[str], sample: str, value: str, length: int) -> DataFrame:
    """Append zero samples until each series is a whole number of ``length`` samples long."""
    ends = df.groupBy(*keys).agg((F.max(sample) + 1).alias("_n"))
    target = F.ceil(F.col("_n") / length) * length
    extra = ends.filter(target > F.col("_n")).select(*keys, F.explode(F.sequence(F.col("_n"), (target - 1).cast("long"))).alias(sample), F.lit(0.0).alias(value))
    return df.select(*keys, sample, value).unionByName(extra)


def interpolate(df: DataFrame, line: Timeline, value: str, *, limit: int, both: bool = False, name: str | None = None) -> DataFrame:
    """Fill nulls of a regular grid on the straight line between their neighbours, at most ``limit`` slots from one.

    Forward: the first ``limit`` slots of a gap after a value are filled (past
    the last value: with it).  ``both`` also fills the last ``limit`` slots of a
    gap and the lead-in.
    """
    at = line.order[0]
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
    seen = running(df, line, {"_back": ("last", known)})
    seen = running(seen, line, {"_ahead": ("last", known)}, reverse=True)
    b, a, t = F.col("_back"), F.col("_ahead"), F.col(at)
    inside = b["v"] + (a["v"] - b["v"]) * (t - b["at"]) / (a["at"] - b["at"])
    guess = F.when(b.isNotNull() & a.isNotNull(), inside).otherwise(F.coalesce(b["v"], a["v"]))
    reach = F.coalesce(t - b["at"] <= limit, F.lit(False))
    if both:
        reach = reach | F.coalesce(a["at"] - t <= limit, F.lit(False))
    filled = F.coalesce(F.col(value), F.when(reach, guess))
    return seen.withColumn(name or value, filled).drop("_back", "_ahead")


def clip_to_int16(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(32767)), F.lit(-32768)).cast("smallint")


def _shifted(value: str, k: int, w) -> Column:
    return F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) if k else F.col(value)


def convolve(df: DataFrame, line: Timeline, value: str, weights: Sequence[float], name: str) -> DataFrame:
    """Weighted sum over the neighbours of each row; beyond the ends the end value repeats.

    An even number of weights reaches one row further ahead than back.
    """
    before, after = (len(weights) - 1) // 2, len(weights) // 2

    def make(w) -> Column:
        first = F.first(value).over(w.rowsBetween(-before, after))
        last = F.last(value).over(w.rowsBetween(-before, after))
        terms = []
        for k, weight in zip(range(-before, after + 1), weights):
            x = _shifted(value, k, w)
            terms.append(F.coalesce(x, first if k < 0 else last) * F.lit(float(weight)))
        return reduce(lambda p, q: p + q, terms)

    return framed(df, line, {name: make}, before=before, after=after)


def savgol_weights(points: int, order: int) -> list[float]:
    """Least-squares polynomial smoothing weights; an even number of points gives the value half a step after the row."""
    basis = np.vander(np.arange(points) - (points - 1) / 2, order + 1, increasing=True)
    return [float(x) for x in np.linalg.pinv(basis)[0]]


def gaussian_weights(sigma: float, reach: float = 4.0) -> list[float]:
    h = int(reach * sigma + 0.5)
    raw = np.exp(-0.5 * (np.arange(-h, h + 1) / sigma) ** 2)
    return [float(x) for x in raw / raw.sum()]


def moving_average(df: DataFrame, line: Timeline, value: str, points: int, name: str, *, valid_only: bool = False) -> DataFrame:
    """Centred box average; ``valid_only`` leaves rows without a full window null, otherwise zeros are assumed outside."""
    before, after = points // 2, points - 1 - points // 2

    def make(w) -> Column:
        f = w.rowsBetween(-before, after)
        mean = F.sum(value).over(f) / points
        return F.when(F.count(F.lit(1)).over(f) == points, mean) if valid_only else mean

    return framed(df, line, {name: make}, before=before, after=after)


def gradient(df: DataFrame, line: Timeline, value: str, name: str) -> DataFrame:
    """Central difference per row, one-sided at the ends."""
    return framed(df, line, {name: lambda w: F.coalesce(
        (F.lead(value).over(w) - F.lag(value).over(w)) / 2,
        F.lead(value).over(w) - F.col(value),
        F.col(value) - F.lag(value).over(w),
    )}, before=1, after=1)


def rate_outlier_bounds(low: Column, high: Column, factor: float = 1.5) -> tuple[Column, Column]:
    return low - factor * (high - low), high + factor * (high - low)


def stream_quality(df: DataFrame, line: Timeline, rate_per_second: float, longer_than: int, per_second: int = 1_000_000) -> DataFrame:
    """Per series: rows, rows expected at the nominal rate, estimated rate, number and length of gaps."""
    at = line.order[0]
    seen = previous(df.select(*line.keys, *line.order), line, _prev=at)
    gap = F.col(at) - F.col("_prev")
    seconds = (F.max(at) - F.min(at)) / per_second
    return seen.groupBy(*line.keys).agg(
        F.count(F.lit(1)).alias("samples"),
        (seconds * rate_per_second).alias("expected"),
        seconds.alias("seconds"),
        F.try_divide(F.count(F.lit(1)), seconds).alias("rate"),
        F.count_if(gap > longer_than).alias("gaps"),
        (F.coalesce(F.sum(F.when(gap > longer_than, gap)), F.lit(0)) / per_second).alias("missing_seconds"),
    )
