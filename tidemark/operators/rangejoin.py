"""Interval, point-in-interval and as-of joins without nested loops.

Both sides are laid on a grid of time buckets and joined on (keys, level,
bucket).  The bucket width grows by ``RATIO`` per level and an interval lives on
the first level whose bucket is at least as long as itself, so it covers at most
two buckets there however long it is.  A pair meets on the higher of its two
levels, in the bucket that holds the later start: exactly once, no distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import Timeline, running

RATIO = 16


def _levels(width: int) -> int:
    """Levels whose bucket width is a long."""
    n = 1
    while width * RATIO**n < 2**62:
        n += 1
    return n


def _own_level(span: Column, width: int) -> Column:
    top = _levels(width) - 1
    level = F.lit(top)
    for i in reversed(range(top)):
        level = F.when(span <= width * RATIO**i, F.lit(i)).otherwise(level)
    return level


def _level_of(span: int, width: int) -> int:
    """The level an interval of that length lives on."""
    return next((i for i in range(_levels(width) - 1) if span <= width * RATIO**i), _levels(width) - 1)


def levels_present(df: DataFrame, start: str, end: str, width: int) -> list[int]:
    """The levels that intervals of a table live on: one aggregate, a handful of numbers."""
    own = _own_level(F.col(end) - F.col(start), width)
    found = df.filter(F.col(end) >= F.col(start)).agg(F.sort_array(F.collect_set(own))).first()[0]
    return list(found)


def _laid_out(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int, prefix: str, *, others: Sequence[int]) -> DataFrame:
    """Rows once per bucket on their own level and on those levels above it where the other side lives."""
    own = _own_level(F.col(end) - F.col(start), width)
    packed = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))).select(
        *[F.col(k).alias(k) for k in keys],
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(prefix),
        F.col(start).alias(f"{prefix}_s"),
        F.col(end).alias(f"{prefix}_e"),
        own.alias(f"{prefix}_own"),
    )
    own_level = F.col(f"{prefix}_own")
    above = F.filter(F.array(*[F.lit(i) for i in others]).cast("array<int>"), lambda i: i > own_level)
    leveled = packed.withColumn("_level", F.explode(F.concat(F.array(own_level), above)))
    span = _span(width)
    return leveled.withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col(f"{prefix}_s") / span).cast("long"), F.floor(F.col(f"{prefix}_e") / span).cast("long"))),
    )


def _span(width: int) -> Column:
    return F.element_at(F.array(*[F.lit(width * RATIO**i).cast("long") for i in range(_levels(width))]), F.col("_level") + 1)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    width: int,
    where: Column | None = None,
    left_longest: int | None = None,
    right_longest: int | None = None,
) -> DataFrame:
    """All pairs whose closed spans meet, as struct columns ``l`` and ``r`` (plus ``where`` on them).

    Spans are integers of any unit (seconds, microseconds, sample numbers);
    equal names mean points.  Open or half-open bounds go into ``where``.
    ``width`` is the finest bucket: about the length of a short interval.
    ``left_longest`` / ``right_longest`` state a length no span of that side
    exceeds (epochs of fixed length, say).  Where it is left out, the levels
    that side lives on are asked first, in one small aggregate; either way rows
    go to those levels only.
    """
    def lives(df: DataFrame, span: tuple[str, str], longest: int | None) -> list[int]:
        if span[0] == span[1]:
            return [0]
        return levels_present(df, *span, width) if longest is None else list(range(_level_of(longest, width) + 1))

    a = _laid_out(left, keys, *left_span, width, "l", others=lives(right, right_span, right_longest))
    b = _laid_out(right, keys, *right_span, width, "r", others=lives(left, left_span, left_longest))
    met = a.join(b, [*keys, "_level", "_bucket"])
    later = F.greatest("l_s", "r_s")
    span = _span(width)
    met = met.filter(
        (F.col("_level") == F.greatest("l_own", "r_own"))
        & (F.col("l_s") <= F.col("r_e"))
        & (F.col("r_s") <= F.col("l_e"))
        & (F.col("_bucket") == F.floor(later / span))
    )
    if where is not None:
        met = met.filter(where)
    return met.select("l", "r")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    *,
    take: Sequence[str],
    chunk: int,
    tie: str | None = None,
) -> DataFrame:
    """Left rows with the ``take`` columns of the last right row at or before them (same key).

    ``tie`` orders right rows that share an instant.  Done as one union and a
    chunked forward fill: no join, nothing broadcast, no key held by one task.
    """
    shared = list(keys)
    r = right.select(*shared, F.col(right_at).alias("_at"), F.lit(0).alias("_side"),
                     (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"),
                     F.struct(*take).alias("_hit"))
    l = left.select(*shared, F.col(left_at).alias("_at"), F.lit(1).alias("_side"),
                    F.lit(0).cast("long").alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    rows = r.unionByName(l, allowMissingColumns=True)
    line = Timeline(tuple(keys), ("_at", "_side", "_tie"), F.floor(F.col("_at") / F.lit(chunk)))
    filled = running(rows, line, {"_found": ("last", F.col("_hit"))})
    return filled.filter(F.col("_side") == 1).select("_row.*", *[F.col("_found")[c].alias(c) for c in take])
