"""Button-press style event logs: debounce, durations, latest, day columns to streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import Timeline, previous, running

LONG = "_long"


def base_event(event: Column) -> Column:
    return F.regexp_replace(event, f"{LONG}$", "")


def with_long_variants(names: Sequence[str]) -> list[str]:
    return [v for n in names for v in (n, n + LONG)]


def debounce(df: DataFrame, keys: Sequence[str], at: str, event: str, order: str, *, within: int, chunk: int) -> DataFrame:
    """Drop a short press when the long press of the same name follows within ``within`` (inclusive).

    The next long press of the name is filled backwards along a chunked timeline.
    """
    base = base_event(F.col(event))
    long = F.col(event).endswith(LONG)
    rows = df.withColumns({"_base": base, "_long": long})
    line = Timeline((*keys, "_base"), (at, order), F.floor(F.col(at) / F.lit(chunk)))
    seen = running(rows, line, {"_next": ("last", F.when(F.col("_long"), F.col(at)))}, reverse=True)
    bounced = ~F.col("_long") & F.coalesce(F.col("_next") - F.col(at) <= within, F.lit(False))
    return seen.filter(~bounced).drop("_base", "_long", "_next")


def long_press_durations(df: DataFrame, line: Timeline, event: str, *, reach: int) -> DataFrame:
    """``since`` of long presses: the previous event if at most ``reach`` earlier, else ``reach`` before; and the duration."""
    at = F.col(line.order[0])
    seen = previous(df, line, _prev=line.order[0])
    since = F.when(F.col(event).endswith(LONG), F.greatest(F.coalesce("_prev", at - reach), at - reach))
    return seen.withColumn("since", since).withColumn("duration", at - F.col("since")).drop("_prev")


def latest_midpoint(df: DataFrame, keys: Sequence[str], kind: str, at: str, first: str, second: str) -> DataFrame:
    """The latest ``first`` and ``second`` event per key and the instant halfway between them."""
    out = df.groupBy(*keys).agg(F.max(F.when(F.col(kind) == first, F.col(at))).alias("before"), F.max(F.when(F.col(kind) == second, F.col(at))).alias("after"))
    return out.withColumn("midpoint", ((F.col("before") + F.col("after")) / 2).cast("long"))


def close_pairs(df: DataFrame, line: Timeline, closer_than: int) -> DataFrame:
    """Events fewer than ``closer_than`` after the one before."""
    at = line.order[0]
    return previous(df, line, prev_at=at).filter(F.col(at) - F.col("prev_at") < closer_than)


def day_columns_to_events(df: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """One event per time column and day at midnight plus its hours; hour 0 means absent; 24 and more fall on later days."""
    cells = F.array(*[F.struct(F.lit(c.split(":")[0]).alias("event"), F.col(f"`{c}`").cast("double").alias("hours")) for c in columns])
    others = [c for c in df.columns if c not in columns]
    rows = df.select(*others, F.inline(cells)).filter("hours IS NOT NULL AND hours <> 0")
    seconds = F.round(F.col("hours") * 3600).cast("long")
    return rows.withColumn("at", F.col(day).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).drop("hours")
