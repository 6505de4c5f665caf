"""Ordered operators over a timeline that one task never has to hold.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts every row of a key into one
task.  Here a timeline is cut into *chunks* (a monotone function of the order,
for instance the hour).  Each chunk is windowed on its own and the little it
needs from its neighbours travels as marked extra rows ("halo" rows): the last
``n`` rows of the chunks before it, or a running total carried over them.  Only
chunk summaries (one row per key and chunk) are ever windowed per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
HALO = "_halo"

WindowExpr = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Timeline:
    """``keys`` identify a series, ``order`` is a total order inside it, ``chunk`` never decreases along it."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: Column

    @staticmethod
    def every(keys: Sequence[str], order: Sequence[str], width: int | float) -> "Timeline":
        """Chunks of ``width`` units of the first (numeric) order column."""
        return Timeline(tuple(keys), tuple(order), F.floor(F.col(order[0]) / F.lit(width)))


def _shared(df: DataFrame, line: Timeline) -> DataFrame:
    """One shuffle by (keys, chunk) that every reader of the timeline can reuse."""
    return df.withColumn(CHUNK, line.chunk).repartition(*line.keys, CHUNK)


def _whole(columns: Sequence[str]) -> Column:
    """A value that depends on every column.

    A summary that carries it (and tests it for null) reads the same columns as
    the rows themselves, so the planner sees one shuffle and not two pruned ones.
    """
    return F.max(F.xxhash64(*[F.col(f"`{c}`") for c in columns])).alias("_whole")


def _pack(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def _edge_rows(base: DataFrame, line: Timeline, n: int, forward: bool) -> DataFrame:
    """Rows of the chunks before (``forward``) or after each chunk, at most ``n``, labelled with that chunk."""
    columns = [c for c in base.columns if c != CHUNK]
    group = [*line.keys, CHUNK]
    key = _pack([*line.order])
    if n == 1:
        pick = F.max_by if forward else F.min_by
        # the packed row names every column already, so this reads the shared shuffle as it is
        packed = base.groupBy(*group).agg(F.array(pick(_pack(columns), key)).alias("_rows"))
    else:
        order = [F.col(c).desc() if forward else F.col(c).asc() for c in line.order]
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        packed = (
            base.withColumn("_rank", rank)
            .filter(F.col("_rank") <= n)
            .groupBy(*group)
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("_rank") if forward else F.col("_rank")).alias("_at"), _pack(columns).alias("_row")))).alias("_rows"))
            .withColumn("_rows", F.transform("_rows", lambda r: r["_row"]))
        )
    per_key = Window.partitionBy(*line.keys).orderBy(CHUNK)
    frame = per_key.rowsBetween(-n, -1) if forward else per_key.rowsBetween(1, n)
    near = F.flatten(F.collect_list("_rows").over(frame))
    if n > 1:
        near = F.slice(near, F.greatest(F.lit(1), F.size(near) - n + 1), n) if forward else F.slice(near, 1, n)
    moved = packed.select(F.col(CHUNK), near.alias("_near"))
    return moved.select(CHUNK, F.inline("_near")).withColumn(HALO, F.lit(True)).repartition(*group)


def framed(
    df: DataFrame,
    line: Timeline,
    exprs: dict[str, WindowExpr],
    *,
    before: int = 1,
    after: int = 0,
) -> DataFrame:
    """Add window columns whose frame reaches at most ``before`` rows back and ``after`` rows ahead."""
    base = _shared(df, line)
    parts = [base.withColumn(HALO, F.lit(False))]
    if before:
        parts.append(_edge_rows(base, line, before, True))
    if after:
        parts.append(_edge_rows(base, line, after, False))
    rows = reduce(DataFrame.unionByName, parts)
    window = Window.partitionBy(*line.keys, CHUNK).orderBy(*line.order)
    wide = rows.select("*", *[make(window).alias(name) for name, make in exprs.items()])
    return wide.filter(~F.col(HALO)).drop(HALO, CHUNK)


_RUNNING = {
    "sum": (F.sum, F.sum),
    "max": (F.max, F.max),
    "min": (F.min, F.min),
}


def running(
    df: DataFrame,
    line: Timeline,
    exprs: dict[str, tuple[str, Column]],
    *,
    reverse: bool = False,
    drop: Sequence[str] = (),
    late: bool = False,
) -> DataFrame:
    """Add running ``sum``/``max``/``min``/``last`` columns over each whole series up to the current row.

    ``last`` is the latest non-null value (forward fill); with ``reverse`` the
    series is walked backwards, so ``last`` becomes the next non-null value.
    ``drop`` names columns only the expressions need; ``late`` works the expressions
    out behind the shuffle, for those wider than what they read.
    """
    values = {name: f"_v_{i}" for i, name in enumerate(exprs)}
    kept = [f"`{c}`" for c in df.columns if c not in drop]
    found = [col.alias(values[name]) for name, (_, col) in exprs.items()]
    base = _shared(df.select(*kept), line).select("*", *found) if late else _shared(df.select(*kept, *found), line)
    at = _pack(list(line.order))
    totals = []
    for name, (kind, _) in exprs.items():
        v = F.col(values[name])
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            totals.append(pick(v, F.when(v.isNotNull(), at)).alias(values[name]))
        else:
            totals.append(_RUNNING[kind][0](v).alias(values[name]))
    summary = base.groupBy(*line.keys, CHUNK).agg(*totals, _whole([c for c in base.columns if not late or c not in values.values()])).filter(F.col("_whole").isNotNull())
    chunk_order = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
    earlier = Window.partitionBy(*line.keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)

    def over(kind: str, col: str, window: WindowSpec) -> Column:
        if kind == "last":
            return F.last(col, ignorenulls=True).over(window)
        return _RUNNING[kind][1](col).over(window)

    carried = summary.select(
        *line.keys,
        CHUNK,
        *[over(kind, values[name], earlier).alias(values[name]) for name, (kind, _) in exprs.items()],
    ).withColumn(HALO, F.lit(True)).repartition(*line.keys, CHUNK)
    rows = base.withColumn(HALO, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    inner = [F.col(c).desc() if reverse else F.col(c).asc() for c in line.order]
    window = (
        Window.partitionBy(*line.keys, CHUNK)
        .orderBy(F.col(HALO).desc(), *inner)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    wide = rows.select("*", *[over(kind, values[name], window).alias(name) for name, (kind, _) in exprs.items()])
    return wide.filter(~F.col(HALO)).drop(HALO, CHUNK, *values.values())


def previous(df: DataFrame, line: Timeline, **columns: str) -> DataFrame:
    """Previous row's values: ``previous(df, line, prev_ts="ts")``."""
    return framed(df, line, {name: (lambda w, c=c: F.lag(c).over(w)) for name, c in columns.items()})


def gap_islands(
    df: DataFrame,
    line: Timeline,
    gap: int | float | Column,
    *,
    end: str | None = None,
    name: str = "island",
    strict: bool = True,
) -> DataFrame:
    """Number runs along the first order column: a distance above ``gap`` to the row before starts a new one.

    Distances are taken from the previous row's ``end`` column when rows are
    disjoint spans, else from its position; ``strict=False`` also breaks at
    exactly ``gap``.  ``gap`` may be a column that is constant per series.

    Each chunk numbers its own runs.  Its summary (first position, last end,
    number of runs) tells, in one small window per series, how many runs came
    before it and whether its first row continues the last of them.
    """
    keys, at, stop = list(line.keys), line.order[0], end or line.order[0]
    limit = gap if isinstance(gap, Column) else F.lit(gap)

    def breaks(step: Column) -> Column:
        return (step > limit if strict else step >= limit).cast("long")

    base = _shared(df, line)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*line.order)
    step = F.col(at) - F.lag(stop).over(local)
    inner = base.withColumn("_new", F.coalesce(breaks(step), F.lit(0)))
    others = [F.first(c).alias(c) for c in df.columns if isinstance(gap, Column) and c not in keys and c not in line.order and c != end]
    summary = inner.groupBy(*keys, CHUNK).agg(
        F.min(at).alias("_first"), F.max(stop).alias("_last"), F.sum("_new").alias("_runs"), _whole(base.columns), *others
    ).filter(F.col("_whole").isNotNull())
    per_key = Window.partitionBy(*keys).orderBy(CHUNK)
    opened = summary.withColumn("_opens", F.coalesce(breaks(F.col("_first") - F.lag("_last").over(per_key)), F.lit(1)))
    before = F.sum(F.col("_runs") + F.col("_opens")).over(per_key.rowsBetween(Window.unboundedPreceding, -1))
    offsets = opened.select(*keys, CHUNK, (F.coalesce(before, F.lit(0)) + F.col("_opens")).alias("_offset"))
    number = F.col("_offset") + F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = inner.join(offsets, [*keys, CHUNK]) if keys else inner.join(offsets, CHUNK)
    return joined.withColumn(name, number).select(*df.columns, name)


#: Slots that one row is expanded to at once.
BLOCK_SLOTS = 10_000


def exploded_range(df: DataFrame, low: Column, high: Column, name: str, *, block: int = BLOCK_SLOTS) -> DataFrame:
    """A row per whole number from ``low`` to ``high``: blocks first, dealt out, then the numbers of each block.

    No array is longer than ``block``, or than the number of blocks' groups; a range of any length is spread over tasks.
    """
    rows = df.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).filter(F.col("_high") >= F.col("_low"))
    for width in (block * block, block):
        last = F.floor((F.col("_high") - F.col("_low")) / width).cast("long")
        rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumns({
            "_low": F.col("_low") + F.col("_b") * width, "_high": F.least(F.col("_high"), F.col("_low") + F.col("_b") * width + (width - 1))})
    rows = rows.repartition(*[F.col(f"`{c}`") for c in df.columns], "_low")
    return rows.withColumn(name, F.explode(F.sequence("_low", "_high"))).drop("_low", "_high", "_b")
