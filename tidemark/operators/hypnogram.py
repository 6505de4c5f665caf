"""Staged epochs: channel choice, transitions, agreement, wake logic, night features.

Epoch tables hold one row per (recording, epoch), so a recording's rows are
bounded by the calendar (2,880 epochs of 30 s a day) however skewed the samples
below them are.  Plain windows per recording are safe here; everything that
touches samples or events walks a chunked timeline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import Timeline, running

# fixed values: stage labels and their integers
STAGES = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "R": 4}

def stage_to_int(stage: Column) -> Column:
    return F.create_map(*[x for k, v in STAGES.items() for x in (F.lit(k), F.lit(v))])[stage]


def best_channel(df: DataFrame, keys: Sequence[str], channel: str, stage: str, confidence: str, rank: Column) -> DataFrame:
    """Per key the stage of the most confident channel; ties keep the lowest ``rank``; zero, NaN and null never win."""
    c = F.nanvl(F.col(confidence), F.lit(None).cast("double"))
    valid = c > 0
    pick = F.min_by(
        F.when(valid, F.struct(F.col(stage).alias("stage"), c.alias("confidence"), F.col(channel).alias("source"))),
        F.when(valid, F.struct(-c, rank)),
    )
    return df.groupBy(*keys).agg(pick.alias("_best")).select(*keys, "_best.stage", "_best.confidence", "_best.source")


def transitions(df: DataFrame, keys: Sequence[str], order: str, stage: str = "stage") -> DataFrame:
    """Counts of (stage, next stage) per recording and their share of the first stage."""
    moved = df.withColumn("_to", F.lead(stage).over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_to").isNotNull())
    counts = moved.groupBy(*keys, F.col(stage).alias("from_stage"), F.col("_to").alias("to_stage")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "from_stage"))
    return counts.withColumn("share", share)


def stability(moves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half-even rounded diagonal of the transition shares per stage, and its mean over deep stages and over all sleep stages."""
    at = stage_to_int(F.col("from_stage"))
    diagonal = moves.groupBy(*keys, "from_stage").agg(
        F.sum(F.when(F.col("from_stage") == F.col("to_stage"), F.col("share")).otherwise(0.0)).alias("d")
    )
    return diagonal.groupBy(*keys).agg(
        F.bround(F.avg(F.when(at >= 2, F.col("d"))), 3).alias("any_stage"),
        *[F.bround(F.max(F.when(F.col("from_stage") == s, F.col("d"))), 3).alias(n) for s, n in
          [("W", "wake"), ("N1", "n1"), ("N2", "n2"), ("N3", "n3"), ("R", "rem")]],
        F.bround(F.avg(F.when(at >= 1, F.col("d"))), 3).alias("sleep"),
    )


def sleep_statistics(df: DataFrame, keys: Sequence[str], epoch: str = "epoch", stage: str = "stage", minutes: float = 0.5) -> DataFrame:
    """Totals, latencies and efficiency per recording from stage labels; null stages are ignored."""
    staged = df.filter(F.col(stage).isNotNull())
    e, s = F.col(epoch), F.col(stage)
    bounds = staged.groupBy(*keys).agg(
        F.min(e).alias("_first"),
        F.min(F.when(s != "W", e)).alias("_onset"),
        F.max(F.when(s != "W", e)).alias("_offset"),
        *[F.min(F.when(s == x, e)).alias(f"_at_{x}") for x in STAGES if x != "W"],
        *[F.count(F.when(s == x, 1)).alias(f"_n_{x}") for x in STAGES],
    )
    inside = staged.filter(s == "W").join(bounds.select(*keys, "_onset", "_offset"), list(keys))
    waso = inside.filter((e > F.col("_onset")) & (e < F.col("_offset"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("_waso"))
    m = F.lit(minutes)
    tst = sum((F.col(f"_n_{x}") for x in STAGES if x != "W"), F.lit(0)) * m
    tib = tst + F.col("_n_W") * m
    waso_min = F.coalesce("_waso", F.lit(0)) * m
    return bounds.join(waso, list(keys), "left").select(
        *keys,
        tib.alias("tib"),
        tst.alias("tst"),
        waso_min.alias("waso"),
        (100 * tst / tib).alias("efficiency"),
        F.try_divide(100 * tst, tst + waso_min).alias("maintenance"),
        ((F.col("_onset") - F.col("_first")) * m).alias("onset_latency"),
        *[((F.col(f"_at_{x}") - F.col("_first")) * m).alias(f"latency_{x.lower()}") for x in STAGES if x != "W"],
        *[(F.col(f"_n_{x}") * m).alias(f"minutes_{x.lower()}") for x in STAGES],
        *[F.try_divide(100 * F.col(f"_n_{x}") * m, tst).alias(f"percent_{x.lower()}") for x in STAGES if x != "W"],
    )


def channels_side_by_side(df: DataFrame, keys: Sequence[str], channel: str, channels: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Outer merge of per-channel rows: one row per key with ``<channel>_<column>``."""
    return df.filter(F.col(channel).isin(*channels)).groupBy(*keys).agg(
        *[F.max(F.when(F.col(channel) == ch, F.col(c))).alias(f"{ch}_{c}") for ch in channels for c in columns]
    )


def _differ(a: Column, b: Column) -> Column:
    # a missing label differs from everything, itself included
    return F.coalesce(a != b, F.lit(True))


def disagreement(wide: DataFrame, first: str, second: str, thresholds: Sequence[float] = (0.05, 0.10, 0.20)) -> DataFrame:
    """How often two channels differ and the first is more confident by each threshold; percents are of all epochs."""
    apart = _differ(F.col(f"{first}_stage"), F.col(f"{second}_stage"))
    total = F.count(F.lit(1))
    out = []
    for t in thresholds:
        over = F.col(f"{first}_confidence") > F.col(f"{second}_confidence") + t
        tag = f"{round(t * 100):02d}"
        out += [F.count_if(apart & over).alias(f"over_{tag}"), (F.count_if(apart & over) / total * 100).alias(f"over_{tag}_pct")]
    return wide.agg(total.alias("epochs"), F.count_if(apart).alias("differ"), (F.count_if(apart) / total * 100).alias("differ_pct"), *out).select(
        F.lit(f"{first}-{second}").alias("channels"), "*"
    )


def triple_agreement(wide: DataFrame, channels: Sequence[str], thresholds: Sequence[float] = (0.05, 0.10, 0.20)) -> DataFrame:
    """Agreement of every ordered channel triple: one pass, all triples unpacked from one aggregate row."""
    from itertools import permutations

    structs = []
    total = F.count(F.lit(1))
    for a, b, c in permutations(channels, 3):
        sa, sb, sc = (F.col(f"{x}_stage") for x in (a, b, c))
        ca, cb, cc = (F.col(f"{x}_confidence") for x in (a, b, c))
        apart = _differ(sa, sb)
        backed = F.coalesce(sa == sc, F.lit(False)) & apart
        fields = [F.lit(f"{a}-{b}-{c}").alias("channels"), total.alias("epochs"), F.count_if(apart).alias("differ"),
                  F.count_if(backed).alias("third_agrees"), F.count_if((sa == sc) & (sa == sb)).alias("all_agree")]
        for t in thresholds:
            tag = f"{round(t * 100):02d}"
            fields += [
                F.count_if(apart & (ca > cb + t)).alias(f"over_{tag}"),
                F.count_if(apart & (ca > cb + t) & (sa == sc)).alias(f"over_{tag}_backed"),
                F.count_if(backed & ((ca > cb + t) | (cc > cb + t))).alias(f"either_{tag}"),
            ]
        structs.append(F.struct(*fields))
    return wide.agg(F.array(*structs).alias("_t")).select(F.inline("_t"))


def confident_wake(df: DataFrame, keys: Sequence[str], order: str, stage: str = "stage", confidence: str = "confidence", level: float = 0.75) -> DataFrame:
    """True where the row and both neighbours are wake with at least ``level`` confidence; ends are false."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_sure", F.coalesce((F.col(stage) == "W") & (F.col(confidence) >= level), F.lit(False)))
    wake = F.col("_sure") & F.lag("_sure", 1, False).over(w) & F.lead("_sure", 1, False).over(w)
    return marked.withColumn("probably_awake", wake).drop("_sure")


def events_per_epoch(epochs: DataFrame, events: DataFrame, keys: Sequence[str], epoch_at: str, event_at: str,
                     manual: tuple[Column, Column] | None = None) -> DataFrame:
    """Epochs with the events in ``[start, next start)``, listed and summarised, and whether they prove wake.

    The last epoch has no end: its list is empty but any later event proves wake. Without a list for it, an epoch's
    events are bounded by its length.
    """
    ends = epochs.withColumn("_end", F.lead(epoch_at).over(Window.partitionBy(*keys).orderBy(epoch_at)))
    # the epoch an event falls into is the last one starting at or before it
    rows = events.select(*keys, F.col(event_at).alias("_at"), F.lit(1).alias("_side")).unionByName(
        ends.select(*keys, F.col(epoch_at).alias("_at"), F.lit(0).alias("_side"), F.col("_end").isNull().alias("_last")), allowMissingColumns=True)
    walk = Timeline(tuple(keys), ("_at", "_side"), F.floor(F.col("_at") / (86_400 * 1_000_000)))
    placed = running(rows, walk, {"_epoch_at": ("last", F.when(F.col("_side") == 0, F.col("_at"))), "_open": ("last", F.when(F.col("_side") == 0, F.col("_last")))}).filter(
        (F.col("_side") == 1) & F.col("_epoch_at").isNotNull())
    hits = placed.groupBy(*keys, F.col("_epoch_at").alias(epoch_at)).agg(
        F.count(F.lit(1)).alias("_hits"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi"),
        F.sort_array(F.collect_list(F.when(~F.coalesce(F.col("_open"), F.lit(False)), F.col("_at")))).alias("_list"))
    joined = ends.join(hits, [*keys, epoch_at], "left")
    inner = F.col("_end").isNotNull()
    any_hit = F.coalesce(F.col("_hits") > 0, F.lit(False))
    by_hand = F.lit(False)
    if manual is not None:
        by_hand = F.coalesce(inner & (F.col(epoch_at) >= manual[0]) & (F.col("_end") <= manual[1]), F.lit(False))
    return joined.withColumns({
        "event_count": F.when(inner, F.coalesce("_hits", F.lit(0))).otherwise(0).cast("long"),
        "event_times": F.when(inner, F.coalesce("_list", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>")),
        "first_event": F.when(inner, F.col("_lo")),
        "last_event": F.when(inner, F.col("_hi")),
        "definitely_awake": any_hit | by_hand,
    }).drop("_end", "_hits", "_lo", "_hi", "_list")


def away_from(df: DataFrame, keys: Sequence[str], at: str, flag: Column, reach: int, name: str = "probably_asleep") -> DataFrame:
    """True unless a flagged row lies within ``reach`` of the row, both bounds included; marks do not cascade."""
    near = Window.partitionBy(*keys).orderBy(at).rangeBetween(-reach, reach)
    return df.withColumn(name, ~F.coalesce(F.bool_or(flag).over(near), F.lit(False)))


def stage_flags(df: DataFrame, stage: str = "stage") -> DataFrame:
    """Stage and period flags; a comparison with a missing minute column is false, and its negation true."""
    s = F.col(stage)

    def known(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    pre = known(F.col("mins_since_ready") <= 0)
    after = known(F.col("mins_since_asleep") >= 0)
    final = known(F.col("mins_until_wake") < 0)
    during = after & ~final
    return df.withColumns({
        "ss_deep": known(s == "N3"), "ss_wake": known(s == "W"), "ss_n1": known(s == "N1"), "ss_n2": known(s == "N2"), "ss_r": known(s == "R"),
        "ss_pre_ready": pre,
        "ss_after_sleep": after,
        "ss_during_ready": pre & ~after,
        "ss_after_final_wake": final,
        "ss_during_sleep": during,
        "ss_wake_during_sleep": during & known(s == "W"),
    })


def long_runs(df: DataFrame, keys: Sequence[str], order: str, flag: Column, *, counts: Column | None = None, max_gap: int = 7, min_length: int = 60,
              name: str = "in_long_run") -> DataFrame:
    """Mark runs of flagged epochs, bridging up to ``max_gap`` unflagged ones, that span at least ``min_length`` epochs.

    ``counts`` says which flagged epochs may extend a run (for instance those in
    the right hours); other flagged epochs neither extend nor break it.  Bridged
    epochs count towards the length and are marked too.  All windows share one
    shuffle on ``keys``.
    """
    on = F.coalesce(flag, F.lit(False))
    use = F.col("_use")
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    run = Window.partitionBy(*keys, "_run")
    placed = df.withColumns({"_use": on & (F.coalesce(counts, F.lit(False)) if counts is not None else F.lit(True)), "_off": ~on}).withColumns({
        "_pos": F.row_number().over(w),
        "_offs": F.count_if("_off").over(upto),
    })
    # unflagged epochs since the last usable one: what a run would have to bridge
    gap = F.col("_offs") - F.col("_last")
    near = F.coalesce(gap <= max_gap, F.lit(False))
    numbered = (
        placed.withColumn("_last", F.last(F.when(use, F.col("_offs")), ignorenulls=True).over(before))
        .withColumn("_gap", F.when(use & near, gap).otherwise(0))
        .withColumn("_run", F.count_if(use & ~near).over(upto))
    )
    # a run's length: usable epochs plus the ones bridged between them
    sized = numbered.withColumn("_long", (F.count_if("_use").over(run) + F.sum("_gap").over(run)) >= min_length)
    ahead = F.first(F.when(use, F.struct(F.col("_pos").alias("pos"), F.col("_gap").alias("gap"), F.col("_long").alias("keep"))), ignorenulls=True).over(after)
    return (
        sized.withColumn("_next", ahead)
        .withColumn(name, F.coalesce(F.col("_next.keep") & (F.col("_pos") >= F.col("_next.pos") - F.col("_next.gap")), F.lit(False)))
        .drop("_use", "_off", "_pos", "_offs", "_last", "_gap", "_run", "_long", "_next")
    )


def minutes_until_first(df: DataFrame, keys: Sequence[str], at: str, flag: str, *, per_minute: int = 60_000_000, none: float = -1.0) -> DataFrame:
    """Per group: minutes to the first flagged row, whether there is one, and whether the row lies before it.

    The group's first flagged time is one aggregate row, joined back, so no group is held in a task.
    """
    first = df.filter(F.col(flag)).groupBy(*keys).agg(F.min(at).alias("_first"))
    joined = df.join(first, list(keys), "left")
    minutes = (F.col("_first") - F.col(at)) / per_minute
    return joined.withColumns({
        "mins_until_first": F.coalesce(minutes, F.lit(none)),
        "group_has_any": F.col("_first").isNotNull(),
        "is_before_first": F.coalesce(minutes > 0, F.lit(False)),
    }).drop("_first")


def anchor_features(df: DataFrame, days: DataFrame, keys: Sequence[str], at: str, *, per_minute: int = 60_000_000) -> DataFrame:
    """Minutes relative to the day's anchors and the closed-interval period flags around them.

    ``days`` holds ``asleep``, ``ready``, ``in_bed``, ``lep`` and ``wake`` in the
    unit of ``at``.  Neighbouring hour bands share their boundary.  A day
    without a record fails the job.
    """
    joined = df.join(days.withColumn("_has_day", F.lit(True)), list(keys), "left")
    checked = F.when(F.col("_has_day").isNull(), F.raise_error(F.lit("no day record for an epoch's night"))).otherwise(F.col(at))
    joined = joined.withColumn(at, checked)
    t = F.col(at)

    def since(anchor: str) -> Column:
        return (t - F.col(anchor)) / per_minute

    def flag(c: Column) -> Column:
        return c.cast("int")

    columns = {
        "mins_since_asleep": since("asleep"), "mins_since_ready": since("ready"), "mins_since_in_bed": since("in_bed"),
        "mins_since_lep": since("lep"), "mins_until_wake": -since("wake"),
    }
    for m in (15, 30, 60):
        columns[f"before_sleep_{m}"] = flag(since("asleep").between(-m, 0))
        columns[f"before_ready_{m}"] = flag(since("ready").between(-m, 0))
    for lo, label in ((0, "1_to_2"), (2, "3_to_4"), (4, "5_to_6"), (6, "7_to_8")):
        columns[f"sleep_hour_{label}"] = flag(since("asleep").between(lo * 60, (lo + 2) * 60))
    columns["during_ready"] = flag(t.between(F.col("ready"), F.col("asleep")))
    return joined.withColumns(columns).drop("_has_day", "asleep", "ready", "in_bed", "lep", "wake")


def within_targets(df: DataFrame, minutes: Column, horizons: Sequence[int]) -> DataFrame:
    """One boolean per horizon: the event comes in more than 0 and at most N minutes."""
    return df.withColumns({f"within_{n}": F.coalesce((minutes > 0) & (minutes <= n), F.lit(False)) for n in horizons})
