"""Temporal patterns and association rules.

Pair statistics never list pairs.  ``sweep_pairs`` walks time once: a first
event becomes active after the shortest allowed gap and retires after the
longest, and every second event reads the running count, sum and sum of squares
of the active ones.  Second events of all kinds walk beside one line of firsts.
Work is linear in events times vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .timeline import Timeline, framed, running

MINUTE = 60_000_000
# fixed values: names and upper bounds (minutes, exclusive) of the gap buckets
GAP_BUCKETS = [("immediate", 5), ("under_15min", 15), ("15_30min", 30), ("30_60min", 60), ("1_2hours", 120)]
WIDE = "decimal(38,0)"


def kind_pairs(df: DataFrame, keys: Sequence[str], kind: str, lo: int, hi: int, *, same: bool = False) -> DataFrame:
    """Ordered pairs of the event kinds that a series has, with a gap range: (keys, first, second, lo, hi, part)."""
    present = df.select(*keys, kind).distinct()
    pairs = present.withColumnRenamed(kind, "first").join(present.withColumnRenamed(kind, "second"), list(keys))
    pairs = pairs if same else pairs.filter(F.col("first") != F.col("second"))
    return pairs.withColumns({"lo": F.lit(lo).cast("long"), "hi": F.lit(hi).cast("long"), "part": F.lit(0)})


def sweep_pairs(df: DataFrame, keys: Sequence[str], at: str, kind: str, order: str, pairs: DataFrame, *, chunk: int) -> DataFrame:
    """One row per second event and pair with the first events ``lo <= gap <= hi`` before it.

    ``n`` of them, their gaps' ``total`` and ``squares`` (exact sums) and the ``nearest`` gap.  ``pairs`` may be per series
    (with the keys) or for all; how it is joined is left to its size.
    """
    per = [c for c in keys if c in pairs.columns]
    k, t = F.col(kind), F.col(at)
    # a first event enters and leaves once per gap range, whichever kinds come second; those with the same range share a line
    ids = [*keys, "first", "part", "lo", "hi"]
    ranges = pairs.select(*per, "first", "part", "lo", "hi").distinct()
    a = df.select(*keys, t.alias(at), k.alias("first"), order).join(ranges, [*per, "first"])
    b = df.select(*keys, t.alias(at), k.alias("second"), order).join(pairs, [*per, "second"])
    first = a.select(*ids, order, F.inline(F.array(
        F.struct((t + F.col("lo")).alias("_t"), F.lit(0).alias("_phase")),
        F.struct((t + F.col("hi")).alias("_t"), F.lit(2).alias("_phase")))), F.lit(None).cast(df.schema[kind].dataType).alias("second"))
    second = b.select(*ids, order, t.alias("_t"), F.lit(1).alias("_phase"), "second")
    rows = first.unionByName(second)
    line = Timeline(tuple(ids), ("_t", "_phase", order), F.floor(F.col("_t") / F.lit(chunk)))
    sign = F.when(F.col("_phase") == 0, 1).when(F.col("_phase") == 2, -1).otherwise(0)
    start = F.col("_t") - F.when(F.col("_phase") == 0, F.col("lo")).otherwise(F.col("hi"))
    x = F.when(F.col("_phase") == 1, F.lit(0)).otherwise(start).cast(WIDE)
    walked = running(rows, line, {
        "n": ("sum", sign.cast("long")),
        "_s": ("sum", (x * sign).cast(WIDE)),
        "_ss": ("sum", (x * x * sign).cast(WIDE)),
        "_last": ("max", F.when(F.col("_phase") == 0, start)),
    }, late=True)
    now = F.col("_t").cast(WIDE)
    n = F.col("n").cast(WIDE)
    hits = walked.filter((F.col("_phase") == 1) & (F.col("n") > 0))
    return hits.select(
        *keys, "first", "second", "part", F.col("_t").alias(at), order, "n",
        (n * now - F.col("_s")).cast("double").alias("total"),
        (n * now * now - 2 * now * F.col("_s") + F.col("_ss")).cast("double").alias("squares"),
        (F.col("_t") - F.col("_last")).alias("nearest"),
    )


def gap_statistics(hits: DataFrame, by: Sequence[str], unit: float = MINUTE) -> DataFrame:
    """Occurrences, mean, population deviation and smallest gap per pair, in units."""
    out = hits.groupBy(*by).agg(F.sum("n").alias("occurrences"), F.sum("total").alias("_t"), F.sum("squares").alias("_q"), F.min("nearest").alias("_m"))
    mean = F.col("_t") / F.col("occurrences") / unit
    var = F.col("_q") / F.col("occurrences") / (unit * unit) - mean * mean
    return out.select(*by, "occurrences", mean.alias("mean_gap"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std_gap"), (F.col("_m") / unit).alias("min_gap"))


def streaks(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Longest run of consecutive distinct days per key."""
    days = df.select(*keys, day).distinct()
    spot = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    return days.withColumn("_run", spot).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("streak"))


def bounded_gap_episodes(df: DataFrame, keys: Sequence[str], at: str, kind: str, order: str, *, gap: int, at_least: int, chunk: int) -> DataFrame:
    """Pairs of different kinds at most ``gap`` apart: every combination counts; statistics and longest day streak.

    Sums are kept per pair and day, then per run of consecutive days, so one
    pass yields both.
    """
    pair = ["first", "second"]
    hits = sweep_pairs(df, keys, at, kind, order, kind_pairs(df, keys, kind, 1, gap), chunk=chunk)
    sums = [F.sum(c).alias(c) for c in ("n", "total", "squares")] + [F.min("nearest").alias("nearest")]
    by_day = hits.groupBy(*pair, F.to_date(F.timestamp_micros(F.col(at))).alias("_day")).agg(*sums)
    run = F.date_sub(F.col("_day"), F.row_number().over(Window.partitionBy(*pair).orderBy("_day")))
    by_run = by_day.withColumn("_run", run).groupBy(*pair, "_run").agg(*sums, F.count(F.lit(1)).alias("streak"))
    longest = by_run.groupBy(*pair).agg(*sums, F.max("streak").alias("streak"))
    stats = gap_statistics(longest, [*pair, "streak"])
    return stats.filter(F.col("occurrences") >= at_least)


def triple_counts(df: DataFrame, keys: Sequence[str], at: str, kind: str, order: str, *, gap: int, at_least: int, chunk: int, shortest: int = 1) -> DataFrame:
    """Triples of different kinds whose neighbours are ``shortest`` to ``gap`` apart, extending frequent pairs.

    A middle event contributes (firsts before it) times (thirds after it); the
    thirds come from the same sweep on reversed time.
    """
    pairs = kind_pairs(df, keys, kind, shortest, gap)
    before = sweep_pairs(df, keys, at, kind, order, pairs, chunk=chunk)
    frequent = before.groupBy("first", "second").agg(F.sum("n").alias("_n")).filter(F.col("_n") >= at_least).select("first", "second")
    mirrored = df.withColumn(at, -F.col(at))
    after = sweep_pairs(mirrored, keys, at, kind, order, pairs, chunk=chunk)
    lead = before.join(frequent, ["first", "second"]).select(*keys, order, "first", F.col("second").alias("middle"), F.col("n").alias("_b"))
    tail = after.select(*keys, order, F.col("first").alias("third"), F.col("second").alias("middle"), F.col("n").alias("_a"))
    follow = frequent.select(F.col("first").alias("middle"), F.col("second").alias("third"))
    met = lead.join(tail.join(follow, ["middle", "third"]), [*keys, order, "middle"]).filter(F.col("first") != F.col("third"))
    return met.groupBy("first", "middle", "third").agg(F.sum(F.col("_a") * F.col("_b")).alias("occurrences")).filter(F.col("occurrences") >= at_least)


def same_day_triples(df: DataFrame, keys: Sequence[str], at: str, kind: str, order: str, day: str, *, lo: int, hi: int, at_least: int, chunk: int) -> DataFrame:
    """Triples of different kinds within one day, neighbours ``lo`` to ``hi`` apart."""
    return triple_counts(df, [*keys, day], at, kind, order, gap=hi, shortest=max(lo, 1), at_least=at_least, chunk=chunk)


def same_day_patterns(df: DataFrame, keys: Sequence[str], at: str, kind: str, order: str, day: str, *, lo: int, hi: int, at_least: int, chunk: int) -> DataFrame:
    """Pairs within a day by gap range: spread, share inside one deviation, consistency, support, lift and day streak.

    The share inside the band is a second sweep whose gap range is each pair's own band.
    """
    spark = df.sparkSession
    every = [*keys, day]
    hits = sweep_pairs(df, every, at, kind, order, kind_pairs(df, every, kind, max(lo, 1), hi, same=True), chunk=chunk)
    by = ["first", "second"]
    ensure_checkpoint_dir(spark)
    # one row per pair of kinds, needed twice
    fixed = gap_statistics(hits, by).filter(F.col("occurrences") >= at_least).checkpoint()
    low = F.ceil((F.col("mean_gap") - F.col("std_gap")) * MINUTE).cast("long")
    high = F.floor((F.col("mean_gap") + F.col("std_gap")) * MINUTE).cast("long")
    band_pairs = fixed.select(*by, F.greatest(low, F.lit(max(lo, 1))).alias("lo"), F.least(high, F.lit(hi)).alias("hi"), F.lit(0).alias("part"))
    inside = sweep_pairs(df, every, at, kind, order, band_pairs, chunk=chunk).groupBy(*by).agg(F.sum("n").alias("_in"))
    seen = hits.select(*by, *every).distinct()
    supported = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("_days"))
    present = df.select(*every, kind).distinct().groupBy(kind).agg(F.count(F.lit(1)).alias("_p"))
    # one row: number of (subject, day) groups
    total = df.select(*every).distinct().agg(F.count(F.lit(1))).first()[0]
    runs = streaks(seen.select(*by, day), by, day)
    first_p = present.select(F.col(kind).alias("first"), F.col("_p").alias("_pa"))
    second_p = present.select(F.col(kind).alias("second"), F.col("_p").alias("_pb"))
    out = fixed.join(inside, by, "left").join(supported, by).join(runs, by).join(first_p, "first").join(second_p, "second")
    return out.select(
        *by, "occurrences", "mean_gap", "std_gap", "min_gap",
        (F.coalesce("_in", F.lit(0)) / F.col("occurrences")).alias("band_share"),
        F.when(F.col("mean_gap") > 0, 1 - F.col("std_gap") / F.col("mean_gap")).otherwise(0.0).alias("consistency"),
        (F.col("_days") / total).alias("support"),
        (F.col("_days") * total / (F.col("_pa") * F.col("_pb"))).alias("lift"),
        "streak",
    )


def sliding_windows(df: DataFrame, keys: Sequence[str], at: str, *, size: int, step: int) -> DataFrame:
    """Rows repeated per window ``[start, start + size)``; windows start at each series' first event, every ``step``, before its last."""
    ends = df.groupBy(*keys).agg(F.min(at).alias("_first"), F.max(at).alias("_lastt"))
    joined = df.join(ends, list(keys))
    since = F.col(at) - F.col("_first")
    lo = F.greatest(F.floor((since - size) / step) + 1, F.lit(0)).cast("long")
    hi = F.least(F.floor(since / step), F.ceil((F.col("_lastt") - F.col("_first")) / step) - 1).cast("long")
    return joined.filter(lo <= hi).withColumn("window", F.explode(F.sequence(lo, hi))).drop("_first", "_lastt")


def window_episodes(df: DataFrame, keys: Sequence[str], at: str, kind: str, order: str, *, size: int, chunk: int, reach: int = 3) -> DataFrame:
    """Ordered pairs up to ``reach`` positions apart in overlapping windows (step a quarter of the size).

    Counted per occurrence and divided by non-empty windows, so support may
    exceed 1.  Gaps weigh every in-window pair by the window's occurrences.
    """
    every = [*keys, "window"]
    rows = sliding_windows(df.select(*keys, at, kind, order), keys, at, size=size, step=size // 4)
    line = Timeline(tuple(every), (at, order), F.floor(F.col(at) / F.lit(chunk)))
    ahead = framed(rows, line, {f"_k{i}": (lambda w, i=i: F.lead(kind, i).over(w)) for i in range(1, reach + 1)}, before=0, after=reach)
    pairs = ahead.select(*every, F.col(kind).alias("first"), F.explode(F.array(*[F.col(f"_k{i}") for i in range(1, reach + 1)])).alias("second")).filter("second IS NOT NULL")
    per = pairs.groupBy(*every, "first", "second").agg(F.count(F.lit(1)).alias("_occ"))
    gaps = sweep_pairs(rows, every, at, kind, order, kind_pairs(rows, every, kind, 1, size, same=True), chunk=chunk).groupBy(*every, "first", "second").agg(
        F.sum("n").alias("_n"), F.sum("total").alias("_t"), F.sum("squares").alias("_q"), F.min("nearest").alias("_m"))
    total = rows.select(*every).distinct().agg(F.count(F.lit(1))).first()[0]
    w = F.col("_occ")
    out = per.join(gaps, [*every, "first", "second"], "left").groupBy("first", "second").agg(
        F.sum(w).alias("occurrences"), F.sum(w * F.col("_n")).alias("_wn"), F.sum(w * F.col("_t")).alias("_wt"), F.sum(w * F.col("_q")).alias("_wq"), F.min("_m").alias("_min"))
    mean = F.try_divide(F.col("_wt"), F.col("_wn")) / MINUTE
    return out.select("first", "second", "occurrences", (F.col("occurrences") / total).alias("support"), mean.alias("mean_gap"),
                      F.sqrt(F.greatest(F.try_divide(F.col("_wq"), F.col("_wn")) / (MINUTE * MINUTE) - mean * mean, F.lit(0.0))).alias("std_gap"), (F.col("_min") / MINUTE).alias("min_gap"))


def window_triples(df: DataFrame, keys: Sequence[str], at: str, kind: str, order: str, *, size: int, chunk: int, reach: int = 3) -> DataFrame:
    """Ordered triples with neighbours up to ``reach`` positions apart, counted like the pairs.

    The middle position stops one short of the window's end, as positions after it must exist.
    """
    every = [*keys, "window"]
    rows = sliding_windows(df.select(*keys, at, kind, order), keys, at, size=size, step=size // 4)
    line = Timeline(tuple(every), (at, order), F.floor(F.col(at) / F.lit(chunk)))
    ahead = framed(rows, line, {f"_k{i}": (lambda w, i=i: F.lead(kind, i).over(w)) for i in range(1, 2 * reach + 1)}, before=0, after=2 * reach)
    spots = [(j, j + d) for j in range(1, reach + 1) for d in range(1, reach + 1)]
    triples = ahead.select(F.col(kind).alias("first"), F.inline(F.array(*[F.struct(F.col(f"_k{j}").alias("second"), F.col(f"_k{k}").alias("third")) for j, k in spots]))).filter("third IS NOT NULL")
    total = rows.select(*every).distinct().agg(F.count(F.lit(1))).first()[0]
    return triples.groupBy("first", "second", "third").agg(F.count(F.lit(1)).alias("occurrences")).withColumn("support", F.col("occurrences") / total)


def sliding_transactions(df: DataFrame, keys: Sequence[str], at: str, kind: str, order: str, *, size: int, chunk: int) -> DataFrame:
    """Item sets of half-overlapping windows: event kinds, and ``A_to_B_<bucket>`` for earlier events up to two hours before (in or out of the window)."""
    bounds, low = [], 1
    for i, (_, bound) in enumerate(GAP_BUCKETS):
        bounds.append((low, bound * MINUTE - 1, i))
        low = bound * MINUTE
    bounds.append((low, low, len(GAP_BUCKETS)))
    ranges = F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi"), F.lit(i).alias("part")) for a, b, i in bounds])
    pairs = kind_pairs(df, keys, kind, 1, 1, same=True).select(*keys, "first", "second", F.inline(ranges))
    names = F.array(*[F.lit(n) for n, _ in GAP_BUCKETS], F.lit("over_2hours"))
    hits = sweep_pairs(df, keys, at, kind, order, pairs, chunk=chunk)
    sequences = hits.select(*keys, at, order, F.concat_ws("_", "first", F.lit("to"), "second", F.element_at(names, F.col("part") + 1)).alias("item"))
    items = df.select(*keys, at, order, F.col(kind).alias("item")).unionByName(sequences)
    ends = df.select(*keys, at)
    span = ends.groupBy(*keys).agg(F.min(at).alias("_first"), F.max(at).alias("_lastt"))
    step = size // 2
    since = F.col(at) - F.col("_first")
    lo = F.greatest(F.floor((since - size) / step) + 1, F.lit(0)).cast("long")
    hi = F.least(F.floor(since / step), F.ceil((F.col("_lastt") - F.col("_first")) / step) - 1).cast("long")
    return items.join(span, list(keys)).filter(lo <= hi).select(*keys, F.explode(F.sequence(lo, hi)).alias("window"), "item").distinct()


def baskets(rows: DataFrame, keys: Sequence[str], item: str = "item") -> DataFrame:
    """One item set per key; its size is bounded by the vocabulary, not by the rows."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(item)).alias("items"))


def frequent_itemsets(transactions: DataFrame, items: str, min_support: float) -> tuple[DataFrame, int]:
    """Item sets of any size with their counts, and the number of transactions."""
    from pyspark.ml.fpm import FPGrowth

    total = transactions.count()
    found = FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=1.0).fit(transactions.select(items)).freqItemsets
    return found.select(F.sort_array("items").alias("items"), F.col("freq").cast("long").alias("freq")), total


def association_rules(itemsets: DataFrame, total: int, *, min_confidence: float = 0.0) -> DataFrame:
    """Every split of each frequent set into antecedent and consequent, with support, confidence and lift.

    A set of n items has 2^n - 2 splits, one per bit pattern.
    """
    patterns = F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, size(items)) - 2"))
    cut = itemsets.filter(F.size("items") >= 2).select("freq", "items", F.explode(patterns).alias("_bits"))

    def side(bit: int) -> Column:
        picked = F.filter("_marked", lambda m: m["bit"] == bit)
        return F.transform(picked, lambda m: m["item"])

    marked = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.getbit(F.col("_bits"), i).cast("int").alias("bit")))
    cut = cut.withColumn("_marked", marked).select("freq", side(1).alias("antecedent"), side(0).alias("consequent"))
    a = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("_fa"))
    c = itemsets.select(F.col("items").alias("consequent"), F.col("freq").alias("_fc"))
    rules = cut.join(a, "antecedent").join(c, "consequent")
    confidence = F.col("freq") / F.col("_fa")
    return rules.select("antecedent", "consequent", (F.col("freq") / total).alias("support"), confidence.alias("confidence"),
                        (confidence / (F.col("_fc") / total)).alias("lift")).filter(F.col("confidence") >= min_confidence)


def rules_for(rules: DataFrame, outcome: Column, *, interventions: Sequence[str] | None = None) -> DataFrame:
    """Rules whose consequent is the outcome; antecedents may be restricted to a list of interventions."""
    out = rules.filter(F.size("consequent") == 1).filter(outcome)
    if interventions is not None:
        allowed = F.array(*map(F.lit, interventions))
        out = out.filter(F.size(F.array_except("antecedent", allowed)) == 0)
    return out


# fixed values: how each gap bucket reads between two events
BUCKET_TEXT = {
    "immediate": " immediately followed by ", "under_15min": " followed within 15 minutes by ", "15_30min": " followed 15-30 minutes later by ",
    "30_60min": " followed 30-60 minutes later by ", "1_2hours": " followed 1-2 hours later by ", "over_2hours": " followed over 2 hours later by ",
}


def readable_item(item: Column) -> Column:
    """``a_to_b_<bucket>`` as a phrase; other items stay."""
    text = item
    for bucket, words in BUCKET_TEXT.items():
        hit = item.contains("_to_") & item.endswith(f"_{bucket}")
        text = F.when(hit, F.regexp_replace(F.regexp_replace(item, f"_{bucket}$", ""), "_to_", words)).otherwise(text)
    return text


def top_rules(rules: DataFrame, n: int) -> DataFrame:
    """The ``n`` rules of highest lift as readable text."""
    said = lambda side: F.array_join(F.transform(side, readable_item), " and ")
    text = F.format_string("When %s then %s (confidence %.1f%%, lift %.2f)", said("antecedent"), said("consequent"), F.col("confidence") * 100, F.col("lift"))
    return rules.withColumn("text", text).orderBy(F.desc("lift"), F.desc("confidence"), F.col("text")).limit(n)


def equal_width_bins(df: DataFrame, value: str, k: int, name: str = "bin") -> DataFrame:
    """Right-closed equal-width bins ``1..k``; the smallest value belongs to the first (one aggregate row, broadcast)."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one")
    at = F.ceil((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / k))
    return joined.withColumn(name, F.least(F.greatest(at, F.lit(1)), F.lit(k)).cast("int")).drop("_lo", "_hi", "_one")


def named_bands(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the right-closed band between two edges, null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(edges[:-1], edges[1:], names))):
        out = F.when((value > lo) & (value <= hi), name).otherwise(out)
    return out


def indicator_items(df: DataFrame, ids: Sequence[str], columns: Sequence[str], above: float = 0.5) -> DataFrame:
    """Items of a wide row: columns above ``above``; a missing value is replaced by the column mean and adds ``<column>_missing``."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns]).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(means), "_one")
    items = []
    for c in columns:
        items += [F.when(F.coalesce(F.col(c), F.col(f"_m_{c}")) > above, F.lit(c)), F.when(F.col(c).isNull(), F.lit(f"{c}_missing"))]
    return joined.select(*ids, F.array_compact(F.array(*items)).alias("items"))


def widest_intervals(df: DataFrame, columns: Sequence[str], min_support: float) -> DataFrame:
    """Per column the maximal value interval with enough support.

    For each low bound the widest interval reaches the largest value, and the
    one from the smallest value contains all others.
    """
    n = F.count(F.lit(1))
    cells = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), (F.count(c) / n).alias("support")) for c in columns]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c")).filter(F.col("support") >= min_support)
