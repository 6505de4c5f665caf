"""Profiles of missing and odd values, and the clean-up steps before modelling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.local import local_table
from ..functions.values import known_of, with_known
from .quantiles import exact_quantiles

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _unpack(row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    return row.select(F.inline(F.array(*structs)))


def missing_profile(df: DataFrame, columns: Sequence[str], day: str | None = None) -> DataFrame:
    """Present, missing (null or NaN) and percent missing per column (one pass); with ``day`` also the first and last day missing."""
    df = with_known(df, list(columns))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        aggs.append(F.count(_q(c)).alias(f"_p{i}"))
        if day:
            aggs += [F.min(F.when(_q(c).isNull(), F.col(day))).alias(f"_f{i}"), F.max(F.when(_q(c).isNull(), F.col(day))).alias(f"_l{i}")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    structs = []
    for i, c in enumerate(columns):
        fields = [F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"_p{i}").alias("present"), (F.col("_n") - F.col(f"_p{i}")).alias("missing"),
                  F.round((F.col("_n") - F.col(f"_p{i}")) / F.col("_n") * 100, 1).alias("missing_pct")]
        if day:
            fields += [F.col(f"_f{i}").alias("first_missing"), F.col(f"_l{i}").alias("last_missing")]
        structs.append(F.struct(*fields))
    return _unpack(df.agg(*aggs), structs)


def require_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows; the job fails on the first row with a null or NaN in one of the columns."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | known_of(df, c).isNull()
    first = columns[0]
    checked = F.when(bad, F.raise_error(F.lit("missing values in a column that must be complete")).cast(df.schema[first].dataType)).otherwise(_q(first))
    return df.withColumn(first, checked)


def negative_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    df = with_known(df, list(columns))
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(_q(c)).alias(f"_n{i}"), F.count_if(_q(c) < 0).alias(f"_k{i}"), F.min(_q(c)).cast("double").alias(f"_m{i}")]
    return _unpack(df.agg(*aggs), [
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n"), F.col(f"_k{i}").alias("negatives"),
                 F.round(F.try_divide(F.col(f"_k{i}") * 100, F.col(f"_n{i}")), 1).alias("negative_pct"), F.col(f"_m{i}").alias("min")) for i, c in enumerate(columns)])


def null_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows share each combination of missing columns: at most ``2 ** columns`` and at most the rows, usually few."""
    return df.groupBy(*[known_of(df, c).isNull().alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("_rows"))


def sequential_removal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows lost per column when incomplete rows are removed column by column, best covered first."""
    coverage = df.agg(*[F.count(_q(c)).alias(c) for c in columns]).first()
    order = sorted(columns, key=lambda c: -coverage[c])
    first_gap = F.array_position(F.array(*[_q(c).isNull() for c in order]), True)
    lost = df.select(first_gap.alias("_at")).filter("_at > 0").groupBy("_at").agg(F.count(F.lit(1)).alias("_k"))
    steps = local_table(df.sparkSession, [(c, i + 1) for i, c in enumerate(order)], "column string, step int")
    joined = steps.join(lost, F.col("step") == F.col("_at"), "left").select("column", "step", F.coalesce("_k", F.lit(0)).alias("removed"))
    # one row per column
    return joined.withColumn("cumulative_removed", F.sum("removed").over(Window.orderBy("step")))


def greedy_removal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows lost when columns are completed in the order that costs fewest rows next; free columns go first together.

    The table is read once, into counts per missing-pattern; every later step
    aggregates those counts only.  They stay cached while it runs; a lost part is counted again.
    """
    spark = df.sparkSession
    patterns = null_patterns(df, columns)
    patterns = patterns.persist()
    try:
        return _greedy(spark, patterns, columns)
    finally:
        patterns.unpersist()


def _greedy(spark: SparkSession, patterns: DataFrame, columns: Sequence[str]) -> DataFrame:
    total = patterns.agg(F.sum("_rows")).first()[0] or 0
    left, gone, out = list(columns), 0, []
    while left:
        counts = patterns.agg(*[F.coalesce(F.sum(F.when(_q(c), F.col("_rows"))), F.lit(0)).alias(c) for c in left]).first()
        free = [c for c in left if counts[c] == 0]
        if free:
            out += [(c, 0, gone) for c in free]
            left = [c for c in left if c not in free]
            continue
        pick = min(left, key=lambda c: counts[c])
        gone += counts[pick]
        out.append((pick, counts[pick], gone))
        patterns = patterns.filter(~_q(pick))
        left.remove(pick)
    rows = [(i + 1, c, int(k), round(k / total * 100, 1) if total else 0.0, int(g), round(g / total * 100, 1) if total else 0.0) for i, (c, k, g) in enumerate(out)]
    return local_table(spark, rows, "step int, column string, removed long, removed_pct double, cumulative_removed long, cumulative_pct double")


def prefix_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column count, present and missing cells per first segment of the column names."""
    profile = missing_profile(df, columns)
    by = profile.groupBy(F.split("column", ":")[0].alias("prefix"))
    out = by.agg(F.count(F.lit(1)).alias("column_count"), F.sum("present").alias("present_count"), F.sum("missing").alias("missing_count"))
    return out.withColumn("missing_pct", F.round(F.col("missing_count") * 100 / (F.col("present_count") + F.col("missing_count")), 1))


def row_prefix_coverage(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Row count, present and missing cells per first segment of a row key."""
    present = sum((F.count(_q(c)) for c in columns), F.lit(0))
    out = df.groupBy(F.split(key, ":")[0].alias("prefix")).agg(F.count(F.lit(1)).alias("row_count"), present.alias("present_count"))
    missing = F.col("row_count") * len(columns) - F.col("present_count")
    return out.withColumn("missing_count", missing).withColumn("missing_pct", F.round(missing * 100 / (F.col("row_count") * len(columns)), 1))


# ---- column choice by name: decided on the driver from the schema, executed as a projection

# fixed values: how a name is tested ("prefix", "exact", "part", "suffix") and with what; admitting rules, then rejecting ones
FEATURE_SOURCES: dict[str, tuple[tuple[tuple[str, str], ...], tuple[tuple[str, str], ...]]] = {
    "eeg": ((("part", "Main_eeg"),), (("suffix", "_s"), ("part", "perm"), ("part", "svdent"))),
    "eeg_no_future": ((("part", "Main_eeg"),), (("suffix", "_s"), ("part", "perm"), ("part", "svdent"), ("part", "_c7min_"))),
    "best_eeg": ((("part", "Main_eeg"),), (("suffix", "_s"), ("part", "perm"), ("part", "svdent"), ("part", "kurt"), ("part", "skew"), ("part", "petrosian"))),
    "eeg_easiest": ((("part", "Main_eeg"),), (("suffix", "_s"), ("part", "perm"), ("part", "svdent"), ("part", "kurt"), ("part", "skew"), ("part", "petrosian"),
                                              ("part", "_c7min_"), ("part", "_p2min"), ("part", "hcomp"), ("part", "hmob"), ("part", "std"))),
    "physical": ((("prefix", "HR"), ("prefix", "Hrv"), ("exact", "O2"), ("prefix", "Movement"), ("prefix", "Temp")), ()),
    "temp": ((("prefix", "Temp"),), ()),
    "times": ((("prefix", "minsSince"), ("prefix", "minsUntil"), ("any case prefix", "epoch")), ()),
    "sleep_stage": ((("prefix", "SS"),), ()),
    "sleep_stage_no_times": ((("prefix", "SS"),), (("part", "MinsUntil"), ("part", "MinsSince"))),
    "microwakings": ((("part", "Microwakings"),), (("part", "MicrowakingsDbg"),)),
    "literally_all": ((("prefix", ""),), ()),
}
# fixed values: day keys that are of no use; a rule is one test or several that must all hold
USELESS_DAY_KEYS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("exact", "night:yasaExtended:Statistics:SE"),),
    (("exact", "night:yasaExtended:Statistics:TIB"),),
    (("prefix", "night:yasaExtended:Statistics:Lat_"),),
    (("prefix", "night:"), ("part", "_s:")),
    (("prefix", "night:"), ("part", "source:")),
    (("prefix", "night:"), ("part", ":W:")),
    (("prefix", "night:"), ("part", ":All:")),
    (("prefix", "night:yasaExtended:Stability:Aggregated:Deep"),),
    (("exact", "night:yasa:adjusted:debug:discardedMicrowakingsCount"),),
)
# fixed values: sources of day keys; admitting rules, then rejecting ones, a rule being one test or several that must all hold
DAY_SOURCES: dict[str, tuple[tuple[tuple[tuple[str, str], ...], ...], tuple[tuple[tuple[str, str], ...], ...]]] = {
    "days": (((("prefix", "sunrise:"),), (("prefix", "date:"),), (("exact", "weather:pressureAfternoon"),)), ()),
    "physical": (((("prefix", "hr:"),), (("prefix", "hrv:"),), (("prefix", "o2:"),), (("prefix", "movement:"),), (("prefix", "diastolic:"),), (("prefix", "systolic:"),),
                  (("prefix", "glucose:"),), (("prefix", "circadian:combined:"),), (("prefix", "coreBodyTemp:"),)), ()),
    "yasa": (((("prefix", "night:"), ("part", "yasa")),), ((("part", "finalWakeModel"),), (("part", "-M1:"),))),
    "literally_all": (((("prefix", ""),),), ()),
}
# fixed values: day keys that no source admits
DENIED_DAY_KEYS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("exact", "night:yasaExtended:Stability:Aggregated:De ep"),),
    (("suffix", "_s"),),
    (("part", "_s:"),),
    (("part", "Prediction"), ("part", "Error")),
    (("exact", "night:yasaExtended:Statistics:SE"),),
    (("exact", "night:yasaExtended:Statistics:TIB"),),
    (("prefix", "night:yasaExtended:Statistics:Lat_"),),
    (("part", "discardedMicrowakingsCount"),),
)
# fixed values: day keys by how far they are under the person's control
CONTROLLED_DAY_KEYS: dict[str, tuple[tuple[str, str], ...]] = {
    "fully": (("prefix", "drugsAndSupplements"), ("exact", "night:aggregated:gotIntoBedTimeSSM"), ("prefix", "exercise"), ("prefix", "sunExposure"),
              ("prefix", "bedroomEnvironment"), ("prefix", "phoneUsage"), ("prefix", "events"), ("prefix", "food"), ("prefix", "oxa")),
    "somewhat": (("part", "asleepTimeSSM"), ("part", "hasYasa"), ("suffix", "readyToSleepTimeSSM"), ("part", "pees"), ("part", "fitbit:heartrate"), ("prefix", "hr")),
}
# fixed values: curated day keys and their titles
CURATED_DAY_KEYS: dict[str, tuple[tuple[str, str], ...]] = {
    "sleep_architecture": (("night:yasa:adjusted:betweenAsleepAndWakeSecs", "Asleep to Wake"), ("night:aggregated:wakeTimeSSM", "Wake Time")),
    "physical": (("coreBodyTemp:AsleepToAwake:percentile10", "Core Body Temp Low"), ("coreBodyTemp:AsleepToAwake:percentile90", "Core Body Temp High"),
                 ("coreBodyTemp:AsleepToAwake:mean", "Core Body Temp Mean"), ("hr:AsleepToAwake:mean", "HR"), ("hrv:AsleepToAwake:mean", "HRV"),
                 ("o2:AsleepToAwake:mean", "O2"), ("o2:AsleepToAwake:percentile10", "O2 Low"), ("o2:AsleepToAwake:percentile90", "O2 High"),
                 ("movement:AsleepToAwake:mean", "Movement"), ("glucose:AsleepToAwake:mean", "Glucose"), ("diastolic:AsleepToAwake:mean", "Diastolic"),
                 ("systolic:AsleepToAwake:mean", "Systolic")),
    "wakings": (("night:aggregated:microwakingsPerHour", "Microwakings"), ("night:yasa:adjusted:wakingsWithDurationCount", "Wakings"),
                ("night:yasa:adjusted:timeAwakeAfterSleepSecs", "Time Awake After Sleep")),
    "next_day_energy": (("energy:energyScore", "Energy"),),
    "settling": (("night:aggregated:asleepTimeSSM", "Asleep Time"), ("night:aggregated:betweenReadyToSleepAndAsleepSecs", "RTS to Asleep")),
}
# fixed values: per stage the words its keys use (amount, stability, microwakings), and the measures all stages have
STAGE_WORDS = {"N1": ("n1", "N1", None), "N2": ("light", "N2", None), "N3": ("deep", "N3", "Deep"), "R": ("rem", "REM", "Rem"), "Sleep": (None, "Sleep", None)}
STAGE_MEASURES = (
    ("iqr", "Power"), ("auc", "AUC"), ("higuchi", "Complexity"),
    ("sdelta", "Sdelta"), ("fdelta", "Fdelta"), ("theta", "Theta"), ("alpha", "Alpha"), ("sigma", "Sigma"), ("beta", "Beta"),
    ("sdeltaabs", "SdeltaAbs"), ("fdeltaabs", "FdeltaAbs"), ("thetaabs", "ThetaAbs"), ("alphaabs", "AlphaAbs"), ("sigmaabs", "SigmaAbs"), ("betaabs", "BetaAbs"),
    ("fdeltaaa", "Fdelta And Above"), ("thetaaa", "Theta And Above"), ("alphaaa", "Alpha And Above"), ("sigmaaa", "Sigma And Above"),
    ("fdeltaabsab", "FdeltaAbs And Below"), ("thetaabsab", "ThetaAbs And Below"), ("alphaabsab", "AlphaAbs And Below"), ("sigmaabsab", "SigmaAbs And Below"),
    ("fdeltaab", "Fdelta And Below"), ("thetaab", "Theta And Below"), ("alphaab", "Alpha And Below"), ("sigmaab", "Sigma And Below"),
)


def stage_day_keys(stage: str) -> tuple[tuple[str, str], ...]:
    """Curated day keys of a stage (``N1 N2 N3 R Sleep``) with their titles."""
    amount, stability, waking = STAGE_WORDS[stage]
    keys = [(f"night:yasa:adjusted:{amount}SleepSecs", "Amount")] if amount else []
    keys.append((f"night:yasaExtended:Stability:Aggregated:{stability}", "Stability"))
    measures = [(f"night:yasaExtended:{stage}:{m}:mean", title) for m, title in STAGE_MEASURES]
    waking_keys = [(f"night:aggregated:microwakingsWithin{waking}PerHour", "Microwakings")] if waking else []
    return tuple(keys + measures[:3] + waking_keys + measures[3:])


def best_night_keys() -> list[str]:
    """Every curated key of a night: all stages, wakings, settling and architecture."""
    sets = [stage_day_keys(s) for s in ("N3", "R", "N1", "N2", "Sleep")] + [CURATED_DAY_KEYS[n] for n in ("wakings", "settling", "sleep_architecture")]
    return [key for keys in sets for key, _ in keys]


_TESTS = {
    "prefix": (str.startswith, lambda c, x: c.startswith(x)),
    "suffix": (str.endswith, lambda c, x: c.endswith(x)),
    "exact": (str.__eq__, lambda c, x: c == x),
    "part": (str.__contains__, lambda c, x: c.contains(x)),
    "any case prefix": (lambda name, x: name.lower().startswith(x), lambda c, x: F.lower(c).startswith(x)),
}


def name_passes(name: str, rule: tuple[str, str]) -> bool:
    return _TESTS[rule[0]][0](name, rule[1])


def key_passes(key: Column, rule: tuple[str, str]) -> Column:
    """The same test on a column of names."""
    return _TESTS[rule[0]][1](key, rule[1])


def chosen_columns(columns: Sequence[str], sources: Sequence[str], *, real_time: bool = False) -> list[str]:
    """Columns admitted by any of the sources, in order; ``prefix:x`` admits names starting with ``x``; real time drops look-ahead columns."""
    def admitted(name: str, source: str) -> bool:
        if source.startswith("prefix:"):
            return name.startswith(source.removeprefix("prefix:"))
        allow, deny = FEATURE_SOURCES[source]
        return any(name_passes(name, r) for r in allow) and not any(name_passes(name, r) for r in deny)

    return [c for c in columns if any(admitted(c, s) for s in sources) and not (real_time and ("_c7" in c or "_p2" in c))]


def _meets(key: Column, rules: Sequence[Sequence[tuple[str, str]]]) -> Column:
    """Whether all tests of any rule hold."""
    hit = F.lit(False)
    for tests in rules:
        every = F.lit(True)
        for one in tests:
            every = every & key_passes(key, one)
        hit = hit | every
    return hit


def useful_day_key(key: Column) -> Column:
    """Whether a day key is worth keeping."""
    return ~_meets(key, USELESS_DAY_KEYS)


def admitted_day_key(key: Column, sources: Sequence[str], unwanted: Sequence[str] = ()) -> Column:
    """Whether any of the sources admits a day key and none of the unwanted ones does.

    Sources are those of ``DAY_SOURCES`` and, with a colon at the end, prefixes; an unknown one admits nothing.
    """
    def any_of(names: Sequence[str]) -> Column:
        hit = F.lit(False)
        for name in names:
            allow, deny = DAY_SOURCES.get(name, ((), ()))
            hit = hit | (_meets(key, allow) & ~_meets(key, deny))
            if name.endswith(":"):
                hit = hit | key.startswith(name)
        return hit

    return any_of(sources) & ~any_of(unwanted) & ~_meets(key, DENIED_DAY_KEYS)


def day_feature_columns(df: DataFrame, target: str, sources: Sequence[str], unwanted: Sequence[str] = ()) -> DataFrame:
    """Number and flag columns that are admitted, and the target, in order of name.

    The two sources ``curated_night`` and ``under_my_control`` stand alone, as given first: they keep their own order.
    """
    usable = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if "curated_night" in sources:
        curated = best_night_keys()
        return df.select(*[_q(c) for c in [*curated, *([] if target in curated else [target])] if c in usable])

    def judged(rule: Callable[[Column], Column]) -> list[str]:
        names = local_table(df.sparkSession, [(c,) for c in usable], "name string")
        return [r["name"] for r in names.filter((F.col("name") == target) | rule(F.col("name"))).collect()]

    if "under_my_control" in sources:
        chosen = set(judged(controlled_day_key))
        return df.select(*[_q(c) for c in usable if c in chosen])
    return df.select(*[_q(c) for c in sorted(judged(lambda name: admitted_day_key(name, sources, unwanted)))])


def controlled_day_key(key: Column) -> Column:
    """Whether a day key is fully or somewhat under the person's control."""
    hit = F.lit(False)
    for r in (*CONTROLLED_DAY_KEYS["fully"], *CONTROLLED_DAY_KEYS["somewhat"]):
        hit = hit | key_passes(key, r)
    return hit


def select_features(df: DataFrame, sources: Sequence[str], keep: Sequence[str] = (), *, real_time: bool = False) -> DataFrame:
    return df.select(*keep, *[_q(c) for c in chosen_columns(df.columns, sources, real_time=real_time) if c not in keep])


def keep_keys(document: Column, allowed: Callable[[Column], Column]) -> Column:
    """Map entries whose key passes a predicate."""
    return F.map_filter(document, lambda k, _: allowed(k))


def numeric_only(df: DataFrame) -> DataFrame:
    """Without text, date, interval and nested columns; booleans stay."""
    return df.select(*[_q(f.name) for f in df.schema if isinstance(f.dataType, (*NUMERIC, T.BooleanType))])


def drop_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without plus or minus infinity in the columns (nulls and NaN stay)."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.abs(_q(c)) == float("inf"), F.lit(False))
    return df.filter(~bad)


def clean_target(df: DataFrame, target: str, largest: float = 1e6) -> DataFrame:
    """Rows whose target is present, finite and at most ``largest``."""
    t = _q(target)
    return df.filter(t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf")) & (t <= largest))


def clip_to_quantiles(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, *, bounded: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Clip each column to its own linear quantiles; then columns by name prefix to fixed bounds.

    The quantiles are one row per column, collected as constants so that the
    clip is a plain projection.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("double").alias("v")) for c in columns])))
    edges = {r["column"]: (r["lo"], r["hi"]) for r in exact_quantiles(long, ["column"], "v", {"lo": low, "hi": high}).collect()}
    changed = {}
    for c in columns:
        x = known_of(df, c).cast("double")
        if c in edges:
            x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(edges[c][0])), F.lit(edges[c][1])))
        for prefix, (lo, hi) in (bounded or {}).items():
            if c.startswith(prefix):
                x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))
        changed[c] = x
    return df.withColumns(changed)


def clip_absolute_features(df: DataFrame, part: str = "abs", bound: float = 1.0) -> DataFrame:
    """Columns sorted by name, booleans as 0/1, and those named with ``part`` clipped to ``[-bound, bound]``."""
    out = []
    for f in sorted(df.schema, key=lambda f: f.name):
        x = _q(f.name)
        if isinstance(f.dataType, T.BooleanType):
            x = x.cast("int")
        if part in f.name:
            x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-bound)), F.lit(bound)))
        out.append(x.alias(f.name))
    return df.select(*out)


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns mapped to [0, 1] by their extremes (one aggregate row, broadcast); a constant column maps to 0, NaN to null."""
    df = with_known(df, list(columns))
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one")
    scaled = {c: F.coalesce(F.try_divide(_q(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.when(_q(c).isNotNull(), F.lit(0.0))) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def scale_by_percentiles(long: DataFrame, stats: DataFrame, column: str = "column", value: str = "value") -> DataFrame:
    """``(x - p10) / (p90 - p10)`` with the statistics of each column; columns without statistics stay as they are.

    ``stats`` has one row per column and is broadcast.
    """
    joined = long.join(F.broadcast(stats.select(column, "p10", "p90")), column, "left")
    scaled = F.when(F.col("p10").isNotNull(), F.try_divide(F.col(value) - F.col("p10"), F.col("p90") - F.col("p10"))).otherwise(F.col(value))
    return joined.withColumn("scaled", scaled).drop("p10", "p90")


def main_channel(df: DataFrame, keys: Sequence[str], source: str, order: Column, preferred: str = "Fpz", prefix: str = "F") -> DataFrame:
    """Per recording the channel to report: the only frontal one, else ``preferred``, else the first seen."""
    frontal = F.col(source).startswith(prefix)
    return df.groupBy(*keys).agg(F.when(F.bool_or(F.col(source) == preferred), F.lit(preferred)).otherwise(
        F.min_by(F.when(frontal, F.col(source)), F.when(frontal, order))).alias("main"))


def alias_main_columns(df: DataFrame, channel: str) -> DataFrame:
    """Copies of the channel's ``eeg`` columns under ``Main``."""
    return df.select("*", *[_q(c).alias(c.replace(channel, "Main")) for c in df.columns if "eeg" in c and c.startswith(channel)])


def redundant_percentile_columns(df: DataFrame, threshold: float = 0.97) -> list[str]:
    """``percentile90/10`` columns that correlate with their ``mean`` twin at least at the threshold: one aggregate."""
    twins = [(c, c.replace("percentile90", "mean").replace("percentile10", "mean")) for c in df.columns]
    twins = [(c, m) for c, m in twins if m != c and m in df.columns]
    if not twins:
        return []
    row = df.agg(*[F.corr(_q(c), _q(m)).alias(c) for c, m in twins]).first()
    return [c for c, _ in twins if row[c] is not None and row[c] >= threshold]


def collinear_columns(df: DataFrame, columns: Sequence[str], *, low_variance: float = 1e-10, above: float = 0.99) -> tuple[list[str], list[str]]:
    """Columns to drop for too little variance and for collinearity.

    All variances and pair correlations are one aggregate; the greedy pass runs
    on that matrix.  Of each pair above the limit, strongest first, the column
    with the higher mean absolute correlation goes.
    """
    variances = df.agg(*[F.var_samp(_q(c)).alias(c) for c in columns]).first()
    flat = [c for c in columns if variances[c] is not None and variances[c] < low_variance]
    rest = [c for c in columns if c not in flat]
    pairs = [(a, b) for i, a in enumerate(rest) for b in rest[i + 1:]]
    if not pairs:
        return flat, []
    row = df.agg(*[F.abs(F.corr(_q(a), _q(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    r = {p: row[f"r{i}"] for i, p in enumerate(pairs)}
    mean = {c: (1 + sum(v for p, v in r.items() if c in p and v is not None)) / len(rest) for c in rest}
    dropped: list[str] = []
    for a, b in sorted((p for p in pairs if r[p] is not None and r[p] > above), key=lambda p: -r[p]):
        if a not in dropped and b not in dropped:
            dropped.append(a if mean[a] > mean[b] else b)
    return flat, dropped


def fill_day_features(df: DataFrame, keys: Sequence[str], day: str, *, zero: Sequence[str] = (), trailing: Sequence[str] = (), indicator: dict[str, str] | None = None) -> DataFrame:
    """Fill rules per column family: indicator of presence, zero for absent, or the mean of the previous three days.

    One row per key and day, so the window is bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-3, -1)
    out = df.withColumns({name: _q(c).isNotNull().cast("int") for name, c in (indicator or {}).items()})
    out = out.withColumns({c: F.coalesce(_q(c), F.avg(_q(c)).over(w)) for c in trailing}) if trailing else out
    return out.withColumns({c: F.coalesce(_q(c), F.lit(0)) for c in zero}) if zero else out


def neighbour_days(df: DataFrame, keys: Sequence[str], day: str, columns: Sequence[str]) -> DataFrame:
    """Previous and next row's values and the change since the previous row (by row, not by calendar)."""
    w = Window.partitionBy(*keys).orderBy(day)
    new = {}
    for c in columns:
        new[f"{c}_prev"] = F.lag(_q(c)).over(w)
        new[f"{c}_next"] = F.lead(_q(c)).over(w)
        new[f"{c}_change"] = _q(c) - F.lag(_q(c)).over(w)
    return df.withColumns(new)


def drop_rows_of_nearly_complete_columns(df: DataFrame, columns: Sequence[str], under_pct: float = 5.0) -> DataFrame:
    """Drop rows with a null in any column that misses fewer than ``under_pct`` percent."""
    df = with_known(df, list(columns))
    near = [r["column"] for r in missing_profile(df, columns).collect() if r["missing_pct"] < under_pct]
    return df.dropna(subset=near) if near else df


# fixed values: label -> (binary, graded, extreme) per version
SETTLING_BEFORE_V4 = {
    "wired": (0, 0, True), "too alert": (0, 0, True), "mid": (0, 50, False), "other": (0, 50, False), "tired": (100, 75, False), "sleepy": (100, 100, True),
}
SETTLING_V4 = {
    "wired or alert": (0, 0, True), "tired but wired": (0, 25, False), "tired but alert": (0, 25, False), "tired": (100, 75, False), "drowsy or sleepy": (100, 100, True),
}
# fixed values: energy label -> 0..1
DAY_ENERGY = {
    "near worst": 0.0, "struggling": 0.1, "tired": 0.3, "standard tired": 0.4, "sub-optimal": 0.4, "okish": 0.7, "lockable": 0.9, "great": 1.0,
}


def map_settling(df: DataFrame, label: str, version: str) -> DataFrame:
    """Binary, graded and extreme-only scores of settling labels by version; ``n/a`` reads as v1, v3 is dropped, unknown labels are null."""
    rows = df.withColumn(version, F.when(F.col(version) == "n/a", "v1").otherwise(F.col(version))).filter(F.col(version) != "v3")

    def table(mapping):
        return F.create_map(*[x for k, (b, g, e) in mapping.items() for x in (F.lit(k), F.struct(F.lit(b).alias("b"), F.lit(g).alias("g"), F.lit(e).alias("e")))])

    hit = F.when(F.col(version) == "v4", F.try_element_at(table(SETTLING_V4), F.col(label))).otherwise(F.try_element_at(table(SETTLING_BEFORE_V4), F.col(label)))
    return rows.withColumn("_hit", hit).withColumns({
        "settling": F.col("_hit.g"), "settling_v4": F.when(F.col(version) == "v4", F.col("_hit.g")), "tired_vs_alert": F.col("_hit.b"),
        "tired_vs_alert_extremes": F.when(F.col("_hit.e"), F.col("_hit.b")),
    }).drop("_hit")


def map_ordinal(label: Column, mapping: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(float(v)))]), label)
