"""Clock, calendar and time-zone column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400
LONDON = "Europe/London"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp column."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def parse_instant(text: Column, *, naive_zone: str = "UTC") -> Column:
    """Instant (UTC wall clock) of mixed-offset text; text without an offset is read in ``naive_zone``; bad text is null."""
    has_offset = text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    in_session = F.try_to_timestamp(text).cast("timestamp_ntz")
    aware = F.convert_timezone(F.current_timezone(), F.lit("UTC"), in_session)
    naive = F.convert_timezone(F.lit(naive_zone), F.lit("UTC"), in_session)
    return F.when(has_offset, aware).otherwise(naive)


def wall_clock(utc: Column, zone: str = LONDON) -> Column:
    """Local wall clock of a UTC wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def seconds_after_midnight(day: Column, seconds: Column, zone: str = LONDON) -> Column:
    """UTC instant of ``seconds`` of local wall clock after the midnight of ``day`` (may pass 24 h)."""
    local = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def logical_date(ts: Column, cutoff_hour: int = 11, shift_days: int = -1) -> Column:
    """The night a time belongs to: before ``cutoff_hour`` it is ``shift_days`` away from its own date."""
    day = F.to_date(ts)
    return F.when(F.hour(ts) < cutoff_hour, F.date_add(day, shift_days)).otherwise(day)


def file_stamp(name: Column) -> Column:
    """Start time in names such as ``recording_20240131_235900.opus``."""
    found = F.regexp_extract(name, r"(\d{8}_\d{6})", 1)
    return F.when(found != "", F.try_to_timestamp(found, F.lit("yyyyMMdd_HHmmss")).cast("timestamp_ntz"))


def seconds_columns_to_hours(df: DataFrame) -> DataFrame:
    """Columns named ``*Secs*`` / ``*SSM*`` become ``*Hours*`` / ``*HSM*``, divided by 3600; originals go."""
    picked = []
    for c in df.columns:
        if "Secs" in c or "SSM" in c:
            picked.append((F.col(f"`{c}`") / 3600).alias(c.replace("Secs", "Hours").replace("SSM", "HSM")))
        else:
            picked.append(F.col(f"`{c}`"))
    return df.select(*picked)


def strip_prefixes(df: DataFrame, prefixes: list[str]) -> DataFrame:
    names = {}
    for c in df.columns:
        new = c
        for p in prefixes:
            new = new.removeprefix(p)
        names[c] = new
    return df.withColumnsRenamed(names)


def hour_fraction(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def clock_text(seconds: Column) -> Column:
    """``HH:MM`` of seconds since midnight; hours keep counting past 24."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60))


def hours_text(hours: Column) -> Column:
    """``HH:MM`` of hours since midnight with ``(+nd)`` for later days."""
    days = F.floor(hours / 24)
    inside = hours - days * 24
    base = F.format_string("%02d:%02d", F.floor(inside), F.floor((inside - F.floor(inside)) * 60))
    return F.when(days >= 1, F.concat(base, F.format_string(" (+%dd)", days))).otherwise(base)


def clock_distance(a: Column, b: Column) -> Column:
    """Shortest way round the 24 h clock, in seconds."""
    apart = F.abs(a - b)
    return F.least(apart, DAY - apart)


# fixed values of the published score: reach, weights
SCORE_REACH_SECONDS = 7_200
SCORE_WEIGHTS = (0.6, 0.4)


def clock_target_score(current: Column, delta: Column, target: Column) -> Column:
    """Closeness to a target clock time (60 %) and improvement towards it since the day before (40 %)."""
    proximity = 100 * (1 - clock_distance(current, target) / SCORE_REACH_SECONDS)
    needed = F.pmod(target - (current - delta) + DAY // 2, F.lit(DAY)) - DAY // 2
    gain = F.least(F.lit(100.0), F.abs(delta / needed) * 100)
    improvement = (
        F.when((delta == 0) | (needed == 0), 0.0).when((delta > 0) == (needed > 0), gain).otherwise(-gain)
    )
    return SCORE_WEIGHTS[0] * proximity + SCORE_WEIGHTS[1] * improvement


def nth_period(start: Column, n: Column, seconds: float) -> Column:
    """``start + n * seconds`` as a timestamp."""
    return from_micros(micros(start) + (n * F.lit(seconds * 1_000_000)).cast("long"))


def bucket_offset(start: Column, seconds: int) -> Column:
    """Seconds by which buckets must shift so that one begins at ``start``."""
    return F.pmod(F.floor(micros(start) / 1_000_000), F.lit(seconds))
