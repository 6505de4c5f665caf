"""Clock and calendar expressions."""

from pyspark.sql import functions as F

from ..functions import timeutil as tu
from .registry import query

# order dates cover summer time; spread over the day by the order number
ORDER_CLOCK_SQL = """
WITH o AS (SELECT o_orderkey, o_orderdate + to_seconds((o_orderkey * 1237) % 86400) AS tm FROM orders)
"""


def _order_clock(t):
    secs = F.col("o_orderkey") * 1237 % 86400
    return t.orders.select("o_orderkey", tu.from_micros(tu.micros(F.col("o_orderdate")) + secs * 1_000_000).alias("at"))


@query("instants_from_text", "B01", """
WITH o AS (SELECT o_orderkey, strftime(o_orderdate + to_seconds((o_orderkey * 1237) % 86400), '%Y-%m-%dT%H:%M:%S')
  || CASE o_orderkey % 4 WHEN 0 THEN '+00:00' WHEN 1 THEN '+01:00' WHEN 2 THEN '' ELSE 'Z' END AS txt
  FROM orders),
p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL
  ELSE CAST(substr(txt, 1, 19) AS TIMESTAMP) - to_hours(CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END) END AS utc FROM o)
SELECT o_orderkey, utc, timezone('Europe/London', timezone('UTC', utc)) AS london FROM p
""")
def _(t):
    tail = F.element_at(F.array(*map(F.lit, ["+00:00", "+01:00", "", "Z"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.when(F.col("o_orderkey") % 97 == 0, "not a time").otherwise(
        F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), tail))
    out = _order_clock(t).select("o_orderkey", tu.parse_instant(text).alias("utc"))
    return out.withColumn("london", tu.wall_clock(F.col("utc")))


@query("naive_text_two_rules", "B02", ORDER_CLOCK_SQL + """
SELECT o_orderkey, timezone('Europe/London', timezone('UTC', tm)) AS read_as_utc,
       CASE WHEN month(tm) = 10 AND day(tm) >= 25 AND dayofweek(tm) = 0 AND hour(tm) = 1 THEN tm - INTERVAL 1 HOUR ELSE timezone('UTC', timezone('Europe/London', tm)) END AS read_as_local FROM o
""")
def _(t):
    # of a local time in the hour repeated each autumn, the first is meant
    text = F.date_format("at", "yyyy-MM-dd HH:mm:ss")
    return _order_clock(t).select(
        "o_orderkey",
        tu.wall_clock(tu.parse_instant(text)).alias("read_as_utc"),
        tu.parse_instant(text, naive_zone=tu.LONDON).alias("read_as_local"),
    )


@query("midnight_seconds_to_instant", "B03", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, 79200 + (o_orderkey * 7) % 10800 AS secs FROM orders)
SELECT o_orderkey, secs, timezone('UTC', timezone('Europe/London', CAST(d AS TIMESTAMP) + to_seconds(secs))) AS utc FROM o
WHERE secs < 86400 OR secs >= 86400
""")
def _(t):
    secs = (79200 + F.col("o_orderkey") * 7 % 10800).alias("secs")
    return t.orders.select("o_orderkey", secs, tu.seconds_after_midnight(F.to_date("o_orderdate"), secs).alias("utc"))


@query("logical_dates", "B04", """
SELECT event_id,
  CAST(CASE WHEN hour(ts) < 11 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS DATE) AS night_11,
  CAST(CASE WHEN hour(ts) < 4 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS DATE) AS night_4,
  CAST(CASE WHEN hour(ts) < 5 THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS DATE) AS night_5_next,
  CAST(CASE WHEN hour(ts) < 12 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS DATE) AS noon_to_noon
FROM events
""")
def _(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        tu.logical_date(ts, 11).alias("night_11"),
        tu.logical_date(ts, 4).alias("night_4"),
        tu.logical_date(ts, 5, +1).alias("night_5_next"),
        tu.logical_date(ts, 12).alias("noon_to_noon"),
    )


@query("file_stamps", "B05", """
SELECT event_id, date_trunc('second', ts) AS started FROM events
""")
def _(t):
    named = t.events.select("event_id", F.concat(F.lit("recording_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".opus")).alias("file"))
    return named.select("event_id", tu.file_stamp(F.col("file")).alias("started"))


@query("seconds_to_hours_columns", "B06 B07", """
SELECT l_orderkey, l_linenumber, l_quantity / 3600 AS restHours, l_extendedprice / 3600 AS wakeHSM FROM lineitem
""")
def _(t):
    day = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("day:restSecs"), F.col("l_extendedprice").alias("day:wakeSSM"))
    return tu.strip_prefixes(tu.seconds_columns_to_hours(day), ["day:"])


@query("clock_fractions", "B08 B09", """
SELECT event_id, hour(ts) + minute(ts) / 60 AS hour_fraction, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day,
  printf('%02d:%02d', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT)) AS clock,
  printf('%02d:%02d', CAST(floor(h) % 24 AS BIGINT), CAST(floor((h - floor(h)) * 60) AS BIGINT))
    || CASE WHEN h >= 24 THEN printf(' (+%dd)', CAST(floor(h / 24) AS BIGINT)) ELSE '' END AS hours_text
FROM (SELECT *, CAST(floor(value * 400) AS BIGINT) AS s, floor(value * 4) / 8 AS h FROM events)
""")
def _(t):
    hours = F.floor(F.col("value") * 4) / 8
    return t.events.select(
        "event_id",
        tu.hour_fraction(F.col("ts")).alias("hour_fraction"),
        tu.minute_of_day(F.col("ts")).alias("minute_of_day"),
        tu.clock_text(F.floor(F.col("value") * 400)).alias("clock"),
        tu.hours_text(hours).alias("hours_text"),
    )


@query("clock_target_scores", "B10", """
WITH s AS (SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS cur,
  CAST(floor(value * 30) AS BIGINT) - 1500 AS delta, 78300 AS target FROM events),
d AS (SELECT *, least(abs(cur - target), 86400 - abs(cur - target)) AS diff,
  (((target - (cur - delta) + 43200) % 86400) + 86400) % 86400 - 43200 AS needed FROM s),
i AS (SELECT *, least(100.0::DOUBLE, abs(delta / nullif(needed, 0)::DOUBLE) * 100) AS gain FROM d)
SELECT event_id, round(0.6 * (100 * (1 - diff / 7200::DOUBLE)) + 0.4 * CASE WHEN delta = 0 OR needed = 0 THEN 0
  WHEN (delta > 0) = (needed > 0) THEN gain ELSE -gain END, 6) AS score FROM i
""")
def _(t):
    current = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    delta = F.floor(F.col("value") * 30) - 1500
    return t.events.select("event_id", F.round(tu.clock_target_score(current, delta, F.lit(78300)), 6).alias("score"))


@query("period_starts", "B11 B12", """
SELECT event_id, ts + to_microseconds((event_id % 900) * 30 * 1000000) AS epoch_at,
  epoch_us(ts) // 1000000 % 30 AS bucket_offset FROM events
""")
def _(t):
    return t.events.select(
        "event_id",
        tu.nth_period(F.col("ts"), F.col("event_id") % 900, 30).alias("epoch_at"),
        tu.bucket_offset(F.col("ts"), 30).alias("bucket_offset"),
    )
