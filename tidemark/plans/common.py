"""Epoch, channel and night tables derived from ``events``, with their SQL twins."""

from pyspark.sql import functions as F

HOURS6 = 21_600_000_000
# fixed mapping: event types stand in for stages
TYPE_STAGE = {"error": "W", "view": "N1", "click": "N2", "purchase": "N3", "signup": "R"}


def stage_of(col):
    return F.create_map(*[x for k, v in TYPE_STAGE.items() for x in (F.lit(k), F.lit(v))])[col]


STAGE_CASE = "CASE event_type WHEN 'error' THEN 'W' WHEN 'view' THEN 'N1' WHEN 'click' THEN 'N2' WHEN 'purchase' THEN 'N3' ELSE 'R' END"


def epochs(t):
    """One row per user and 6-hour epoch: dominant stage, its share, number of events, start."""
    counts = t.timed.groupBy("user_id", F.floor(F.col("us") / HOURS6).alias("epoch"), "event_type").agg(
        F.count(F.lit(1)).alias("k"), F.sum("value").alias("v"))
    best = F.min_by("event_type", F.struct(-F.col("k"), F.col("event_type")))
    return counts.groupBy("user_id", "epoch").agg(
        stage_of(best).alias("stage"),
        (F.max("k") / F.sum("k")).alias("confidence"),
        F.sum("k").alias("n"),
        (F.sum("v") / F.sum("k")).alias("mean_value"),
    ).withColumn("at", F.col("epoch") * HOURS6)


EPOCHS = f"""
type_counts AS (SELECT user_id, epoch_us(ts) // {HOURS6} AS epoch, {STAGE_CASE} AS stage, event_type, count(*) AS k, sum(value) AS v FROM events GROUP BY ALL),
type_ranks AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY k DESC, event_type) AS rn,
  sum(k) OVER (PARTITION BY user_id, epoch) AS n, sum(v) OVER (PARTITION BY user_id, epoch) AS sv FROM type_counts),
ep AS (SELECT user_id, epoch, stage, k / n AS confidence, CAST(n AS BIGINT) AS n, sv / n AS mean_value, epoch * {HOURS6} AS at_us,
  CAST(make_timestamp(epoch * {HOURS6}) AS DATE) AS day FROM type_ranks WHERE rn = 1)
"""


def channel_epochs(t):
    """Per user, day and channel (three by event number): dominant stage and its share."""
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), F.concat(F.lit("F"), F.col("event_id") % 3).alias("channel"), "event_type")
    counts = rows.groupBy("user_id", "day", "channel", "event_type").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("user_id", "day", "channel").agg(
        stage_of(F.min_by("event_type", F.struct(-F.col("k"), F.col("event_type")))).alias("stage"),
        (F.max("k") / F.sum("k")).alias("confidence"),
    )


CHANNELS = f"""
cc AS (SELECT user_id, CAST(ts AS DATE) AS day, 'F' || (event_id % 3) AS channel, event_type, {STAGE_CASE} AS stage, count(*) AS k FROM events GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, channel ORDER BY k DESC, event_type) AS rn,
  sum(k) OVER (PARTITION BY user_id, day, channel) AS n FROM cc),
ch AS (SELECT user_id, day, channel, stage, k / n AS confidence FROM cr WHERE rn = 1)
"""

WIDE = CHANNELS + """,
w AS (SELECT user_id, day, max(stage) FILTER (channel = 'F0') AS s0, max(stage) FILTER (channel = 'F1') AS s1, max(stage) FILTER (channel = 'F2') AS s2,
  max(confidence) FILTER (channel = 'F0') AS c0, max(confidence) FILTER (channel = 'F1') AS c1, max(confidence) FILTER (channel = 'F2') AS c2
  FROM ch GROUP BY ALL)
"""
