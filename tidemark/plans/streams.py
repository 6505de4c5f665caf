"""Streaming queries: the events table as a stream, processed to its end.

Windows that the final watermark has not passed stay open, in the SQL twins too.
"""

from pyspark.sql import functions as F

from ..streaming import live as lv
from .registry import query
from .resampling import HOUR_US

LATE_US = HOUR_US


def _stream(t):
    # the file source wants instants for event time
    rows = lv.incoming_files(t.spark, t.folder, t.events.schema, pattern="events.parquet")
    return rows.withColumns({"ts": F.col("ts").cast("timestamp")})


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


CLOSED = f"wm AS (SELECT (max(epoch_us(ts)) // 1000 * 1000) - {LATE_US} AS us FROM events)"


@query("live_epochs", "S02", f"WITH {CLOSED}, w AS (SELECT user_id, epoch_us(ts) // {6 * HOUR_US} * {6 * HOUR_US} AS s, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY ALL) SELECT user_id, make_timestamp(s) AS \"at\", n, round(m + 1e-9, 6) AS mean_value, round(sd, 6) AS std_value FROM w, wm WHERE s + {6 * HOUR_US} <= wm.us")
def _(t):
    out = lv.run_available(lv.online_epochs(_stream(t), ["user_id"], "ts", "value", length="6 hours", late="1 hour"))
    return _ntz(out, "at").select("user_id", "at", "n", F.round(F.col("mean_value") + 1e-9, 6).alias("mean_value"), F.round("std_value", 6).alias("std_value"))


@query("live_view", "S01 S09", f"WITH {CLOSED}, w AS (SELECT user_id, (epoch_us(ts) // {6 * HOUR_US} - k) * {6 * HOUR_US} AS s, ts, value FROM events, range(0, 4) r(k)), g AS (SELECT user_id, s, count(*) AS n, max(ts) AS newest FROM w GROUP BY ALL) SELECT user_id, make_timestamp(s) AS from_at, n, newest FROM g, wm WHERE s + {24 * HOUR_US} <= wm.us")
def _(t):
    out = lv.run_available(lv.latest_view(_stream(t), ["user_id"], "ts", "value", length="24 hours", slide="6 hours", late="1 hour"))
    return _ntz(out, "from_at", "newest").select("user_id", "from_at", "n", "newest")


@query("live_medians", "S03 G01", f"WITH {CLOSED}, w AS (SELECT event_type, epoch_us(ts) // {HOUR_US} * {HOUR_US} AS s, quantile_disc(value, 0.5) AS median FROM events GROUP BY ALL) SELECT event_type, make_timestamp(s) AS \"at\", median FROM w, wm WHERE s + {HOUR_US} <= wm.us")
def _(t):
    out = lv.run_available(lv.online_medians(_stream(t), ["event_type"], "ts", "value", length="1 hour", late="1 hour"))
    return _ntz(out, "at")


@query("live_bouts", "S06", f"WITH {CLOSED}, l AS (SELECT user_id, epoch_us(ts) AS us, ts, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), i AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= {6 * HOUR_US} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS b FROM l), g AS (SELECT user_id, b, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, max(us) AS last_us FROM i GROUP BY user_id, b) SELECT user_id, n, first_at, last_at FROM g, wm WHERE last_us + {6 * HOUR_US} <= wm.us")
def _(t):
    return _ntz(lv.run_available(lv.online_bouts(_stream(t), ["user_id"], "ts", "6 hours", late="1 hour")), "first_at", "last_at")


@query("live_without_repeats", "S07", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    twice = _stream(t).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out = lv.run_available(lv.without_repeats(twice, ["event_id"], "ts", late="1 hour"))
    return out.select("event_id", "user_id", "event_type")


@query("live_enriched_epochs", "S08", f"""
SELECT a.event_id AS epoch_id, b.event_id AS event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'error' AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) AND epoch_us(a.ts) + {6 * HOUR_US}
""")
def _(t):
    views = _stream(t).filter("event_type = 'view'").select("user_id", F.col("event_id").alias("epoch_id"), F.col("ts").alias("at"))
    errors = _stream(t).filter("event_type = 'error'").select("user_id", "event_id", "ts")
    out = lv.enriched_epochs(views, errors, ["user_id"], "at", "ts", "6 HOURS", late="1 hour").select("epoch_id", "event_id")
    return lv.run_available(out)


@query("live_counter_filter", "S05 C02", """
WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS c FROM events),
nx AS (SELECT a.user_id, a.event_id, min(b.event_id) AS nxt FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.c = (a.c + 1) % 4 GROUP BY ALL),
walk AS (SELECT user_id, min(event_id) AS event_id FROM e GROUP BY user_id
  UNION ALL SELECT walk.user_id, nx.nxt FROM walk JOIN nx ON nx.user_id = walk.user_id AND nx.event_id = walk.event_id)
SELECT user_id, event_id, c FROM e JOIN walk USING (user_id, event_id)
""")
def _(t):
    rows = _stream(t).select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("long") % 4).alias("c"))
    return lv.run_available(lv.online_counter_filter(rows, ["user_id"], "event_id", "c", modulus=4))


@query("live_buttons", "S04 I01 I02", f"""
WITH {CLOSED}, lg AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type AS base, event_id % 2 = 1 AS is_long, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id AS device, event_id, CAST(CASE WHEN is_long THEN greatest(coalesce(p, lg.us - {6 * HOUR_US}), lg.us - {6 * HOUR_US}) END AS DOUBLE) AS since FROM lg, wm
WHERE is_long OR (lg.us + {12 * HOUR_US} < wm.us AND NOT EXISTS (SELECT 1 FROM lg n WHERE n.user_id = lg.user_id AND n.base = lg.base AND n.is_long AND n.us > lg.us AND n.us <= lg.us + {12 * HOUR_US}))
""")
def _(t):
    event = F.concat("event_type", F.when(F.col("event_id") % 2 == 1, "_long").otherwise(""))
    rows = _stream(t).select("user_id", "event_id", event.alias("event"), F.unix_micros("ts").alias("us"), "ts")
    out = lv.run_available(lv.online_buttons(rows, "user_id", "ts", within=12 * HOUR_US, reach=6 * HOUR_US, late="1 hour"))
    return out.select("device", "event_id", F.col("since").cast("double").alias("since"))
