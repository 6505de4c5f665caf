"""Interval, as-of and record joins."""

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators.rangejoin import asof_join
from .common import EPOCHS, HOURS6, epochs
from .registry import query
from .resampling import SIGNAL, signal

MIN_US = 60_000_000

HAPPENED = f"""
ev AS (SELECT event_id, user_id, event_type, event_type IN ('error', 'purchase') AS is_long, epoch_us(ts) AS us,
  epoch_us(ts) - CAST(floor(value * 6) AS BIGINT) * {MIN_US} AS since, value FROM events)
"""


def happened(t):
    """Events as log entries; errors and purchases are long presses that began ``value * 6`` minutes earlier."""
    return t.timed.select(
        "event_id", "user_id", "event_type", F.col("event_type").isin("error", "purchase").alias("is_long"), "us",
        (F.col("us") - F.floor(F.col("value") * 6) * MIN_US).alias("since"), "value")


@query("stitched_stages", "F01 F02", f"WITH {EPOCHS}" + """,
a AS (SELECT user_id, epoch, n, round(mean_value, 6) AS mean_value FROM ep WHERE n > 1),
b AS (SELECT user_id, epoch, round(confidence, 6) AS confidence FROM ep WHERE stage <> 'W')
SELECT ep.user_id, ep.epoch, ep.stage, a.n, a.mean_value, b.confidence FROM ep LEFT JOIN a USING (user_id, epoch) LEFT JOIN b USING (user_id, epoch)
""", nullable="n")
def _(t):
    ep = epochs(t)
    first = ep.filter("n > 1").select("user_id", "epoch", "n", F.round("mean_value", 6).alias("mean_value"))
    second = ep.filter("stage <> 'W'").select("user_id", "epoch", F.lit("x").alias("stage"), F.round("confidence", 6).alias("confidence"))
    return jn.stitch(ep.select("user_id", "epoch", "stage"), [first, second], ["user_id", "epoch"])


@query("reviewed_or_detected", "F03 F02", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
r AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT coalesce(d.user_id, r.user_id) AS user_id, coalesce(d.day, r.day) AS day, coalesce(r.value, d.value) AS value
FROM d FULL JOIN r ON d.user_id = r.user_id AND d.day = r.day
""")
def _(t):
    day = t.events.withColumn("day", F.to_date("ts"))
    detected = day.filter("event_type = 'view'").groupBy("user_id", "day").agg(F.min("value").alias("value"))
    reviewed = day.filter("event_type = 'click'").groupBy("user_id", "day").agg(F.max("value").alias("value"))
    return jn.reviewed_or_detected(detected, reviewed, ["user_id", "day"], ["value"])


@query("first_matching_event", "F05 F06", f"WITH {EPOCHS}, {HAPPENED}," + f"""
m AS (SELECT ep.user_id, ep.epoch, ev.event_id, ev.event_type, ev.value, row_number() OVER (PARTITION BY ep.user_id, ep.epoch ORDER BY ev.event_id) AS rn
  FROM ep JOIN ev ON ev.user_id = ep.user_id AND CASE WHEN is_long THEN at_us + {HOURS6} > since AND at_us < us ELSE us BETWEEN at_us AND at_us + {HOURS6} END)
SELECT ep.user_id, ep.epoch, ep.stage, m.event_id, m.event_type, m.value FROM ep LEFT JOIN m ON m.user_id = ep.user_id AND m.epoch = ep.epoch AND rn = 1
""", nullable="event_id")
def _(t):
    out = jn.match_events(epochs(t), happened(t), ["user_id"], epoch_at="at", length=HOURS6, since="since", at="us", is_long=F.col("is_long"),
                          order="event_id", keep=["event_id", "event_type", "value"])
    return out.select("user_id", "epoch", "stage", "event_id", "event_type", "value")


KINDS = ["error", "view", "purchase"]


@query("event_type_flags", "F07", f"WITH {EPOCHS}, {HAPPENED}" + f"""
SELECT ep.user_id, ep.epoch, {', '.join(f"CAST(coalesce(bool_or(ev.event_type = '{k}'), false) AS INTEGER) AS {k}" for k in KINDS)}
FROM ep LEFT JOIN ev ON ev.user_id = ep.user_id AND CASE WHEN is_long THEN since ELSE us END BETWEEN at_us AND at_us + {HOURS6}
GROUP BY ALL
""")
def _(t):
    out = jn.event_type_flags(epochs(t), happened(t), ["user_id"], epoch_at="at", length=HOURS6, since="since", at="us", is_long=F.col("is_long"),
                              kind="event_type", kinds=KINDS)
    return out.select("user_id", "epoch", *KINDS)


@query("interval_overlap_flags", "F08", f"WITH {EPOCHS}, {HAPPENED}," + f"""
m AS (SELECT ep.user_id, ep.epoch, max(ev.event_id) AS event_id FROM ep JOIN ev ON ev.user_id = ep.user_id AND is_long
  AND floor((least(at_us + {HOURS6}, us) - greatest(at_us, since)) / 1000000) > 600 GROUP BY ALL),
h AS (SELECT ep.user_id, ep.epoch, m.event_id, m.event_id IS NOT NULL AS here FROM ep LEFT JOIN m USING (user_id, epoch))
SELECT user_id, epoch, event_id, here, lead(here, 1, false) OVER w AS in_next, lag(here, 1, false) OVER w AS in_prev,
  here OR lead(here, 1, false) OVER w OR lag(here, 1, false) OVER w AS nearby FROM h WINDOW w AS (PARTITION BY user_id ORDER BY epoch)
""", nullable="event_id")
def _(t):
    out = jn.overlap_flags(epochs(t), happened(t).filter("is_long"), ["user_id"], epoch_at="at", length=HOURS6, start="since", end="us",
                           number="event_id", longer_than=600)
    return out.select("user_id", "epoch", "event_id", "here", "in_next", "in_prev", "nearby")


@query("samples_in_intervals", "F09", f"WITH {HAPPENED}" + f"""
SELECT event_id, user_id, us // {HOURS6} AS epoch, CAST(EXISTS (SELECT 1 FROM ev i WHERE i.user_id = ev.user_id AND i.is_long AND ev.us BETWEEN i.since AND i.us - {MIN_US}) AS INTEGER) AS label
FROM ev
""")
def _(t):
    ev = happened(t)
    spans = ev.filter("is_long").select("user_id", F.col("since").alias("lo"), (F.col("us") - MIN_US).alias("hi"))
    out = jn.inside_intervals(ev.select("user_id", "event_id", "us"), spans, ["user_id"], identity=["event_id"], at="us", start="lo", end="hi", width=HOURS6)
    return out.select("event_id", "user_id", F.floor(F.col("us") / HOURS6).alias("epoch"), "label")


@query("start_end_pairs", "F10", f"WITH {HAPPENED}," + f"""
m AS (SELECT s.user_id, s.event_id AS start_order, s.us AS "start", e.us AS "end", e.event_id AS end_order,
  row_number() OVER (PARTITION BY s.event_id ORDER BY e.event_id) AS rn
  FROM ev s JOIN ev e ON s.user_id = e.user_id AND s.event_type = 'click' AND e.event_type = 'purchase' AND e.us BETWEEN s.us AND s.us + {720 * MIN_US})
SELECT user_id, start_order, "start", "end", end_order FROM m WHERE rn = 1
""")
def _(t):
    ev = happened(t)
    return jn.pair_starts_with_ends(ev.filter("event_type = 'click'"), ev.filter("event_type = 'purchase'"), ["user_id"], at="us", order="event_id", within=720 * MIN_US)


@query("latest_recording_before", "F11", """
WITH r AS (SELECT user_id, epoch_us(ts) AS started, event_id AS rec FROM events WHERE event_type = 'signup'),
e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type <> 'signup')
SELECT e.event_id, e.user_id, r.rec, CAST(floor((us - started) / 1000000 * 0.25) AS BIGINT) AS sample_offset
FROM e ASOF LEFT JOIN r ON r.user_id = e.user_id AND e.us >= r.started
""", nullable="rec sample_offset")
def _(t):
    recs = t.timed.filter("event_type = 'signup'").select("user_id", F.col("us").alias("started"), F.col("event_id").alias("rec"))
    rows = t.timed.filter("event_type <> 'signup'").select("event_id", "user_id", "us")
    out = asof_join(rows, recs, ["user_id"], "us", "started", take=["rec", "started"], chunk=7 * 86_400_000_000, tie="rec")
    return out.select("event_id", "user_id", "rec", F.floor((F.col("us") - F.col("started")) / 1_000_000 * 0.25).alias("sample_offset"))


STIM = "st AS (SELECT event_id % 50 AS rec, (event_id * 37) % 640 AS at_sample, CASE WHEN event_type = 'error' THEN 'deviant' ELSE 'standard' END AS kind FROM events)"


@query("stimulus_locked_average", "F12", f"WITH {SIGNAL}, {STIM}," + """
m AS (SELECT kind, sample_no - at_sample AS "offset", avg(value) AS v FROM sg JOIN st ON sg.rec = st.rec AND sample_no >= at_sample - 20 AND sample_no < at_sample + 20 GROUP BY ALL)
SELECT "offset", round(max(v) FILTER (kind = 'standard'), 6) AS standard, round(max(v) FILTER (kind = 'deviant'), 6) AS deviant,
  round(max(v) FILTER (kind = 'deviant') - max(v) FILTER (kind = 'standard'), 6) AS difference FROM m GROUP BY ALL
""")
def _(t):
    stimuli = t.events.select((F.col("event_id") % 50).alias("rec"), (F.col("event_id") * 37 % 640).alias("at_sample"),
                              F.when(F.col("event_type") == "error", "deviant").otherwise("standard").alias("kind"))
    mean = jn.locked_windows(signal(t), stimuli, ["rec"], sample="sample_no", value="value", at="at_sample", kind="kind", before=20, after=20)
    wide = mean.groupBy("offset").pivot("kind", ["standard", "deviant"]).agg(F.first("mean_value"))
    return wide.select("offset", F.round("standard", 6).alias("standard"), F.round("deviant", 6).alias("deviant"),
                       F.round(F.col("deviant") - F.col("standard"), 6).alias("difference"))


DAILY = "dy AS (SELECT user_id, CAST(ts AS DATE) AS day, max(epoch_us(ts)) AS last_us, min(epoch_us(ts)) AS first_us, count(*) AS n FROM events GROUP BY ALL)"


def daily(t):
    return t.timed.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.max("us").alias("last_us"), F.min("us").alias("first_us"), F.count(F.lit(1)).alias("n"))


@query("joined_to_next_day", "F13", f"WITH {DAILY} SELECT a.user_id, a.day, a.last_us, b.first_us AS next_first_us FROM dy a JOIN dy b ON a.user_id = b.user_id AND b.day = a.day + 1")
def _(t):
    d = daily(t)
    return jn.with_next_day(d.select("user_id", "day", "last_us"), d, ["user_id", "day"][:1], "day", ["first_us"])


@query("attached_targets", "F14", """
SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL
""")
def _(t):
    return jn.attach_targets(t.documents.select("doc_id", "n_chars"), t.labels, ["doc_id"], ["quality", "toxic"])


@query("series_side_by_side", "F15 G01", f"""
WITH b AS (SELECT epoch_us(ts) // {HOURS6} AS slot, event_type, avg(value) AS v FROM events GROUP BY ALL)
SELECT slot, {', '.join(f"round(max(v) FILTER (event_type = '{k}'), 6) AS {k}" for k in KINDS)} FROM b WHERE event_type IN {tuple(KINDS)} GROUP BY slot
""")
def _(t):
    long = t.timed.filter(F.col("event_type").isin(*KINDS)).groupBy(F.floor(F.col("us") / HOURS6).alias("slot"), "event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    return jn.series_side_by_side(long, ["slot"], "event_type", "v", KINDS)


@query("differing_counts", "F16", """
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS k FROM events WHERE event_type <> 'view' GROUP BY ALL), b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS k FROM events WHERE event_type <> 'click' GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, coalesce(a.k, 0) AS in_a, coalesce(b.k, 0) AS in_b
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day WHERE coalesce(a.k, 0) <> coalesce(b.k, 0)
""")
def _(t):
    day = t.events.select("user_id", F.to_date("ts").alias("day"), "event_type")
    return jn.differing_counts(day.filter("event_type <> 'view'"), day.filter("event_type <> 'click'"), ["user_id", "day"])


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("column_pairs", "F17 L12", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in MEASURES for b in MEASURES if a != b))
def _(t):
    return jn.column_pairs(t.lineitem, MEASURES).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("vx", "vy"), 6).alias("r"))


@query("last_known_review", "F18", """
WITH u AS (SELECT user_id AS who, ts, event_id, value AS score, NULL::VARCHAR AS note FROM events WHERE event_type = 'view'
  UNION ALL SELECT user_id, ts, event_id, NULL, props FROM events WHERE event_type = 'click')
SELECT who, arg_max(score, {'a': ts, 'b': event_id}) FILTER (score IS NOT NULL) AS score, arg_max(note, {'a': ts, 'b': event_id}) FILTER (note IS NOT NULL) AS note FROM u GROUP BY who
""")
def _(t):
    rows = t.events.withColumnRenamed("user_id", "who")
    a = rows.filter("event_type = 'view'").select("who", "ts", "event_id", F.col("value").alias("score"))
    b = rows.filter("event_type = 'click'").select("who", "ts", "event_id", F.col("props").alias("note"))
    return jn.last_known([a, b], ["who"], ["ts", "event_id"], ["score", "note"])
