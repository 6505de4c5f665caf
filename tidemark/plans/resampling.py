"""Grid, gap and smoothing queries."""

from pyspark.sql import functions as F

from ..operators import resample as rs
from ..operators.quantiles import exact_quantiles
from ..operators.timeline import Timeline
from .common import HOURS6
from .registry import query

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

SIGNAL = """
sg AS (SELECT vec_id // 10 AS rec, (vec_id % 10) * 64 + i - 1 AS sample_no, CAST(v AS DOUBLE) * 1000 AS value
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))
"""


def signal(t):
    """Embedding vectors laid end to end as sampled signals: ten vectors per recording."""
    cells = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return cells.select(
        F.floor(F.col("vec_id") / 10).alias("rec"),
        (F.col("vec_id") % 10 * 64 + F.col("pos")).alias("sample_no"),
        (F.col("v").cast("double") * 1000).alias("value"),
    )


def signal_line(chunk=160):
    return Timeline.every(["rec"], ["sample_no"], chunk)


def event_line(chunk=7 * DAY_US):
    return Timeline.every(["user_id"], ["us", "event_id"], chunk)


@query("tumbling_epochs", "C01", f"WITH {SIGNAL}," + """
n AS (SELECT rec, max(sample_no) + 1 AS total FROM sg GROUP BY rec)
SELECT rec, sample_no // 100 AS epoch, count(*) AS samples, round(avg(value), 6) AS mean_value FROM sg JOIN n USING (rec)
WHERE (sample_no // 100 + 1) * 100 <= total GROUP BY ALL
""")
def _(t):
    return rs.split_epochs(signal(t), ["rec"], "sample_no", 100).groupBy("rec", "epoch").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("sliding_epochs", "C01", f"WITH {SIGNAL}," + """
n AS (SELECT rec, max(sample_no) + 1 AS total FROM sg GROUP BY rec),
k AS (SELECT rec, total, unnest(range(0, (total - 100) // 40 + 1)) AS epoch FROM n WHERE total >= 100)
SELECT k.rec, k.epoch, count(*) AS samples, round(avg(value), 6) AS mean_value FROM k JOIN sg ON sg.rec = k.rec AND sample_no >= epoch * 40 AND sample_no < epoch * 40 + 100
GROUP BY ALL
""")
def _(t):
    return rs.split_epochs(signal(t), ["rec"], "sample_no", 100, step=40).groupBy("rec", "epoch").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("counter_order_filter", "C02", """
WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS c FROM events),
nx AS (SELECT a.user_id, a.event_id, min(b.event_id) AS nxt FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.c = (a.c + 1) % 4 GROUP BY ALL),
walk AS (SELECT user_id, min(event_id) AS event_id FROM e GROUP BY user_id
  UNION ALL SELECT walk.user_id, nx.nxt FROM walk JOIN nx ON nx.user_id = walk.user_id AND nx.event_id = walk.event_id)
SELECT user_id, event_id, c FROM e JOIN walk USING (user_id, event_id)
""")
def _(t):
    rows = t.events.select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("long") % 4).alias("c"))
    return rs.drop_out_of_order(rows, ["user_id"], "event_id", "c", modulus=4, chunk=50_000)


LAGGED = "SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events"


@query("time_gaps", "C03", f"SELECT user_id, p AS gap_start, us AS gap_end, us - p AS gap FROM ({LAGGED}) WHERE us - p > {12 * HOUR_US}")
def _(t):
    return rs.find_gaps(t.timed.select("user_id", "us", "event_id"), event_line(), 12 * HOUR_US)


@query("gap_fill", "C04", f"""
SELECT user_id, epoch_us(ts) AS us, value, 0 AS inserted FROM events UNION ALL
SELECT user_id, p + k * {HOUR_US} AS us, 0.0::DOUBLE AS value, 1 AS inserted FROM
  (SELECT user_id, p, unnest(range(1, CAST(ceil((us - p) / {HOUR_US}) AS BIGINT) + 1)) AS k FROM ({LAGGED}) WHERE us - p > {12 * HOUR_US})
""")
def _(t):
    return rs.fill_gaps(t.timed.select("user_id", "us", "event_id", "value"), event_line(), ["value"], HOUR_US, 12 * HOUR_US)


SLOTS = f"sl AS (SELECT user_id, epoch_us(ts) // {HOURS6} AS slot, avg(value) AS value FROM events GROUP BY ALL), g AS (SELECT user_id, unnest(range(min(slot), max(slot) + 1)) AS slot FROM sl GROUP BY user_id)"


def slots(t):
    return t.timed.groupBy("user_id", F.floor(F.col("us") / HOURS6).alias("slot")).agg(F.avg("value").alias("value"))


@query("missing_slots", "C05 F04", f"WITH {SLOTS} SELECT user_id, slot FROM g ANTI JOIN sl USING (user_id, slot)")
def _(t):
    return rs.missing_slots(slots(t), ["user_id"], "slot")


@query("zero_missing_slots", "C06", f"WITH {SLOTS} SELECT user_id, slot, round(coalesce(value, 0), 6) AS value FROM g LEFT JOIN sl USING (user_id, slot)")
def _(t):
    return rs.zero_missing_slots(slots(t), ["user_id"], "slot", "value").withColumn("value", F.round("value", 6))


@query("pad_to_whole_seconds", "C07", f"WITH {SIGNAL}," + """
n AS (SELECT rec, max(sample_no) + 1 AS n FROM sg GROUP BY rec)
SELECT rec, sample_no, value FROM sg UNION ALL SELECT rec, unnest(range(n, CAST(ceil(n / 250) * 250 AS BIGINT))) AS sample_no, 0.0::DOUBLE AS value FROM n
""")
def _(t):
    return rs.pad_to_multiple(signal(t), ["rec"], "sample_no", "value", 250)


def _interp_sql(both):
    reach = "slot - bs <= 2" + (" OR fs - slot <= 2" if both else "")
    return f"""WITH {SLOTS}, x AS (SELECT user_id, slot, value FROM g LEFT JOIN sl USING (user_id, slot)),
y AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS bs, last_value(value IGNORE NULLS) OVER b AS bv,
  first_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER f AS fs, first_value(value IGNORE NULLS) OVER f AS fv FROM x
  WINDOW b AS (PARTITION BY user_id ORDER BY slot ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, slot, round(coalesce(value, CASE WHEN {reach} THEN CASE WHEN bs IS NULL THEN fv WHEN fs IS NULL THEN bv ELSE bv + (fv - bv) * (slot - bs) / (fs - bs) END END), 6) AS value FROM y"""


@query("interpolate_forward", "C08", _interp_sql(False))
def _(t):
    grid = rs.grid_of(slots(t), ["user_id"], "slot").join(slots(t), ["user_id", "slot"], "left")
    out = rs.interpolate(grid, Timeline.every(["user_id"], ["slot"], 28), "value", limit=2)
    return out.withColumn("value", F.round("value", 6))


@query("interpolate_both_ways", "C08", _interp_sql(True))
def _(t):
    grid = rs.grid_of(slots(t), ["user_id"], "slot").join(slots(t), ["user_id", "slot"], "left")
    out = rs.interpolate(grid, Timeline.every(["user_id"], ["slot"], 28), "value", limit=2, both=True)
    return out.withColumn("value", F.round("value", 6))


@query("downsample", "C09", f"WITH {SIGNAL} SELECT rec, sample_no // 25 AS tick, round(avg(value), 6) AS value FROM sg GROUP BY ALL")
def _(t):
    return signal(t).groupBy("rec", F.floor(F.col("sample_no") / 25).alias("tick")).agg(F.round(F.avg("value"), 6).alias("value"))


@query("clip_and_quantise", "C10", f"WITH {SIGNAL} SELECT rec, sample_no, CAST(trunc(greatest(least(value * 100, 32767), -32768)) AS SMALLINT) AS packed FROM sg")
def _(t):
    return signal(t).select("rec", "sample_no", rs.clip_to_int16(F.col("value") * 100).alias("packed"))


@query("sample_rate_estimate", "C11", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, max(epoch_us(ts)) FILTER (event_type = 'view') AS started, max(epoch_us(ts)) FILTER (event_type = 'purchase') AS stopped,
  count(*) AS samples FROM events GROUP BY 1),
r AS (SELECT day, samples / ((stopped - started) / 1000000) AS rate FROM d WHERE stopped > started),
q AS (SELECT quantile_cont(rate, 0.1) AS lo, quantile_cont(rate, 0.9) AS hi FROM r)
SELECT count(*) AS days, round(avg(rate), 6) AS rate FROM r, q WHERE rate >= lo - 1.5 * (hi - lo) AND rate <= hi + 1.5 * (hi - lo)
""")
def _(t):
    day = t.timed.groupBy(F.to_date("ts").alias("day")).agg(
        F.max(F.when(F.col("event_type") == "view", F.col("us"))).alias("started"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("us"))).alias("stopped"),
        F.count(F.lit(1)).alias("samples"))
    rates = day.filter("stopped > started").select("day", (F.col("samples") / ((F.col("stopped") - F.col("started")) / 1_000_000)).alias("rate")).withColumn("one", F.lit(1))
    q = exact_quantiles(rates, ["one"], "rate", {"lo": 0.1, "hi": 0.9})
    lo, hi = rs.rate_outlier_bounds(F.col("lo"), F.col("hi"))
    # q is one row
    return rates.join(F.broadcast(q), "one").filter((F.col("rate") >= lo) & (F.col("rate") <= hi)).agg(
        F.count(F.lit(1)).alias("days"), F.round(F.avg("rate"), 6).alias("rate"))


@query("stream_quality", "C12", f"""
SELECT user_id, count(*) AS samples, round((max(us) - min(us)) / 1000000 * 0.0001, 6) AS expected, round((max(us) - min(us)) / 1000000, 6) AS seconds,
  round(count(*) / nullif((max(us) - min(us)) / 1000000, 0), 9) AS rate, count_if(us - p > {12 * HOUR_US}) AS gaps,
  round(coalesce(sum(CASE WHEN us - p > {12 * HOUR_US} THEN us - p END), 0) / 1000000, 6) AS missing_seconds FROM ({LAGGED}) GROUP BY user_id
""")
def _(t):
    out = rs.stream_quality(t.timed.select("user_id", "us", "event_id"), event_line(), 0.0001, 12 * HOUR_US)
    return out.select("user_id", "samples", F.round("expected", 6).alias("expected"), F.round("seconds", 6).alias("seconds"),
                      F.round("rate", 9).alias("rate"), "gaps", F.round("missing_seconds", 6).alias("missing_seconds"))


@query("moving_average", "C13", f"WITH {SIGNAL}" + """
SELECT rec, sample_no, round(sum(value) OVER w / 9, 6) AS ma, round(CASE WHEN count(*) OVER w = 9 THEN sum(value) OVER w / 9 END, 6) AS ma_valid FROM sg
WINDOW w AS (PARTITION BY rec ORDER BY sample_no ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)
""")
def _(t):
    line = signal_line()
    out = rs.moving_average(rs.moving_average(signal(t), line, "value", 9, "ma"), line, "value", 9, "ma_valid", valid_only=True)
    return out.select("rec", "sample_no", F.round("ma", 6).alias("ma"), F.round("ma_valid", 6).alias("ma_valid"))


def _conv_sql(weights):
    before, after = (len(weights) - 1) // 2, len(weights) // 2
    terms = []
    for k, w in zip(range(-before, after + 1), weights):
        fn = f"lag(value, {-k}) OVER o" if k < 0 else f"lead(value, {k}) OVER o" if k else "value"
        edge = "first_value(value) OVER w" if k < 0 else "last_value(value) OVER w"
        terms.append(f"coalesce({fn}, {edge}) * {w!r}")
    return (f"WITH {SIGNAL} SELECT rec, sample_no, round({' + '.join(terms)}, 6) AS smooth FROM sg WINDOW o AS (PARTITION BY rec ORDER BY sample_no), "
            f"w AS (PARTITION BY rec ORDER BY sample_no ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)")


@query("savgol_smooth", "C14", _conv_sql(rs.savgol_weights(11, 2)))
def _(t):
    return rs.convolve(signal(t), signal_line(), "value", rs.savgol_weights(11, 2), "smooth").select("rec", "sample_no", F.round("smooth", 6).alias("smooth"))


@query("savgol_smooth_even", "C14", _conv_sql(rs.savgol_weights(20, 2)))
def _(t):
    return rs.convolve(signal(t), signal_line(), "value", rs.savgol_weights(20, 2), "smooth").select("rec", "sample_no", F.round("smooth", 6).alias("smooth"))


@query("gaussian_smooth", "C15", _conv_sql(rs.gaussian_weights(1.0)))
def _(t):
    return rs.convolve(signal(t), signal_line(), "value", rs.gaussian_weights(1.0), "smooth").select("rec", "sample_no", F.round("smooth", 6).alias("smooth"))


@query("gradient", "C16", f"WITH {SIGNAL}" + """
SELECT rec, sample_no, round(coalesce((lead(value) OVER o - lag(value) OVER o) / 2, lead(value) OVER o - value, value - lag(value) OVER o), 6) AS slope
FROM sg WINDOW o AS (PARTITION BY rec ORDER BY sample_no)
""")
def _(t):
    return rs.gradient(signal(t), signal_line(), "value", "slope").select("rec", "sample_no", F.round("slope", 6).alias("slope"))
