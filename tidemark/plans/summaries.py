"""Bucket, percentile, profile and streak queries."""

from pyspark.sql import functions as F

from ..functions import timeutil as tu
from ..operators import aggregates as ag
from ..operators.quantiles import exact_quantiles
from ..operators.timeline import previous
from .common import EPOCHS, HOURS6, epochs
from .joining import DAILY, HAPPENED, MEASURES, daily, happened
from .registry import query
from .resampling import DAY_US, SIGNAL, event_line, signal

TYPES = ["view", "click", "error", "purchase", "signup"]


@query("bucket_medians", "G01 B12", f"""
WITH b AS (SELECT event_type, (epoch_us(ts) - 600000000) // {HOURS6} * {HOURS6} + 600000000 AS bucket, value FROM events),
g AS (SELECT event_type, unnest(range(min(bucket), max(bucket) + 1, {HOURS6})) AS bucket FROM b GROUP BY event_type)
SELECT g.event_type, g.bucket, round(median(b.value), 6) AS median FROM g LEFT JOIN b ON b.event_type = g.event_type AND b.bucket = g.bucket GROUP BY ALL
""")
def _(t):
    return ag.bucket_medians(t.timed, ["event_type"], "us", "value", HOURS6, offset=600_000_000).withColumn("median", F.round("median", 6))


@query("any_nonzero", "G02", """
WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS k FROM events WHERE ts >= TIMESTAMP '2024-01-03')
SELECT user_id, day, CAST(ceil(max(k) FILTER (k NOT IN (1, 2)) / nullif(max(k) FILTER (k NOT IN (1, 2)), 0)) AS DOUBLE) AS active FROM v GROUP BY ALL
""", nullable="active")
def _(t):
    rows = t.events.filter("ts >= timestamp_ntz'2024-01-03'").select("user_id", F.to_date("ts").alias("day"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("k"))
    return ag.any_nonzero(rows, ["user_id", "day"], "k")


@query("filtered_bucket_means", "G03", f"""
SELECT event_type, epoch_us(ts) // 3600000000 AS hour, round(avg(value), 6) AS mean_value FROM events WHERE value BETWEEN 2 AND 60 GROUP BY ALL
""")
def _(t):
    return t.timed.filter(F.col("value").between(2, 60)).groupBy("event_type", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.round(F.avg("value"), 6).alias("mean_value"))


def _index_pick(p, v="vs"):
    n = f"len({v})"
    return (f"CASE WHEN {n} * {p} = floor({n} * {p}) THEN ({v}[greatest(CAST({n} * {p} AS BIGINT), 1)] + {v}[least(CAST({n} * {p} AS BIGINT) + 1, {n})]) / 2 "
            f"ELSE {v}[CAST(floor({n} * {p}) AS BIGINT) + 1] END")


@query("stage_percentiles", "G04", f"WITH {EPOCHS}" + """,
l AS (SELECT unnest(list_filter(['All', stage, CASE WHEN stage <> 'W' THEN 'Sleep' END, CASE WHEN stage <> 'N3' THEN 'NonDeepSleep' END], lambda x: x IS NOT NULL)) AS grp, mean_value, CAST(n AS DOUBLE) AS n FROM ep),
m AS (SELECT grp, 'mean_value' AS col, mean_value AS v FROM l UNION ALL SELECT grp, 'n', n FROM l),
s AS (SELECT grp, col, list_sort(list(v)) AS vs FROM m GROUP BY ALL)
SELECT col AS "column", grp, """ + f"round({_index_pick('0.1::DOUBLE')}, 6) AS p10, round({_index_pick('0.9::DOUBLE')}, 6) AS p90, round(vs[1], 6) AS min, round(vs[-1], 6) AS max FROM s")
def _(t):
    out = ag.stage_percentiles(epochs(t), ["mean_value", "n"], "stage")
    return out.select("column", "grp", *[F.round(c, 6).alias(c) for c in ("p10", "p90", "min", "max")])


@query("first_ten_errors", "G05 M10", f"WITH {EPOCHS}" + """,
r AS (SELECT user_id, abs(mean_value - 20) AS e, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS rn FROM ep)
SELECT user_id, round(avg(e), 6) AS mean_abs, round(avg(e) FILTER (rn <= 10), 6) AS mean_first_ten, bool_or(e > 30) AS any_large FROM r GROUP BY user_id
""")
def _(t):
    from pyspark.sql import Window

    e = F.abs(F.col("mean_value") - 20)
    rows = epochs(t).select("user_id", e.alias("e"), F.row_number().over(Window.partitionBy("user_id").orderBy("epoch")).alias("rn"))
    return rows.groupBy("user_id").agg(F.round(F.avg("e"), 6).alias("mean_abs"), F.round(F.avg(F.when(F.col("rn") <= 10, F.col("e"))), 6).alias("mean_first_ten"),
                                       F.bool_or(F.col("e") > 30).alias("any_large"))


@query("version_coverage", "G06", """
SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS rows, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY event_type
""")
def _(t):
    return ag.coverage(t.events, "event_type", F.to_date("ts"))


@query("cross_tab", "G07", f"""
SELECT CAST(ts AS DATE) AS day, {', '.join(f"count_if(event_type = '{k}') AS {k}" for k in TYPES)} FROM events GROUP BY 1
""")
def _(t):
    return ag.cross_tab(t.events.withColumn("day", F.to_date("ts")), "day", "event_type", TYPES)


@query("duration_quantiles", "G08", f"WITH {HAPPENED}" + """
SELECT event_type, count(*) AS n, round(quantile_cont((us - since) / 1000000, 0.25), 6) AS q25, round(quantile_cont((us - since) / 1000000, 0.5), 6) AS q50,
  round(quantile_cont((us - since) / 1000000, 0.75), 6) AS q75, round(count(*) / ((max(us) - min(since)) / 3600000000), 6) AS per_hour FROM ev GROUP BY event_type
""")
def _(t):
    ev = happened(t).withColumn("secs", (F.col("us") - F.col("since")) / 1_000_000)
    q = exact_quantiles(ev, ["event_type"], "secs", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    n = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / ((F.max("us") - F.min("since")) / 3_600_000_000), 6).alias("per_hour"))
    return n.join(q, "event_type").select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "per_hour")


PROFILE = """
a AS (SELECT user_id, min(epoch_us(ts)) AS anchor FROM events WHERE event_type = 'signup' GROUP BY user_id),
u AS (SELECT e.user_id, e.value, (epoch_us(ts) - anchor) / 3600000000 AS u FROM events e JOIN a USING (user_id)),
f AS (SELECT *, CAST(floor(u / 12) * 12 AS BIGINT) AS "offset" FROM u WHERE u >= 0 AND u <= 480),
p AS (SELECT "offset", avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM f GROUP BY "offset")
"""


def _profile(t, **kw):
    anchors = t.timed.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("us").alias("anchor"))
    return anchors, ag.relative_profile(t.timed.select("user_id", "us", "value"), anchors, ["user_id"], "us", "anchor", "value", unit=3_600_000_000, step=12, reach=480, **kw)


@query("relative_time_profile", "G09", f"WITH {PROFILE}" + """
SELECT "offset", n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - std, 6) AS low_1, round(mean + std, 6) AS high_1, round(mean - 2 * std, 6) AS low_2, round(mean + 2 * std, 6) AS high_2 FROM p
""")
def _(t):
    _, out = _profile(t)
    return out.select("offset", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low_1", "high_1", "low_2", "high_2")])


@query("user_against_profile", "G10", f"WITH {PROFILE}" + """
SELECT user_id, count_if(value > mean) AS above, count_if(value < mean) AS below FROM f JOIN p USING ("offset") GROUP BY user_id
""")
def _(t):
    anchors, profile = _profile(t)
    hours = (F.col("us") - F.col("anchor")) / 3_600_000_000
    rows = t.timed.select("user_id", "us", "value").join(anchors, "user_id").withColumn("_u", hours).filter("_u >= 0 AND _u <= 480").withColumn("slot", (F.floor(F.col("_u") / 12) * 12).cast("long"))
    return ag.against_profile(rows, profile, ["user_id"], "slot", "value")


@query("longest_streaks", "G11", f"WITH {EPOCHS}" + """,
x AS (SELECT user_id, epoch, mean_value > 15 AS f, row_number() OVER (PARTITION BY user_id ORDER BY epoch) - row_number() OVER (PARTITION BY user_id, mean_value > 15 ORDER BY epoch) AS g FROM ep),
r AS (SELECT user_id, f, count(*) AS n FROM x GROUP BY user_id, f, g)
SELECT user_id, coalesce(max(n) FILTER (f), 0) AS streak, CASE WHEN bool_or(f) THEN max(n) ELSE 0 END AS any_run FROM r GROUP BY user_id
""")
def _(t):
    ep = epochs(t)
    flag = F.col("mean_value") > 15
    plain = ag.longest_streak(ep, ["user_id"], "epoch", flag)
    return plain.join(ag.longest_streak(ep, ["user_id"], "epoch", flag, any_run=True).withColumnRenamed("streak", "any_run"), "user_id")


@query("timing_against_mean", "G12", f"WITH {DAILY}" + """,
h AS (SELECT user_id, day, hour(make_timestamp(first_us)) + minute(make_timestamp(first_us)) / 60 AS hr FROM dy), m AS (SELECT user_id, avg(hr) AS expected FROM h GROUP BY user_id)
SELECT user_id, day, round(expected, 6) AS expected, round(hr - expected, 6) AS deviation FROM h JOIN m USING (user_id)
""")
def _(t):
    h = daily(t).select("user_id", "day", tu.hour_fraction(tu.from_micros(F.col("first_us"))).alias("hr"))
    m = h.groupBy("user_id").agg(F.avg("hr").alias("expected"))
    return h.join(m, "user_id").select("user_id", "day", F.round("expected", 6).alias("expected"), F.round(F.col("hr") - F.col("expected"), 6).alias("deviation"))


@query("rolling_stability", "G13", f"WITH {DAILY}" + """
SELECT user_id, day, round(CASE WHEN count(n) OVER w >= 3 THEN avg(n) OVER w END, 6) AS rolling_mean, round(CASE WHEN count(n) OVER w >= 3 THEN stddev_samp(n) OVER w END, 6) AS rolling_std
FROM dy WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
""")
def _(t):
    out = ag.centred_rolling(daily(t), ["user_id"], "day", "n")
    return out.select("user_id", "day", F.round("rolling_mean", 6).alias("rolling_mean"), F.round("rolling_std", 6).alias("rolling_std"))


@query("detection_error_summary", "G14", """
WITH e AS (SELECT abs(value - 20) AS e FROM events)
SELECT round(median(e), 6) AS median, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.9), 6) AS q90, round(count_if(e > 5) / count(*), 6) AS mismatch_share, count(*) AS n FROM e
""")
def _(t):
    out = ag.error_summary(t.events, F.col("value") - 20, 5)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("median", "mean", "q90", "mismatch_share")])


@query("key_prefix_sizes", "G15 H06", """
WITH c AS (SELECT event_type || ':k' AS key, json_extract_string(props, '$.k') AS v FROM events UNION ALL SELECT event_type || ':value:raw', CAST(user_id AS VARCHAR) FROM events)
SELECT split_part(key, ':', 1) AS prefix, count(*) AS entries, CAST(sum(strlen(key)) AS BIGINT) AS key_bytes, CAST(sum(strlen(v)) AS BIGINT) AS value_bytes,
  round(sum(strlen(key)) / (sum(strlen(key)) + sum(strlen(v))), 6) AS key_share FROM c GROUP BY 1
""")
def _(t):
    doc = t.events.select(F.create_map(F.concat("event_type", F.lit(":k")), F.get_json_object("props", "$.k"),
                                       F.concat("event_type", F.lit(":value:raw")), F.col("user_id").cast("string")).alias("doc"))
    return ag.key_prefix_sizes(doc, "doc").withColumn("key_share", F.round("key_share", 6))


@query("distinct_tags", "G16 N07", """
SELECT tag, count(DISTINCT doc_id) AS notes FROM (SELECT doc_id, unnest([lang, source]) AS tag FROM documents) GROUP BY tag
""")
def _(t):
    tags = t.documents.select("doc_id", F.explode(F.array("lang", "source")).alias("tag"))
    return tags.groupBy("tag").agg(F.count_distinct("doc_id").alias("notes"))


@query("label_correlations", "G17", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS r, round(avg({c}) FILTER (l_returnflag = 'R'), 6) AS mean_true, round(avg({c}) FILTER (l_returnflag <> 'R'), 6) AS mean_false FROM lineitem"
    for c in MEASURES))
def _(t):
    out = ag.label_correlations(t.lineitem, MEASURES, F.col("l_returnflag") == "R")
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("r", "mean_true", "mean_false")])


@query("zscore_exceedances", "G18", """
WITH l AS (SELECT 'value' AS col, value AS v FROM events UNION ALL SELECT 'price', l_extendedprice FROM lineitem WHERE false),
b AS (SELECT col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY col),
c AS (SELECT l.col, k.clip, CASE WHEN k.clip < 0 THEN v ELSE least(greatest(v, q1 - k.clip * (q3 - q1)), q3 + k.clip * (q3 - q1)) END AS v
  FROM l JOIN b USING (col) CROSS JOIN (VALUES (-1.0::DOUBLE), (1.5::DOUBLE), (3.0::DOUBLE)) k(clip)),
m AS (SELECT col, clip, avg(v) AS m, stddev_samp(v) AS s FROM c GROUP BY ALL)
SELECT col AS "column", clip, count_if((v - m) / s > 1.0) AS over_1_0, count_if((v - m) / s > 2.5) AS over_2_5 FROM c JOIN m USING (col, clip) GROUP BY ALL
""")
def _(t):
    return ag.exceedances(t.events, ["value"], [1.0, 2.5], [None, 1.5, 3.0])


@query("session_rates", "G19", f"WITH {HAPPENED}" + """
SELECT user_id, round(count_if(is_long) / ((max(us) - min(us)) / 3600000000), 6) AS wakings_per_hour, round(count_if(is_long) / count(*), 6) AS label_share,
  round((max(us) - min(us)) / 3600000000, 6) AS hours FROM ev GROUP BY user_id HAVING max(us) > min(us)
""")
def _(t):
    hours = (F.max("us") - F.min("us")) / 3_600_000_000
    out = happened(t).groupBy("user_id").agg(F.count_if("is_long").alias("k"), F.count(F.lit(1)).alias("n"), hours.alias("h")).filter("h > 0")
    return out.select("user_id", F.round(F.col("k") / F.col("h"), 6).alias("wakings_per_hour"), F.round(F.col("k") / F.col("n"), 6).alias("label_share"), F.round("h", 6).alias("hours"))


@query("stage_feature_averages", "G20 G23", f"WITH {EPOCHS}" + """
SELECT user_id, round(avg(mean_value) FILTER (stage = 'N3') + 1e-9, 6) AS mean_deep, round(median(mean_value) FILTER (stage = 'N3') + 1e-9, 6) AS median_deep,
  count_if(stage = 'N3') * 0.5::DOUBLE AS minutes_deep, count_if(stage = 'W') > 10 AS bad_night FROM ep GROUP BY user_id
""")
def _(t):
    ep = epochs(t)
    deep = exact_quantiles(ep.filter("stage = 'N3'"), ["user_id"], "mean_value", {"median_deep": 0.5})
    out = ep.groupBy("user_id").agg(F.avg(F.when(F.col("stage") == "N3", F.col("mean_value"))).alias("mean_deep"),
                                    (F.count_if(F.col("stage") == "N3") * F.lit(0.5)).alias("minutes_deep"), (F.count_if(F.col("stage") == "W") > 10).alias("bad_night"))
    return out.join(deep, "user_id", "left").select("user_id", F.round(F.col("mean_deep") + 1e-9, 6).alias("mean_deep"), F.round(F.col("median_deep") + 1e-9, 6).alias("median_deep"), "minutes_deep", "bad_night")


@query("describe_columns", "G21", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"
    for c in MEASURES))
def _(t):
    out = ag.describe(t.lineitem, MEASURES)
    return out.select("column", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@query("signal_resolution", "G22", f"WITH {SIGNAL}," + """
s AS (SELECT *, abs(round(value / 20) * 20 - lag(round(value / 20) * 20) OVER (PARTITION BY rec, sample_no // 64 ORDER BY sample_no)) AS step FROM sg)
SELECT rec, sample_no // 64 AS epoch, round(count(DISTINCT round(value / 20) * 20) / count(*), 6) AS distinct_ratio, round(avg(step), 6) AS mean_step FROM s GROUP BY ALL
""")
def _(t):
    from ..operators.timeline import Timeline

    rows = signal(t).select("rec", F.floor(F.col("sample_no") / 64).alias("epoch"), "sample_no", (F.round(F.col("value") / 20) * 20).alias("q"))
    # an epoch holds a fixed number of samples, so it is its own chunk
    seen = previous(rows, Timeline(("rec", "epoch"), ("sample_no",), F.lit(0)), p="q")
    return seen.groupBy("rec", "epoch").agg(F.round(F.count_distinct("q") / F.count(F.lit(1)), 6).alias("distinct_ratio"), F.round(F.avg(F.abs(F.col("q") - F.col("p"))), 6).alias("mean_step"))


@query("resolution_of_first_deep_epoch", "G22", f"WITH {EPOCHS}, {SIGNAL.strip().removesuffix(',')}," + """
f AS (SELECT user_id, min(epoch) AS epoch FROM ep WHERE stage = 'N3' AND confidence > 0.8 GROUP BY user_id),
s AS (SELECT rec, sample_no // 64 AS epoch, value, abs(value - lag(value) OVER (PARTITION BY rec, sample_no // 64 ORDER BY sample_no)) AS step FROM sg)
SELECT f.user_id, f.epoch, round(count(DISTINCT value) / count(*), 6) AS distinct_ratio, round(avg(step), 6) AS mean_step
FROM f JOIN s ON s.rec = f.user_id AND s.epoch = f.epoch % 4 GROUP BY ALL
""")
def _(t):
    from ..operators.timeline import Timeline

    # the first deep epoch that is sure; its samples are those of the recording with its number
    first = epochs(t).filter("stage = 'N3' AND confidence > 0.8").groupBy("user_id").agg(F.min("epoch").alias("first_epoch"))
    rows = signal(t).select("rec", F.floor(F.col("sample_no") / 64).alias("epoch"), "sample_no", "value")
    chosen = rows.join(first.select(F.col("user_id").alias("rec"), (F.col("first_epoch") % 4).alias("epoch"), "first_epoch"), ["rec", "epoch"])
    seen = previous(chosen, Timeline(("rec", "epoch"), ("sample_no",), F.lit(0)), p="value")
    return seen.groupBy(F.col("rec").alias("user_id"), F.col("first_epoch").alias("epoch")).agg(
        F.round(F.count_distinct("value") / F.count(F.lit(1)), 6).alias("distinct_ratio"), F.round(F.avg(F.abs(F.col("value") - F.col("p"))), 6).alias("mean_step"))
