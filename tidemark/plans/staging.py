"""Hypnogram queries on epochs derived from ``events``."""

from itertools import permutations

from pyspark.sql import functions as F

from ..functions import timeutil as tu
from ..operators import hypnogram as hy
from .common import CHANNELS, EPOCHS, HOURS6, WIDE, channel_epochs, epochs
from .registry import query

def _runs_sql(max_gap, min_len, hours):
    return f"""
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS pos,
  sum(CASE WHEN stage <> 'W' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch) AS offs FROM ep),
q AS (SELECT *, lag(offs) OVER (PARTITION BY user_id ORDER BY epoch) AS last_offs FROM b WHERE stage = 'W' AND {hours}),
q2 AS (SELECT *, CASE WHEN offs - last_offs <= {max_gap} THEN offs - last_offs ELSE 0 END AS gap,
  sum(CASE WHEN last_offs IS NULL OR offs - last_offs > {max_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch) AS run FROM q),
k AS (SELECT user_id, run FROM q2 GROUP BY ALL HAVING count(*) + sum(gap) >= {min_len}),
g AS (SELECT q2.user_id, q2.pos, q2.gap FROM q2 JOIN k USING (user_id, run)),
lr AS (SELECT b.*, EXISTS (SELECT 1 FROM g WHERE g.user_id = b.user_id AND b.pos <= g.pos AND b.pos >= g.pos - g.gap) AS in_long_run FROM b)
"""


@query("long_run_epochs", "B04 C01 G01 E12 E13 E14", f"WITH {EPOCHS}, {_runs_sql(1, 2, 'true')}," + """
md AS (SELECT user_id, epoch_us(ts) // 21600000000 AS epoch, median(value) AS median_value FROM events GROUP BY ALL),
f AS (SELECT user_id, day, min(at_us) AS first_us FROM lr WHERE in_long_run GROUP BY ALL)
SELECT lr.user_id, lr.epoch, lr.day AS night, lr.stage, lr.n, round(md.median_value, 6) AS median_value, in_long_run,
  coalesce((f.first_us - at_us) / 60000000, -1) AS mins_until_first, f.first_us IS NOT NULL AS group_has_any,
  coalesce((f.first_us - at_us) / 60000000 > 0, false) AS is_before_first
FROM lr JOIN md USING (user_id, epoch) LEFT JOIN f ON f.user_id = lr.user_id AND f.day = lr.day
""")
def _(t):
    from ..operators.quantiles import exact_quantiles

    medians = exact_quantiles(t.timed.withColumn("epoch", F.floor(F.col("us") / HOURS6)), ["user_id", "epoch"], "value", {"median_value": 0.5})
    runs = hy.long_runs(epochs(t), ["user_id"], "epoch", F.col("stage") == "W", max_gap=1, min_length=2)
    runs = runs.withColumn("night", F.to_date(tu.from_micros(F.col("at"))))
    out = hy.minutes_until_first(runs, ["user_id", "night"], "at", "in_long_run")
    return out.join(medians, ["user_id", "epoch"]).select(
        "user_id", "epoch", "night", "stage", "n", F.round("median_value", 6).alias("median_value"),
        "in_long_run", "mins_until_first", "group_has_any", "is_before_first")


@query("long_wakes_in_hours", "E12", f"WITH {EPOCHS}, {_runs_sql(2, 4, 'epoch % 4 < 3')} SELECT user_id, epoch, stage, in_long_run FROM lr")
def _(t):
    runs = hy.long_runs(epochs(t), ["user_id"], "epoch", F.col("stage") == "W", counts=F.pmod("epoch", F.lit(4)) < 3, max_gap=2, min_length=4)
    return runs.select("user_id", "epoch", "stage", "in_long_run")


@query("best_channel", "E01 E02 F02", f"WITH {CHANNELS}" + """,
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY confidence DESC, channel) AS rk FROM ch)
SELECT user_id, day, stage, confidence, channel AS source, CAST(list_position(['W','N1','N2','N3','R'], stage) - 1 AS INTEGER) AS stage_int FROM b WHERE rk = 1
""")
def _(t):
    best = hy.best_channel(channel_epochs(t), ["user_id", "day"], "channel", "stage", "confidence", F.col("channel"))
    return best.withColumn("stage_int", hy.stage_to_int(F.col("stage")))


@query("stage_transitions", "E03", f"WITH {EPOCHS}" + """,
m AS (SELECT user_id, stage AS from_stage, lead(stage) OVER (PARTITION BY user_id ORDER BY epoch) AS to_stage FROM ep)
, g AS (SELECT user_id, from_stage, to_stage, count(*) AS n FROM m WHERE to_stage IS NOT NULL GROUP BY ALL)
SELECT user_id, from_stage, to_stage, n, round(n / sum(n) OVER (PARTITION BY user_id, from_stage), 6) AS share FROM g
""")
def _(t):
    return hy.transitions(epochs(t), ["user_id"], "epoch").withColumn("share", F.round("share", 6))


@query("stage_stability", "E03", f"WITH {EPOCHS}" + """,
m AS (SELECT user_id, stage AS f, lead(stage) OVER (PARTITION BY user_id ORDER BY epoch) AS g FROM ep),
d AS (SELECT user_id, f, list_position(['W','N1','N2','N3','R'], f) - 1 AS i, count_if(f = g) / count(*) AS d FROM m WHERE g IS NOT NULL GROUP BY ALL)
SELECT user_id, round_even(avg(d) FILTER (i >= 2), 3) AS any_stage, round_even(max(d) FILTER (f = 'W'), 3) AS wake, round_even(max(d) FILTER (f = 'N1'), 3) AS n1,
  round_even(max(d) FILTER (f = 'N2'), 3) AS n2, round_even(max(d) FILTER (f = 'N3'), 3) AS n3, round_even(max(d) FILTER (f = 'R'), 3) AS rem,
  round_even(avg(d) FILTER (i >= 1), 3) AS sleep FROM d GROUP BY user_id
""")
def _(t):
    return hy.stability(hy.transitions(epochs(t), ["user_id"], "epoch"), ["user_id"])


def _stats_sql():
    stages = ["N1", "N2", "N3", "R"]
    lat = ", ".join(f"(min(epoch) FILTER (stage = '{s}') - min(epoch)) * 0.5 AS latency_{s.lower()}" for s in stages)
    mins = ", ".join(f"count_if(stage = '{s}') * 0.5 AS minutes_{s.lower()}" for s in ["W", *stages])
    pct = ", ".join(f"100 * minutes_{s.lower()} / nullif(tst, 0) AS percent_{s.lower()}" for s in stages)
    names = ", ".join([f"latency_{s.lower()}" for s in stages] + [f"minutes_{s.lower()}" for s in ["W", *stages]])
    return f"""WITH {EPOCHS},
o AS (SELECT user_id, min(epoch) FILTER (stage <> 'W') AS onset, max(epoch) FILTER (stage <> 'W') AS fin FROM ep GROUP BY ALL),
a AS (SELECT user_id, count(*) * 0.5 AS tib, count_if(stage <> 'W') * 0.5 AS tst, count_if(stage = 'W' AND epoch > onset AND epoch < fin) * 0.5 AS waso,
  (min(epoch) FILTER (stage <> 'W') - min(epoch)) * 0.5 AS onset_latency, {lat}, {mins} FROM ep JOIN o USING (user_id) GROUP BY user_id)
SELECT user_id, tib::DOUBLE AS tib, tst::DOUBLE AS tst, waso::DOUBLE AS waso, onset_latency::DOUBLE AS onset_latency,
  100 * tst / tib AS efficiency, 100 * tst / nullif(tst + waso, 0) AS maintenance, COLUMNS('latency_n|latency_r|minutes_')::DOUBLE, {pct} FROM a"""


@query("sleep_statistics", "E04", _stats_sql())
def _(t):
    return hy.sleep_statistics(epochs(t), ["user_id"])


def _pair_sql(a, b):
    over = ", ".join(
        f"count_if(s{a} IS DISTINCT FROM s{b} AND c{a} > c{b} + {v}) AS over_{tag}, count_if(s{a} IS DISTINCT FROM s{b} AND c{a} > c{b} + {v}) / count(*) * 100 AS over_{tag}_pct"
        for v, tag in ((0.05, "05"), (0.1, "10"), (0.2, "20")))
    apart = f"(s{a} <> s{b} OR s{a} IS NULL OR s{b} IS NULL)"
    return f"SELECT 'F{a}-F{b}' AS channels, count(*) AS epochs, count_if({apart}) AS differ, count_if({apart}) / count(*) * 100 AS differ_pct, {over} FROM w"


@query("channel_disagreement", "E05 F02", f"WITH {WIDE} {_pair_sql(0, 1)} UNION ALL {_pair_sql(1, 0)}")
def _(t):
    wide = hy.channels_side_by_side(channel_epochs(t), ["user_id", "day"], "channel", ["F0", "F1", "F2"], ["stage", "confidence"])
    return hy.disagreement(wide, "F0", "F1").unionByName(hy.disagreement(wide, "F1", "F0"))


def _triple_sql(a, b, c):
    apart = f"(s{a} <> s{b} OR s{a} IS NULL OR s{b} IS NULL)"
    cols = "".join(
        f", count_if({apart} AND c{a} > c{b} + {v}) AS over_{g}, count_if({apart} AND c{a} > c{b} + {v} AND s{a} = s{c}) AS over_{g}_backed,"
        f" count_if(s{a} = s{c} AND {apart} AND (c{a} > c{b} + {v} OR c{c} > c{b} + {v})) AS either_{g}"
        for v, g in ((0.05, "05"), (0.1, "10"), (0.2, "20")))
    return (f"SELECT 'F{a}-F{b}-F{c}' AS channels, count(*) AS epochs, count_if({apart}) AS differ, count_if(s{a} = s{c} AND {apart}) AS third_agrees,"
            f" count_if(s{a} = s{c} AND s{a} = s{b}) AS all_agree{cols} FROM w")


@query("channel_triples", "E06", f"WITH {WIDE} " + " UNION ALL ".join(_triple_sql(*p) for p in permutations(range(3), 3)))
def _(t):
    channels = ["F0", "F1", "F2"]
    wide = hy.channels_side_by_side(channel_epochs(t), ["user_id", "day"], "channel", channels, ["stage", "confidence"])
    return hy.triple_agreement(wide, channels)


@query("confident_wake", "E07", f"WITH {EPOCHS}" + """,
s AS (SELECT *, stage = 'W' AND confidence >= 0.75 AS sure FROM ep)
SELECT user_id, epoch, sure AND coalesce(lag(sure) OVER o, false) AND coalesce(lead(sure) OVER o, false) AS probably_awake
FROM s WINDOW o AS (PARTITION BY user_id ORDER BY epoch)
""")
def _(t):
    return hy.confident_wake(epochs(t), ["user_id"], "epoch").select("user_id", "epoch", "probably_awake")


@query("events_in_epochs", "E08", f"WITH {EPOCHS}" + """,
x AS (SELECT user_id, epoch, at_us, lead(at_us) OVER (PARTITION BY user_id ORDER BY epoch) AS end_us FROM ep),
h AS (SELECT x.user_id, x.epoch, count(e.us) AS k, min(e.us) AS lo, max(e.us) AS hi, string_agg(e.us, ' ' ORDER BY e.us) AS times FROM x LEFT JOIN
  (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error') e
  ON e.user_id = x.user_id AND e.us >= x.at_us AND (e.us < x.end_us OR x.end_us IS NULL) GROUP BY ALL)
SELECT user_id, epoch, CASE WHEN end_us IS NULL THEN 0 ELSE k END AS event_count, CASE WHEN end_us IS NOT NULL THEN lo END AS first_event,
  CASE WHEN end_us IS NOT NULL THEN hi END AS last_event, CASE WHEN end_us IS NOT NULL THEN coalesce(times, '') ELSE '' END AS event_times,
  k > 0 OR coalesce(end_us IS NOT NULL AND at_us >= 1704844800000000 AND end_us <= 1704931200000000, false) AS definitely_awake
FROM x JOIN h USING (user_id, epoch)
""", nullable="first_event last_event")
def _(t):
    presses = t.timed.filter("event_type = 'error'").select("user_id", "us")
    manual = (F.lit(1704844800000000), F.lit(1704931200000000))
    out = hy.events_per_epoch(epochs(t), presses, ["user_id"], "at", "us", manual)
    return out.select("user_id", "epoch", "event_count", "first_event", "last_event", F.array_join("event_times", " ").alias("event_times"), "definitely_awake")


@query("away_from_wake", "E09 E10", f"WITH {EPOCHS}" + """,
m AS (SELECT *, bool_or(stage = 'W') OVER (PARTITION BY user_id ORDER BY at_us RANGE BETWEEN 43200000000 PRECEDING AND 43200000000 FOLLOWING) AS near_wake FROM ep)
SELECT user_id, epoch, stage = 'W' AS awake, NOT near_wake AS probably_asleep, stage = 'W' AND NOT near_wake AS impossible FROM m
""")
def _(t):
    out = hy.away_from(epochs(t), ["user_id"], "at", F.col("stage") == "W", 2 * HOURS6)
    awake = F.col("stage") == "W"
    return out.select("user_id", "epoch", awake.alias("awake"), "probably_asleep", (awake & F.col("probably_asleep")).alias("impossible"))


ANCHORS = f"""
WITH {EPOCHS},
dd AS (SELECT user_id, day, min(at_us) FILTER (stage = 'N3') AS asleep, min(at_us) FILTER (stage = 'N2') AS ready, min(at_us) - 1800000000 AS in_bed,
  min(at_us) - 900000000 AS lep, max(at_us) + 600000000 AS wake FROM ep GROUP BY ALL),
a AS (SELECT ep.*, (at_us - asleep) / 60000000 AS mins_since_asleep, (at_us - ready) / 60000000 AS mins_since_ready, (at_us - in_bed) / 60000000 AS mins_since_in_bed,
  (at_us - lep) / 60000000 AS mins_since_lep, (wake - at_us) / 60000000 AS mins_until_wake, asleep, ready FROM ep JOIN dd USING (user_id, day))
"""


def _anchored(t):
    ep = epochs(t).withColumn("day", F.to_date(tu.from_micros(F.col("at"))))
    days = ep.groupBy("user_id", "day").agg(
        F.min(F.when(F.col("stage") == "N3", F.col("at"))).alias("asleep"),
        F.min(F.when(F.col("stage") == "N2", F.col("at"))).alias("ready"),
        (F.min("at") - 1_800_000_000).alias("in_bed"),
        (F.min("at") - 900_000_000).alias("lep"),
        (F.max("at") + 600_000_000).alias("wake"),
    )
    return hy.anchor_features(ep, days, ["user_id", "day"], "at")


@query("anchor_features", "E16 E17 E18", ANCHORS + """
SELECT user_id, epoch, mins_since_asleep, mins_since_ready, mins_since_in_bed, mins_since_lep, mins_until_wake,
""" + "".join(f"CAST(mins_since_asleep BETWEEN -{m} AND 0 AS INTEGER) AS before_sleep_{m}, CAST(mins_since_ready BETWEEN -{m} AND 0 AS INTEGER) AS before_ready_{m}, " for m in (15, 30, 60))
    + "".join(f"CAST(mins_since_asleep BETWEEN {lo * 60} AND {lo * 60 + 120} AS INTEGER) AS sleep_hour_{n}, " for lo, n in ((0, "1_to_2"), (2, "3_to_4"), (4, "5_to_6"), (6, "7_to_8")))
    + "CAST(at_us BETWEEN ready AND asleep AS INTEGER) AS during_ready, "
    + ", ".join(f"coalesce(mins_until_wake > 0 AND mins_until_wake <= {n}, false) AS within_{n}" for n in (10, 60, 240))
    + ", coalesce(mins_since_asleep >= 60, false) AS insomnia FROM a",
    nullable="before_sleep_15 before_ready_15 before_sleep_30 before_ready_30 before_sleep_60 before_ready_60 sleep_hour_1_to_2 sleep_hour_3_to_4 sleep_hour_5_to_6 sleep_hour_7_to_8 during_ready")
def _(t):
    out = hy.within_targets(_anchored(t), F.col("mins_until_wake"), [10, 60, 240])
    out = out.withColumn("insomnia", F.coalesce(F.col("mins_since_asleep") >= 60, F.lit(False)))
    return out.drop("stage", "confidence", "n", "mean_value", "at", "day")


@query("stage_flags", "E11", ANCHORS + """,
f AS (SELECT user_id, epoch, stage, coalesce(mins_since_ready <= 0, false) AS pre, coalesce(mins_since_asleep >= 0, false) AS post, coalesce(mins_until_wake < 0, false) AS fin FROM a)
SELECT user_id, epoch, stage = 'N3' AS ss_deep, stage = 'W' AS ss_wake, stage = 'N1' AS ss_n1, stage = 'N2' AS ss_n2, stage = 'R' AS ss_r,
  pre AS ss_pre_ready, post AS ss_after_sleep, pre AND NOT post AS ss_during_ready, fin AS ss_after_final_wake, post AND NOT fin AS ss_during_sleep,
  post AND NOT fin AND stage = 'W' AS ss_wake_during_sleep FROM f
""")
def _(t):
    out = hy.stage_flags(_anchored(t))
    return out.select("user_id", "epoch", *[c for c in out.columns if c.startswith("ss_")])


@query("usable_nights", "E15", f"WITH {EPOCHS}" + """
SELECT user_id, epoch, stage FROM ep WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def _(t):
    usable = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return epochs(t).select("user_id", "epoch", "stage").join(usable, "user_id", "left_semi")


@query("night_summary", "E19 G05", f"WITH {EPOCHS}" + """
SELECT user_id, day, arg_min(stage, epoch) AS first_stage, bool_or(stage = 'W') AS any_wake, count_if(stage = 'W') AS wake_epochs,
  count_if(stage <> 'W') AS sleep_epochs, round(avg(abs(mean_value - 20)), 6) AS mean_abs_error FROM ep GROUP BY ALL
""")
def _(t):
    wake = F.col("stage") == "W"
    return epochs(t).groupBy("user_id", F.to_date(tu.from_micros(F.col("at"))).alias("day")).agg(
        F.min_by("stage", "epoch").alias("first_stage"), F.bool_or(wake).alias("any_wake"), F.count_if(wake).alias("wake_epochs"),
        F.count_if(~wake).alias("sleep_epochs"), F.round(F.avg(F.abs(F.col("mean_value") - 20)), 6).alias("mean_abs_error"))
