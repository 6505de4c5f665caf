"""Profiles, clean-up and event-log queries."""

from pyspark.sql import functions as F

from ..operators import eventlog as el
from ..operators import quality as qu
from ..operators.quantiles import exact_quantiles
from .common import CHANNELS, EPOCHS, HOURS6, channel_epochs, epochs
from .joining import DAILY, MEASURES, daily
from .registry import query
from .resampling import DAY_US, HOUR_US, event_line

HOLES = """
wd AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CASE WHEN value >= 5 THEN value END AS a, CASE WHEN k % 7 <> 0 THEN CAST(k AS DOUBLE) END AS b,
  CASE WHEN user_id % 3 <> 0 THEN CAST(user_id AS DOUBLE) END AS c, value - 20 AS d, CASE WHEN event_id % 100 = 0 THEN 'inf'::DOUBLE ELSE value END AS e
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))
"""
COLS = ["a", "b", "c", "d"]


def holes(t):
    k = F.get_json_object("props", "$.k").cast("long")
    v, u = F.col("value"), F.col("user_id")
    return t.events.select(
        "event_id", "user_id", F.to_date("ts").alias("day"), F.when(v >= 5, v).alias("a"), F.when(k % 7 != 0, k.cast("double")).alias("b"),
        F.when(u % 3 != 0, u.cast("double")).alias("c"), (v - 20).alias("d"),
        F.when(F.col("event_id") % 100 == 0, F.lit(float("inf"))).otherwise(v).alias("e"))


@query("missing_profile", "H01 G06", f"WITH {HOLES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 'double' AS type, count({c}) AS present, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 1) AS missing_pct, min(day) FILTER ({c} IS NULL) AS first_missing, max(day) FILTER ({c} IS NULL) AS last_missing FROM wd" for c in COLS))
def _(t):
    return qu.missing_profile(holes(t), COLS, "day")


@query("required_complete", "H02", f"WITH {HOLES} SELECT event_id, d FROM wd")
def _(t):
    return qu.require_complete(holes(t), ["d", "event_id"]).select("event_id", "d")


@query("negative_profile", "H03", f"WITH {HOLES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, count_if({c} < 0) AS negatives, round(count_if({c} < 0) * 100 / count({c}), 1) AS negative_pct, min({c}) AS min FROM wd" for c in COLS))
def _(t):
    return qu.negative_profile(holes(t), COLS)


@query("sequential_row_removal", "H04", f"WITH {HOLES}," + """
o AS (SELECT unnest(['a','b','c','d']) AS col, unnest([count(a), count(b), count(c), count(d)]) AS present FROM wd),
r AS (SELECT col, row_number() OVER (ORDER BY present DESC, col) AS step FROM o),
m AS (SELECT event_id, min(step) AS at FROM (SELECT event_id, unnest(['a','b','c','d']) AS col, unnest([a IS NULL, b IS NULL, c IS NULL, d IS NULL]) AS gone FROM wd) JOIN r USING (col) WHERE gone GROUP BY event_id),
k AS (SELECT r.col, r.step, count(m.event_id) AS removed FROM r LEFT JOIN m ON m.at = r.step GROUP BY ALL)
SELECT col AS "column", CAST(step AS INTEGER) AS step, removed, CAST(sum(removed) OVER (ORDER BY step) AS BIGINT) AS cumulative_removed FROM k
""".replace("AS at FROM", "AS pos FROM").replace("m.at", "m.pos"))
def _(t):
    return qu.sequential_removal(holes(t), COLS)


@query("greedy_row_removal", "H05", f"WITH RECURSIVE {HOLES}," + """
pt AS (SELECT list_filter([CASE WHEN a IS NULL THEN 1 END, CASE WHEN b IS NULL THEN 2 END, CASE WHEN c IS NULL THEN 3 END, CASE WHEN d IS NULL THEN 4 END], lambda x: x IS NOT NULL) AS miss, count(*) AS n FROM wd GROUP BY 1),
nx AS (SELECT 0 AS step, []::INTEGER[] AS done, 0::BIGINT AS removed, 0::BIGINT AS gone
  UNION ALL SELECT step + 1, list_append(done, pick[2]::INTEGER), pick[1], gone + pick[1] FROM (
    SELECT nx.step, nx.done, nx.gone, list_min(list_transform(list_filter([1, 2, 3, 4], lambda c: NOT list_contains(nx.done, c)),
      lambda c: [coalesce(list_sum(list_transform(pp.all_patterns, lambda p: CASE WHEN list_contains(p.miss, c) AND NOT list_has_any(p.miss, nx.done) THEN p.n ELSE 0 END)), 0)::BIGINT, c])) AS pick
    FROM nx, (SELECT list({'miss': miss, 'n': n}) AS all_patterns FROM pt) pp WHERE nx.step < 4))
SELECT step, ['a', 'b', 'c', 'd'][done[-1]] AS "column", removed, round(removed / (SELECT count(*) FROM wd) * 100, 1) AS removed_pct, gone AS cumulative_removed, round(gone / (SELECT count(*) FROM wd) * 100, 1) AS cumulative_pct
FROM nx WHERE step > 0
""")
def _(t):
    return qu.greedy_removal(holes(t), COLS)


@query("prefix_coverage", "H06", f"WITH {HOLES}," + """
p AS (SELECT 'x' AS prefix, 2 AS column_count, count(a) + count(b) AS present_count, 2 * count(*) AS cells FROM wd UNION ALL SELECT 'y', 2, count(c) + count(d), 2 * count(*) FROM wd)
SELECT prefix, CAST(column_count AS BIGINT) AS column_count, CAST(present_count AS BIGINT) AS present_count, CAST(cells - present_count AS BIGINT) AS missing_count, round((cells - present_count) * 100 / cells, 1) AS missing_pct FROM p
""")
def _(t):
    df = holes(t).select(F.col("a").alias("x:a"), F.col("b").alias("x:b"), F.col("c").alias("y:c"), F.col("d").alias("y:d"))
    return qu.prefix_coverage(df, df.columns)


@query("row_prefix_coverage", "H06", f"WITH {HOLES}," + """
p AS (SELECT 'u' || (user_id % 5) AS prefix, count(*) AS row_count, count(a) + count(b) AS present_count FROM wd GROUP BY 1)
SELECT prefix, row_count, present_count, row_count * 2 - present_count AS missing_count, round((row_count * 2 - present_count) * 100 / (row_count * 2), 1) AS missing_pct FROM p
""")
def _(t):
    df = holes(t).withColumn("key", F.concat(F.lit("u"), F.col("user_id") % 5, F.lit(":"), F.col("event_id")))
    return qu.row_prefix_coverage(df, "key", ["a", "b"])


@query("selected_features", "H07", f"WITH {EPOCHS} SELECT user_id, epoch, round(mean_value, 6) AS \"Main_eeg_abspow\", n AS \"minsSinceStart\", n AS \"HR_30s\", n AS \"O2\", n AS \"SSDeep\", n AS \"Microwakings30\" FROM ep")
def _(t):
    n = lambda *names: [F.col("n").alias(x) for x in names]
    wide = epochs(t).select("user_id", "epoch", F.round("mean_value", 6).alias("Main_eeg_abspow"), *n(
        "Main_eeg_kurt", "Main_eeg_abspow_c7min_norm", "Main_eeg_abspow_s", "Main_eeg_std", "minsSinceStart", "HR_30s", "O2", "O2_low", "threshold_x", "three",
        "SSDeep", "SSMinsUntilWake", "Microwakings30", "MicrowakingsDbg30", "other"))
    picked = qu.chosen_columns([c for c in wide.columns if c not in ("user_id", "epoch")], ["eeg_easiest", "times", "physical", "sleep_stage_no_times", "microwakings"], real_time=True)
    return wide.select("user_id", "epoch", *picked)


def _day_keys(t):
    """A table of day keys: fixed ones of every kind, dealt to events."""
    names = ["night:yasaExtended:Statistics:SE", "night:yasaExtended:Statistics:Lat_N1", "night:yasaExtended:N3:iqr_s:mean", "night:yasaExtended:W:iqr:mean",
             "night:yasaExtended:All:iqr:mean", "night:yasaExtended:N3:iqr:mean", "night:aggregated:wakeTimeSSM", "night:source:x", "day:source:x",
             "night:yasaExtended:Stability:Aggregated:Deep", "night:yasaExtended:Stability:Aggregated:REM", "energy:energyScore", "hr:AsleepToAwake:mean",
             "exercise:mins", "night:aggregated:readyToSleepTimeSSM", "night:aggregated:microwakingsWithinDeepPerHour", "food:sugar", "night:aggregated:asleepTimeSSM"]
    return t.events.select("event_id", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int")).alias("key"))


DAY_KEYS = """k AS (SELECT event_id, ['night:yasaExtended:Statistics:SE', 'night:yasaExtended:Statistics:Lat_N1', 'night:yasaExtended:N3:iqr_s:mean', 'night:yasaExtended:W:iqr:mean',
  'night:yasaExtended:All:iqr:mean', 'night:yasaExtended:N3:iqr:mean', 'night:aggregated:wakeTimeSSM', 'night:source:x', 'day:source:x', 'night:yasaExtended:Stability:Aggregated:Deep',
  'night:yasaExtended:Stability:Aggregated:REM', 'energy:energyScore', 'hr:AsleepToAwake:mean', 'exercise:mins', 'night:aggregated:readyToSleepTimeSSM',
  'night:aggregated:microwakingsWithinDeepPerHour', 'food:sugar', 'night:aggregated:asleepTimeSSM'][event_id % 18 + 1] AS key FROM events)"""


@query("useful_day_keys", "H07", f"WITH {DAY_KEYS}" + """
SELECT event_id, key FROM k WHERE NOT (key LIKE 'night:yasaExtended:Statistics:%' OR key LIKE 'night:%' AND (contains(key, '_s:') OR contains(key, 'source:') OR contains(key, ':W:') OR contains(key, ':All:'))
  OR key LIKE 'night:yasaExtended:Stability:Aggregated:Deep%' OR key = 'night:yasa:adjusted:debug:discardedMicrowakingsCount')
""")
def _(t):
    return _day_keys(t).filter(qu.useful_day_key(F.col("key")))


@query("curated_day_keys", "H08", f"WITH {DAY_KEYS}" + """
SELECT event_id, key, key IN ('night:yasaExtended:N3:iqr:mean', 'night:aggregated:wakeTimeSSM', 'night:yasaExtended:Stability:Aggregated:REM',
  'night:aggregated:microwakingsWithinDeepPerHour', 'night:aggregated:asleepTimeSSM') AS best_night,
  key IN ('exercise:mins', 'food:sugar', 'night:aggregated:asleepTimeSSM', 'night:aggregated:readyToSleepTimeSSM', 'hr:AsleepToAwake:mean') AS controlled
FROM k
""")
def _(t):
    return _day_keys(t).select("event_id", "key", F.col("key").isin(*qu.best_night_keys()).alias("best_night"), qu.controlled_day_key(F.col("key")).alias("controlled"))


@query("selected_map_keys", "H07 A06", """
SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS kept FROM events
""")
def _(t):
    doc = F.create_map(F.concat("event_type", F.lit(":v")), F.col("value"))
    kept = qu.keep_keys(F.col("doc"), lambda k: ~k.startswith("view"))
    return t.events.select("event_id", "event_type", doc.alias("doc")).select("event_id", F.try_element_at(kept, F.concat("event_type", F.lit(":v"))).alias("kept"))


@query("numeric_finite_rows", "H09 H10 H11", f"WITH {HOLES} SELECT event_id, user_id, a, b, c, d, e FROM wd WHERE NOT isinf(e) AND a IS NOT NULL AND b IS NOT NULL")
def _(t):
    return qu.drop_infinite(qu.numeric_only(holes(t)), ["e"]).dropna(subset=["a", "b"])


@query("clean_target", "H12", f"WITH {HOLES} SELECT event_id, e FROM wd WHERE e IS NOT NULL AND NOT isinf(e) AND e <= 100")
def _(t):
    return qu.clean_target(holes(t).select("event_id", "e"), "e", 100.0)


@query("quantile_clip", "H13", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS plo, quantile_cont(l_extendedprice, 0.99) AS phi, quantile_cont(l_quantity, 0.01) AS qlo, quantile_cont(l_quantity, 0.99) AS qhi FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, plo), phi), 6) AS price, least(least(greatest(l_quantity, qlo), qhi), 40.0::DOUBLE) AS hrv_quantity FROM lineitem, q
""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("hrv_quantity"))
    return qu.clip_to_quantiles(df, ["price", "hrv_quantity"], bounded={"hrv": (0, 40)}).withColumn("price", F.round("price", 6))


@query("absolute_feature_clip", "H14", f"WITH {HOLES} SELECT event_id, least(greatest(d, -1), 1) AS d_abs, CAST(d > 0 AS INTEGER) AS up FROM wd")
def _(t):
    return qu.clip_absolute_features(holes(t).select((F.col("d") > 0).alias("up"), F.col("d").alias("d_abs"), "event_id"))


@query("min_max_scale", "H15", """
WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, round((value - lo) / (hi - lo), 6) AS value FROM events, m
""")
def _(t):
    return qu.min_max_scale(t.events.select("event_id", "value"), ["value"]).withColumn("value", F.round("value", 6))


@query("percentile_scale", "H16", """
WITH l AS (SELECT event_type AS col, value, event_id FROM events), s AS (SELECT col, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM l WHERE col <> 'view' GROUP BY col)
SELECT event_id, col AS "column", round(CASE WHEN p10 IS NULL THEN value ELSE (value - p10) / (p90 - p10) END, 6) AS scaled FROM l LEFT JOIN s USING (col)
""")
def _(t):
    long = t.events.select("event_id", F.col("event_type").alias("column"), "value")
    stats = exact_quantiles(long.filter("column <> 'view'"), ["column"], "value", {"p10": 0.1, "p90": 0.9})
    return qu.scale_by_percentiles(long, stats).select("event_id", "column", F.round("scaled", 6).alias("scaled"))


@query("main_channel", "H17", f"WITH {CHANNELS} SELECT user_id, CASE WHEN bool_or(channel = 'F2') THEN 'F2' ELSE arg_min(channel, (day, channel)) END AS main FROM ch GROUP BY user_id")
def _(t):
    return qu.main_channel(channel_epochs(t), ["user_id"], "channel", F.struct("day", "channel"), preferred="F2")


@query("redundant_percentile_columns", "H18", """
WITH u AS (SELECT user_id, avg(value) AS m, max(value) AS p90, avg(value) + 1 AS p10 FROM events GROUP BY user_id),
r AS (SELECT corr(p90, m) AS r90, corr(p10, m) AS r10 FROM u)
SELECT user_id, round(m, 6) AS value_mean, CASE WHEN r90 >= 0.97 THEN NULL ELSE p90 END AS value_percentile90 FROM u, r
""")
def _(t):
    u = t.events.groupBy("user_id").agg(F.avg("value").alias("value_mean"), F.max("value").alias("value_percentile90"), (F.avg("value") + 1).alias("value_percentile10"))
    return u.drop(*qu.redundant_percentile_columns(u)).withColumn("value_mean", F.round("value_mean", 6))


@query("collinear_columns", "H19", f"WITH {HOLES}," + """
w AS (SELECT b, d, d * 2 + CASE WHEN event_id % 50 = 0 THEN 5 ELSE 0 END AS d2 FROM wd),
r AS (SELECT abs(corr(b, d)) AS bd, abs(corr(b, d2)) AS bd2, abs(corr(d, d2)) AS dd2 FROM w)
SELECT 'flat' AS "column", 'variance' AS reason UNION ALL SELECT CASE WHEN bd > bd2 THEN 'd' ELSE 'd2' END, 'collinear' FROM r WHERE dd2 > 0.99
""")
def _(t):
    noisy = F.col("d") * 2 + F.when(F.col("event_id") % 50 == 0, 5).otherwise(0)
    df = holes(t).select("event_id", "b", "d", noisy.alias("d2"), F.lit(1.0).alias("flat"))
    flat, twins = qu.collinear_columns(df, ["b", "d", "d2", "flat"])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(r).alias("reason")) for r, names in (("variance", flat), ("collinear", twins)) for c in names]
    return df.limit(1).select(F.inline(F.array(*rows)))


DAYS = f"{DAILY}, dn AS (SELECT user_id, day, CASE WHEN n > 1 THEN CAST(n AS DOUBLE) END AS n, CASE WHEN n <> 2 THEN CAST(n AS DOUBLE) END AS m FROM dy)"


def _days(t):
    return daily(t).select("user_id", "day", F.when(F.col("n") > 1, F.col("n").cast("double")).alias("n"), F.when(F.col("n") != 2, F.col("n").cast("double")).alias("m"))


@query("filled_day_features", "H20", f"WITH {DAYS}" + """
SELECT user_id, day, coalesce(n, 0) AS n, round(coalesce(m, avg(m) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), 6) AS m, CAST(n IS NOT NULL AS INTEGER) AS has_n FROM dn
""")
def _(t):
    return qu.fill_day_features(_days(t), ["user_id"], "day", zero=["n"], trailing=["m"], indicator={"has_n": "n"}).withColumn("m", F.round("m", 6))


@query("neighbour_days", "H21", f"WITH {DAYS}" + """
SELECT user_id, day, n, lag(n) OVER w AS n_prev, lead(n) OVER w AS n_next, n - lag(n) OVER w AS n_change FROM dn WINDOW w AS (PARTITION BY user_id ORDER BY day)
""")
def _(t):
    return qu.neighbour_days(_days(t).drop("m"), ["user_id"], "day", ["n"])


@query("nearly_complete_rows", "H22", """
WITH w AS (SELECT event_id, CASE WHEN event_id % 40 <> 0 THEN value END AS a, CASE WHEN event_id % 3 <> 0 THEN value END AS b FROM events)
SELECT event_id, a, b FROM w WHERE a IS NOT NULL
""")
def _(t):
    df = t.events.select("event_id", F.when(F.col("event_id") % 40 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("b"))
    return qu.drop_rows_of_nearly_complete_columns(df, ["a", "b"])


def _label_sql():
    early = "".join(f" WHEN '{k}' THEN {{'b': {b}, 'g': {g}, 'e': {str(e).lower()}}}" for k, (b, g, e) in qu.SETTLING_BEFORE_V4.items())
    late = "".join(f" WHEN '{k}' THEN {{'b': {b}, 'g': {g}, 'e': {str(e).lower()}}}" for k, (b, g, e) in qu.SETTLING_V4.items())
    names = list(dict.fromkeys([*qu.SETTLING_BEFORE_V4, *qu.SETTLING_V4, "unknown"]))
    pick = "".join(f" WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return names, f"""
WITH l AS (SELECT event_id, CASE event_id % {len(names)}{pick} END AS label, CASE event_type WHEN 'view' THEN 'v4' WHEN 'click' THEN 'n/a' WHEN 'error' THEN 'v3' ELSE 'v2' END AS version FROM events),
h AS (SELECT event_id, CASE WHEN version = 'n/a' THEN 'v1' ELSE version END AS version, CASE WHEN version = 'v4' THEN CASE label{late} END ELSE CASE label{early} END END AS h FROM l WHERE version <> 'v3')
SELECT event_id, version, h.g AS settling, CASE WHEN version = 'v4' THEN h.g END AS settling_v4, h.b AS tired_vs_alert, CASE WHEN h.e THEN h.b END AS tired_vs_alert_extremes FROM h"""


LABELS, LABEL_SQL = _label_sql()


@query("settling_scores", "H23", LABEL_SQL, nullable="settling settling_v4 tired_vs_alert tired_vs_alert_extremes")
def _(t):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("event_id") % len(LABELS) + 1).cast("int"))
    version = F.when(F.col("event_type") == "view", "v4").when(F.col("event_type") == "click", "n/a").when(F.col("event_type") == "error", "v3").otherwise("v2")
    return qu.map_settling(t.events.select("event_id", label.alias("label"), version.alias("version")), "label", "version").drop("label")


ENERGY = list(qu.DAY_ENERGY)


@query("energy_scores", "H24", "SELECT event_id, CASE event_id % 9" + "".join(f" WHEN {i} THEN {v}::DOUBLE" for i, v in enumerate(qu.DAY_ENERGY.values())) + " END AS energy FROM events")
def _(t):
    label = F.element_at(F.array(*map(F.lit, [*ENERGY, "none of these"])), (F.col("event_id") % 9 + 1).cast("int"))
    return t.events.select("event_id", qu.map_ordinal(label, qu.DAY_ENERGY).alias("energy"))


# ---- event log: odd event numbers are long presses of the same button

LOG = """
lg AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type AS base, event_type || CASE WHEN event_id % 2 = 1 THEN '_long' ELSE '' END AS event FROM events)
"""


def log(t):
    return t.timed.select("event_id", "user_id", "us", F.concat("event_type", F.when(F.col("event_id") % 2 == 1, "_long").otherwise("")).alias("event"))


@query("debounced_events", "I01 I03", f"WITH {LOG}" + f"""
SELECT event_id, user_id, event FROM lg WHERE NOT (event NOT LIKE '%\\_long' ESCAPE '\\' AND EXISTS (SELECT 1 FROM lg n WHERE n.user_id = lg.user_id AND n.base = lg.base AND n.event LIKE '%\\_long' ESCAPE '\\'
  AND n.us > lg.us AND n.us <= lg.us + {48 * HOUR_US}))
""")
def _(t):
    return el.debounce(log(t), ["user_id"], "us", "event", "event_id", within=48 * HOUR_US, chunk=7 * DAY_US).select("event_id", "user_id", "event")


@query("long_press_durations", "I02", f"WITH {LOG}" + f"""
SELECT event_id, user_id, CASE WHEN event_id % 2 = 1 THEN greatest(coalesce(lag(us) OVER w, us - {6 * HOUR_US}), us - {6 * HOUR_US}) END AS since,
  CASE WHEN event_id % 2 = 1 THEN us - greatest(coalesce(lag(us) OVER w, us - {6 * HOUR_US}), us - {6 * HOUR_US}) END AS duration FROM lg WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)
""", nullable="since duration")
def _(t):
    return el.long_press_durations(log(t), event_line(), "event", reach=6 * HOUR_US).select("event_id", "user_id", "since", "duration")


@query("base_event_counts", "I03", "SELECT event_type AS base, count_if(event_id % 2 = 1) AS long_presses, count(*) AS presses FROM events GROUP BY event_type")
def _(t):
    names = el.with_long_variants(["view", "click", "error", "purchase", "signup"])
    return log(t).filter(F.col("event").isin(names)).groupBy(el.base_event(F.col("event")).alias("base")).agg(
        F.count_if(F.col("event").endswith("_long")).alias("long_presses"), F.count(F.lit(1)).alias("presses"))


@query("latest_start_midpoint", "I04", """
WITH m AS (SELECT user_id, max(epoch_us(ts)) FILTER (event_type = 'view') AS before, max(epoch_us(ts)) FILTER (event_type = 'click') AS after FROM events GROUP BY user_id)
SELECT user_id, before, after, CAST(trunc((before + after) / 2) AS BIGINT) AS midpoint FROM m
""", nullable="before after midpoint")
def _(t):
    return el.latest_midpoint(t.timed, ["user_id"], "event_type", "us", "view", "click")


@query("close_event_pairs", "I05", f"""
SELECT event_id, user_id, us - p AS apart FROM (SELECT event_id, user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE us - p < {HOUR_US}
""")
def _(t):
    out = el.close_pairs(t.timed.select("event_id", "user_id", "us"), event_line(), HOUR_US)
    return out.select("event_id", "user_id", (F.col("us") - F.col("prev_at")).alias("apart"))


@query("day_columns_to_events", "I06", f"WITH {DAILY}" + """,
h AS (SELECT user_id, day, floor(first_us % 86400000000 / 3600000000) AS wake, floor(last_us % 86400000000 / 3600000000) * 2 AS lep FROM dy),
l AS (SELECT user_id, day, 'wake' AS event, wake AS hours FROM h UNION ALL SELECT user_id, day, 'lep', lep FROM h)
SELECT user_id, day, event, CAST(day AS TIMESTAMP) + to_seconds(hours * 3600) AS "at" FROM l WHERE hours <> 0
""")
def _(t):
    h = daily(t).select("user_id", "day", F.floor(F.col("first_us") % DAY_US / HOUR_US).alias("wake:first"), (F.floor(F.col("last_us") % DAY_US / HOUR_US) * 2).alias("lep:last"))
    return el.day_columns_to_events(h, "day", ["wake:first", "lep:last"])


@query("cohort_filter", "I07", f"WITH {DAILY}," + """
s AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'purchase' AND hour(ts) >= 18) AS shower, bool_or(event_type = 'signup') AS lamp, sum(value) AS light, bool_or(event_type = 'view') AS has_lep FROM events GROUP BY ALL)
SELECT user_id, day, round(light, 6) AS light FROM s WHERE NOT shower AND NOT lamp AND light < 30 AND has_lep
""")
def _(t):
    e = F.col("event_type")
    s = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.bool_or((e == "purchase") & (F.hour("ts") >= 18)).alias("shower"), F.bool_or(e == "signup").alias("lamp"), F.sum("value").alias("light"), F.bool_or(e == "view").alias("has_lep"))
    return s.filter("NOT shower AND NOT lamp AND light < 30 AND has_lep").select("user_id", "day", F.round("light", 6).alias("light"))


# names of every kind that the rules tell apart
SOURCE_KEYS = ["sunrise:mins", "date:month", "weather:pressureAfternoon", "weather:pressureMorning", "hr:AsleepToAwake:mean", "hrv:mean", "o2:mean", "movement:mean", "glucose:mean", "circadian:combined:low",
               "circadian:other", "coreBodyTemp:mean", "night:yasa:adjusted:wakeTimeSSM", "night:yasa:finalWakeModel:x", "night:yasaExtended:C3-M1:iqr", "night:yasaExtended:Stability:Aggregated:De ep",
               "night:yasaExtended:N3:iqr_s", "hr:iqr_s:mean", "date:sleepPredictionError", "night:yasaExtended:Statistics:SE", "night:yasaExtended:Statistics:Lat_N1", "night:yasa:discardedMicrowakingsCount",
               "food:sugar", "foodless"]
SOURCES = ["days", "physical", "yasa", "food:", "literally_all", "unknown"]
_KEYED = "k AS (SELECT event_id, [" + ", ".join(f"'{k}'" for k in SOURCE_KEYS) + f"][event_id % {len(SOURCE_KEYS)} + 1] AS key FROM events)"
_DENIED = """(key = 'night:yasaExtended:Stability:Aggregated:De ep' OR suffix(key, '_s') OR contains(key, '_s:') OR contains(key, 'Prediction') AND contains(key, 'Error')
  OR key = 'night:yasaExtended:Statistics:SE' OR key = 'night:yasaExtended:Statistics:TIB' OR starts_with(key, 'night:yasaExtended:Statistics:Lat_') OR contains(key, 'discardedMicrowakingsCount'))"""
_DAYS = "(starts_with(key, 'sunrise:') OR starts_with(key, 'date:') OR key = 'weather:pressureAfternoon')"
_PHYSICAL = "regexp_matches(key, '^(hr|hrv|o2|movement|diastolic|systolic|glucose|circadian:combined|coreBodyTemp):')"
_YASA = "(starts_with(key, 'night:') AND contains(key, 'yasa') AND NOT contains(key, 'finalWakeModel') AND NOT contains(key, '-M1:'))"


def _source_keys(t):
    return t.events.select("event_id", F.element_at(F.array(*map(F.lit, SOURCE_KEYS)), (F.col("event_id") % len(SOURCE_KEYS) + 1).cast("int")).alias("key"))


@query("day_keys_by_source", "H07", f"""WITH {_KEYED}
SELECT event_id, key, source FROM k, (VALUES ('days'), ('physical'), ('yasa'), ('food:'), ('literally_all')) s(source)
WHERE NOT {_DENIED} AND CASE source WHEN 'days' THEN {_DAYS} WHEN 'physical' THEN {_PHYSICAL} WHEN 'yasa' THEN {_YASA} WHEN 'food:' THEN starts_with(key, 'food:') ELSE true END
""")
def _(t):
    keys = _source_keys(t)
    named = F.array_compact(F.array(*[F.when(qu.admitted_day_key(F.col("key"), [s]), F.lit(s)) for s in SOURCES]))
    return keys.select("event_id", "key", F.explode(named).alias("source"))


@query("day_keys_without_unwanted", "H07", f"WITH {_KEYED} SELECT event_id, key FROM k WHERE NOT {_DENIED} AND ({_DAYS} OR {_YASA} OR {_PHYSICAL}) AND NOT ({_DAYS} OR starts_with(key, 'circadian:'))")
def _(t):
    return _source_keys(t).filter(qu.admitted_day_key(F.col("key"), ["days", "yasa", "physical"], ["days", "circadian:"]))


@query("day_feature_columns", "H07 H09", """SELECT CAST(event_id AS BIGINT) AS "hr:mean", value AS "night:yasa:amount", value AS "zz:target" FROM events""")
def _(t):
    wide = t.events.select(F.col("value").alias("zz:target"), F.col("event_type").alias("hr:text"), F.col("value").alias("night:yasa:amount"), F.col("value").alias("night:yasa:iqr_s"),
                           F.col("event_id").alias("hr:mean"), F.col("event_id").alias("date:day"), F.col("event_id").alias("other"))
    return qu.day_feature_columns(wide, "zz:target", ["physical", "yasa", "date:"], ["days"])
