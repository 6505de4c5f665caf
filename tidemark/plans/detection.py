"""Run, section, dip and peak queries."""

from pyspark.sql import functions as F

from ..functions import timeutil as tu
from ..operators import detect as de
from ..operators import resample as rs
from ..operators.timeline import Timeline
from .common import HOURS6, epochs, EPOCHS
from .joining import DAILY, daily
from .registry import query
from .resampling import DAY_US, SIGNAL, signal, signal_line

RUNS = SIGNAL + """,
h AS (SELECT rec, sample_no, value, sample_no - row_number() OVER (PARTITION BY rec ORDER BY sample_no) AS grp FROM sg WHERE abs(value) > 100),
rn AS (SELECT rec, min(sample_no) AS s, max(sample_no) + 1 AS e, max(abs(value)) AS peak FROM h GROUP BY rec, grp),
k AS (SELECT *, lag(e) OVER (PARTITION BY rec ORDER BY s) AS pe FROM rn WHERE e - s >= 2),
k2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s) AS sec FROM k),
mg AS (SELECT rec, min(s) AS s, max(e) AS e FROM k2 GROUP BY rec, sec),
sx AS (SELECT mg.rec, mg.s, mg.e, max(rn.peak) AS peak FROM mg JOIN rn ON rn.rec = mg.rec AND rn.s >= mg.s AND rn.s < mg.e GROUP BY ALL HAVING mg.e - mg.s >= 12 OR max(rn.peak) > 400)
"""


def _sections(t):
    return de.artifact_sections(signal(t), signal_line(), "value", above=100, min_run=2, merge_gap=6, min_length=12, keep_above=400, chunk=160)


@query("artifact_sections", "J01", f'WITH {RUNS} SELECT rec, s AS "start", e AS "end", round(peak, 6) AS peak FROM sx')
def _(t):
    return _sections(t).select("rec", "start", "end", F.round("peak", 6).alias("peak"))


@query("epochs_with_artifacts", "J02", f"WITH {RUNS} SELECT DISTINCT rec, unnest(range(s // 50, e // 50 + 1)) AS epoch FROM sx")
def _(t):
    return de.epochs_touched(_sections(t), ["rec"], "start", "end", 50)


@query("samples_outside_artifacts", "J03", f"WITH {RUNS} SELECT rec, sample_no, value FROM sg WHERE NOT EXISTS (SELECT 1 FROM sx WHERE sx.rec = sg.rec AND sample_no >= s AND sample_no < e)")
def _(t):
    return de.samples_outside(signal(t), _sections(t), ["rec"], "sample_no", "start", "end", width=50)


SETTLED = SIGNAL + """,
sp AS (SELECT rec, min(sample_no) AS lo, max(sample_no) AS hi FROM sg GROUP BY rec),
h AS (SELECT rec, sample_no, sample_no - row_number() OVER (PARTITION BY rec ORDER BY sample_no) AS grp FROM sg WHERE value > 30),
rn AS (SELECT rec, min(sample_no) AS s, max(sample_no) AS e FROM h GROUP BY rec, grp HAVING count(*) >= 2),
k AS (SELECT *, lag(e) OVER (PARTITION BY rec ORDER BY s) AS pe FROM rn),
k2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s) AS sec FROM k),
mg AS (SELECT rec, min(s) AS s, max(e) AS e FROM k2 GROUP BY rec, sec),
sx AS (SELECT rec, CASE WHEN s - lo <= 3 THEN lo ELSE s END AS s, CASE WHEN hi - e <= 3 THEN hi ELSE e END AS e FROM mg JOIN sp USING (rec)),
fin AS (SELECT rec, s AS "start", e AS "end" FROM sx WHERE e - s + 1 >= 6)
"""


def _settled(t):
    return de.settled_predictions(signal(t), signal_line(), "value", threshold=30, min_first=2, fill=3, min_last=6, chunk=160)


@query("settled_predictions", "J04", f"WITH {SETTLED} SELECT * FROM fin")
def _(t):
    return _settled(t)


@query("blocks_of_ones", "J05", f"""WITH {SIGNAL},
h AS (SELECT rec, sample_no, sample_no - row_number() OVER (PARTITION BY rec ORDER BY sample_no) AS grp FROM sg WHERE value > 0)
SELECT rec, min(sample_no) AS "start", max(sample_no) AS "end", count(*) AS n FROM h GROUP BY rec, grp""")
def _(t):
    return de.runs_where(signal(t), signal_line(), F.col("value") > 0)


def _loud_sql(level, limit):
    return SIGNAL + f""",
lv AS (SELECT rec, sample_no // 8 AS b, {level} AS level FROM sg GROUP BY ALL HAVING count(*) = 8),
h AS (SELECT rec, b, b - row_number() OVER (PARTITION BY rec ORDER BY b) AS grp FROM (SELECT *, {limit} AS lim FROM lv) WHERE level > lim),
r0 AS (SELECT rec, min(b) AS s, max(b) AS e FROM h GROUP BY rec, grp),
rn AS (SELECT rec, greatest(s - 1, 0) * 8 AS s, e * 8 AS e FROM r0 WHERE rec IN (SELECT rec FROM r0 WHERE s > 0)),
k AS (SELECT *, lag(e) OVER (PARTITION BY rec ORDER BY s) AS pe FROM rn),
k2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe >= 24 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s) AS sec FROM k),
mg AS (SELECT rec, min(s) AS s, max(e) AS e FROM k2 GROUP BY rec, sec HAVING max(e) - min(s) >= 16)
"""


@query("sound_events_by_energy", "J06", f"WITH {_loud_sql('sqrt(avg(value * value))', '1.2 * avg(level) OVER (PARTITION BY rec)')}" + """
SELECT rec, s AS "start", e AS "end", TIMESTAMP '2024-01-31 23:59:00' + to_microseconds(s * 10000) AS started FROM mg""")
def _(t):
    levels = de.above_mean(de.bucket_levels(signal(t), ["rec"], "sample_no", "value", 8), ["rec"], 1.2)
    events = de.loud_sections(levels, ["rec"], 8, F.col("level") > F.col("limit"), merge=24, shortest=16, chunk=20)
    file_start = tu.file_stamp(F.lit("recording_20240131_235900.opus"))
    return events.withColumn("started", tu.nth_period(file_start, F.col("start"), 0.01))


@query("sound_events_by_amplitude", "J07", f"WITH {_loud_sql('max(abs(value))', '260')} SELECT rec, s AS \"start\", e AS \"end\" FROM mg")
def _(t):
    levels = de.bucket_levels(signal(t), ["rec"], "sample_no", "value", 8, "peak")
    return de.loud_sections(levels, ["rec"], 8, F.col("level") > 260, merge=24, shortest=16, chunk=20)


@query("silences", "J08", f"""WITH {SIGNAL},
d AS (SELECT rec, sample_no, 20 * log10(greatest(abs(value), 1e-5) / greatest(max(abs(value)) OVER (PARTITION BY rec), 1e-5)) AS db FROM sg),
h AS (SELECT rec, sample_no, sample_no - row_number() OVER (PARTITION BY rec ORDER BY sample_no) AS grp FROM d WHERE db < -15)
SELECT rec, min(sample_no) AS "start", max(sample_no) + 1 AS "end", count(*) AS n FROM h GROUP BY rec, grp HAVING count(*) >= 2""")
def _(t):
    return de.silences(signal(t), signal_line(), "value", below_db=-15, shortest=2)


@query("silent_share", "J08", f"""WITH {SIGNAL},
d AS (SELECT rec, sample_no, 20 * log10(greatest(abs(value), 1e-5) / greatest(max(abs(value)) OVER (PARTITION BY rec), 1e-5)) AS db FROM sg),
h AS (SELECT rec, sample_no, sample_no - row_number() OVER (PARTITION BY rec ORDER BY sample_no) AS grp FROM d WHERE db < -15),
r AS (SELECT rec, count(*) AS n FROM h GROUP BY rec, grp HAVING count(*) >= 2), q AS (SELECT rec, sum(n) AS quiet FROM r GROUP BY rec), tt AS (SELECT rec, count(*) AS n FROM sg GROUP BY rec)
SELECT rec, round(coalesce(quiet, 0) / n * 100, 6) AS silent_pct FROM tt LEFT JOIN q USING (rec)""")
def _(t):
    quiet = de.silences(signal(t), signal_line(), "value", below_db=-15, shortest=2).groupBy("rec").agg(F.sum(F.col("end") - F.col("start")).alias("quiet"))
    total = signal(t).groupBy("rec").agg(F.count(F.lit(1)).alias("total"))
    return total.join(quiet, "rec", "left").select("rec", F.round(F.coalesce("quiet", F.lit(0)) / F.col("total") * 100, 6).alias("silent_pct"))


@query("dips", "J09", f"""WITH {SIGNAL},
h AS (SELECT rec, sample_no, value, CASE WHEN sample_no - lag(sample_no) OVER (PARTITION BY rec ORDER BY sample_no) <= 3 THEN 0 ELSE 1 END AS st FROM sg WHERE value < -75),
g AS (SELECT *, sum(st) OVER (PARTITION BY rec ORDER BY sample_no) AS grp FROM h)
SELECT rec, min(sample_no) AS "start", max(sample_no) AS "end", count(*) AS n, arg_min(sample_no, (value, sample_no)) AS peak_at, round(min(value), 6) AS peak_value, max(sample_no) - min(sample_no) + 1 AS length FROM g GROUP BY rec, grp""")
def _(t):
    return de.dips(signal(t), signal_line(), "value", below=-75, reach=3).withColumn("peak_value", F.round("peak_value", 6))


@query("naive_maxima", "J10", f"""WITH {SIGNAL}, w AS (SELECT *, lag(value) OVER o AS p, lead(value, 2) OVER o AS n FROM sg WINDOW o AS (PARTITION BY rec ORDER BY sample_no))
SELECT rec, sample_no, value FROM w WHERE p < value AND value >= n""")
def _(t):
    return de.naive_maxima(signal(t), signal_line(), "value")


@query("peaks_and_valleys", "J11 C14")
def _(t):
    smooth = rs.convolve(signal(t), signal_line(), "value", rs.savgol_weights(21, 2), "smooth")
    night = smooth.withColumn("night", F.floor(F.col("sample_no") / 640))
    return de.peaks_and_valleys(night, ["rec", "night"], "sample_no", "smooth", "value", peak=(30, 5.0), valley=(10, 1.0))


ASLEEP = "CASE WHEN user_id % 5 <> 0 THEN {} + (user_id % 3) * 0.5 END"


def _night_sql(first: int, last: int, rule: str) -> str:
    """Candidates of user and day at hours [first, last), hours past 24 belonging to the day before."""
    return f"""hs AS (SELECT user_id, event_id, value, CAST(ts AS DATE) - {{late}} AS day, hour(ts) + minute(ts) / 60 + 24 * {{late}} AS hr FROM events),
cd AS (SELECT user_id, day, hr, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM hs WHERE hr >= {first} AND hr < {last} AND {rule} GROUP BY user_id, day, hr)""".replace(
        "{late}", f"CAST(hour(ts) < {max(last - 24, 0)} AS INTEGER)")


def _night(t, first, last, **limits):
    late = (F.hour("ts") < max(last - 24, 0)).cast("int")
    hr = tu.hour_fraction(F.col("ts")) + 24 * late
    rows = t.events.select("user_id", "event_id", "value", F.date_sub(F.to_date("ts"), late).alias("day"), hr.alias("hr"))
    kept = de.in_night_hours(rows, F.col("hr"), first, last, **limits)
    return kept.groupBy("user_id", "day", "hr").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))


def _asleep(hour):
    return F.when(F.col("user_id") % 5 != 0, hour + F.col("user_id") % 3 * 0.5)


@query("evening_peak_choice", "J12", f"WITH RECURSIVE {_night_sql(20, 24, f'coalesce(hr <= {ASLEEP.format(22)}, true)')}," + """
dn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM (SELECT user_id, day, list({'hr': hr, 'id': event_id} ORDER BY hr) AS c FROM cd GROUP BY user_id, day)),
wk AS (SELECT user_id, k, [c[-1].hr] AS recent, c[-1] AS pick, day FROM dn WHERE k = 1
  UNION ALL SELECT n.user_id, n.k, list_append(wk.recent, p.pick.hr)[-3:], p.pick, n.day FROM wk JOIN dn n ON n.user_id = wk.user_id AND n.k = wk.k + 1,
  LATERAL (SELECT CASE WHEN len(wk.recent) >= 3 THEN list_reduce(n.c, lambda a, b: CASE WHEN abs(b.hr - list_sum(wk.recent) / 3) < abs(a.hr - list_sum(wk.recent) / 3) THEN b ELSE a END) ELSE n.c[-1] END AS pick) p)
SELECT user_id, day, pick.hr AS hr, pick.id AS event_id FROM wk
""")
def _(t):
    # not after falling asleep, where that is known
    return de.choose_evening_peaks(_night(t, 20, 24, before=[_asleep(22)]), "user_id", "day", "hr").select("user_id", "day", "hr", "event_id")


@query("first_stable_valley", "J13", f"WITH {_night_sql(23, 27, f'coalesce(hr >= {ASLEEP.format(23.5)}, true)')}," + """
l AS (SELECT user_id, day, list({'hr': hr, 'v': value, 'done': false} ORDER BY hr) AS c FROM cd GROUP BY ALL),
p AS (SELECT user_id, day, list_reduce(c, lambda a, b: CASE WHEN NOT a.done AND b.v < a.v - 0.1 THEN {'hr': b.hr, 'v': b.v, 'done': false} ELSE {'hr': a.hr, 'v': a.v, 'done': true} END) AS q FROM l)
SELECT user_id, day, q.hr AS hr, q.v AS value FROM p
""")
def _(t):
    # from 23 to 3 o'clock, once asleep
    return de.first_stable(_night(t, 23, 27, after=[_asleep(23.5)]), ["user_id", "day"], "hr", "value")


@query("first_stable_peak", "J14", f"WITH {_night_sql(6, 11, 'true')}," + """
l AS (SELECT user_id, day, list({'hr': hr, 'v': value} ORDER BY hr) AS c FROM cd GROUP BY ALL),
p AS (SELECT user_id, day, list_reduce(c, lambda a, b: CASE WHEN b.v > a.v + 0.1 THEN b ELSE a END) AS q FROM l)
SELECT user_id, day, q.hr AS hr, q.v AS value FROM p
""")
def _(t):
    return de.first_stable(_night(t, 6, 11), ["user_id", "day"], "hr", "value", rising=True)


REVIEW = """
de AS (SELECT user_id, CAST(ts AS DATE) AS day, max(epoch_us(ts)) FILTER (event_type <> 'view') AS at_us, count(*) AS n FROM events GROUP BY ALL),
rv AS (SELECT user_id, CAST(ts AS DATE) AS day, max(epoch_us(ts)) AS at_us FROM events WHERE event_type <> 'click' GROUP BY ALL)
"""


def _det_rev(t):
    rows = t.timed.withColumn("day", F.to_date("ts"))
    det = rows.groupBy("user_id", "day").agg(F.max(F.when(F.col("event_type") != "view", F.col("us"))).alias("at"), F.count(F.lit(1)).alias("n"))
    return det, rows.filter("event_type <> 'click'").groupBy("user_id", "day").agg(F.max("us").alias("at"))


@query("detection_mismatches", "J15", f"WITH {REVIEW} SELECT user_id, day, abs(de.at_us - rv.at_us) / 60000000 AS minutes FROM de JOIN rv USING (user_id, day) WHERE abs(de.at_us - rv.at_us) > 300000000")
def _(t):
    det, rev = _det_rev(t)
    out = de.against_review(det.filter("at IS NOT NULL"), rev, ["user_id", "day"], "at")
    return out.filter("difference > 300000000").select("user_id", "day", (F.col("difference") / 60_000_000).alias("minutes")).orderBy(F.desc("minutes"))


@query("detection_status", "J16", f"""WITH {REVIEW}
SELECT user_id, day, CASE WHEN n < 2 THEN 'Error' WHEN at_us IS NOT NULL THEN 'Detected' ELSE 'Not found' END AS status,
  CASE WHEN n < 2 THEN 'No usable input' WHEN at_us IS NULL THEN 'No usable peaks found' END AS reason FROM de""")
def _(t):
    det, _ = _det_rev(t)
    return de.detection_status(det, F.col("n") >= 2, F.col("at").isNotNull()).select("user_id", "day", "status", "reason")


def _grid_sql():
    return SIGNAL + """,
par AS (SELECT w, m, g, s FROM (VALUES (8), (16)) a(w), (VALUES (1.1::DOUBLE), (1.3::DOUBLE)) b(m), (VALUES (16), (40)) c(g), (VALUES (8), (32)) d(s)),
lv AS (SELECT rec, w, sample_no // w AS b, sqrt(avg(value * value)) AS level FROM sg, (VALUES (8), (16)) a(w) GROUP BY ALL HAVING count(*) = w),
l2 AS (SELECT *, avg(level) OVER (PARTITION BY rec, w) AS mean_level FROM lv),
h AS (SELECT rec, w, m, b, b - row_number() OVER (PARTITION BY rec, w, m ORDER BY b) AS grp FROM l2, (VALUES (1.1::DOUBLE), (1.3::DOUBLE)) b(m) WHERE level > mean_level * m),
r0 AS (SELECT rec, w, m, min(b) AS s0, max(b) AS e0 FROM h GROUP BY rec, w, m, grp),
rn AS (SELECT r0.rec, r0.w, r0.m, greatest(s0 - 1, 0) * r0.w AS s0, e0 * r0.w AS e0 FROM r0 SEMI JOIN (SELECT * FROM r0 WHERE s0 > 0) z USING (rec, w, m)),
k AS (SELECT rn.*, par.g, par.s, lag(e0) OVER (PARTITION BY rec, rn.w, rn.m, g, s ORDER BY s0) AS pe FROM rn JOIN par USING (w, m)),
k2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s0 - pe >= g THEN 1 ELSE 0 END) OVER (PARTITION BY rec, w, m, g, s ORDER BY s0) AS sec FROM k),
mg AS (SELECT rec, w, m, g, s, sec FROM k2 GROUP BY ALL HAVING max(e0) - min(s0) >= s),
ct AS (SELECT rec, w, m, g, s, count(*) AS found FROM mg GROUP BY ALL),
ex AS (SELECT DISTINCT rec, CASE WHEN rec % 2 = 0 THEN 5 END AS exact, CASE WHEN rec % 2 = 1 THEN 8 END AS at_least FROM sg)
SELECT par.w AS "window", par.m AS multiplier, par.g AS "merge", par.s AS shortest,
  CAST(sum(coalesce(abs(coalesce(found, 0) - exact), 0) + coalesce(greatest(at_least - coalesce(found, 0), 0), 0)) AS BIGINT) AS total_error
FROM par CROSS JOIN ex LEFT JOIN ct ON ct.rec = ex.rec AND ct.w = par.w AND ct.m = par.m AND ct.g = par.g AND ct.s = par.s GROUP BY ALL
"""


@query("sound_detection_grid", "J17", f"WITH {_grid_sql()}")
def _(t):
    sg = signal(t)
    odd = F.col("rec") % 2
    expected = sg.select("rec").distinct().select("rec", F.when(odd == 0, 5).alias("exact"), F.when(odd == 1, 8).alias("at_least"))
    return de.tune_sound_detection(sg, expected, ["rec"], "sample_no", "value", windows=[8, 16], multipliers=[1.1, 1.3], merges=[16, 40], shortest=[8, 32], chunk=20)


@query("events_without_epoch", "J18 F04", f"WITH {EPOCHS} SELECT event_id, user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM ep WHERE ep.user_id = events.user_id AND ep.epoch = epoch_us(ts) // {HOURS6} AND ep.stage <> 'W')")
def _(t):
    known = epochs(t).filter("stage <> 'W'").select("user_id", "epoch")
    rows = t.timed.select("event_id", "user_id", F.floor(F.col("us") / HOURS6).alias("epoch"))
    return rows.join(known, ["user_id", "epoch"], "left_anti").select("event_id", "user_id")
