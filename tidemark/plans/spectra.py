"""Epoch feature queries on the embedding signals: 64 samples per epoch."""

from pyspark.sql import functions as F

from ..operators import features as fe
from .common import EPOCHS, HOURS6, epochs
from .detection import RUNS, _sections
from .registry import query
from .resampling import SIGNAL, signal

RATE = 64.0


def _epoch_signal(t):
    return signal(t).withColumn("epoch", F.floor(F.col("sample_no") / 64))


@query("artifact_share", "D01", f"WITH {RUNS}," + """
ep AS (SELECT DISTINCT rec, sample_no // 64 * 64 AS f FROM sg),
ov AS (SELECT ep.rec, ep.f, sum(least(ep.f + 64, sx.e) - greatest(ep.f, sx.s)) AS lost FROM ep JOIN sx ON sx.rec = ep.rec AND sx.s < ep.f + 64 AND sx.e > ep.f GROUP BY ALL)
SELECT ep.rec, ep.f AS "first", round(coalesce(lost, 0) * 100 / 64, 6) AS removed_pct FROM ep LEFT JOIN ov ON ov.rec = ep.rec AND ov.f = ep.f
""")
def _(t):
    ep = signal(t).select("rec", (F.floor(F.col("sample_no") / 64) * 64).alias("first")).distinct()
    return fe.removed_share(ep, _sections(t), ["rec"], first="first", length=64, start="start", end="end").withColumn("removed_pct", F.round("removed_pct", 6))


SHAPE = SIGNAL + """,
b AS (SELECT rec, sample_no // 64 AS epoch, value AS x, lag(value) OVER w AS p, lag(value, 2) OVER w AS q FROM sg WINDOW w AS (PARTITION BY rec, sample_no // 64 ORDER BY sample_no)),
b2 AS (SELECT *, x - p AS d, (x - p) - (p - q) AS dd, CAST(((x - p) < 0) <> ((p - q) < 0) AS INT) AS turn, CAST((x < 0) <> (p < 0) AS INT) AS crs,
  CASE WHEN q IS NOT NULL THEN (CAST(p < q AS INT) + CAST(x < q AS INT)) * 3 + CAST(q <= p AS INT) + CAST(x < p AS INT) END AS pat FROM b),
pe AS (SELECT rec, epoch, -sum(k / tot * log2(k / tot)) / log2(6) AS perm FROM (SELECT rec, epoch, pat, count(*) AS k, sum(count(*)) OVER (PARTITION BY rec, epoch) AS tot FROM b2 WHERE pat IS NOT NULL GROUP BY rec, epoch, pat) GROUP BY ALL),
mm AS (SELECT rec, epoch, avg(x) AS m FROM b2 GROUP BY ALL),
f AS (SELECT rec, epoch, stddev_samp(x) AS std, avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 AS skew, kurtosis_pop(x) AS kurt, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, CAST(sum(crs) AS BIGINT) AS zero_crossings,
  sqrt(var_pop(d) / var_pop(x)) AS mob, sqrt(var_pop(dd) / var_pop(d)) AS mob1, sum((abs(x) + abs(p)) / 2) AS auc, log10(count(*)) / (log10(count(*)) + log10(count(*) / (count(*) + 0.4::DOUBLE * sum(turn)))) AS petrosian
  FROM b2 JOIN mm USING (rec, epoch) GROUP BY ALL)
"""


@query("shape_features", "D02 D03 D04 D05 D06 D07 D08 D09", f"WITH {SHAPE}" + """
SELECT rec, epoch, round(std, 6) AS std, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(iqr, 6) AS iqr, zero_crossings, round(mob, 6) AS hjorth_mobility, round(mob1 / mob, 6) AS hjorth_complexity,
  round(auc, 6) AS auc, round(perm, 6) AS perm_entropy, round(petrosian, 6) AS petrosian FROM f JOIN pe USING (rec, epoch)
""")
def _(t):
    out = fe.shape_features(_epoch_signal(t), ["rec", "epoch"], "sample_no", "value")
    return out.select("rec", "epoch", "zero_crossings", *[F.round(c, 6).alias(c) for c in ("std", "skew", "kurt", "iqr", "hjorth_mobility", "hjorth_complexity", "auc", "perm_entropy", "petrosian")])


def _psd(t):
    return fe.epoch_arrays(_epoch_signal(t), ["rec", "epoch"], "sample_no", "value").withColumn("psd", fe.periodogram("samples"))


PSD = SIGNAL + """,
c AS (SELECT rec, sample_no // 64 AS epoch, sample_no % 64 AS i, (value - avg(value) OVER (PARTITION BY rec, sample_no // 64)) * (0.5 - 0.5 * cos(2 * pi() * (sample_no % 64) / 64)) AS x FROM sg),
p0 AS (SELECT rec, epoch, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, sum(x * sin(2 * pi() * k * i / 64)) AS im FROM c, range(0, 33) r(k) GROUP BY ALL),
ps AS (SELECT rec, epoch, k, (re * re + im * im) / 24 * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS p FROM p0)
"""


@query("power_spectrum", "D12", f"WITH {PSD} SELECT rec, epoch, CAST(k AS INTEGER) AS k, round(p, 3) AS p FROM ps")
def _(t):
    return _psd(t).select("rec", "epoch", F.posexplode("psd").alias("k", "p")).withColumn("p", F.round("p", 3))


@query("spectral_entropy", "D11", f"WITH {PSD}, tt AS (SELECT rec, epoch, sum(p) AS s FROM ps GROUP BY ALL) SELECT rec, epoch, round(-sum(CASE WHEN p > 0 THEN p / s * log2(p / s) ELSE 0 END) / log2(33), 6) AS entropy FROM ps JOIN tt USING (rec, epoch) GROUP BY ALL")
def _(t):
    return _psd(t).select("rec", "epoch", F.round(fe.spectral_entropy(F.col("psd")), 6).alias("entropy"))


def _band_sql():
    names = [b[0] for b in fe.BANDS]
    absolute = ", ".join(f"coalesce(sum(p) FILTER (k >= ceil({lo}) AND k < ceil({hi})), 0) AS abs_{n}" for n, lo, hi in fe.BANDS)
    total = " + ".join(f"abs_{n}" for n in names)
    rel = ", ".join(f"abs_{n} / nullif({total}, 0) AS rel_{n}" for n in names)
    cum = []
    for i in range(1, 5):
        for kind, suffix in (("rel", ""), ("abs", "abs")):
            cum += [f"round({' + '.join(f'{kind}_{b}' for b in names[i:])}, 3) AS {names[i]}_{suffix}aa", f"round({' + '.join(f'{kind}_{b}' for b in names[:i + 1])}, 3) AS {names[i]}_{suffix}ab"]
    plain = ", ".join([f"round(abs_{n}, 3) AS abs_{n}, round(rel_{n}, 6) AS rel_{n}" for n in names] + cum)
    return f"""WITH {PSD}, a AS (SELECT rec, epoch, {absolute}, sum(p) FILTER (k >= 1 AND k < 35) AS abspow, sum(p * k) / sum(p) AS centroid FROM ps GROUP BY ALL), r AS (SELECT *, {rel} FROM a)
SELECT rec, epoch, {plain}, round(abspow, 3) AS abspow, round(centroid, 6) AS centroid, round((rel_sdelta + rel_fdelta) / nullif(rel_theta, 0), 6) AS dt, round((rel_sdelta + rel_fdelta) / nullif(rel_sigma, 0), 6) AS ds,
  round((rel_sdelta + rel_fdelta) / nullif(rel_beta, 0), 6) AS db, round(rel_alpha / nullif(rel_theta, 0), 6) AS "at" FROM r"""


@query("band_features", "D13 D14 D15 D16 D17", _band_sql())
def _(t):
    out = fe.band_features(_psd(t), "psd", "samples", RATE).drop("psd", "samples")
    coarse = lambda c: 3 if c.startswith("abs") or c.endswith(("aa", "ab")) else 6
    return out.select("rec", "epoch", *[F.round(c, coarse(c)).alias(c) for c in out.columns if c not in ("rec", "epoch")])


@query("higuchi_dimension", "D10")
def _(t):
    return fe.epoch_arrays(_epoch_signal(t), ["rec", "epoch"], "sample_no", "value").select("rec", "epoch", F.round(fe.higuchi("samples"), 6).alias("higuchi"))


def _tri_sql():
    top = " + ".join(f"coalesce(lead(mean_value, {k}) OVER o * {1 - abs(k) / 8!r}, 0)" for k in range(-7, 8))
    bottom = " + ".join(f"CASE WHEN lead(mean_value, {k}) OVER o IS NOT NULL THEN {1 - abs(k) / 8!r} ELSE 0 END" for k in range(-7, 8))
    return f"""WITH {EPOCHS}, s AS (SELECT user_id, epoch, mean_value, ({top}) / ({bottom}) AS c7, avg(mean_value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS p2
  FROM ep WINDOW o AS (PARTITION BY user_id ORDER BY epoch)),
q AS (SELECT user_id, quantile_cont(c7, 0.05) AS lo, median(c7) AS mid, quantile_cont(c7, 0.95) AS hi FROM s GROUP BY user_id)
SELECT user_id, epoch, round(c7 + 1e-9, 6) AS c7, round(p2 + 1e-9, 6) AS p2, round((c7 - mid) / nullif(hi - lo, 0), 5) AS c7_norm FROM s JOIN q USING (user_id)"""


@query("smoothed_and_scaled", "D18 D19 D20", _tri_sql())
def _(t):
    ep = epochs(t).select("user_id", "epoch", "mean_value")
    out = fe.trailing_mean(fe.triangular_mean(ep, ["user_id"], "epoch", "mean_value", "c7"), ["user_id"], "epoch", "mean_value", "p2")
    out = fe.robust_scale(out, ["user_id"], ["c7"])
    return out.select("user_id", "epoch", F.round(F.col("c7") + 1e-9, 6).alias("c7"), F.round(F.col("p2") + 1e-9, 6).alias("p2"), F.round("c7_norm", 5).alias("c7_norm"))


@query("unreliable_nulled", "D21 D22", f"WITH {EPOCHS} SELECT user_id, epoch, CASE WHEN n * 30 <= 50 THEN round(confidence, 6) END AS confidence, round(mean_value, 6) AS mean_norm, round(confidence, 6) AS \"Raw_confidence\" FROM ep")
def _(t):
    ep = epochs(t).select("user_id", "epoch", (F.col("n") * 30).alias("removed"), F.round("confidence", 6).alias("confidence"), F.round("mean_value", 6).alias("mean_norm"))
    cleaned = fe.null_out_unreliable(ep, "removed", ["confidence", "mean_norm"]).drop("removed")
    return fe.raw_beside_cleaned(ep, cleaned, ["user_id", "epoch"], ["confidence"])


@query("area_over_time", "D23", f"WITH {EPOCHS}, s AS (SELECT user_id, (at_us - lag(at_us) OVER w) / 3600000000 * (mean_value + lag(mean_value) OVER w) / 2 AS a FROM ep WINDOW w AS (PARTITION BY user_id ORDER BY at_us)) SELECT user_id, round(coalesce(sum(a), 0), 5) AS area FROM s GROUP BY user_id")
def _(t):
    ep = epochs(t).select("user_id", (F.col("at") / 3_600_000_000).alias("hours"), "mean_value")
    return fe.area_over_time(ep, ["user_id"], "hours", "mean_value").withColumn("area", F.round("area", 5))


@query("waveform_summaries", "D24", """
WITH c AS (SELECT user_id, event_type AS channel, avg(value) AS amplitude, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS duration FROM events GROUP BY ALL)
SELECT user_id, channel, round(amplitude, 6) AS amplitude, round(duration, 6) AS duration FROM c UNION ALL SELECT user_id, 'Aggregated', round(avg(amplitude), 6), round(avg(duration), 6) FROM c GROUP BY user_id
""")
def _(t):
    rows = t.events.select("user_id", F.col("event_type").alias("channel"), F.col("value").alias("amplitude"), F.get_json_object("props", "$.k").cast("double").alias("duration"))
    out = fe.waveform_summaries(rows, ["user_id"], "channel", ["amplitude", "duration"])
    return out.select("user_id", "channel", F.round("amplitude", 6).alias("amplitude"), F.round("duration", 6).alias("duration"))


@query("multitaper_bands", "D12 D13")
def _(t):
    from ..operators.tapers import multitaper

    epochs_ = fe.epoch_arrays(_epoch_signal(t), ["rec", "epoch"], "sample_no", "value").withColumn("psd", multitaper(RATE)("samples"))
    return fe.band_features(epochs_, "psd", "samples", RATE).drop("psd", "samples")


WELCH = f"""{SIGNAL},
s0 AS (SELECT rec, sample_no // 64 AS epoch, sample_no % 64 AS i, value FROM sg), g AS (SELECT rec, epoch, part, i - part * 16 AS j, value FROM s0, range(0, 3) p(part) WHERE i >= part * 16 AND i < part * 16 + 32),
h AS (SELECT rec, epoch, part, j, (value - avg(value) OVER (PARTITION BY rec, epoch, part)) * (0.54 - 0.46 * cos(2 * pi() * j / 32)) AS x FROM g),
f AS (SELECT rec, epoch, part, k, sum(x * cos(2 * pi() * k * j / 32)) AS re, sum(x * sin(2 * pi() * k * j / 32)) AS im FROM h, range(0, 17) r(k) GROUP BY ALL),
u AS (SELECT sum((0.54 - 0.46 * cos(2 * pi() * j / 32)) ** 2) AS energy FROM range(0, 32) r(j))
"""


@query("median_spectrum", "D12", f"WITH {WELCH} SELECT rec, epoch, CAST(k AS INTEGER) AS k, round(median((re * re + im * im) * CASE WHEN k BETWEEN 1 AND 15 THEN 2 ELSE 1 END) / (64 * any_value(energy)) / (1 + 1 / 3 - 1 / 2), 3) AS p FROM f, u GROUP BY rec, epoch, k")
def _(t):
    from ..operators.tapers import welch_median

    spectra = fe.epoch_arrays(_epoch_signal(t), ["rec", "epoch"], "sample_no", "value").withColumn("psd", welch_median(RATE, 0.5)("samples"))
    return spectra.select("rec", "epoch", F.posexplode("psd").alias("k", "p")).withColumn("p", F.round("p", 3))
