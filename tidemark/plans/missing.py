"""Queries over values of which some are NaN: everywhere NaN counts as missing."""

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import quality as qu
from ..operators import stats as st
from .common import HOURS6
from .registry import query

NAN = "nv AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS x, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS DOUBLE) END AS y FROM events)"


def _nan(t):
    hole = lambda n, c: F.when(F.col("event_id") % n != 0, c).otherwise(F.lit(float("nan")))
    return t.timed.select("event_id", "event_type", "us", hole(7, F.col("value")).alias("x"), hole(5, F.col("user_id").cast("double")).alias("y"))


@query("missing_profile_nan", "H01", f"WITH {NAN} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 'double' AS type, count({c}) AS present, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 1) AS missing_pct FROM nv" for c in "xy"))
def _(t):
    return qu.missing_profile(_nan(t), ["x", "y"])


@query("complete_rows_nan", "H02", f"WITH {NAN} SELECT event_id, x FROM nv WHERE x IS NOT NULL")
def _(t):
    rows = _nan(t).filter(~F.isnan("x"))
    return qu.require_complete(rows, ["x"]).select("event_id", "x")


@query("quantile_clip_nan", "H13", f"WITH {NAN}, q AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM nv) SELECT event_id, round(CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END, 6) AS x FROM nv, q")
def _(t):
    return qu.clip_to_quantiles(_nan(t), ["x"]).select("event_id", F.round("x", 6).alias("x"))


@query("min_max_scale_nan", "H15", f"WITH {NAN}, m AS (SELECT min(x) AS lo, max(x) AS hi FROM nv) SELECT event_id, round((x - lo) / (hi - lo), 6) AS x FROM nv, m")
def _(t):
    return qu.min_max_scale(_nan(t), ["x"]).select("event_id", F.round("x", 6).alias("x"))


@query("bucket_medians_nan", "G01", f"WITH {NAN} SELECT event_type, epoch_us(ts) // {HOURS6} * {HOURS6} AS bucket, round(median(x), 6) AS median FROM nv WHERE x IS NOT NULL GROUP BY ALL")
def _(t):
    return ag.bucket_medians(_nan(t), ["event_type"], "us", "x", HOURS6, keep_empty=False).withColumn("median", F.round("median", 6))


@query("describe_columns_nan", "G21", f"WITH {NAN} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, "
    f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM nv" for c in "xy"))
def _(t):
    return ag.describe(_nan(t), ["x", "y"]).select("column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", "max", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


@query("rank_correlations_nan", "L12", f"WITH {NAN}, b AS (SELECT * FROM nv WHERE x IS NOT NULL AND y IS NOT NULL)," + """
r AS (SELECT event_type, x, y, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2 AS ry FROM b)
SELECT event_type, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY event_type
""")
def _(t):
    return st.spearman(_nan(t), ["event_type"], "x", "y").select("event_type", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("target_against_all_nan", "L39", f"WITH {NAN} SELECT 'x' AS \"column\", count(*) AS n, round(corr(x, y), 6) AS r FROM nv WHERE x IS NOT NULL AND y IS NOT NULL")
def _(t):
    return st.target_against_all(_nan(t), "y", ["x"]).withColumn("r", F.round("r", 6))
