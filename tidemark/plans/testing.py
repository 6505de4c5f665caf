"""Bin, test, correlation and threshold queries."""

from pyspark.sql import functions as F

from ..operators import stats as st
from ..operators.joins import column_pairs
from .joining import MEASURES
from .registry import query

XY = "xy AS (SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y, l_discount AS z, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"


def _xy(t):
    return t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"),
                             (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


BINS = XY + """,
eg AS (SELECT flag, list_sort(list_distinct([quantile_cont(y, 0.0), quantile_cont(y, 0.25), quantile_cont(y, 0.5), quantile_cont(y, 0.75), quantile_cont(y, 1.0)])) AS edges FROM xy GROUP BY flag),
bn AS (SELECT xy.*, edges, CAST(greatest(len(list_filter(edges, lambda e: e < y)) - 1, 0) AS INTEGER) AS bin FROM xy JOIN eg USING (flag))
"""


def _binned(t, k=4):
    return st.quantile_bins(_xy(t), ["flag"], "y", k)


@query("quantile_bins", "L01 L03", f"WITH {BINS} SELECT flag, id, bin FROM bn")
def _(t):
    return _binned(t, st.fallback_bin_count(60_000)).select("flag", "id", "bin")


BS = """
s AS (SELECT flag, bin, count(y) AS n, min(y) AS mn, max(y) AS mx, avg(y) AS mean, median(y) AS median, stddev_samp(y) AS std FROM bn GROUP BY flag, bin),
s2 AS (SELECT *, n * 100 / sum(n) OVER (PARTITION BY flag) AS pct, (sum(n) OVER (PARTITION BY flag ORDER BY bin) - n) * 100 / sum(n) OVER (PARTITION BY flag) AS below FROM s)
"""


@query("bin_statistics", "L04 L08", f"WITH {BINS}, {BS} SELECT flag, bin, n, mn AS min, mx AS max, round(mean, 5) AS mean, round(median, 5) AS median, round(std, 5) AS std, round(pct, 6) AS percent FROM s2")
def _(t):
    out = st.bin_statistics(_binned(t), ["flag"], "bin", "y")
    return out.select("flag", "bin", "n", "min", "max", *[F.round(c, 5).alias(c) for c in ("mean", "median", "std")], F.round("percent", 6).alias("percent"))


@query("bin_names", "L05", f"WITH {BINS}, {BS} SELECT flag, bin, CASE WHEN below < 15 THEN 'Very Low' WHEN below < 35 THEN 'Low' WHEN below < 65 THEN 'Medium' WHEN below < 85 THEN 'High' ELSE 'Very High' END || printf(' price: %.2f-%.2f', mn, mx) AS name FROM s2")
def _(t):
    return st.bin_names(st.bin_statistics(_binned(t), ["flag"], "bin", "y"), ["flag"], "bin", "price").select("flag", "bin", "name")


SOFT = BINS + """,
ce AS (SELECT flag, unnest(range(0, len(edges) - 1)) AS bin, edges, 0.1::DOUBLE * (edges[-1] - edges[1]) AS h FROM eg),
xr AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM xy),
wt AS (SELECT xr.flag, id, rid, y, ce.bin, exp(-((y - (edges[bin + 1] + edges[bin + 2]) / 2) ** 2) / (2 * h * h)) AS w FROM xr JOIN ce USING (flag)),
mb AS (SELECT flag, id, y, bin, w / sum(w) OVER (PARTITION BY rid) AS m FROM wt)
"""


@query("soft_bin_membership", "L06", f"WITH {SOFT} SELECT flag, id, CAST(bin AS INTEGER) AS bin, round(m, 6) AS membership FROM mb")
def _(t):
    return st.soft_quantile_membership(_xy(t), ["flag"], ["id"], "y", 4).select("flag", "id", "bin", F.round("membership", 6).alias("membership"))


@query("soft_bin_statistics", "L07", f"WITH {SOFT} SELECT flag, CAST(bin AS INTEGER) AS bin, round(sum(m), 4) AS weight, round(sum(m * y) / sum(m), 4) AS mean, round(sqrt(sum(m * y * y) / sum(m) - (sum(m * y) / sum(m)) ** 2), 3) AS std FROM mb GROUP BY flag, bin")
def _(t):
    out = st.weighted_bin_statistics(st.soft_quantile_membership(_xy(t), ["flag"], ["id"], "y", 4), ["flag"], "y")
    return out.select("flag", "bin", F.round("weight", 4).alias("weight"), F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std"))


@query("bin_anova", "L09", f"WITH {BINS}," + """
g AS (SELECT flag, bin, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM bn GROUP BY flag, bin HAVING count(x) >= 5),
s AS (SELECT flag, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS bt, sum(n * v) AS wi FROM g GROUP BY flag)
SELECT flag, k AS groups, n, round((bt / (k - 1)) / (wi / (n - k)), 5) AS f, round(bt / (bt + wi), 6) AS eta_squared FROM s
""")
def _(t):
    out = st.anova(_binned(t), ["flag"], "bin", "x")
    return out.select("flag", "groups", "n", F.round("f", 5).alias("f"), F.round("eta_squared", 6).alias("eta_squared"))


@query("welch_test", "L10", f"WITH {XY}," + """
g AS (SELECT flag, z > 0.05 AS hi, count(y) AS n, avg(y) AS m, var_samp(y) AS v FROM xy GROUP BY ALL),
p AS (SELECT a.flag, a.m - b.m AS d, a.v / a.n AS va, b.v / b.n AS vb, a.n AS na, b.n AS nb FROM g a JOIN g b ON a.flag = b.flag AND NOT a.hi AND b.hi)
SELECT flag, round(d / sqrt(va + vb), 6) AS t, round((va + vb) ** 2 / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)), 3) AS dof FROM p
""")
def _(t):
    out = st.welch(_xy(t).withColumn("hi", F.col("z") > 0.05), ["flag"], "hi", "y")
    return out.select("flag", F.round("t", 6).alias("t"), F.round("dof", 3).alias("dof"))


@query("bin_group_tests", "L11")
def _(t):
    return st.group_test(_binned(t), ["flag"], "bin", "x")


RANKS = """
rk AS (SELECT *, rank() OVER (PARTITION BY flag ORDER BY x) + (count(*) OVER (PARTITION BY flag, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2 AS ry FROM xy)
"""


@query("rank_correlations", "L12", f"WITH {XY}, {RANKS} SELECT flag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM rk GROUP BY flag")
def _(t):
    out = st.spearman(_xy(t), ["flag"], "x", "y")
    return out.select("flag", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("binned_mutual_information", "L15", f"WITH {BINS}," + """
c AS (SELECT flag, bin, x, count(*) AS n FROM bn GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY flag) AS t, sum(n) OVER (PARTITION BY flag, bin) AS a, sum(n) OVER (PARTITION BY flag, x) AS b FROM c)
SELECT flag, round(sum(n / t * ln(n * t / (a * b))), 6) AS mutual_information FROM m GROUP BY flag
""")
def _(t):
    return st.binned_mutual_information(_binned(t), ["flag"], "bin", "x").withColumn("mutual_information", F.round("mutual_information", 6))


@query("all_pair_analysis", "L16 L17 F17")
def _(t):
    return st.pair_analysis(column_pairs(t.lineitem, MEASURES))


def _pair_sql(x: str, y: str) -> str:
    edges = ", ".join(f"quantile_cont({x}, {q})" for q in (0.0, 0.25, 0.5, 0.75, 1.0))
    return f"""SELECT '{x}' AS x, '{y}' AS y, c.n, c.pearson, c.spearman, CASE WHEN t.k = 2 THEN 'welch' WHEN t.k > 2 THEN 'anova' END AS test,
  round(CASE WHEN t.k = 2 THEN (t.m1 - t.m2) / sqrt(t.e1 + t.e2) WHEN t.k > 2 THEN (t.q - t.s * t.s / t.n) / (t.k - 1) / (t.within / (t.n - t.k)) END, 4) AS bin_statistic
FROM (SELECT count(*) AS n, round(corr({x}, {y}), 6) AS pearson, round(corr(r_{x}, r_{y}), 6) AS spearman FROM r) c,
  (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS within, min_by(m, b) AS m1, max_by(m, b) AS m2, min_by(e, b) AS e1, max_by(e, b) AS e2
   FROM (SELECT greatest(len(list_filter(edges, lambda e: e < {x})) - 1, 0) AS b, count(*) AS n, avg({y}) AS m, var_pop({y}) AS v, var_samp({y}) / count(*) AS e
         FROM r, (SELECT list_sort(list_distinct([{edges}])) AS edges FROM r) GROUP BY 1 HAVING count(*) >= 5)) t"""


@query("all_pair_statistics", "L16 L11 L12", "WITH r AS (SELECT " + ", ".join(f"{c}, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r_{c}" for c in MEASURES) + " FROM lineitem) " +
       " UNION ALL ".join(_pair_sql(a, b) for a in MEASURES for b in MEASURES if a != b))
def _(t):
    out = st.pair_statistics(column_pairs(t.lineitem, MEASURES))
    return out.select("x", "y", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "test", F.round("bin_statistic", 4).alias("bin_statistic"))


@query("pair_cluster_ranks", "L16 L35")
def _(t):
    from ..operators.pairclusters import cluster_ranks

    return cluster_ranks(column_pairs(t.lineitem, MEASURES, ordered=False), ["x", "y"], "vx", "vy")


@query("all_pair_ranks", "L17 L12", "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in MEASURES) + " FROM lineitem) " +
       " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, round(corr({a}, {b}), 6) AS spearman FROM r" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]))
def _(t):
    out = st.spearman(column_pairs(t.lineitem, MEASURES, ordered=False), ["x", "y"], "vx", "vy")
    return out.select("x", "y", "n", F.round("spearman", 6).alias("spearman"))


@query("partial_correlation", "L18", f"WITH {XY}, c AS (SELECT flag, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM xy GROUP BY flag), r AS (SELECT flag, n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM c) SELECT flag, n, round(r, 6) AS partial_r, round(sqrt(n - 4) * abs(0.5 * ln((1 + r) / (1 - r))), 4) AS z FROM r")
def _(t):
    out = st.partial_correlation(_xy(t), ["flag"], "x", "y", "z")
    return out.select("flag", "n", F.round("partial_r", 6).alias("partial_r"), F.round("z", 4).alias("z"))


@query("conditional_independence", "L19 L20")
def _(t):
    rows = st.quantile_bins(_xy(t), ["flag"], "z", 4, "zbin")
    return st.conditional_independence(rows, ["flag"], "x", "y", "zbin")


@query("best_split", "L21", f"WITH {XY}," + """
d AS (SELECT flag, x, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM xy GROUP BY ALL),
c AS (SELECT flag, x, sum(n) OVER w AS n, sum(n) OVER (PARTITION BY flag) AS t, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxy) OVER w AS sxy, sum(sxx) OVER w AS sxx, sum(syy) OVER w AS syy FROM d WINDOW w AS (PARTITION BY flag ORDER BY x DESC)),
r AS (SELECT *, (n * sxy - sx * sy) ** 2 / nullif((n * sxx - sx * sx) * (n * syy - sy * sy), 0) AS r2 FROM c WHERE n >= 5 AND t - n >= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY round(r2, 12) DESC NULLS LAST, x) AS rn FROM r)
SELECT flag, x AS threshold, CAST(n AS BIGINT) AS points_after, round(r2, 6) AS r2 FROM k WHERE rn = 1
""")
def _(t):
    return st.best_split(_xy(t), ["flag"], "x", "y").withColumn("r2", F.round("r2", 6))


@query("binary_segmentation", "L22")
def _(t):
    return st.binary_segmentation(_xy(t), "x", "y", "id")


@query("consensus_thresholds", "L24", """
WITH m AS (SELECT stddev_samp(value) * power(count(value), -0.2) AS h, min(value) AS lo, (max(value) - min(value)) / 999 AS step FROM events),
v AS (SELECT value, count(*) AS w FROM events GROUP BY value), g AS (SELECT i, lo + i * step AS x, h FROM range(0, 1000) r(i), m),
dn AS (SELECT i, x, sum(w * exp(-((x - value) * (x - value)) / (2 * h * h))) AS d FROM g, v GROUP BY ALL),
p AS (SELECT *, lag(d) OVER (ORDER BY i) AS before, lead(d) OVER (ORDER BY i) AS after FROM dn)
SELECT round(x, 6) AS threshold, round(d, 5) AS density FROM p WHERE d > before AND d > after ORDER BY d DESC LIMIT 3
""")
def _(t):
    return st.consensus_thresholds(t.events, "value").select(F.round("threshold", 6).alias("threshold"), F.round("density", 5).alias("density"))


@query("regional_errors", "L25", f"WITH {XY}, n AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY y, id) AS pos, count(*) OVER (PARTITION BY flag) AS t FROM xy)," + """
s AS (SELECT *, CAST(least((pos - 1) // (t // 7), 6) AS INTEGER) AS segment, y - 1500 * x AS e FROM n)
SELECT flag, segment, count(*) AS n, min(y) AS from_x, max(y) AS to_x, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - avg(e * e) / var_pop(y), 5) AS r2 FROM s GROUP BY flag, segment
""")
def _(t):
    out = st.regional_errors(_xy(t).withColumn("p", F.col("x") * 1500), ["flag"], "y", "id", "y", "p", 7)
    return out.select("flag", "segment", "n", "from_x", "to_x", F.round("rmse", 4).alias("rmse"), F.round("r2", 5).alias("r2"))


@query("percentile_trim", "L26", f"WITH {XY}, q AS (SELECT quantile_cont(x, 0.005) AS xl, quantile_cont(x, 0.995) AS xh, quantile_cont(y, 0.005) AS yl, quantile_cont(y, 0.995) AS yh FROM xy) SELECT id, x, y FROM xy, q WHERE x > xl AND x < xh AND y > yl AND y < yh")
def _(t):
    return st.trim_percentiles(_xy(t), ["x", "y"]).select("id", "x", "y")


@query("deviation_trim", "L27", "WITH m AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, value FROM events, m WHERE abs(value - m) <= 3 * s")
def _(t):
    return st.trim_deviations(t.events.withColumn("flat", F.lit(1.0)), ["value", "flat"]).select("event_id", "value")


@query("improving_removals", "L28", f"WITH {XY}," + """
f AS (SELECT flag, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS t, sum(x) AS tx, sum(y) AS ty, sum(x * y) AS txy, sum(x * x) AS txx, sum(y * y) AS tyy FROM xy GROUP BY flag),
e AS (SELECT xy.*, -abs(y - a - b * x) AS e FROM xy JOIN f USING (flag)),
s AS (SELECT flag, row_number() OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * y) OVER w AS sxy, sum(x * x) OVER w AS sxx, sum(y * y) OVER w AS syy FROM e WINDOW w AS (PARTITION BY flag ORDER BY e, id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT flag, n, ((t - n) * (txy - sxy) - (tx - sx) * (ty - sy)) ** 2 / (((t - n) * (txx - sxx) - (tx - sx) ** 2) * ((t - n) * (tyy - syy) - (ty - sy) ** 2)) AS r2 FROM s JOIN f USING (flag) WHERE n <= floor(t * 0.1)),
k AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY round(r2, 9) DESC, n) AS rn FROM r), i AS (SELECT flag, (t * txy - tx * ty) ** 2 / ((t * txx - tx ** 2) * (t * tyy - ty ** 2)) AS r0 FROM f)
SELECT flag, round(r0, 6) AS initial_r2, CASE WHEN r2 > r0 THEN n ELSE 0 END AS removed, round(greatest(r2, r0), 6) AS best_r2 FROM k JOIN i USING (flag) WHERE rn = 1
""")
def _(t):
    out = st.improving_removals(_xy(t), ["flag"], "x", "y", "id")
    return out.select("flag", F.round("initial_r2", 6).alias("initial_r2"), "removed", F.round("best_r2", 6).alias("best_r2"))


@query("distant_removals", "L28", """
WITH xy AS (SELECT event_type AS flag, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y, event_id AS id FROM events),
s AS (SELECT *, list_sort(list_filter([""" + ", ".join(f"x - lag(x, {i}) OVER w, lead(x, {i}) OVER w - x" for i in range(1, 5)) + """], lambda d: d IS NOT NULL)) AS near FROM xy WINDOW w AS (PARTITION BY flag ORDER BY x, id)),
e AS (SELECT *, -((near[1] + near[2] + near[3] + near[4]) / 5) AS e FROM s),
f AS (SELECT flag, count(*) AS t, sum(x) AS tx, sum(y) AS ty, sum(x * y) AS txy, sum(x * x) AS txx, sum(y * y) AS tyy FROM xy GROUP BY flag),
p AS (SELECT flag, row_number() OVER w AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * y) OVER w AS sxy, sum(x * x) OVER w AS sxx, sum(y * y) OVER w AS syy FROM e WINDOW w AS (PARTITION BY flag ORDER BY e, id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT flag, n, ((t - n) * (txy - sxy) - (tx - sx) * (ty - sy)) ** 2 / (((t - n) * (txx - sxx) - (tx - sx) ** 2) * ((t - n) * (tyy - syy) - (ty - sy) ** 2)) AS r2 FROM p JOIN f USING (flag) WHERE n <= floor(t * 0.1)),
k AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY round(r2, 9) DESC, n) AS rn FROM r), i AS (SELECT flag, (t * txy - tx * ty) ** 2 / ((t * txx - tx ** 2) * (t * tyy - ty ** 2)) AS r0 FROM f)
SELECT flag, round(r0, 6) AS initial_r2, CASE WHEN r2 > r0 THEN n ELSE 0 END AS removed, round(greatest(r2, r0), 6) AS best_r2 FROM k JOIN i USING (flag) WHERE rn = 1
""")
def _(t):
    out = st.improving_removals_by_distance(_pq(t).withColumn("id", F.col("event_id")), ["flag"], "x", "y", "id")
    return out.select("flag", F.round("initial_r2", 6).alias("initial_r2"), "removed", F.round("best_r2", 6).alias("best_r2"))


@query("neighbour_information", "L15")
def _(t):
    from ..operators.neighbours import neighbour_information

    return neighbour_information(_pq(t), ["flag"], "x", "y")


@query("low_contribution_refit", "L29", f"WITH {XY}," + """
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, var_pop(y) * count(*) AS sst FROM xy), r AS (SELECT xy.*, 1 - (y - (a + b * x)) ** 2 / sst AS r FROM xy, f), m AS (SELECT avg(r) AS m, stddev_samp(r) AS s FROM r)
SELECT count(*) AS kept, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM r, m WHERE r >= m - 2 * s
""")
def _(t):
    out = st.drop_low_contribution(_xy(t), "x", "y")
    return out.select("kept", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("cluster_effect_sizes", "L32", """
WITH g AS (SELECT event_type AS c, avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT a.c AS cluster1, b.c AS cluster2, round(abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS effect_size, abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) >= 0.3 AS meaningful
FROM g a JOIN g b ON a.c < b.c
""")
def _(t):
    return st.effect_sizes(t.events, [], "event_type", "value").withColumn("effect_size", F.round("effect_size", 6))


@query("merged_clusters", "L34", """
WITH v AS (SELECT event_id, event_type AS c, value + CASE event_type WHEN 'purchase' THEN 1000 WHEN 'signup' THEN 1000 WHEN 'view' THEN 5000 ELSE 0 END AS x FROM events),
g AS (SELECT c, dense_rank() OVER (ORDER BY c) - 1 AS label, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM v GROUP BY c),
p AS (SELECT b.c, min(a.label) AS label FROM g a JOIN g b ON a.label <= b.label WHERE a.label = b.label OR abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) < 0.3 GROUP BY b.c)
SELECT event_id, CAST(label AS INTEGER) AS merged FROM v JOIN p USING (c)
""")
def _(t):
    label = F.element_at(F.create_map(*[x for i, k in enumerate(["click", "error", "purchase", "signup", "view"]) for x in (F.lit(k), F.lit(i))]), F.col("event_type"))
    apart = F.when(label.isin(2, 3), 1000).when(label == 4, 5000).otherwise(0)
    return st.merge_similar(t.events.select("event_id", (F.col("value") + apart).alias("value"), label.alias("c")), "c", "value").select("event_id", "merged")


@query("cluster_lines", "L35", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL")
def _(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity", "l_extendedprice")
    out = st.cluster_lines(rows, ["flag", "status"], "l_quantity", "l_extendedprice")
    return out.select("flag", "status", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("r", 6).alias("r"))


# fixed values: the published rational form (algorithm AS 241) of the normal quantile: centre, tail, far tail
AS241 = {
    "centre": ("2.509080928730122672e3 3.343057558358812811e4 6.726577092700870085e4 4.592195393154987146e4 1.373169376550946111e4 1.971590950306551443e3 1.331416678917843775e2 3.387132872796366608e0",
               "5.226495278852854561e3 2.872908573572194267e4 3.930789580009271061e4 2.121379430158965979e4 5.394196021424751108e3 6.871870074920579083e2 4.231333070160091125e1 1.0"),
    "tail": ("7.7454501427834140764e-4 2.27238449892691845833e-2 2.4178072517745061177e-1 1.27045825245236838258e0 3.64784832476320460504e0 5.7694972214606914055e0 4.6303378461565452959e0 1.42343711074968357734e0",
             "1.05075007164441684324e-9 5.475938084995344946e-4 1.51986665636164571966e-2 1.4810397642748007459e-1 6.8976733498510000455e-1 1.6763848301838038494e0 2.05319162663775882187e0 1.0"),
    "far": ("2.01033439929228813265e-7 2.71155556874348757815e-5 1.2426609473880784386e-3 2.6532189526576123093e-2 2.9656057182850489123e-1 1.7848265399172913358e0 5.4637849111641143699e0 6.6579046435011037772e0",
            "2.04426310338993978564e-15 1.4215117583164458887e-7 1.8463183175100546818e-5 7.868691311456132591e-4 1.4875361290850615025e-2 1.3692988092273580531e-1 5.9983220655588793769e-1 1.0"),
}


def _quantile_sql(p: str) -> str:
    def ratio(part: str, r: str) -> str:
        sums = []
        for side in AS241[part]:
            out = ""
            for c in side.split():
                out = f"({out} * {r} + {c}::DOUBLE)" if out else f"{c}::DOUBLE"
            sums.append(out)
        return f"{sums[0]} / {sums[1]}"

    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return (f"CASE WHEN abs{q} <= 0.425 THEN {q} * {ratio('centre', f'(0.180625 - {q} * {q})')} "
            f"ELSE sign{q} * CASE WHEN {r} <= 5 THEN {ratio('tail', f'({r} - 1.6)')} ELSE {ratio('far', f'({r} - 5)')} END END")


@query("gaussian_copula", "L37", f"WITH {XY}," + """
k AS (SELECT flag, (rank() OVER (PARTITION BY flag ORDER BY x) + (count(*) OVER (PARTITION BY flag, x) - 1) / 2) / (count(*) OVER (PARTITION BY flag) + 1) AS px,
  (rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2) / (count(*) OVER (PARTITION BY flag) + 1) AS py FROM xy),
""" + f"z AS (SELECT flag, {_quantile_sql('px')} AS zx, {_quantile_sql('py')} AS zy FROM k) SELECT flag, round(corr(zx, zy), 6) AS rho FROM z GROUP BY flag")
def _(t):
    return st.gaussian_copula(_xy(t), ["flag"], "x", "y").withColumn("rho", F.round("rho", 6))


@query("target_against_all", "L39", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, round(corr({c}, l_extendedprice), 6) AS r FROM lineitem WHERE {c} IS NOT NULL" for c in ("l_quantity", "l_discount", "l_tax")))
def _(t):
    return st.target_against_all(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).withColumn("r", F.round("r", 6))


PQ = "pq AS (SELECT event_type AS flag, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y, event_id AS id FROM events)"


def _pq(t):
    return t.events.select(F.col("event_type").alias("flag"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_id")


@query("kendall_tau", "L13 L37", f"WITH {PQ}," + """
s AS (SELECT a.flag, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) FILTER (a.x <> b.x) AS dx, count(*) FILTER (a.y <> b.y) AS dy FROM pq a JOIN pq b ON a.flag = b.flag AND a.id < b.id GROUP BY a.flag),
n AS (SELECT flag, count(*) AS n FROM pq GROUP BY flag), t AS (SELECT flag, n, s / sqrt(dx::DOUBLE * dy) AS tau FROM s JOIN n USING (flag))
SELECT flag, n, round(tau, 9) AS tau, round(2 * tau / (1 - tau), 9) AS clayton, round(1 / (1 - tau), 9) AS gumbel FROM t
""")
def _(t):
    from ..operators.dominance import archimedean_parameters, kendall

    out = archimedean_parameters(kendall(_pq(t), ["flag"], "x", "y"))
    return out.select("flag", "n", *[F.round(c, 9).alias(c) for c in ("tau", "clayton", "gumbel")])


@query("distance_correlation", "L14", f"WITH {PQ}," + """
d AS (SELECT a.flag, a.id AS i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM pq a JOIN pq b ON a.flag = b.flag),
r AS (SELECT flag, i, sum(dx) AS a, sum(dy) AS b, sum(dx * dy) AS ab, sum(dx * dx) AS aa, sum(dy * dy) AS bb, count(*)::DOUBLE AS n FROM d GROUP BY flag, i),
g AS (SELECT flag, max(n) AS n, sum(ab) / max(n) ** 2 + sum(a) * sum(b) / max(n) ** 4 - 2 * sum(a * b) / max(n) ** 3 AS c, sum(aa) / max(n) ** 2 + sum(a) ** 2 / max(n) ** 4 - 2 * sum(a * a) / max(n) ** 3 AS vx,
  sum(bb) / max(n) ** 2 + sum(b) ** 2 / max(n) ** 4 - 2 * sum(b * b) / max(n) ** 3 AS vy FROM r GROUP BY flag)
SELECT flag, CAST(n AS BIGINT) AS n, round(sqrt(greatest(c / sqrt(vx * vy), 0)), 6) AS distance_correlation FROM g
""")
def _(t):
    from ..operators.dominance import distance_correlation

    return distance_correlation(_pq(t), ["flag"], "x", "y").withColumn("distance_correlation", F.round("distance_correlation", 6))
