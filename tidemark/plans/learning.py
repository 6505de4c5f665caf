"""Split, model and clustering queries."""

from pyspark.sql import functions as F

from ..operators import modeling as mo
from ..operators.quality import numeric_only
from .common import EPOCHS, epochs
from .joining import MEASURES
from .registry import query

BUCKET = "CAST('0x' || substr(md5(concat_ws('|', {keys}, '42')), 1, 8) AS BIGINT) % 100"


@query("row_split", "M01", f"SELECT event_id, {BUCKET.format(keys='event_id')} < 10 AS is_test FROM events")
def _(t):
    return mo.split(t.events.select("event_id"), ["event_id"])


@query("night_split", "M02", f"SELECT event_id, {BUCKET.format(keys='CAST(CAST(ts AS DATE) AS VARCHAR)')} < 10 AS is_test FROM events")
def _(t):
    return mo.split(t.events.select("event_id", F.to_date("ts").alias("night")), ["night"]).drop("night")


@query("date_split", "M14", "SELECT event_id, CAST(ts AS DATE) >= DATE '2024-01-20' AS is_test FROM events")
def _(t):
    return mo.split_by_date(t.events.select("event_id", F.to_date("ts").alias("night")), "night", F.lit("2024-01-20").cast("date")).drop("night")


@query("supervised_table", "M03", f"WITH {EPOCHS} SELECT user_id, epoch, round(confidence, 6) AS confidence, CAST(n AS DOUBLE) AS n, round(mean_value, 6) AS mean_value FROM ep WHERE stage <> 'W' AND mean_value <= 1000000")
def _(t):
    ep = epochs(t).select("user_id", "epoch", "stage", F.round("confidence", 6).alias("confidence"), F.col("n").cast("double").alias("n"), F.round("mean_value", 6).alias("mean_value"))
    return mo.supervised_table(ep, "mean_value", ["confidence", "n"], condition=F.col("stage") != "W", keep=["user_id", "epoch"])


def _features(t):
    k = F.get_json_object("props", "$.k").cast("double")
    return t.events.select("event_id", "user_id", "ts", F.hour("ts").cast("double").alias("hour"), k.alias("k"), (F.col("user_id") % 7).cast("double").alias("u7"),
                           F.dayofweek("ts").cast("double").alias("dow"), (F.col("event_type") == "error").cast("int").alias("wake"), F.col("value"))


FEATURES = ["hour", "k", "u7", "dow"]


@query("regressor_scores", "M04 M08")
def _(t):
    rows = mo.kept(mo.split(_features(t), ["event_id"]).select(*FEATURES, "value", "is_test"))
    train = rows.filter(~F.col("is_test"))
    out = []
    for kind in ("linear", "tree", "forest", "boosted"):
        scored = mo.fit(train, FEATURES, mo.regressor(kind, "value", trees=20, depth=5)).transform(rows)
        out.append(mo.regression_metrics(scored, "value", "prediction", ["is_test"]).withColumn("model", F.lit(kind)))
    from ..operators.aggregates import union_all
    return union_all(out)


@query("classifier_scores", "M05 M09")
def _(t):
    rows = mo.kept(mo.split(_features(t), ["event_id"]).select(*FEATURES, "value", "wake", "is_test"))
    scored = mo.fit(rows.filter(~F.col("is_test")), [*FEATURES, "value"], mo.classifier("boosted", "wake", trees=20, depth=5)).transform(rows)
    return mo.classification_metrics(scored, F.col("wake") == 1, F.col("prediction") == 1, ["is_test"])


@query("positive_unlabelled_scores", "M06")
def _(t):
    return mo.positive_unlabelled_scores(_features(t), [*FEATURES, "value"], "wake", ["event_id"])


@query("feature_reduction", "M07 M11 M12")
def _(t):
    rows = mo.split(mo.weigh_columns(_features(t), FEATURES, {"u7": 0.5}), ["event_id"])
    return mo.reduce_features(rows.filter(~F.col("is_test")), rows.filter("is_test"), FEATURES, lambda: mo.regressor("tree", "value"), "value")


@query("feature_importances", "M11")
def _(t):
    rows = _features(t)
    return mo.importance_table(rows, mo.fit(rows, FEATURES, mo.regressor("forest", "value")), FEATURES)


@query("regression_metrics", "M08", "SELECT event_type, count(*) AS n, round(avg(abs(value - user_id)), 6) AS mae, round(avg((value - user_id) ** 2), 5) AS mse, round(sqrt(avg((value - user_id) ** 2)), 6) AS rmse FROM events GROUP BY event_type")
def _(t):
    out = mo.regression_metrics(t.events, "value", "user_id", ["event_type"])
    return out.select("event_type", "n", F.round("mae", 6).alias("mae"), F.round("mse", 5).alias("mse"), F.round("rmse", 6).alias("rmse"))


@query("classification_metrics", "M09", """
WITH c AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0 AND value > 14) AS tp, count(*) FILTER (user_id % 2 <> 0 AND value > 14) AS fp, count(*) FILTER (user_id % 2 = 0 AND value <= 14) AS fn, count(*) FILTER (user_id % 2 <> 0 AND value <= 14) AS tn FROM events GROUP BY 1)
SELECT event_type, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c
""")
def _(t):
    out = mo.classification_metrics(t.events, F.col("user_id") % 2 == 0, F.col("value") > 14, ["event_type"])
    return out.select("event_type", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("nightly_errors", "M10", f"WITH {EPOCHS}," + """
r AS (SELECT user_id, day, abs(mean_value - 20) AS e, row_number() OVER (PARTITION BY user_id, day ORDER BY epoch) AS rn FROM ep), n AS (SELECT user_id, day, avg(e) AS mae, avg(e) FILTER (rn <= 10) AS f FROM r GROUP BY ALL)
SELECT user_id, day, round(mae + 1e-9, 6) AS mae, round(f + 1e-9, 6) AS mae_first_ten, round(avg(mae) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS rolling_mae FROM n
""")
def _(t):
    rows = epochs(t).withColumns({"day": F.to_date(F.timestamp_micros("at")), "guess": F.lit(20.0)})
    out = mo.nightly_errors(rows, ["user_id"], "day", "epoch", "mean_value", "guess")
    return out.select("user_id", "day", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mae", "mae_first_ten", "rolling_mae")])


@query("cross_validated_fit", "M13", """
WITH xy AS (SELECT l_quantity AS x, l_extendedprice AS y, CAST(CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 3 AS INTEGER) AS fold FROM lineitem),
l AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT DISTINCT fold FROM xy) f JOIN xy ON xy.fold <> f.fold GROUP BY f.fold),
r AS (SELECT l.fold, 1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)) AS r2 FROM l JOIN xy USING (fold) GROUP BY l.fold)
SELECT 'price_by_quantity' AS model, round(avg(r2), 6) AS r2 FROM r
""")
def _(t):
    from ..functions.local import local_table

    rows = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice")
    return local_table(t.spark, [("price_by_quantity", mo.cross_validate(rows, ["l_quantity"], "l_extendedprice", ["l_orderkey"]))], "model string, r2 double").withColumn("r2", F.round("r2", 6))


@query("clustered_bins", "L02 L08")
def _(t):
    from ..operators.aggregates import union_all
    from ..operators.stats import bin_statistics

    rows = t.events.select("event_id", F.col("value"), F.col("user_id").cast("double").alias("u"))
    return union_all([bin_statistics(mo.cluster_bins(rows, "value", 4, m, "u"), [], "bin", "value").withColumn("method", F.lit(m)) for m in ("kmeans", "mixture", "tree")])


@query("bin_count_choice", "L03")
def _(t):
    return mo.choose_bin_count(t.events.select("value"), "value", 5)


@query("tree_thresholds", "L23")
def _(t):
    return mo.tree_thresholds(t.lineitem, "l_quantity", "l_extendedprice")


@query("clusters_in_two_dimensions", "L30 L32 L35")
def _(t):
    from ..operators.stats import cluster_lines

    rows = t.lineitem.select("l_quantity", "l_extendedprice")
    return cluster_lines(mo.clusters_2d(rows, "l_quantity", "l_extendedprice", 3), ["cluster"], "l_quantity", "l_extendedprice")


@query("ward_clusters_2d", "L30")
def _(t):
    from ..operators.ward import cluster_shapes, ward_clusters

    return cluster_shapes(ward_clusters(t.lineitem.select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", 3), "l_quantity", "l_extendedprice")


@query("bin_count_choices", "L03")
def _(t):
    from ..operators.bincounts import bin_count_choices

    return bin_count_choices(t.events, ["event_id"], "value")


@query("cluster_count_by_bic", "L31")
def _(t):
    return mo.choose_k_by_bic(t.lineitem, ["l_quantity", "l_extendedprice"], 2, 6)


@query("largest_meaningful_k", "L33")
def _(t):
    return mo.largest_meaningful_k(t.lineitem.select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")


@query("principal_components", "L36 H09")
def _(t):
    return mo.principal_components(numeric_only(t.lineitem), MEASURES, 3)


@query("singular_values", "L36")
def _(t):
    return mo.singular_values(t.lineitem, MEASURES, 3)


@query("compared_formulas", "L38")
def _(t):
    rows = _features(t).withColumns({"evening": (F.col("hour") >= 18).cast("double"), "evening_k": F.when(F.col("hour") >= 18, F.col("k")).otherwise(0.0)})
    return mo.compare_formulas(rows, "value", {"plain": ["hour", "k"], "flags": ["evening", "k", "evening_k"]})


@query("formulas_with_products", "L38", """
WITH m AS (SELECT avg(value) FILTER (NOT e AND NOT o) AS m00, avg(value) FILTER (e AND NOT o) AS m10, avg(value) FILTER (NOT e AND o) AS m01, avg(value) FILTER (e AND o) AS m11, count(value) AS n,
  avg(value) AS m FROM (SELECT value, hour(ts) >= 18 AS e, user_id % 2 = 1 AS o FROM events))
SELECT 'flat' AS model, '1' AS term, round(m, 6) AS coefficient, CAST(n AS BIGINT) AS n FROM m UNION ALL SELECT 'products', '1', round(m00, 6), n FROM m UNION ALL SELECT 'products', 'evening', round(m10 - m00, 6), n FROM m
UNION ALL SELECT 'products', 'odd', round(m01 - m00, 6), n FROM m UNION ALL SELECT 'products', 'evening_and_odd', round(m11 - m10 - m01 + m00, 6), n FROM m
""")
def _(t):
    from ..operators.formulas import linear_formulas, with_products

    rows = with_products(t.events.select("value", (F.hour("ts") >= 18).alias("evening"), (F.col("user_id") % 2 == 1).alias("odd")), ["evening", "odd"])
    rows = rows.withColumns({c: F.col(c).cast("int") for c in ("evening", "odd")})
    out = linear_formulas(rows, "value", {"flat": [], "products": ["evening", "odd", "evening_and_odd"]})
    return out.select("model", "term", F.round("coefficient", 6).alias("coefficient"), "n")
