"""Splits, Spark ML models, metrics, clustering and decompositions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.local import local_table
from ..session import ensure_checkpoint_dir
from . import fits
from .quality import clean_target, drop_infinite
from .stats import effect_sizes

SEED = 42


# ---- splits

def bucket_of(keys: Sequence[str], seed: int = SEED, buckets: int = 100) -> Column:
    """Reproducible bucket of a key: the same in every run, engine and partitioning."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def split(df: DataFrame, keys: Sequence[str], test_percent: int = 10, seed: int = SEED) -> DataFrame:
    """``is_test`` by hash of the keys: row keys for a random split, the night for a leak-free one."""
    return df.withColumn("is_test", bucket_of(keys, seed) < test_percent)


def split_by_date(df: DataFrame, night: str, first_test: Column) -> DataFrame:
    return df.withColumn("is_test", F.col(night) >= first_test)


def supervised_table(df: DataFrame, target: str, features: Sequence[str], *, condition: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a clean target that meet the condition and have all features present and finite."""
    out = clean_target(df, target)
    if condition is not None:
        out = out.filter(condition)
    out = out.select(*keep, *features, target).dropna(subset=list(features))
    return drop_infinite(out, features)


# ---- models

def regressor(kind: str, target: str, seed: int = SEED, *, trees: int = 200, depth: int = 8):
    """An estimator; ``trees`` and ``depth`` are those of the boosted kind."""
    made = {
        "boosted": lambda: GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed),
        "linear": LinearRegression,
        "tree": lambda: DecisionTreeRegressor(maxDepth=5, seed=seed),
        "forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=8, seed=seed),
    }[kind]()
    return made.setLabelCol(target).setFeaturesCol("features")


def classifier(kind: str, target: str, seed: int = SEED, *, trees: int = 200, depth: int = 8):
    """An estimator; ``trees`` and ``depth`` are those of the boosted kind."""
    made = {
        "boosted": lambda: GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed),
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=8, seed=seed),
    }[kind]()
    return made.setLabelCol(target).setFeaturesCol("features")


def kept(df: DataFrame) -> DataFrame:
    """The rows written once, in the partitions and order they have, so that models come out the same.

    A fit reads its rows several times; the steps before it are then not repeated for every model and pass.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fit(df: DataFrame, features: Sequence[str], estimator, weights: dict[str, float] | None = None) -> Model:
    """Assemble and fit; ``weights`` scales columns by name pattern before assembly."""
    rows = weigh_columns(df, features, weights) if weights else df
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator]).fit(rows)


def weigh_columns(df: DataFrame, columns: Sequence[str], weights: dict[str, float]) -> DataFrame:
    changed = {c: F.col(c) * f for c in columns for part, f in weights.items() if part in c}
    return df.withColumns(changed) if changed else df


def importances(model: Model, features: Sequence[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda p: -p[1])


def importance_table(df: DataFrame, model: Model, features: Sequence[str]) -> DataFrame:
    return local_table(df.sparkSession, importances(model, features), "feature string, importance double")


def reduce_features(train: DataFrame, test: DataFrame, features: Sequence[str], make: Callable[[], object], target: str) -> DataFrame:
    """Train, score, drop the least important: halve above 16 features, else four fewer, down to two."""
    left, out, step = list(features), [], 0
    evaluate = RegressionEvaluator(labelCol=target, metricName="mae")
    while True:
        model = fit(train, left, make())
        out.append((step, len(left), float(evaluate.evaluate(model.transform(test))), "|".join(left)))
        if len(left) <= 2:
            break
        keep = len(left) // 2 if len(left) > 16 else max(2, len(left) - 4)
        left = [f for f, _ in importances(model, left)[:keep]]
        step += 1
    return local_table(train.sparkSession, out, "step int, features int, mae double, columns string")


def positive_unlabelled_scores(df: DataFrame, features: Sequence[str], positive: str, keys: Sequence[str]) -> DataFrame:
    """Probability of being positive when only some positives are labelled: score over the mean score of held-out positives."""
    held = (bucket_of(keys) < 10) & (F.col(positive) == 1)
    model = fit(df.filter(~held), features, classifier("forest", positive))
    scored = model.transform(df).withColumn("_p", vector_to_array("probability")[1])
    c = scored.filter(held).agg(F.avg("_p")).first()[0]
    return scored.select(*keys, positive, F.least(F.col("_p") / F.lit(c), F.lit(1.0)).alias("score"))


# ---- metrics

def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"))


def classification_metrics(df: DataFrame, actual: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and derived rates; null rates when only one class occurs."""
    counts = df.groupBy(*by).agg(F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = ((tp + fn) > 0) & ((fp + tn) > 0)
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return counts.withColumns({
        "accuracy": F.when(both, (tp + tn) / (tp + fp + fn + tn)), "precision": F.when(both, p), "recall": F.when(both, r), "f1": F.when(both, F.try_divide(2 * p * r, p + r)),
    })


def nightly_errors(df: DataFrame, keys: Sequence[str], night: str, order: str, actual: str, predicted: str) -> DataFrame:
    """Error per row and, per night, its mean, the mean of the first ten rows and the mean over the last ten nights.

    Rows are one per epoch, nights one per key and day, so both windows are bounded by the calendar.
    """
    e = F.abs(F.col(actual) - F.col(predicted))
    rank = F.row_number().over(Window.partitionBy(*keys, night).orderBy(order))
    rows = df.select(*keys, night, e.alias("_e"), rank.alias("_rn"))
    per = rows.groupBy(*keys, night).agg(F.avg("_e").alias("mae"), F.avg(F.when(F.col("_rn") <= 10, F.col("_e"))).alias("mae_first_ten"))
    return per.withColumn("rolling_mae", F.avg("mae").over(Window.partitionBy(*keys).orderBy(night).rowsBetween(-9, 0)))


def cross_validate(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], *, folds: int = 3) -> float:
    """Mean R2 of a linear fit over folds given by the hash of the keys."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(df).withColumn("_fold", bucket_of(keys, buckets=folds))
    estimator = LinearRegression(labelCol=target, featuresCol="features")
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=ParamGridBuilder().build(), evaluator=RegressionEvaluator(labelCol=target, metricName="r2"), numFolds=folds, foldCol="_fold")
    return float(cv.fit(rows).avgMetrics[0])


# ---- bins and clusters

def _vector(df: DataFrame, columns: Sequence[str], *, standardise: bool = False) -> DataFrame:
    rows = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)
    if not standardise:
        return rows
    scaled = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True).fit(rows).transform(rows)
    return scaled.drop("features").withColumnRenamed("_scaled", "features")


def _by_mean(df: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """Relabel clusters 0.. by ascending mean of a column (one row per cluster)."""
    means = [r[label] for r in df.groupBy(label).agg(F.avg(value).alias("m")).orderBy("m").collect()]
    mapping = F.create_map(*[x for i, v in enumerate(means) for x in (F.lit(v), F.lit(i))])
    return df.withColumn(name, mapping[F.col(label)])


def cluster_bins(df: DataFrame, value: str, k: int, method: str = "kmeans", target: str | None = None) -> DataFrame:
    """Bins of one column by K-means, mixture or a tree on the target, numbered by ascending mean."""
    if method == "tree":
        rows = _vector(df, [value])
        depth = max(1, math.ceil(math.log2(k)))
        out = DecisionTreeRegressor(labelCol=target, featuresCol="features", maxDepth=depth, seed=SEED).fit(rows).transform(rows)
        return _by_mean(out.withColumn("_l", F.round("prediction", 9)), "_l", value, "bin").drop("features", "_l", "prediction")
    with fits.points(df, [value]) as p:
        label = fits.nearest(p, fits.k_means(p, [k], SEED)[k][0]) if method == "kmeans" else fits.likeliest(p, fits.mixture(p, k, SEED))
        return _by_mean(p.rows.withColumn("_l", label), "_l", value, "bin").drop(*p.names, "_l")


def choose_bin_count(df: DataFrame, value: str, largest: int = 6) -> DataFrame:
    """Silhouette per number of K-means bins."""
    rows = _vector(df, [value])
    judge = ClusteringEvaluator(metricName="silhouette")
    return local_table(df.sparkSession, [(k, float(judge.evaluate(KMeans(k=k, seed=SEED).fit(rows).transform(rows)))) for k in range(2, largest + 1)], "k int, silhouette double")


def _mixture_2d(p: fits.Points, x: str, k: int) -> DataFrame:
    labelled = p.rows.withColumn("_l", fits.likeliest(p, fits.mixture(p, k, SEED)))
    return _by_mean(labelled, "_l", x, "cluster").drop(*p.names, "_l")


def clusters_2d(df: DataFrame, x: str, y: str, k: int, method: str = "mixture", *, points: fits.Points | None = None) -> DataFrame:
    """Two-dimensional clusters (mixture or bisecting K-means), numbered left to right.

    ``points``: those of x and y, standardised, which several mixtures of the same rows may share.
    """
    if method == "mixture":
        if points:
            return _mixture_2d(points, x, k)
        with fits.points(df, [x, y], standardise=True) as p:
            return _mixture_2d(p, x, k)
    rows = _vector(df, [x, y], standardise=True)
    model = BisectingKMeans(k=k, seed=SEED).fit(rows)
    return _by_mean(model.transform(rows), "prediction", x, "cluster").drop("features", "prediction", "probability")


def choose_k_by_bic(df: DataFrame, columns: Sequence[str], smallest: int = 2, largest: int = 10) -> DataFrame:
    """K-means cost plus ``k (d + 1) ln n`` per k on standardised columns; the lowest wins."""
    with fits.points(df, columns, standardise=True) as p:
        n, d = p.vectors.count(), len(columns)
        found = fits.k_means(p, range(smallest, largest + 1), SEED)
        out = [(k, float(cost + k * (d + 1) * math.log(n))) for k, (_, cost) in found.items()]
    best = min(out, key=lambda p: p[1])[0]
    return local_table(df.sparkSession, [(k, b, int(k == best)) for k, b in out], "k int, bic double, chosen int")


def largest_meaningful_k(df: DataFrame, x: str, y: str, ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Whether all clusters differ meaningfully on y, per k."""
    out = []
    with fits.points(df, [x, y], standardise=True) as p:
        for k in ks:
            ok = k == 1 or effect_sizes(clusters_2d(df, x, y, k, points=p), [], "cluster", y).agg(F.bool_and("meaningful")).first()[0]
            out.append((k, int(bool(ok))))
    return local_table(df.sparkSession, out, "k int, meaningful int")


def tree_thresholds(df: DataFrame, x: str, y: str, *, depth: int = 3, min_rows: int = 10) -> DataFrame:
    """Split points of a regression tree on x."""
    model = DecisionTreeRegressor(labelCol=y, featuresCol="features", maxDepth=depth, minInstancesPerNode=min_rows, seed=SEED, maxBins=256).fit(_vector(df, [x]))
    cuts = sorted({float(v) for v in re.findall(r"feature 0 <= ([-0-9.eE]+)", model.toDebugString)})
    return local_table(df.sparkSession, [(c,) for c in cuts], "threshold double")


def principal_components(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Loadings and explained variance of standardised columns; columns missing more than half are dropped first."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns]).first()
    kept = [c for c in columns if row[c] * 2 >= row["_n"]]
    model = PCA(k=min(k, len(kept)), inputCol="features", outputCol="_pc").fit(_vector(df.dropna(subset=kept), kept, standardise=True))
    load, share = model.pc.toArray(), model.explainedVariance.toArray()
    out = [(i + 1, c, float(load[j][i]), float(share[i])) for i in range(load.shape[1]) for j, c in enumerate(kept)]
    return local_table(df.sparkSession, out, "component int, column string, loading double, explained double")


def singular_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Largest singular values of the standardised rows, from one aggregate of all column correlations."""
    complete = df.dropna(subset=list(columns))
    d = len(columns)
    row = complete.agg(F.count(F.lit(1)).alias("n"), *[F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i in range(d) for j in range(i)]).first()
    gram = np.eye(d)
    for i in range(d):
        for j in range(i):
            gram[i, j] = gram[j, i] = row[f"r{i}_{j}"]
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(gram)[::-1], 0) * (row["n"] - 1))
    return local_table(df.sparkSession, [(i + 1, float(v)) for i, v in enumerate(values[:k])], "component int, singular_value double")


def compare_formulas(df: DataFrame, target: str, formulas: dict[str, Sequence[str]]) -> DataFrame:
    """AIC, coefficients and their p values of several linear models."""
    out = []
    for name, columns in formulas.items():
        rows = _vector(df.dropna(subset=[*columns, target]), columns)
        model = GeneralizedLinearRegression(labelCol=target, featuresCol="features", family="gaussian").fit(rows)
        p = [*model.summary.pValues[:-1]] if len(model.summary.pValues) == len(columns) + 1 else [None] * len(columns)
        out += [(name, c, float(b), pv if pv is None else float(pv), float(model.summary.aic)) for c, b, pv in zip(columns, model.coefficients, p)]
    return local_table(df.sparkSession, out, "model string, term string, coefficient double, p double, aic double")
