"""Ward's clusters, numbers of bins, deep documents and day columns against loops."""

import json

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import bincounts as bc
from tidemark.operators import quality as qu
from tidemark.operators import resample as rs
from tidemark.operators import ward as wd
from tidemark.sources import tables as tb


def _ward(points, k):
    groups = [[i] for i in range(len(points))]
    while len(groups) > k:
        def cost(a, b):
            p, q = points[groups[a]], points[groups[b]]
            return len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum()
        a, b = min(((a, b) for b in range(len(groups)) for a in range(b)), key=lambda ab: cost(*ab))
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_ward_equals_pairwise_merging(spark):
    rng = np.random.default_rng(5)
    cells = rng.choice(20 * 20, 45, replace=False)
    points = np.c_[cells // 20, cells % 20] + rng.uniform(0.2, 0.8, (45, 2))
    points = np.r_[[[0.0, 0.0], [20.0, 20.0]], points]
    points = points[[i for i, c in enumerate(map(tuple, np.minimum(points.astype(int), 19))) if c not in list(map(tuple, np.minimum(points.astype(int), 19)))[:i]]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(900, None, 1.0), (901, float("nan"), 2.0)], "i long, x double, y double")
    got = wd.ward_clusters(df, "x", "y", 4, side=20).toPandas().set_index("i")
    mine = got.dropna(subset=["cluster"]).groupby("cluster")
    assert {frozenset(g.index) for _, g in mine} == _ward(points, 4)
    assert list(mine["x"].mean()) == sorted(mine["x"].mean()) and got.loc[[900, 901], "cluster"].isna().all()
    near = np.array(got.loc[0, "nearness"])
    d = np.sqrt([((points[0] - points[list(g.index)].mean(0)) ** 2).sum() for _, g in mine])
    assert np.allclose(near, np.exp(-d) / np.exp(-d).sum())
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "x double, y double")
    assert [r["cluster"] for r in wd.ward_clusters(flat, "x", "y", 3).collect()] == [0, 0]
    assert wd.ward_clusters(flat.limit(0), "x", "y", 3).count() == 0


def test_bin_counts_of_three_heaps(spark):
    rng = np.random.default_rng(8)
    v = np.r_[rng.normal(0, 1, 120), rng.normal(30, 1, 100), rng.normal(60, 1, 90)]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(999, None), (998, float("nan"))], "i long, v double")
    got = bc.bin_count_choices(df, ["i"], "v", largest=5).toPandas()
    assert {r.method: r.k for r in got[got["chosen"] == 1].itertuples()} == {"elbow": _elbow(got), "gap": 3, "silhouette": 3, "bic": 3}
    three = got[got["k"] == 3].set_index("method")["score"]
    label = np.searchsorted([15, 45], v)
    groups = [v[label == c] for c in range(3)]
    assert np.isclose(three["elbow"], sum(((g - g.mean()) ** 2).sum() for g in groups))
    far = np.array([[((x - g) ** 2).sum() / (len(g) - (c == l) or 1) for c, g in enumerate(groups)] for x, l in zip(v, label)])
    own = far[np.arange(len(v)), label]
    other = np.where(np.arange(3) == label[:, None], np.inf, far).min(1)
    assert np.isclose(three["silhouette"], ((other - own) / np.maximum(own, other)).mean())
    # heaps this far apart are a mixture of the groups themselves
    like = sum(np.log(len(g) / len(v) / np.sqrt(2 * np.pi * g.var()) * np.exp(-(g - g.mean()) ** 2 / 2 / g.var())).sum() for g in groups)
    assert np.isclose(three["bic"], -2 * like + 8 * np.log(len(v)), rtol=1e-4)


def test_a_round_counts_a_point_once(spark, monkeypatch):
    met, plain = [], F.broadcast
    monkeypatch.setattr(bc.F, "broadcast", lambda t: met.append(t) or plain(t))
    x = np.random.default_rng(2).uniform(0, 1, 200) ** 2
    points = spark.createDataFrame([(s, float(v)) for s in (0, 1) for v in (x if s else x ** 2)], "s int, x double")
    got = bc._lloyd(points, 2, [2, 3, 4], 40)
    assert met[0].count() == 2  # one row of cuts per set, not one per set and k
    for (s, k), parts in got.items():
        v = x if s else x ** 2
        centres = (np.arange(k) + 0.5) / k
        for _ in range(40):
            label = np.searchsorted((centres[1:] + centres[:-1]) / 2, v)
            moved = np.array([v[label == c].mean() if (label == c).any() else centres[c] for c in range(k)])
            if np.abs(moved - centres).max() <= 1e-5:
                break
            centres = moved
        assert [p[0] for p in parts] == [(label == c).sum() for c in range(k)]
        assert np.allclose([p[1:] for p in parts], [((v[label == c]).sum(), (v[label == c] ** 2).sum()) for c in range(k)])


def _elbow(got):
    s = got[got["method"] == "elbow"].sort_values("k")["score"].to_list()
    return 2 + int(np.argmax(np.diff(np.diff(s))))


def test_bin_counts_of_small_columns(spark):
    def chosen(values):
        df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i long, v double")
        return {(r["k"], r["score"], r["chosen"]) for r in bc.bin_count_choices(df, ["i"], "v").collect()}

    assert chosen([1, 2, 3, 4, 5]) == {(2, None, 1)} and chosen([1, 2, 3] * 10) == {(2, None, 1)} and chosen([None]) == set()


def test_deep_documents(spark):
    deep = {"leaf": 7, "list": [1, {"b": "x"}], "no": [], "nil": None}
    for i in range(40):
        deep = {f"l{i}": deep}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"a": true}'), (3, None), (4, "5")], "i long, doc string")
    got = {(r["i"], r["path"], r["value"]) for r in tb.flatten_documents(df, ["i"], "doc").collect()}
    stem = "_".join(f"l{i}" for i in range(39, -1, -1))
    assert got == {(1, f"{stem}_leaf", "7"), (1, f"{stem}_list_0", "1"), (1, f"{stem}_list_1_b", "x"), (1, f"{stem}_nil", None), (2, "a", "true"), (4, "", "5")}


def test_even_smoothing_weights():
    w = rs.savgol_weights(20, 2)
    at = np.arange(20) - 9.5
    # a parabola is met exactly half a step ahead of the row
    assert len(w) == 20 and np.isclose(sum(w), 1) and np.isclose(np.dot(w, 3 * at**2 + 2 * at + 1), 1)


def test_day_columns_of_control_and_curation(spark):
    df = spark.range(1).select(*[F.lit(1.0).alias(c) for c in ("food:x", "night:aggregated:asleepTimeSSM", "night:yasa:other", "t")], F.lit("a").alias("events"))
    assert qu.day_feature_columns(df, "t", ["under_my_control"]).columns == ["food:x", "night:aggregated:asleepTimeSSM", "t"]
    assert qu.day_feature_columns(df, "t", ["curated_night"]).columns == ["night:aggregated:asleepTimeSSM", "t"]
    assert qu.day_feature_columns(df, "t", ["literally_all"], ["food:"]).columns == ["night:aggregated:asleepTimeSSM", "night:yasa:other", "t"]
