"""Fits over packed points beside Spark's own."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler

from tidemark.operators import blocks as bl
from tidemark.operators import fits
from tidemark.operators import modeling as mo


@pytest.fixture(scope="module")
def heaps(spark):
    rng = np.random.default_rng(3)
    at = rng.choice(3, 600, p=[0.5, 0.3, 0.2])
    x = np.array([0.0, 6.0, 11.0])[at] + rng.normal(0, 1, 600)
    y = np.array([0.0, 5.0, -4.0])[at] + rng.normal(0, 1, 600) + 0.4 * x
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(600, None, 1.0), (601, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "i long, x double, y double").coalesce(2).cache()


def test_fits_equal_sparks(heaps):
    whole = VectorAssembler(inputCols=["x", "y"], outputCol="features", handleInvalid="skip").transform(heaps)
    with fits.points(heaps, ["x", "y"]) as p:
        state, wanted = fits.mixture(p, 3, 42), GaussianMixture(k=3, seed=42).fit(whole)
        for (w, m, c), weight, g in zip(state, wanted.weights, wanted.gaussiansDF.collect()):
            assert w == pytest.approx(weight, rel=1e-6)
            assert np.allclose(m, g["mean"].toArray(), rtol=1e-6) and np.allclose(c, g["cov"].toArray(), rtol=1e-6)
        mine = {r["i"]: r["l"] for r in p.rows.withColumn("l", fits.likeliest(p, state)).collect()}
        assert mine == {r["i"]: r["prediction"] for r in wanted.transform(whole).collect()}
        for k, (centres, cost) in fits.k_means(p, [2, 3, 4], 42).items():
            model = KMeans(k=k, seed=42).fit(whole)
            assert np.allclose(centres, np.array([list(c) for c in model.clusterCenters()]), rtol=1e-6)
            assert cost == pytest.approx(model.summary.trainingCost, rel=1e-6)
            mine = {r["i"]: r["l"] for r in p.rows.withColumn("l", fits.nearest(p, centres)).collect()}
            assert mine == {r["i"]: r["prediction"] for r in model.transform(whole).collect()}


def test_no_round_reads_vectors(heaps, monkeypatch):
    rounds = []
    for kind in (GaussianMixture, KMeans):
        monkeypatch.setattr(kind, "_fit", lambda self, df, of=kind._fit: (rounds.append(self.getMaxIter()), of(self, df))[1])
    sizes = sorted(r["count"] for r in mo.clusters_2d(heaps, "x", "y", 3).groupBy("cluster").count().collect())
    assert sum(sizes) == 600 and len(sizes) == 3
    assert [r["meaningful"] for r in mo.largest_meaningful_k(heaps, "x", "y", (1, 2)).collect()][0] == 1
    assert mo.choose_k_by_bic(heaps, ["x", "y"], 2, 3).count() == 2
    assert mo.cluster_bins(heaps, "x", 3, "kmeans").filter("bin IS NULL").count() == 0
    assert mo.cluster_bins(heaps, "x", 3, "mixture").select("bin").distinct().count() == 3
    assert rounds and not any(rounds)


def test_one_value_is_one_heap(spark):
    flat = spark.createDataFrame([(2.0,)] * 8, "x double")
    assert {r["bin"] for r in mo.cluster_bins(flat, "x", 3, "kmeans").collect()} == {0}
    assert {r["bin"] for r in mo.cluster_bins(flat, "x", 3, "mixture").collect()} == {0}


def test_packing_keeps_every_point(monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 7)
    monkeypatch.setattr(bl, "HELD", 20)
    rng = np.random.default_rng(1)
    key, v = [None if i % 11 == 0 else f"k{i % 9}" for i in range(200)], rng.normal(size=200)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i:i + 30]), pa.array(v[i:i + 30])], names=["k", "v"]) for i in range(0, 200, 30)]
    got = [(r["k"], np.frombuffer(r["data"])) for b in bl._packer(["v"], ["k"])(batches) for r in b.to_pylist()]
    for k in set(key) - {None}:
        assert sorted(np.concatenate([d for name, d in got if name == k])) == sorted(a for a, b in zip(v, key) if b == k)
    assert None not in {k for k, _ in got} and len(got) > 9
    plain = [np.frombuffer(r["data"]) for b in bl._packer(["v"], [])([b.select(["v"]) for b in batches]) for r in b.to_pylist()]
    assert np.array_equal(np.concatenate(plain), v)


def test_a_mixture_round_works_in_slices(monkeypatch):
    monkeypatch.setattr(fits, "SLICE", 100, raising=False)
    x = np.random.default_rng(5).normal(size=(2, 730))
    state = [(0.6, np.array([-1.0, 0.0]), np.eye(2)), (0.4, np.array([1.0, 0.5]), np.diag([1.0, 2.0]))]
    seen, exp = [], np.exp
    monkeypatch.setattr(fits.np, "exp", lambda v, *a, **b: seen.append(np.size(v)) or exp(v, *a, **b))
    got = fits._expected(state)((), x)[""]
    d = [np.exp(-0.5 * (((x - m[:, None]) ** 2) / np.diag(c)[:, None]).sum(0)) * w / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, m, c in state]
    all_ = sum(d)
    want = [np.log(all_).sum(), *[v for p in d for v in ((p / all_).sum(), *(x @ (p / all_)), *((x * (p / all_)) @ x.T).ravel())]]
    assert np.allclose(got, want) and max(seen[:16]) == 100
