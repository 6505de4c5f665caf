"""Motifs against all pairs of windows."""

import numpy as np
import pandas as pd

from tidemark.operators import motifs as mf
from tidemark.operators.timeline import Timeline


def line():
    return Timeline.every(["rec"], ["i"], 50)


def brute(values, size, k):
    windows = []
    for at in range(len(values) - size + 1):
        w = np.array(values[at:at + size], dtype=float)
        if np.isfinite(w).all():
            windows.append((at, np.zeros(size) if w.min() == w.max() else (w - w.mean()) / w.std()))
    best = []
    for at, z in windows:
        near = [(round(float(np.sqrt(((z - y) ** 2).sum())), 9), o) for o, y in windows if abs(at - o) > -(-size // 4)]
        if near:
            d, o = min(near)
            best.append((d, at, o))
    return [(at, o, d) for d, at, o in sorted(best)[:k]], len(windows)


def found(spark, series, size, k):
    rows = pd.DataFrame([(r, i, float(v)) for r, vs in series.items() for i, v in enumerate(vs)], columns=["rec", "i", "v"])
    df = spark.createDataFrame(rows.astype({"rec": object}), "rec string, i long, v double").replace(float("nan"), None)
    return mf.motifs(df, line(), "v", size, k).toPandas().sort_values(["rec", "rank"])


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(mf, "TILE", 40)  # tiles of cells and of bands take part
    rng = np.random.default_rng(7)
    walk = rng.normal(size=400).cumsum()
    walk[300:324] = walk[40:64] * 2 + 5  # the same shape again
    series = {"walk": walk, "noise": rng.normal(size=150), "short": rng.normal(size=9), "gaps": np.where(np.arange(120) % 37 == 5, np.nan, rng.normal(size=120).cumsum()), "flat": [1.0] * 40}
    got = found(spark, series, 12, 4)
    for name, values in series.items():
        want, windows = brute(values, 12, 4)
        mine = got[got["rec"] == name]
        assert [(r.at, r.other) for r in mine.itertuples()] == [(a, o) for a, o, _ in want]
        assert np.allclose(mine["distance"], [d for _, _, d in want], atol=1e-8)
        if len(mine):
            assert set(mine["windows"]) == {windows}
    assert "short" not in set(got["rec"])
    assert [(r.at, r.other, r.distance) for r in got[got["rec"] == "flat"].itertuples()] == [(0, 4, 0), (1, 5, 0), (2, 6, 0), (3, 7, 0)]


def test_smooth_series_compares_few_pairs(spark):
    rng = np.random.default_rng(3)
    walk = rng.normal(size=3000).cumsum()
    walk[2000:2032] = walk[500:532]
    got = found(spark, {"walk": walk}, 32, 2)
    assert [tuple(x) for x in got[["at", "other"]].to_numpy()] == [(500, 2000), (2000, 500)]
    n = int(got["windows"].iloc[0])
    assert got["compared"].iloc[0] < n * (n - 1) / 2 / 4


def test_a_short_series_meets_once(spark):
    noise = np.random.default_rng(5).normal(size=300)
    got = found(spark, {"noise": noise}, 12, 3)
    want, windows = brute(noise, 12, 3)
    assert [(r.at, r.other) for r in got.itertuples()] == [(a, o) for a, o, _ in want]
    # all pairs that start more than a quarter of a window apart, each once
    assert set(got["compared"]) == {sum(windows - apart for apart in range(4, windows))}


def test_empty(spark):
    empty = spark.createDataFrame([], "rec string, i long, v double")
    assert mf.motifs(empty, line(), "v", 8).count() == 0
