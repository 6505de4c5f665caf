"""Packed points of column pairs: ranks, bins and clusters beside pandas and the operators on rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks as bl
from tidemark.operators import pairclusters as pc
from tidemark.operators import pairranks as pr
from tidemark.operators import stats as st
from tidemark.operators.joins import column_pairs

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(6)
    a = np.round(rng.normal(0, 3, 900), 1)
    out = pd.DataFrame({"a": a, "b": np.where(rng.random(900) < 0.4, 5.0, a * 2 + rng.normal(0, 4, 900)), "c": rng.integers(0, 4, 900) / 10})
    out.loc[:30, "a"], out.loc[20:60, "c"] = np.nan, np.nan
    out.loc[70:80, "a"] = -0.0
    return out


@pytest.fixture(scope="module")
def rows(spark, table):
    text = pd.DataFrame({"n": table.index})
    for c in NAMES:
        text[c] = table[c]
    return spark.createDataFrame(text).repartition(3)


@pytest.mark.parametrize("few", [False, True])
def test_pairs_equal_pandas(rows, table, monkeypatch, few):
    if few:
        # several chunks and rounds of packing at this size
        monkeypatch.setattr(bl, "BLOCK", 50)
        monkeypatch.setattr(bl, "GATHERED", 300)
        monkeypatch.setattr(pr, "FEWEST", 4)
    pairs = column_pairs(rows, NAMES)
    # the same rows, by way of the long form
    for long in (pairs, pairs.filter(F.lit(True))):
        out = {(r["x"], r["y"]): r for r in st.pair_statistics(long).collect()}
        assert len(out) == 6
        for (x, y), r in out.items():
            both = table[[x, y]].dropna()
            assert r["n"] == len(both) and r["pearson"] == pytest.approx(both[x].corr(both[y]), abs=1e-9)
            assert r["spearman"] == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-9)
            edges = np.unique(both[x].quantile([0, 0.25, 0.5, 0.75, 1]))
            bins = [g for _, g in both.groupby(np.maximum(np.searchsorted(edges, both[x]) - 1, 0))[y] if len(g) >= 5]
            assert r["test"] == ("welch" if len(bins) == 2 else "anova")
            if len(bins) > 2:
                within, n = sum(((g - g.mean()) ** 2).sum() for g in bins), sum(map(len, bins))
                mean = sum(g.sum() for g in bins) / n
                between = sum(len(g) * (g.mean() - mean) ** 2 for g in bins)
                assert r["bin_statistic"] == pytest.approx(between / (len(bins) - 1) / (within / (n - len(bins))), rel=1e-9)


def test_bins_equal_those_of_rows(rows):
    pairs = column_pairs(rows, NAMES)
    want = {(r["x"], r["y"]): r for r in st.group_test(st.quantile_bins(pairs, ["x", "y"], "vx", 4), ["x", "y"], "bin", "vy").collect()}
    for r in st.pair_statistics(pairs).collect():
        w = want[r["x"], r["y"]]
        assert r["test"] == w["test"] and r["bin_statistic"] == pytest.approx(w["statistic"], rel=1e-9) and r["bin_p"] == pytest.approx(w["p"], abs=1e-9)


def test_no_pair_row_is_made(spark, table, tmp_path, monkeypatch):
    """Before, every pair's rows were dealt by a shuffle to meet the edges of their bins."""
    path = str(tmp_path / "t")
    spark.createDataFrame(table).write.parquet(path)
    seen = []
    real = bl._wide_packer
    monkeypatch.setattr(bl, "_wide_packer", lambda count, pairs: seen.append((count, sorted(pairs))) or real(count, pairs))
    out = st.pair_analysis(column_pairs(spark.read.parquet(path), NAMES))
    assert seen == [(3, [(0, 1), (0, 2), (1, 2)])]
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 6


def test_flat_columns_and_bins(spark):
    rows = spark.createDataFrame([(float(i), 0.1, float(i // 10)) for i in range(40)], "a double, b double, c double")
    out = {(r["x"], r["y"]): r for r in st.pair_statistics(column_pairs(rows, NAMES).filter("x <> 'b'")).collect()}
    assert out["a", "b"]["pearson"] is None and out["a", "b"]["spearman"] is None and out["a", "c"]["spearman"] > 0.9
    # y is one value in every bin: nothing varies inside
    assert all(out[pair]["test"] == "anova" and out[pair]["bin_statistic"] is None for pair in (("a", "b"), ("a", "c"), ("c", "b")))


def test_clusters_are_packed_from_rows(rows, monkeypatch):
    """Before, a shuffle counted every pair's points, and others dealt them to meet their ranks."""
    monkeypatch.setattr(bl, "_wide_packer", lambda count, pairs, real=bl._wide_packer: seen.append((count, sorted(pairs))) or real(count, pairs))
    seen = []
    out = pc.cluster_ranks(column_pairs(rows, NAMES, ordered=False), ["x", "y"], "vx", "vy")
    assert seen == [(3, [(0, 1), (0, 2), (1, 2)])]
    want = {(r["x"], r["y"], r["cluster"]): (r["n"], r["spearman"]) for r in pc.cluster_ranks(column_pairs(rows, NAMES, ordered=False).filter(F.lit(True)), ["x", "y"], "vx", "vy").collect()}
    got = {(r["x"], r["y"], r["cluster"]): (r["n"], r["spearman"]) for r in out.collect()}
    assert len(seen) == 1 and got.keys() == want.keys() and all(got[k][0] == n and got[k][1] == pytest.approx(s, abs=1e-9) for k, (n, s) in want.items())


def test_copies_are_counted(monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 8)
    monkeypatch.setattr(bl, "GATHERED", 60)
    monkeypatch.setattr(bl, "HELD_CELLS", 12)
    rng = np.random.default_rng(0)
    values = rng.integers(0, 5, (2, 300)) / 4
    values[0, ::17] = np.nan
    batches = [pa.RecordBatch.from_arrays([pa.array(v[i:i + 30]) for v in values], names=["c0", "c1"]) for i in range(0, 300, 30)]
    cells = [bl._uncut(r["single"], r["n"], r["data"]) for b in bl._wide_packer(2, [(0, 1)])(batches) for r in b.to_pylist()]
    got = pd.DataFrame(np.concatenate(cells, axis=1).T).groupby([0, 1])[2].sum()
    want = pd.DataFrame(values.T).dropna().groupby([0, 1]).size()
    assert (got == want).all() and len(got) == len(want) and max(c.shape[1] for c in cells) <= 8
    keyed = [pa.RecordBatch.from_arrays([pa.array([None if i % 7 == 0 else f"k{i % 3}" for i in range(30)]), *b.columns], names=["k", "x", "y"]) for b in batches]
    full = [b.filter(pa.compute.invert(pa.compute.is_nan(b["x"]))) for b in keyed]
    found = [(r["k"], bl._uncut(r["single"], r["n"], r["data"])) for b in bl._long_packer("x", "y", ["k"], [pa.string()])(full) for r in b.to_pylist()]
    for k in ("k0", "k1", "k2"):
        mine = pd.concat([b.to_pandas() for b in full])
        want = mine[mine["k"] == k].groupby(["x", "y"]).size()
        got = pd.DataFrame(np.concatenate([c for name, c in found if name == k], axis=1).T).groupby([0, 1])[2].sum()
        assert (got.to_numpy() == want.to_numpy()).all()
    assert {name for name, _ in found} == {"k0", "k1", "k2"}
