"""What the work on column pairs reads and writes."""

import numpy as np
import pytest

from tidemark.operators import pairclusters as pc
from tidemark.operators import stats as st
from tidemark.operators.joins import column_pairs


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 2, 600), 1)
    rows = [(float(a), float(b)) for a, b in zip(x, x + rng.normal(0, 1, 600))] + [(None, 1.0), (float("nan"), 1.0)]
    return spark.createDataFrame(rows, "x double, y double")


def test_rounds_of_pairs_write_no_table(table, monkeypatch):
    written = []
    kind = type(table)
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, of=kind.checkpoint, **b: (written.append(1), of(self, *a, **b))[1])
    ranks = pc.cluster_ranks(column_pairs(table, ["x", "y"], ordered=False), ["x", "y"], "vx", "vy").collect()
    assert sum(r["n"] for r in ranks) == 600 and not written
    assert pc.cluster_ranks(column_pairs(table.limit(0), ["x", "y"]), ["x", "y"], "vx", "vy").count() == 0


def test_spearman_shares_its_counts(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table.write.parquet(path)
    out = st.spearman(column_pairs(spark.read.parquet(path), ["x", "y"]), ["x", "y"], "vx", "vy")
    got = {r["x"]: r for r in out.collect()}
    data = table.toPandas().dropna()
    for r in got.values():
        assert r["n"] == 600 and r["pearson"] == pytest.approx(data["x"].corr(data["y"]), abs=1e-12)
        assert r["spearman"] == pytest.approx(data["x"].rank().corr(data["y"].rank()), abs=1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") <= 4  # five before
