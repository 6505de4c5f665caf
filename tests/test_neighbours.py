"""Clusters of column pairs, neighbour distances, neighbour-based information and removals beside plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.special import beta_fraction
from tidemark.operators import pairclusters as pc
from tidemark.operators import stats as st
from tidemark.operators.joins import column_pairs


# ---- clusters of pairs

def _lloyd(p, k=3):
    mean, cov = p.mean(0), np.cov(p.T, bias=True)
    turn = math.atan2(2 * cov[0, 1], cov[0, 0] - cov[1, 1]) / 2
    spread = math.sqrt((cov[0, 0] + cov[1, 1] + math.hypot(cov[0, 0] - cov[1, 1], 2 * cov[0, 1])) / 2)
    centres = np.array([mean + 1.5 * (2 * i + 1 - k) / k * spread * np.array([math.cos(turn), math.sin(turn)]) for i in range(k)])
    for _ in range(200):
        label = ((p[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([p[label == i].mean(0) if (label == i).any() else centres[i] for i in range(k)])
    return label


def _ranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def _spearman(p):
    a, b = _ranks(p[:, 0]), _ranks(p[:, 1])
    if len(p) < 2 or a.std() == 0 or b.std() == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])


def _p(r, n):
    if r is None or n <= 2:
        return None
    t = abs(r) * math.sqrt(n - 2) / math.sqrt(1 - r * r) if abs(r) < 1 else 1e9
    df = np.array([float(max(n - 2, 1))])
    return float(beta_fraction(df / 2, np.array([0.5]), df / (df + t * t))[0])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.normal(0, 1, 60), rng.normal(8, 1, 50), rng.normal(16, 1, 4)])
    b = np.where(a < 4, a, -2 * a) + rng.normal(0, 0.5, len(a))
    c = rng.integers(0, 4, len(a)).astype(float)
    d = np.round(rng.normal(0, 3, len(a)))
    data = np.column_stack([a, b, c, d])
    rows = [tuple(map(float, r)) for r in data] + [(None, 1.0, 1.0, 1.0), (float("nan"), 2.0, 1.0, 5.0)]
    return data, spark.createDataFrame(rows, "a double, b double, c double, d double")


def test_cluster_ranks_equal_a_loop(table):
    data, df = table
    names = ["a", "b", "c", "d"]
    got = {(r["x"], r["y"], r["cluster"]): r for r in pc.cluster_ranks(column_pairs(df, names), ["x", "y"], "vx", "vy").collect()}
    assert not any(x == "c" for x, _, _ in got)  # four distinct values
    seen = 0
    for x in "abd":
        for y in names:
            if x == y:
                continue
            p = data[:, [names.index(x), names.index(y)]]
            if "a" not in (x, y):  # the rows without a count here
                more = np.array([(1.0, 1.0, 1.0), (2.0, 1.0, 5.0)])
                p = np.vstack([p, more[:, ["bcd".index(x), "bcd".index(y)]]])
            label = _lloyd(p)
            for i in set(label):
                r, mine = got[x, y, i], p[label == i]
                seen += 1
                assert r["n"] == len(mine)
                want = _spearman(mine)
                assert (r["spearman"] is None) == (want is None) or len(mine) < 2
                if want is not None:
                    assert r["spearman"] == pytest.approx(want, abs=1e-9)
                    if len(mine) > 2:
                        assert r["p"] == pytest.approx(_p(want, len(mine)), rel=1e-6, abs=1e-12)
    assert seen == len(got)


def test_best_p_takes_clusters_of_five_in(table):
    _, df = table
    out = {(r["x"], r["y"]): r for r in st.pair_analysis(column_pairs(df, ["a", "b", "c", "d"])).collect()}
    inside = {}
    for r in pc.cluster_ranks(column_pairs(df, ["a", "b", "c", "d"]), ["x", "y"], "vx", "vy").collect():
        if r["n"] >= 5 and r["p"] is not None and not math.isnan(r["p"]):
            inside.setdefault((r["x"], r["y"]), []).append(r["p"])
    for key, r in out.items():
        assert r["cluster_p"] == (pytest.approx(min(inside[key]), rel=1e-9) if key in inside else None)
        assert r["best_p"] == min(v for v in (r["spearman_p"], r["bin_p"], r["cluster_p"]) if v is not None)
    assert out["c", "a"]["clusters"] == 0 and out["a", "b"]["clusters"] == 3


def test_few_rows_say_so(spark):
    rows = spark.createDataFrame([(float(i), float(i * i)) for i in range(7)] + [(None, 1.0)], "a double, b double")
    out = st.pair_analysis(column_pairs(rows, ["a", "b"])).collect()
    assert {r["error"] for r in out} == {"only 7 shared rows"} and {r["best_p"] for r in out} == {None}
    none = st.pair_analysis(column_pairs(rows.filter(F.lit(False)), ["a", "b"]))
    assert none.count() == 0


# ---- neighbours

@pytest.fixture(scope="module")
def scattered(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 220)
    y = x * 2 + rng.normal(0, 0.5, 220)
    x[:30], y[:20] = x[0], y[0]  # a hot value, and copies of one point
    x[150:], y[150:] = np.round(x[150:], 1), np.round(y[150:])
    rows = [("a", float(p), float(q)) for p, q in zip(x, y)] + [("b", float(p), float(q)) for p, q in zip(x[40:90], y[40:90])]
    rows += [("c", 1.0, 2.0)] * 3 + [("a", None, 1.0), ("a", float("nan"), 2.0), (None, 1.0, 1.0)]
    return x, y, spark.createDataFrame(rows, "g string, x double, y double")


def _information(x, y, k=3):
    x, y, n = x / x.std(), y / y.std(), len(x)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, 1)[:, k - 1]
    near = lambda e: np.where(r > 0, (e < (r * (1 - 1e-9))[:, None]).sum(1), (e == 0).sum(1))
    psi = lambda m: -0.5772156649015329 + sum(1 / i for i in range(1, int(m)))
    return max(0.0, psi(n) + psi(k) - np.mean([psi(a) + psi(b) for a, b in zip(near(dx), near(dy))]))


def test_neighbour_information_equals_brute_force(scattered):
    from tidemark.operators.neighbours import neighbour_information

    x, y, df = scattered
    got = {r["g"]: r for r in neighbour_information(df.filter("g IS NOT NULL"), ["g"], "x", "y", per_cell=8).collect()}
    assert got["a"]["n"] == 220 and got["c"]["mutual_information"] is None
    assert got["a"]["mutual_information"] == pytest.approx(_information(x, y), abs=1e-9)
    assert got["b"]["mutual_information"] == pytest.approx(_information(x[40:90], y[40:90]), abs=1e-9)


def test_nearest_distances_equal_brute_force_in_one_and_two_dimensions(scattered):
    from tidemark.operators.neighbours import nearest_distances

    x, y, df = scattered
    for second, euclid in (("y", True), (None, False)):
        d = np.hypot(x[:, None] - x, y[:, None] - y) if second else np.abs(x[:, None] - x)
        np.fill_diagonal(d, np.inf)
        want = {(a, b if second else 0.0): sorted(row)[:4] for a, b, row in zip(x, y, d)}
        near = nearest_distances(df.filter("g = 'a'"), ["g"], "x", second, k=4, euclid=euclid, per_cell=8).collect()
        assert sum(r["w"] for r in near) == 220 and len(near) == len(want)
        assert all(np.allclose(r["near"], want[r["x"], r["y"]], rtol=0, atol=1e-12) for r in near)


def test_ends_of_stretches_are_the_first_numbers_out_of_reach():
    from tidemark.operators.neighbours import first_beyond

    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 500), [0.0, -0.0, 1000.0, -1e-300, 5e-324]])
    r = np.concatenate([np.abs(rng.normal(0, 1, 500)), [0.0, 1.0, 1000.0, 0.0, 0.0]])
    t = first_beyond(v + 0.0, r)
    before = np.nextafter(t, -np.inf)
    assert np.where(r > 0, t - v >= r, t > v).all() and np.where(r > 0, before - v < r, before <= v).all()


def test_distant_removals_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 60), [9.0, -8.0, 9.5, 30.0]])
    y = 3 * x + rng.normal(0, 1, 64)
    y[60:] = rng.normal(0, 20, 4)

    def fit(p, q):
        return np.corrcoef(p, q)[0, 1] ** 2

    d = np.sort(np.abs(x[:, None] - x), 1)[:, :5]  # itself is the first
    order = sorted(range(64), key=lambda i: (-(d[i, 1] + d[i, 2] + d[i, 3] + d[i, 4]) / 5, i))
    tries = [(fit(x, y), 0)] + [(fit(np.delete(x, order[:m]), np.delete(y, order[:m])), m) for m in range(1, 7)]
    best = max(tries, key=lambda t: (round(t[0], 9), -t[1]))
    rows = [("a", i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))] + [("a", 99, None, 1.0), ("b", 1, 1.0, 2.0), ("b", 2, 2.0, 2.5), ("b", 3, 4.0, 1.0)]
    got = {r["g"]: r for r in st.improving_removals_by_distance(spark.createDataFrame(rows, "g string, id long, x double, y double"), ["g"], "x", "y", "id").collect()}
    assert got["a"]["initial_r2"] == pytest.approx(tries[0][0], abs=1e-9)
    assert (got["a"]["removed"], got["a"]["best_r2"]) == (best[1], pytest.approx(best[0], abs=1e-9)) and best[1] > 0
    assert got["b"]["removed"] == 0
