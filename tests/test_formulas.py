"""Formulas against least squares on the whole design."""

import numpy as np

from tidemark.operators import formulas as fo


def test_formulas_equal_least_squares(spark):
    rng = np.random.default_rng(4)
    a, b, y0 = rng.normal(1e4, 3, 300), rng.integers(0, 2, 300), rng.normal(size=300)
    y = 2 * a - 5 * b + 0.5 * a * b + y0
    rows = [(float(p), int(q), float(r)) for p, q, r in zip(a, b, y)] + [(None, 1, 3.0), (2.0, 0, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b int, y double")
    got = fo.linear_formulas(df, "y", {"plain": ["a", "b"], "product": ["a", "b", "a:b"], "twice": ["b", "b"], "mean": []}).toPandas()
    for model, columns in {"plain": [a, b], "product": [a, b, a * b]}.items():
        x = np.column_stack([np.ones(300), *columns])
        centred = x[:, 1:] - x[:, 1:].mean(0)
        slopes = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
        want = np.r_[y.mean() - slopes @ x[:, 1:].mean(0), slopes]
        rest = ((y - x @ want) ** 2).sum()
        mine = got[got["model"] == model]
        assert np.allclose(mine["coefficient"], want, rtol=1e-4) and set(mine["n"]) == {300}
        if model == "plain":
            errors = np.sqrt(np.diag(np.linalg.inv(centred.T @ centred)) * rest / 297)
            assert np.allclose(mine["std_error"][1:], errors, rtol=1e-6)
            assert np.isclose(mine["aic"].iloc[0], 300 * (np.log(2 * np.pi * rest / 300) + 1) + 6) and np.isclose(mine["r2"].iloc[0], 1 - rest / ((y - y.mean()) ** 2).sum())
    mean = got[got["model"] == "mean"]
    assert np.isclose(mean["coefficient"].iloc[0], np.r_[y, 3.0].mean()) and mean["n"].iloc[0] == 301
    twice = got[got["model"] == "twice"]["coefficient"].to_list()
    assert np.isclose(twice[1], twice[2])


def test_products_gaps_and_no_rows(spark):
    df = spark.createDataFrame([(True, True, False, 3.0, 5.0)], "a boolean, b boolean, c boolean, s double, e double")
    out = fo.with_gap(fo.with_products(df, ["a", "b", "c"]), "s", "e", "gap").first()
    assert (out["a_and_b"], out["a_and_c"], out["b_and_c"], out["a_and_b_and_c"], out["gap"]) == (1, 0, 0, 0, 2.0)
    assert fo.linear_formulas(df.limit(0), "s", {"m": ["e"]}).count() == 0
    one = fo.linear_formulas(df, "s", {"m": ["e"]}).collect()
    assert [(r["term"], r["coefficient"], r["p"]) for r in one] == [("1", 3.0, None), ("e", 0.0, None)]
