"""Chunked ordered operators against plain loops, with chunks far smaller than the series."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import quantiles as qu
from tidemark.operators import rangejoin as rj
from tidemark.operators.timeline import Timeline, framed, gap_islands, previous, running


def _series(seed=1, rows=300, keys=3):
    rnd = random.Random(seed)
    # key 0 holds most rows: the hot key
    data = [(0 if rnd.random() < 0.7 else rnd.randrange(1, keys), rnd.randrange(0, 500), i, rnd.random() if rnd.random() < 0.6 else None) for i in range(rows)]
    return pd.DataFrame(data, columns=["k", "t", "i", "v"])


def _frame(spark, pdf):
    return spark.createDataFrame([tuple(None if x != x else x for x in r) for r in pdf.itertuples(index=False)], "k long, t long, i long, v double")


def _sorted(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def test_previous_and_running_match_pandas(spark):
    pdf = _series().sort_values(["k", "t", "i"]).reset_index(drop=True)
    line = Timeline.every(["k"], ["t", "i"], 7)
    got = _sorted(running(previous(_frame(spark, pdf), line, p="i"), line, {"n": ("sum", F.lit(1)), "m": ("max", F.col("i")), "f": ("last", F.col("v"))}), "k", "t", "i")
    g = pdf.groupby("k")
    pd.testing.assert_series_equal(got["p"], g["i"].shift(), check_names=False)
    assert (got["n"] == g.cumcount() + 1).all()
    assert (got["m"] == g["i"].cummax()).all()
    pd.testing.assert_series_equal(got["f"], g["v"].ffill(), check_names=False)


def test_running_backwards_fills_from_the_future(spark):
    pdf = _series(2).sort_values(["k", "t", "i"]).reset_index(drop=True)
    got = _sorted(running(_frame(spark, pdf), Timeline.every(["k"], ["t", "i"], 11), {"f": ("last", F.col("v"))}, reverse=True), "k", "t", "i")
    pd.testing.assert_series_equal(got["f"], pdf.groupby("k")["v"].bfill(), check_names=False)


def test_wide_frames_reach_over_several_small_chunks(spark):
    pdf = _series(3, rows=120).sort_values(["k", "t", "i"]).reset_index(drop=True)
    line = Timeline.every(["k"], ["t", "i"], 3)
    got = _sorted(framed(_frame(spark, pdf), line, {"s": lambda w: F.sum("i").over(w.rowsBetween(-5, 4))}, before=5, after=4), "k", "t", "i")
    want = []
    for _, g in pdf.groupby("k"):
        v = g["i"].to_numpy()
        want += [int(v[max(0, j - 5): j + 5].sum()) for j in range(len(v))]
    assert got["s"].tolist() == want


def test_gap_islands_match_a_loop_for_both_bounds(spark):
    pdf = _series(4).sort_values(["k", "t", "i"]).reset_index(drop=True)
    for strict in (True, False):
        got = _sorted(gap_islands(_frame(spark, pdf), Timeline.every(["k"], ["t", "i"], 6), 3, strict=strict), "k", "t", "i")
        want = []
        for _, g in pdf.groupby("k"):
            n, last = 0, None
            for t in g["t"]:
                if last is None or (t - last > 3 if strict else t - last >= 3):
                    n += 1
                want.append(n)
                last = t
        assert got["island"].tolist() == want


def test_quantiles_do_not_depend_on_the_number_of_chunks(spark):
    rnd = random.Random(5)
    rows = [(0, float(rnd.randrange(40))) for _ in range(400)] + [(1, rnd.random()) for _ in range(333)] + [(2, 1.5), (2, None), (2, float("nan"))]
    df = spark.createDataFrame(rows, "k long, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    for method in ("linear", "index"):
        few = qu.exact_quantiles(df, ["k"], "v", probs, method=method, bins=2).toPandas().sort_values("k").reset_index(drop=True)
        many = qu.exact_quantiles(df, ["k"], "v", probs, method=method, bins=37).toPandas().sort_values("k").reset_index(drop=True)
        pd.testing.assert_frame_equal(few, many, check_exact=True)
    assert few.loc[2].tolist()[1:] == [1.5] * 5
    values = np.array([v for k, v in rows if k == 0])
    assert few.loc[0, "c"] == np.sort(values)[199:201].mean()
    linear = qu.exact_quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    assert np.allclose(linear.loc[0].to_numpy(), np.quantile(values, list(probs.values())))


def test_ranges_expand_in_blocks(spark):
    from tidemark.operators.timeline import exploded_range

    df = spark.createDataFrame([(1, 5, 30), (2, 7, 7), (3, 9, 8)], "k long, a long, b long")
    got = exploded_range(df, F.col("a"), F.col("b"), "n", block=3).select("k", "n").collect()
    assert sorted(map(tuple, got)) == [(1, n) for n in range(5, 31)] + [(2, 7)]
    # a range of 3e9 numbers: its blocks can be counted without the numbers
    huge = spark.createDataFrame([(1,)], "k long")
    plan = exploded_range(huge, F.lit(0), F.lit(2_999_999_999), "n")
    assert plan.columns == ["k", "n"] and plan.filter("n < 3").limit(3).count() == 3


def test_interval_rows_go_to_levels_that_occur(spark):
    points = spark.createDataFrame([(1, t) for t in range(0, 100_000, 50)], "k long, t long")
    spans = spark.createDataFrame([(1, s, s + 40) for s in range(0, 100_000, 1000)], "k long, s long, e long")
    assert rj.levels_present(spans, "s", "e", 50) == [0]
    laid = rj._laid_out(points, ["k"], "t", "t", 50, "p", others=rj.levels_present(spans, "s", "e", 50))
    assert laid.count() == points.count()


def test_ranks_average_ties(spark):
    values = [5.0, 1.0, 5.0, 2.0, 2.0, 2.0, None, 9.0]
    df = spark.createDataFrame([(0, v) for v in values], "k long, v double")
    got = qu.value_ranks(df, ["k"], "v", bins=3).toPandas().set_index("v")["rank_avg"].to_dict()
    assert got == pd.Series(values).dropna().rank().set_axis([v for v in values if v is not None]).to_dict()


def test_interval_join_equals_nested_loop(spark):
    rnd = random.Random(6)
    left = [(rnd.randrange(2), i, s, s + rnd.choice([0, 3, 40, 900, 200_000])) for i in range(60) for s in [rnd.randrange(3000)]]
    right = [(rnd.randrange(2), i, s, s + rnd.choice([0, 5, 70, 5000])) for i in range(60) for s in [rnd.randrange(-500, 3000)]]
    l = spark.createDataFrame(left, "k long, a long, s long, e long")
    r = spark.createDataFrame(right, "k long, b long, s long, e long")
    got = [(x["l"]["a"], x["r"]["b"]) for x in rj.interval_join(l, r, ["k"], ("s", "e"), ("s", "e"), width=10).collect()]
    want = [(a, b) for k, a, s, e in left for q, b, t, f in right if k == q and s <= f and t <= e]
    assert sorted(got) == sorted(want)
    bounded = rj.interval_join(l.filter("e - s <= 40"), r, ["k"], ("s", "e"), ("s", "e"), width=10, left_longest=40)
    short = [(a, b) for k, a, s, e in left if e - s <= 40 for q, b, t, f in right if k == q and s <= f and t <= e]
    assert sorted((x["l"]["a"], x["r"]["b"]) for x in bounded.collect()) == sorted(short)


def test_points_in_intervals_once_each(spark):
    p = spark.createDataFrame([(1, t) for t in range(0, 300, 7)], "k long, t long")
    iv = spark.createDataFrame([(1, 0, 299), (1, 50, 50), (1, 49, 57)], "k long, s long, e long")
    got = rj.interval_join(p, iv, ["k"], ("t", "t"), ("s", "e"), width=5).count()
    assert got == sum(s <= t <= e for t in range(0, 300, 7) for s, e in [(0, 299), (50, 50), (49, 57)])


def test_asof_takes_the_last_at_or_before(spark):
    l = spark.createDataFrame([(1, 5), (1, 10), (1, 25), (2, 3)], "k long, t long")
    r = spark.createDataFrame([(1, 10, 100), (1, 10, 101), (1, 20, 102)], "k long, at long, x long")
    got = {(x["k"], x["t"]): x["x"] for x in rj.asof_join(l, r, ["k"], "t", "at", take=["x"], chunk=4, tie="x").collect()}
    assert got == {(1, 5): None, (1, 10): 101, (1, 25): 102, (2, 3): None}
