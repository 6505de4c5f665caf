"""Clocks, documents, files, quality, mining and statistics by hand."""

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import special as sp
from tidemark.functions import timeutil as tu
from tidemark.operators import eventlog as el
from tidemark.operators import mining as mi
from tidemark.operators import quality as qa
from tidemark.operators import stats as st
from tidemark.sources import manifest as mf
from tidemark.sources import tables as tb


def test_midnight_seconds_over_clock_changes(spark):
    df = spark.createDataFrame([(dt.date(2025, 3, 30), 90000), (dt.date(2024, 10, 27), 90000), (dt.date(2025, 3, 30), 0)], "d date, s long")
    got = [r[0] for r in df.select(tu.seconds_after_midnight(F.col("d"), F.col("s"))).collect()]
    assert got == [dt.datetime(2025, 3, 31, 0, 0), dt.datetime(2024, 10, 28, 1, 0), dt.datetime(2025, 3, 30, 0, 0)]


def test_mixed_offsets_and_bad_text(spark):
    df = spark.createDataFrame([("2025-06-01T10:00:00+01:00",), ("2025-06-01T10:00:00Z",), ("2025-06-01T10:00:00",), ("nonsense",)], "t string")
    got = [r[0] for r in df.select(tu.parse_instant(F.col("t"), naive_zone=tu.LONDON)).collect()]
    nine, ten = dt.datetime(2025, 6, 1, 9), dt.datetime(2025, 6, 1, 10)
    assert got == [nine, ten, nine, None]


def test_clock_target_score(spark):
    df = spark.createDataFrame([(81000, -1800), (78300, 0), (79200, 900)], "c long, d long")
    got = [round(r[0], 2) for r in df.select(tu.clock_target_score(F.col("c"), F.col("d"), F.lit(78300))).collect()]
    # 45 min late after moving 30 min closer: 0.6 * 62.5 + 0.4 * 40
    assert got == [53.5, 60.0, 52.5]


def test_day_columns_skip_zero_and_roll_over(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 0.5, 0.0), (dt.date(2024, 1, 2), 49.0, 24.5)], "day date, `a:first` double, `b:last` double")
    got = sorted((r["event"], r["at"]) for r in el.day_columns_to_events(df, "day", ["a:first", "b:last"]).collect())
    assert got == [("a", dt.datetime(2024, 1, 1, 0, 30)), ("a", dt.datetime(2024, 1, 4, 1, 0)), ("b", dt.datetime(2024, 1, 3, 0, 30))]


def test_debounce_is_inclusive_and_idempotent(spark):
    rows = [(1, 0, "a", 0), (1, 2_000_000, "a_long", 1), (1, 10_000_000, "a", 2), (1, 12_000_001, "a_long", 3), (1, 12_500_000, "b", 4)]
    df = spark.createDataFrame(rows, "k long, t long, e string, i long")
    once = el.debounce(df, ["k"], "t", "e", "i", within=2_000_000, chunk=3_000_000)
    assert sorted(r["i"] for r in once.collect()) == [1, 2, 3, 4]
    twice = el.debounce(once, ["k"], "t", "e", "i", within=2_000_000, chunk=3_000_000)
    assert sorted(r["i"] for r in twice.collect()) == [1, 2, 3, 4]


def test_recordings_round_trip(spark, tmp_path):
    root = tmp_path / "in"
    for name, body in (("2024-01-01-22-00-00", "epoch,stage\n0,W\n1,N1\n"), ("2024-01-02-22-00-00", "epoch,stage\n0,R\nbad,W\n")):
        (root / name).mkdir(parents=True)
        (root / name / "raw.csv").write_text(body)
    schema = T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("stage", T.StringType())])
    df = tb.read_recordings(spark, str(root), "raw.csv", schema)
    rows = df.collect()
    assert len(rows) == 4 and [r["recording_id"] for r in rows if r["_corrupt_record"]] == ["2024-01-02-22-00-00"]
    assert tb.read_recordings(spark, str(root), "missing.csv", schema).count() == 0
    out = str(tmp_path / "out")
    good = spark.createDataFrame([r for r in rows if not r["_corrupt_record"]], df.schema).drop("_corrupt_record")
    tb.write_recordings(good, out)
    tb.write_recordings(good.filter("recording_id LIKE '2024-01-02%'").withColumn("stage", F.lit("X")), out)
    got = sorted((r["recording_id"], r["stage"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01-22-00-00", "N1"), ("2024-01-01-22-00-00", "W"), ("2024-01-02-22-00-00", "X")]
    files = tb.list_files(spark, f"{root}/*/raw.csv").select("folder", "name").collect()
    assert {r["folder"] for r in files} == {"2024-01-01-22-00-00", "2024-01-02-22-00-00"}


def test_digest_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (2, "zz")], "k long, v string")
    changed = mf.changed(mf.content_digests(b, ["k"], ["v"]), mf.content_digests(a, ["k"], ["v"]), ["k"])
    assert [r["k"] for r in changed.collect()] == [2]


def test_require_complete_fails_and_constant_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, b double")
    with pytest.raises(Exception, match="missing values"):
        qa.require_complete(df, ["a"]).collect()
    assert [r["b"] for r in qa.min_max_scale(df, ["b"]).collect()] == [0.0, 0.0]


def test_greedy_removal_takes_the_cheapest_next(spark):
    rows = [(1, None, 1, 1), (1, 1, None, 1), (1, 1, None, None), (1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = [(r["column"], r["removed"]) for r in qa.greedy_removal(df, ["a", "b", "c", "d"]).orderBy("step").collect()]
    assert got == [("a", 0), ("b", 1), ("d", 1), ("c", 1)]


def test_sweep_counts_every_pair_without_listing_them(spark):
    rnd = random.Random(3)
    ev = [(k, rnd.randrange(0, 4000) * 1_000_000, i, rnd.choice("abc")) for i in range(150) for k in [0 if rnd.random() < 0.8 else 1]]
    df = spark.createDataFrame(ev, "k long, t long, i long, e string")
    lo, hi = 60_000_000, 900_000_000
    hits = mi.sweep_pairs(df, ["k"], "t", "e", "i", mi.kind_pairs(df, ["k"], "e", lo, hi, same=True), chunk=500_000_000)
    got = {(r["first"], r["second"]): (r["occurrences"], round(r["mean_gap"], 6), round(r["std_gap"], 5), round(r["min_gap"], 6)) for r in mi.gap_statistics(hits, ["first", "second"]).collect()}
    want = {}
    for (k, t, i, e), (q, u, j, f) in itertools.product(ev, ev):
        if k == q and lo <= u - t <= hi:
            want.setdefault((e, f), []).append((u - t) / 60e6)
    assert got == {p: (len(g), round(np.mean(g), 6), round(np.std(g), 5), round(min(g), 6)) for p, g in want.items()}


def test_sweep_sends_a_first_event_once_per_range(spark, monkeypatch):
    sent, walk = [], mi.running
    monkeypatch.setattr(mi, "running", lambda rows, *a, **b: sent.append(rows) or walk(rows, *a, **b))
    df = spark.createDataFrame([(0, t * 60_000_000, t, "abcd"[t % 4]) for t in range(12)], "k long, t long, i long, e string")
    pairs = mi.kind_pairs(df, ["k"], "e", 60_000_000, 300_000_000, same=True)
    assert mi.sweep_pairs(df, ["k"], "t", "e", "i", pairs, chunk=500_000_000).agg(F.sum("n")).first()[0] == 11 + 10 + 9 + 8 + 7
    # in and out once per event, and one question to each kind of firsts
    assert sent[0].count() == 12 * (2 + 4)
    assert not [c for c in sent[0].schema.fields if "decimal" in c.dataType.simpleString()]


def test_tail_probabilities_against_tables(spark):
    df = spark.createDataFrame([(2.228, 10.0, 4.96, 1.0, 10.0, 1.959964, 9.48773)], "t double, df double, f double, a double, b double, z double, c double")
    r = df.select(sp.t_two_sided("t", "df"), sp.f_tail("f", "a", "b"), sp.normal_two_sided("z"), sp.chi2_even_tail(F.col("c"), F.lit(2)), sp.normal_quantile(F.lit(0.975))).first()
    assert np.allclose(list(r), [0.05, 0.05, 0.05, 0.05, 1.959964], atol=2e-4)


def test_binary_segmentation_finds_the_steps(spark):
    rnd = np.random.default_rng(0)
    y = np.concatenate([np.zeros(40), np.full(40, 5.0), np.full(40, -3.0)]) + rnd.normal(0, 0.1, 120)
    df = spark.createDataFrame([(float(i), float(v), i) for i, v in enumerate(y)], "x double, y double, i long")
    got = sorted(r["threshold"] for r in st.binary_segmentation(df, "x", "y", "i", breaks=2).collect())
    assert got == [40.0, 80.0]


def test_conditional_independence_and_pair_scan_agree_with_numpy(spark):
    rnd = np.random.default_rng(1)
    z = rnd.normal(size=300)
    x, y = z + rnd.normal(size=300), z + rnd.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y, "z": z}))
    r = st.partial_correlation(df, ["k"], "x", "y", "z").first()
    inv = np.linalg.inv(np.corrcoef([x, y, z]))
    assert abs(r["partial_r"] + inv[0, 1] / np.sqrt(inv[0, 0] * inv[1, 1])) < 1e-9
    s = st.spearman(df, ["k"], "x", "y").first()
    rx, ry = pd.Series(x).rank(), pd.Series(y).rank()
    assert abs(s["spearman"] - rx.corr(ry)) < 1e-9
    out = st.conditional_independence(st.quantile_bins(df, ["k"], "z", 4, "b"), ["k"], "x", "y", "b").first()
    assert out["direct_p"] < 0.001 and out["bins_used"] == 4


def test_small_groups_are_reported_but_left_out_of_the_f_test(spark):
    rows = [(1, g, float(v)) for g, n in (("a", 5), ("b", 6), ("c", 4)) for v in range(n)]
    r = st.anova(spark.createDataFrame(rows, "k long, g string, v double"), ["k"], "g", "v").first()
    assert (r["groups_seen"], r["groups"], r["n"]) == (3, 2, 11)


def test_dominance_by_brute_force_and_over_chunks(spark):
    from tidemark.operators.dominance import dominated, kendall, distance_correlation

    rnd = np.random.default_rng(2)
    x, y = rnd.integers(0, 30, 500).astype(float), rnd.integers(0, 40, 500).astype(float)
    got = dominated(x, y, np.ones((500, 1)))[:, 0]
    assert got.tolist() == [int(((x < a) & (y < b)).sum()) for a, b in zip(x, y)]
    # one x value holds a third of the rows
    x[:170] = 7.0
    y = y + x * 0.3
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y}))
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum())
    assert abs(kendall(df, ["k"], "x", "y", bins=6).first()["tau"] - want) < 1e-12
    a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    a = a - a.mean(0) - a.mean(1)[:, None] + a.mean()
    b = b - b.mean(0) - b.mean(1)[:, None] + b.mean()
    want = np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))
    assert abs(distance_correlation(df, ["k"], "x", "y", bins=6).first()["distance_correlation"] - want) < 1e-9
