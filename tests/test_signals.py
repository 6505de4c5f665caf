"""Hand-worked cases of sampling, staging, joins, features and detection."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import detect as de
from tidemark.operators import features as fe
from tidemark.operators import hypnogram as hy
from tidemark.operators import joins as jn
from tidemark.operators import resample as rs
from tidemark.operators.timeline import Timeline


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def _kept(counters, modulus=256):
    keep, last = [], None
    for c in counters:
        ok = last is None or c == (last + 1) % modulus
        keep.append(ok)
        last = c if ok else last
    return keep


def test_counter_filter_by_hand_and_against_the_loop(spark):
    counters = [253, 254, 255, 0, 0, 2, 1, 2]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(counters)], "k long, i long, c int")
    got = [i for _, i in _rows(rs.drop_out_of_order(df, ["k"], "i", "c", chunk=2), "k", "i")]
    assert got == [0, 1, 2, 3, 6, 7]
    rnd = random.Random(0)
    for modulus in (2, 4, 7):
        seq = [rnd.randrange(modulus) for _ in range(200)]
        df = spark.createDataFrame([(k, i, c) for k in (1, 2) for i, c in enumerate(seq)], "k long, i long, c int")
        got = _rows(rs.drop_out_of_order(df, ["k"], "i", "c", modulus=modulus, chunk=9), "k", "i")
        assert got == sorted((k, i) for k in (1, 2) for i, ok in enumerate(_kept(seq, modulus)) if ok)


def test_gap_of_exactly_the_limit_is_no_gap_and_fill_rounds_up(spark):
    line = Timeline.every(["k"], ["t"], 300)
    df = spark.createDataFrame([(1, t, 1.0) for t in (0, 500, 1001, 1005)], "k long, t long, v double")
    assert _rows(rs.find_gaps(df, line, 500), "gap_start", "gap_end", "gap") == [(500, 1001, 501)]
    filled = rs.fill_gaps(df, line, ["v"], 100, 500).filter("inserted = 1")
    assert _rows(filled, "t") == [(600,), (700,), (800,), (900,), (1000,), (1100,)]


def test_interpolation_limit(spark):
    values = [None, 1.0, None, None, None, 5.0, None, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k long, i long, v double")
    line = Timeline.every(["k"], ["i"], 2)
    forward = [v for _, v in _rows(rs.interpolate(df, line, "v", limit=1).na.fill(-1.0), "i", "v")]
    assert forward == [-1.0, 1.0, 2.0, -1.0, -1.0, 5.0, 5.0, -1.0]
    both = [v for _, v in _rows(rs.interpolate(df, line, "v", limit=1, both=True).na.fill(-1.0), "i", "v")]
    assert both == [1.0, 1.0, 2.0, -1.0, 4.0, 5.0, 5.0, -1.0]


def test_smoothing_weights():
    assert np.allclose(rs.savgol_weights(5, 2), np.array([-3, 12, 17, 12, -3]) / 35)
    assert abs(sum(rs.gaussian_weights(1.0)) - 1) < 1e-12 and len(rs.gaussian_weights(1.0)) == 9


def _long_runs(flags, use, max_gap, min_len):
    out, run, gap, runs = set(), [], 0, []
    for i, (f, u) in enumerate(zip(flags, use)):
        if f:
            if u:
                if 0 < gap <= max_gap:
                    run += range(i - gap, i)
                run.append(i)
                gap = 0
        elif run:
            gap += 1
            if gap > max_gap:
                runs.append(run)
                run, gap = [], 0
    for r in [*runs, run]:
        if len(r) >= min_len:
            out |= set(r)
    return out


def test_long_runs_bridge_small_gaps(spark):
    for n, gap, expected in ((60, 7, True), (59, 7, False), (60, 8, False)):
        flags = [True] * 30 + [False] * gap + [True] * (n - 30 - (gap if gap <= 7 else 0)) + [False]
        df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k long, i long, f boolean")
        got = hy.long_runs(df, ["k"], "i", F.col("f")).filter("in_long_run").count()
        assert (got >= 60) == expected
    rnd = random.Random(1)
    flags = [rnd.random() < 0.5 for _ in range(400)]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k long, i long, f boolean")
    got = {i for (i,) in _rows(hy.long_runs(df, ["k"], "i", F.col("f"), max_gap=2, min_length=8).filter("in_long_run"), "i")}
    assert got == _long_runs(flags, [True] * 400, 2, 8)


def test_best_channel_ties_nan_and_zero(spark):
    df = spark.createDataFrame([(1, "A", "W", 0.5), (1, "B", "N1", 0.5), (2, "A", "W", float("nan")), (2, "B", "R", 0.1), (3, "A", "W", 0.0)], "e long, c string, s string, p double")
    got = {r["e"]: r["source"] for r in hy.best_channel(df, ["e"], "c", "s", "p", F.col("c")).collect()}
    assert got == {1: "A", 2: "B", 3: None}


def test_boundary_event_hits_two_epochs_but_a_long_one_only_overlapped(spark):
    epochs = spark.createDataFrame([(1, 0), (1, 30), (1, 60)], "k long, t long")
    events = spark.createDataFrame([(1, 1, "a", False, 30, 30), (1, 2, "b", True, 60, 70)], "k long, id long, e string, lng boolean, since long, at long")
    got = {r["t"]: r["id"] for r in jn.match_events(epochs, events, ["k"], epoch_at="t", length=30, since="since", at="at", is_long=F.col("lng"), order="id", keep=["id"]).collect()}
    assert got == {0: 1, 30: 1, 60: 2}


def test_overlap_needs_more_than_one_whole_second_and_last_wins(spark):
    epochs = spark.createDataFrame([(1, t * 1_000_000) for t in (0, 30, 60)], "k long, t long")
    cuts = spark.createDataFrame([(1, 1, 28_100_000, 30_000_000), (1, 2, 28_000_000, 32_000_000), (1, 3, 29_000_000, 33_900_000)], "k long, n long, s long, e long")
    got = {r["t"]: (r["n"], r["nearby"]) for r in jn.overlap_flags(epochs, cuts, ["k"], epoch_at="t", length=30_000_000, start="s", end="e", number="n").collect()}
    assert got == {0: (2, True), 30_000_000: (3, True), 60_000_000: (None, True)}


def test_null_out_and_masked_epochs(spark):
    df = spark.createDataFrame([(1, 50.0, 2.0, 3.0), (2, 50.1, 2.0, 3.0)], "e long, removed double, a double, a_norm double")
    assert _rows(fe.null_out_unreliable(df, "removed", ["a", "a_norm"]).na.fill(-1.0), "e", "a", "a_norm") == [(1, 2.0, 3.0), (2, -1.0, 3.0)]
    s = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (2, 0, 1.0), (2, 1, 2.0)], "e long, i long, v double")
    got = {r["e"]: r["std"] for r in fe.shape_features(s, ["e"], "i", "v").collect()}
    assert got[1] is None and abs(got[2] - 0.5**0.5) < 1e-12


def test_spectrum_and_higuchi(spark):
    t = np.arange(256) / 64
    tone = np.sin(2 * np.pi * 10 * t)
    df = spark.createDataFrame([(1, tone.tolist()), (2, (t * 3).tolist())], "e long, samples array<double>")
    out = fe.band_features(df.withColumn("psd", fe.periodogram("samples")), "psd", "samples", 64.0).withColumn("h", fe.higuchi("samples")).toPandas().set_index("e")
    assert out.loc[1, "rel_alpha"] > 0.99 and abs(out.loc[1, "centroid"] - 10) < 0.01
    assert abs(out.loc[2, "h"] - 1.0) < 1e-6


def test_artifacts_keep_short_sections_only_when_loud(spark):
    values = [0.0] * 10 + [200.0] * 5 + [0.0] * 3 + [5000.0] + [0.0] * 2 + [200.0] * 5 + [0.0] * 30 + [200.0] * 5
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k long, i long, v double")
    out = de.artifact_sections(df, Timeline.every(["k"], ["i"], 4), "v", above=150, min_run=5, merge_gap=10, min_length=100, keep_above=1000, chunk=4)
    assert _rows(out, "start", "end", "peak") == [(10, 26, 5000.0)]


def test_peaks_by_distance_and_prominence():
    y = np.array([0, 3, 0, 1, 0, 2, 2, 0, 5, 0], dtype=float)
    assert de.peak_positions(y, 1, 0.5).tolist() == [1, 3, 5, 8]
    assert de.peak_positions(y, 4, 0.5).tolist() == [1, 8]
    assert de.peak_positions(y, 1, 2.5).tolist() == [1, 8]


def test_prediction_passes(spark):
    line = Timeline.every(["k"], ["i"], 5)
    on = [0, 0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(on)], "k long, i long, v double")
    got = de.settled_predictions(df, line, "v", threshold=0.5, min_first=2, fill=2, min_last=4, chunk=5)
    assert _rows(got, "start", "end") == [(0, 7)]
