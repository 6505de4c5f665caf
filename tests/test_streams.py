"""Streams equal their batch twins; late rows are dropped; files are read once."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.streaming import live as lv

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("i", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("v", T.DoubleType()), T.StructField("c", T.LongType())])
START = dt.datetime(2024, 1, 1)


def _write(spark, folder, rows):
    data = [(k, i, START + dt.timedelta(seconds=s), float(i), c) for k, i, s, c in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_epochs_drop_late_rows_and_resume(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    epochs = lambda: lv.online_epochs(lv.incoming_files(spark, folder, SCHEMA), ["k"], "ts", "v", length="30 seconds", late="10 seconds")
    _write(spark, folder, [(1, 0, 5, 0), (1, 1, 20, 0), (1, 2, 100, 0)])
    assert [r["n"] for r in lv.run_available(epochs(), out).collect()] == [2]
    _write(spark, folder, [(1, 3, 6, 0), (1, 4, 200, 0)])
    got = lv.run_available(epochs(), out).orderBy("at").collect()
    # the row at 6 s came after its window had closed
    assert [r["n"] for r in got] == [2, 1]


def test_counter_filter_carries_state_over_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    filtered = lambda: lv.online_counter_filter(lv.incoming_files(spark, folder, SCHEMA), ["k"], "i", "c")
    _write(spark, folder, [(1, 0, 0, 254), (1, 1, 1, 255), (1, 2, 2, 9)])
    lv.run_available(filtered(), out)
    _write(spark, folder, [(1, 3, 3, 0), (1, 4, 4, 0), (1, 5, 5, 1)])
    assert sorted(r["i"] for r in lv.run_available(filtered(), out).collect()) == [0, 1, 3, 5]


def test_repeats_are_suppressed(spark, tmp_path):
    folder = str(tmp_path / "in")
    _write(spark, folder, [(1, 0, 0, 0), (1, 0, 0, 0), (1, 1, 1, 0)])
    out = lv.run_available(lv.without_repeats(lv.incoming_files(spark, folder, SCHEMA), ["k", "i"], "ts"), str(tmp_path / "out"))
    assert out.count() == 2
