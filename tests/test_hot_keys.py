"""A key that holds nearly all rows is not gathered by the joins with its one row."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import stats as st
from tidemark.operators.quantiles import join_per_key


@pytest.fixture
def plain(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for c, v in before.items():
        spark.conf.set(c, v)


def _largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_bins_of_a_hot_key_are_spread(plain):
    rows = plain.range(2000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    binned = st.quantile_bins(rows, ["k"], "v", 4)
    assert _largest(binned) < 1200
    assert {r["bin"]: r["count"] for r in binned.groupBy("bin").count().collect()} == {0: 500, 1: 500, 2: 500, 3: 500}


def test_rows_meet_their_key_once(plain):
    rows = plain.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), ("c", 4)], "k string, v int")
    per_key = plain.createDataFrame([("a", 10), ("b", 20), (None, 30)], "k string, w int")
    got = lambda how: sorted(map(str, map(tuple, join_per_key(rows, per_key, ["k"], how).select("k", "v", "w").collect())))
    assert got("inner") == sorted(map(str, [("a", 1, 10), ("a", 1, 10), ("b", 2, 20)]))
    assert got("left") == sorted(map(str, [("a", 1, 10), ("a", 1, 10), ("b", 2, 20), (None, 3, None), ("c", 4, None)]))
