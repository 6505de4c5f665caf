"""Cut points of value chunks follow the rows, not the order in which they arrive."""

from pyspark.sql import functions as F

from tidemark.operators.quantiles import value_edges, with_value_chunk


def _rows(spark, n=30_000):
    v = F.sin(F.col("id") * 0.37) * F.sqrt(F.col("id"))
    return spark.range(n, numPartitions=1).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 50 > 0, v).alias("v"))


def _edges(df):
    return {r["g"]: r["_edges"] for r in value_edges(df, ["g"], "v").collect()}


def test_cut_points_do_not_follow_the_order_of_arrival(spark):
    rows = _rows(spark)
    mixed = rows.repartition(7, "v").sortWithinPartitions(F.desc("id"))
    assert _edges(rows) == _edges(mixed)


def test_chunks_are_about_equal_and_in_the_order_of_the_values(spark):
    found = with_value_chunk(_rows(spark), ["g"], "v").filter("v IS NOT NULL").groupBy("g", "_bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("g", "_bin").collect()
    for g in (0, 1):
        chunks = [r for r in found if r["g"] == g]
        n = sum(r["n"] for r in chunks)
        assert len(chunks) == 64 and max(r["n"] for r in chunks) < 2.5 * n / 64
        assert all(a["hi"] < b["lo"] for a, b in zip(chunks, chunks[1:]))
