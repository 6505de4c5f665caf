"""Target-distribution importance resampling over hashed word runs, with equal lines counted once.

Line feeds part no words, so a text is cut into its lines. Each distinct line of the corpus gets its features once, its
words' runs as bucket numbers, and counts them as often as it occurs; runs that reach over a line end are added per
document. Bucket counts of corpus and target give each bucket a gain; a line's gain is summed once as well and reaches
the documents that hold it. A document's weight is its mean gain; Gumbel noise from its id turns the highest scores into
a sample without replacement.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemark.llm.common import stored, text_of, with_rows

#: Words, once A-Z are lower case: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST_RUN, FEWEST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that make up one in so many of all lines or more reach documents by broadcast: no more lines than this can.
HOT_LINES = 1024


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _buckets(words: str, longest: int, buckets: int) -> Column:
    """Bucket numbers of all runs of 1 to ``longest`` words."""
    bucket = lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int")

    def runs(k: int) -> Column:
        places = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: bucket(F.array_join(F.slice(words, i, k), " ")))

    return F.concat(F.transform(words, bucket), *[runs(k) for k in range(2, longest + 1)])


def over_line_ends(longest: int, buckets: int):
    """Bucket numbers of a text's runs that reach over a line end: those that begin in an earlier line than they end in."""
    word, lower = re.compile(WORD), str.maketrans(_UPPER, _LOWER)

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def cross(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            before: list[str] = []
            found = []
            for line in text.split("\n"):
                words = word.findall(line.translate(lower))
                head = words[: longest - 1]
                both, edge = before + head, len(before)
                for end in range(edge, len(both)):
                    for start in range(max(0, end + 1 - longest), edge):
                        found.append(zlib.crc32(" ".join(both[start: end + 1]).encode()) % buckets)
                before = (before + words)[-(longest - 1):]
            out.append(found)
        return pd.Series(out)

    return cross


def _hashes(line: Column) -> list[Column]:
    """Two hashes of 64 bits that name a line on its way back to the documents."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.length(line), F.lit("line"), line).alias("check")]


def distinct_lines(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``h, check, times, words, features`` of each distinct line of ``texts`` (text), stored."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    lines = lines.withColumn("in_line", _words(F.col("line")))
    return stored(lines.select(*_hashes(F.col("line")), "times", F.size("in_line").alias("words"), _buckets("in_line", longest, buckets).alias("features")), "lines")


def bucket_counts(texts: DataFrame, lines: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``bucket, held``: a line's features times its occurrences, and the runs over line ends."""
    rows = lines.select("times", F.explode("features").alias("bucket"))
    if longest > 1:
        rows = rows.unionByName(texts.select(F.lit(1).cast("long").alias("times"), F.explode(over_line_ends(longest, buckets)("text")).alias("bucket")))
    return rows.groupBy("bucket").agg(F.sum("times").alias("held"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row with ``gains``, a long for each bucket: how much likelier the target makes it, in thousandths of a nat."""
    spark = corpus.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    # at most ``buckets`` rows from here on
    both = every.join(F.broadcast(corpus.withColumnRenamed("held", "s")), "bucket", "left").join(F.broadcast(target.withColumnRenamed("held", "t")), "bucket", "left").na.fill(0)
    table = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("held"), F.sum("s").alias("S"), F.sum("t").alias("T"))
    num = lambda c: c.cast("double")
    gain = lambda b: F.floor(1000 * F.log(
        (num(b["t"]) + 1) * (num(F.col("S")) + buckets) / ((num(b["s"]) + 1) * (num(F.col("T")) + buckets)))).cast("long")
    return table.select(F.transform("held", gain).alias("gains"))


def _sum_of(features: str) -> Column:
    return F.aggregate(features, F.lit(0).cast("long"), lambda total, bucket: total + F.element_at("gains", bucket + 1))


def _floored(total: Column, n: Column) -> Column:
    """total / n rounded down, in whole numbers."""
    return F.when(n > 0, F.expr("(total - pmod(total, n)) div n")).otherwise(0)


def weighted_documents(docs: DataFrame, target: DataFrame, *, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """Per row ``doc_id, n_features, n_words, weight, _file, _at``; see ``importance_sample``."""
    base = with_rows(docs).select("doc_id", "_file", "_at", text_of().alias("text"))
    wanted = target.select(text_of().alias("text"))
    lines = distinct_lines(base.select("text"), longest, buckets)
    gains = bucket_gains(
        bucket_counts(base.select("text"), lines, longest, buckets),
        bucket_counts(wanted, distinct_lines(wanted, longest, buckets), longest, buckets), buckets)
    gains = F.broadcast(stored(gains.withColumn("one", F.lit(1)), "gains"))  # one row of ``buckets`` numbers

    scored = lines.withColumn("one", F.lit(1)).join(gains, "one").select(
        F.col("h").alias("lh"), F.col("check").alias("lc"), "times", "words", F.size("features").cast("long").alias("n"), _sum_of("features").alias("total"))
    scored = stored(scored, "line-gains")
    all_lines = scored.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"]
    hot = F.col("times") * HOT_LINES >= all_lines

    places = base.select("doc_id", "_file", "_at", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", "_file", "_at", *_hashes(F.col("line")))
    same = (F.col("h") == F.col("lh")) & (F.col("check") == F.col("lc"))
    kept = ["doc_id", "_file", "_at", "words", "n", "total"]
    # at most HOT_LINES rows, however large the corpus; the others repeat too little to fill a task
    often = places.join(F.broadcast(scored.filter(hot)), same, "left")
    near = often.filter(F.col("lh").isNotNull()).select(*kept)
    far = often.filter(F.col("lh").isNull()).select("doc_id", "_file", "_at", "h", "check").join(scored.filter(~hot), same).select(*kept)
    parts = near.unionByName(far)
    if longest > 1:
        across = base.select("doc_id", "_file", "_at", over_line_ends(longest, buckets)("text").alias("features"), F.lit(1).alias("one")).join(gains, "one")
        parts = parts.unionByName(across.select("doc_id", "_file", "_at", F.lit(0).alias("words"), F.size("features").cast("long").alias("n"), _sum_of("features").alias("total")))
    whole = parts.groupBy("doc_id", "_file", "_at").agg(F.sum("words").alias("n_words"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    return whole.select("doc_id", F.col("n").alias("n_features"), "n_words", _floored(F.col("total"), F.col("n")).cast("long").alias("weight"), "_file", "_at")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in ``order``: sorted over the cluster, numbered in each task, shifted by the tasks before."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_nth": within}), "sorted")
    # one row per task
    counts = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return sorted_.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def importance_sample(
    docs: DataFrame, target: DataFrame, *, longest: int = LONGEST_RUN, buckets: int = BUCKETS, fewest_words: int = FEWEST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """Every row's ``doc_id, n_features, weight, score, rank``, and ``drawn`` where it is in the sample.

    Drawn are floor(percent * N / 100) of the N rows with at least ``fewest_words`` words: the highest scores, ties to
    the smaller doc_id (null last), then to the first stored row; ``rank`` counts them from 1 and is null for all
    others. Null and empty texts have no features and weight 0; a null doc_id draws its noise as the empty string;
    repeated rows are scored each, and alike; a table without rows gives none, and a target without rows weighs buckets
    by the corpus alone. Other columns are left out. Texts count whole; a long one without line ends is one line.
    """
    rows = weighted_documents(docs, target, longest=longest, buckets=buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = stored(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(draw))).cast("long")), "scores")
    long_enough = F.col("n_words") >= fewest_words
    n_drawn = percent * rows.filter(long_enough).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_file"), F.col("_at")]
    chosen = ranked(rows.filter(long_enough), order, "place").withColumn("rank", F.when(F.col("place") <= n_drawn, F.col("place"))).drop("place")
    out = chosen.unionByName(rows.filter(~long_enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", F.col("rank").isNotNull().alias("drawn"))
