"""What to rebuild: stale partitions and changed content."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stale_partitions(wanted: DataFrame, built: DataFrame, upstream: DataFrame, key: str, *, built_at: str, code_cutoff: datetime | None = None,
                     forced: Column | None = None, needed: Sequence[str] = (), columns: str | None = None) -> DataFrame:
    """Partitions to rebuild with the reason: forced, missing, older than the code, older than any upstream, or lacking a column."""
    newest = upstream.groupBy(key).agg(F.max(built_at).alias("_up"))
    joined = wanted.join(built.withColumn("_have", F.lit(True)), key, "left").join(newest, key, "left")
    at = F.col(built_at)
    reason = F.when(forced, "forced") if forced is not None else F.when(F.lit(False), "")
    reason = reason.when(F.col("_have").isNull(), "missing")
    if code_cutoff is not None:
        reason = reason.when(at < F.lit(code_cutoff), "older than code")
    reason = reason.when(at < F.col("_up"), "older than upstream")
    if needed and columns:
        reason = reason.when(F.size(F.array_except(F.array(*map(F.lit, needed)), F.col(columns))) > 0, "lacks a column")
    return joined.select(key, reason.alias("reason")).filter(F.col("reason").isNotNull())


def content_digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One digest per group that does not depend on row order.

    Row hashes are summed, not collected, so a group of any size combines on the
    map side.
    """
    # each field says how long it is, and null differs from any text
    field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    text = F.concat(*[field(F.col(c).cast("string")) for c in columns])
    half = lambda at: F.conv(F.substring(F.md5(text), at, 16), 16, 10).cast("decimal(38,0)")
    rows = df.select(*keys, half(1).alias("_h"), half(17).alias("_l"))
    return rows.groupBy(*keys).agg(F.md5(F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.sum("_h").cast("string"), F.sum("_l").cast("string"))).alias("digest"))


def changed(now: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose digest is new or different."""
    return now.join(before.select(*keys, "digest"), [*keys, "digest"], "left_anti")
