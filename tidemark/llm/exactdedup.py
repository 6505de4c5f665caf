"""Exact dedup of a batch against an immutable snapshot: static binary-fuse filters, exact buckets and byte checks.

The distinct digests of the snapshot are dealt into buckets by hash, and each bucket gets a three-wise binary fuse
filter of 8-bit fingerprints (about 9 bits a digest; 1 in 256 absent digests passes). A batch first groups its own
rows by digest, so a digest meets its filter once however many copies it has. Digests that no filter holds are new.
Those that pass are joined to the exact groups of the snapshot, which settles false positives. All texts of a group
are compared as bytes: grouping by the text itself has to give one text per digest and check value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, as_scan, stored, text_of, with_rows

#: Digests per filter.
BUCKET_KEYS = 50_000


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, odd in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    return h


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three slots of each key, in neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    base = first * np.uint64(segment)
    return np.stack([base + (h & mask), base + np.uint64(segment) + ((h >> np.uint64(16)) & mask),
                     base + np.uint64(2 * segment) + (_mixed(h, 7) & mask)]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFF)).astype(np.uint8)


class FuseFilter:
    """A static set of 64-bit keys: no false negatives, about 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, table: np.ndarray):
        self.seed, self.segment, self.table = seed, segment, table

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1_000_000) / np.log(max(n, 2)))
        for seed in range(1, 1000):
            if seed % 10 == 0:
                factor *= 1.1
            segments = max(1, -(-int(n * factor) // segment) - 2)
            h = _mixed(keys, seed)
            slots = _places(h, segment, segments)
            size = (segments + 2) * segment
            count = np.bincount(slots.ravel(), minlength=size)
            held = np.zeros(size, np.int64)
            for row in slots:
                np.bitwise_xor.at(held, row, np.arange(n))
            # keys that stand alone in a slot are taken off, round by round
            order = []
            lone = np.flatnonzero(count == 1)
            while len(lone):
                taken, at = np.unique(held[lone], return_index=True)
                order.append((taken, lone[at]))
                touched = slots[:, taken]
                np.subtract.at(count, touched.ravel(), 1)
                np.bitwise_xor.at(held, touched.ravel(), np.tile(taken, 3))
                near = np.unique(touched)
                lone = near[count[near] == 1]
            if sum(len(taken) for taken, _ in order) < n:
                continue
            table, prints = np.zeros(size, np.uint8), _prints(h)
            for taken, own in reversed(order):
                others = table[slots[0, taken]] ^ table[slots[1, taken]] ^ table[slots[2, taken]] ^ table[own]
                table[own] = prints[taken] ^ others
            return cls(seed, segment, table)
        raise ValueError("no filter found")

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys.astype(np.uint64), self.seed)
        a, b, c = _places(h, self.segment, len(self.table) // self.segment - 2)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == _prints(h)


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One filter per bucket of a table of distinct ``key`` longs."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "slots": [f.table.tobytes()]})

    return _bucketed(digests, buckets).groupBy("bucket").applyInPandas(build, "bucket long, seed long, segment long, slots binary")


def _bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets).cast("long")))


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Rows of (digest, check, key) with ``maybe``: false where the snapshot surely lacks the digest."""
    def probe(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(mine), bool)
        for _, f in theirs.iterrows():
            hit |= FuseFilter(int(f["seed"]), int(f["segment"]), np.frombuffer(f["slots"], np.uint8)).maybe(mine["key"].to_numpy().view(np.uint64))
        return mine[["digest", "check"]].assign(maybe=hit)

    return _bucketed(digests, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest string, check long, maybe boolean")


def plain_digest(normal: Column) -> Column:
    return F.sha2(normal, 256)


def dedup_against_snapshot(docs: DataFrame, incoming: Column, *, digest=plain_digest, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Every row's group: ``doc_id, keep_id, group_size, kept, digest, incoming, _file, _at``.

    ``incoming`` says which rows are the new batch; the others are the snapshot. Rows are equal when their texts are,
    white space left out. Of equal rows the one with the most code points in its original text stays, then the
    smallest doc_id (null last), then the first stored. Null counts as empty text, and empty texts are equal; rows
    that repeat are copies; an empty table, snapshot or batch gives no groups of its own. Other columns are left out.
    ``digest`` maps the normalised text; a weak one only makes larger buckets, since groups also carry a second hash
    and byte checks stop the run if two texts share both.
    """
    normal = F.regexp_replace(text_of(), SPACES, "")
    base = with_rows(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), "_file", "_at", F.length(text_of()).alias("n"), normal.alias("normal"),
        F.coalesce(incoming, F.lit(False)).alias("incoming"))
    base = base.withColumns({"digest": digest(F.col("normal")), "check": F.xxhash64("normal", F.length("normal"))})
    keyed = stored(base.drop("normal"), "digests")

    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("late"), "doc_id", "_file", "_at")
    groups = keyed.groupBy("incoming", "digest", "check").agg(F.count(F.lit(1)).alias("size"), F.min(best).alias("best"))
    groups = stored(groups, "groups").withColumn("key", F.xxhash64("digest"))
    old, new = groups.filter(~F.col("incoming")), groups.filter(F.col("incoming"))

    buckets = max(1, -(-old.count() // bucket_keys))
    filters = build_filters(old.select("key").distinct(), buckets)
    screened = screen(new.select("digest", "check", "key"), filters, buckets)
    known = screened.filter("maybe").select("digest", "check").join(old.select("digest", "check"), ["digest", "check"])

    # groups by digest and check, new ones beside and known ones joined with the snapshot's
    merged = old.select("digest", "check", "size", "best").unionByName(
        new.join(known, ["digest", "check"], "left_semi").select("digest", "check", "size", "best"))
    merged = merged.groupBy("digest", "check").agg(F.sum("size").alias("size"), F.min("best").alias("best"))
    fresh = new.join(known, ["digest", "check"], "left_anti").select("digest", "check", "size", "best")

    # byte checks: copies collapse where they are read, and no group may hold a second text
    texts = base.groupBy("digest", "check", "normal").agg(F.count(F.lit(1)).alias("rows")).groupBy("digest", "check").agg(F.count(F.lit(1)).alias("texts"))
    settled = merged.unionByName(fresh).join(texts.filter("texts > 1"), ["digest", "check"], "left")
    settled = settled.withColumn("size", F.when(F.col("texts").isNull(), F.col("size")).otherwise(
        F.raise_error(F.concat(F.lit("two texts share digest and check: "), F.col("digest")))))
    settled = stored(settled.select(F.col("digest").alias("of"), F.col("check").alias("checked"), "size", "best"), "settled")

    rows = keyed.join(settled, (F.col("digest") == F.col("of")) & (F.col("check") == F.col("checked")))
    return rows.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        ((F.col("_file") == F.col("best._file")) & (F.col("_at") == F.col("best._at"))).alias("kept"),
        "digest", "incoming", "_file", "_at")


def in_batch() -> Column:
    """A stand-in for arrival: every row whose id hashes to an odd number is the new batch."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 1


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    docs = as_scan(docs)
    dropped = dedup_against_snapshot(docs, in_batch()).filter(~F.col("kept"))
    dropped = dropped.select(F.col("_file").alias("gone_file"), F.col("_at").alias("gone_at"))
    return with_rows(docs).join(dropped, (F.col("_file") == F.col("gone_file")) & (F.col("_at") == F.col("gone_at")), "left_anti").select(*docs.columns)
