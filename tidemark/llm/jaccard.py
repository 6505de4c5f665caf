"""N-gram Jaccard join by chosen paths: split on sampled shared tokens, brute-force the buckets, repeat in runs.

A text is the set of its five-word shingles. Each set is embedded in a fixed number of tokens, (i, i-th min-hash), of
which two sets share a part equal to their Jaccard similarity on average. A run walks down from one bucket of all
sets: each level samples a token position and puts together the sets that share the token there. At depth five sets
of little similarity have parted, while a pair at the threshold is still together with probability 0.8 ^ 5; buckets
that are large there and whose sets agree on the next token no more than half the time are split further. Runs repeat
until a pair at the threshold is missed with a probability below one minus the target recall. Sets that were split
further in any run take part in more runs: a pair that agrees at depth five in some run is found there, or both its sets
are split, and then it has the runs that the deepest level needs.

Sets in a bucket are compared by brute force. A pair counts in the first run that has it together, so counts need no
list of pairs: a task returns how many links each set gained, and just enough of them to hold its clusters together.
Copies, texts with equal sets, are joined once, as a class with a weight. Large buckets are dealt out as tiles.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_scan, remembered, stored, text_of, with_rows

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Levels of every path and of the longest; members from which a bucket may be split further, and from which it is dealt as tiles.
DEPTH, DEEPEST, LARGE, TILE = 5, 8, 512, 2048
#: Shingles from which a bucket is dealt as tiles, however few sets they are (32 MB of hashes), and those compared at a time.
VOLUME, SLICE = 4_000_000, 500_000
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILARITY ** DEPTH))
#: Runs of sets that are split further, so that pairs never together at DEPTH and pairs parted below it stay under 1 - RECALL in all.
MOST_RUNS = math.ceil(math.log(1 - RECALL - (1 - SIMILARITY ** DEPTH) ** RUNS) / math.log(1 - SIMILARITY ** DEEPEST))
_WORD = re.compile(r"\w+")
_MASK = 0xFFFFFFFFFFFFFFFF


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_ODD = _mix(np.arange(1, MOST_RUNS * DEEPEST + 1, dtype=np.uint64)) | np.uint64(1)
_PLUS = _mix(np.arange(10_001, MOST_RUNS * DEEPEST + 10_001, dtype=np.uint64))
_STEPS = _mix(np.arange(501, 501 + WORDS, dtype=np.uint64)) | np.uint64(1)


class Shingles:
    """Shingle sets of texts as sorted 64-bit hashes; remembers the hashes of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if len(self.known) > 100_000:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        """Words are runs of letters and digits in lower case. A text of fewer than five is one shingle, one without any has none."""
        words = _WORD.findall(text.lower())
        known, n = self.known, len(words)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.fromiter([known.get(w) or self._hash(w) for w in words], np.uint64, n)
        if n < WORDS:
            return _mix((h * _STEPS[:n]).sum(keepdims=True) + np.uint64(n))
        total = h[:n - WORDS + 1] * _STEPS[0]
        for i in range(1, WORDS):
            total += h[i:n - WORDS + 1 + i] * _STEPS[i]
        return np.unique(_mix(total))


def tokens_of(shingles: np.ndarray, first: int = 0, end: int = RUNS) -> np.ndarray:
    """The embedded set: 16 bits of the min-hash at each position of the runs from ``first`` to before ``end``."""
    odd, plus = _ODD[first * DEEPEST: end * DEEPEST], _PLUS[first * DEEPEST: end * DEEPEST]
    least = np.full(len(odd), _MASK, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at: at + 4096, None] * odd + plus
        np.minimum(least, part.min(0), out=least)
    return (_mix(least) & np.uint64(0xFFFF)).astype("<u2")


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingles = remembered("shingles", Shingles)
    for pdf in batches:
        sets = [shingles.of(t) for t in pdf["text"]]
        digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"], "_file": pdf["_file"], "_at": pdf["_at"], "shingles": [len(s) for s in sets],
            "k1": [signed(d >> 64) for d in digests], "k2": [signed(d & _MASK) for d in digests],
            "tokens": [tokens_of(s).tobytes() if len(s) else None for s in sets],
        })


def _more_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingles = remembered("shingles", Shingles)
    for pdf in batches:
        yield pd.DataFrame({"rid": pdf["rid"], "later": [tokens_of(shingles.of(t), RUNS, MOST_RUNS).tobytes() for t in pdf["text"]]})


def _path(depth) -> F.Column:
    """Name of the bucket that a set is in at ``depth`` of its run."""
    return F.xxhash64("run", depth, F.expr(f"substring(tokens, run * {2 * DEEPEST} + 1, depth * 2)"))


def candidates(tokens: np.ndarray, depths: np.ndarray, run: int, crossing: np.ndarray | None) -> np.ndarray:
    """Upper-triangle mask of a bucket's pairs: first together in ``run``, and alike enough to need an exact look.

    ``tokens`` is (members, runs, DEEPEST). Tokens agree as often as sets are similar, within a spread of
    sqrt(s (1 - s) / positions); pairs that stay 5 such spreads below the threshold are left out.
    """
    n, runs = tokens.shape[:2]
    agree = np.zeros((n, n), np.int32)
    for r in range(runs):
        for d in range(DEEPEST):
            column = tokens[:, r, d]
            agree += column[:, None] == column
    positions = runs * DEEPEST
    spread = math.sqrt(SIMILARITY * (1 - SIMILARITY) * positions)
    mask = np.triu(agree >= SIMILARITY * positions - 5 * spread, 1)
    if crossing is not None:
        mask &= crossing[:, None] != crossing
    for r in range(run):
        if not mask.any():
            break
        same = depths[:, r][:, None] == depths[:, r]
        for d in range(DEEPEST):
            column = tokens[:, r, d]
            same &= (column[:, None] == column) | (depths[:, r] <= d)[:, None]
        mask &= ~same
    return mask


def similar(sets: list[np.ndarray], mask: np.ndarray) -> np.ndarray:
    """The pairs of ``mask`` whose Jaccard similarity reaches the threshold, exactly."""
    size = np.array([len(s) for s in sets])
    i, j = np.nonzero(mask)
    if len(i) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    else:
        both = _common(sets, size)[i, j].astype(np.int64)
    # both / (a + b - both) >= 4 / 5 in integers
    top, low = round(SIMILARITY * 1000), 1000
    found = both * low >= top * (size[i] + size[j] - both)
    out = np.zeros_like(mask)
    out[i[found], j[found]] = True
    return out


def _common(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Shared shingles of all pairs, by ranges of hashes that hold about ``SLICE`` shingles each: memory follows the slice."""
    common = np.zeros((len(sets), len(sets)), np.float32)
    slices = int(size.sum()) // SLICE + 1
    width = max(1, 4_000_000 // len(sets))
    start = np.zeros(len(sets), np.int64)
    for k in range(1, slices + 1):
        end = size if k == slices else np.array([np.searchsorted(s, np.uint64(_MASK // slices * k)) for s in sets])
        parts = [s[a:b] for s, a, b in zip(sets, start, end)]
        owner, every = np.repeat(np.arange(len(sets)), end - start), np.concatenate(parts)
        start = end
        order = np.argsort(every, kind="stable")
        owner, every = owner[order], every[order]
        if not len(every):
            continue
        column = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]))
        # columns lie in order, so a block of them is a stretch
        edges = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width))
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            held = np.zeros((len(sets), int(column[b - 1]) + 1 - n * width), np.float32)
            held[owner[a:b], column[a:b] - n * width] = 1
            common += held @ held.T
    return common


def _spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep the clusters of ``links`` together, at most one less than members."""
    root = list(range(len(links)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(links)):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(a), int(b)))
    return out


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole buckets of rows that come sorted by bucket and tile."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        key = held[["bucket", "tile"]].to_numpy()
        new = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        at = 0
        for end in new:
            yield held.iloc[at:end]
            at = end
        held = held.iloc[at:]
    if held is not None and len(held):
        yield held


def _mask(group: pd.DataFrame) -> np.ndarray:
    n = len(group)
    tokens = np.frombuffer(b"".join(group["tokens"]), "<u2").reshape(n, -1, DEEPEST)
    depths = np.full((n, MOST_RUNS), DEPTH, np.uint8)
    for i, own in enumerate(group["depths"]):
        if own is not None and len(own):
            depths[i] = np.asarray(own, np.uint8)
    block = group["block"].to_numpy()
    return candidates(tokens, depths, int(group["run"].iloc[0]), block if len(set(block)) > 1 else None)


def _promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept, n = [], 0
    for group in _buckets(batches):
        mask = _mask(group)
        rows = group[mask.any(0) | mask.any(1)]
        if len(rows):
            kept.append(rows)
            n += len(rows)
        if n > 20_000:
            yield pd.concat(kept)
            kept, n = [], 0
    if kept:
        yield pd.concat(kept)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingles = remembered("shingles", Shingles)
    kind = {"rid": "int64", "other": "Int64", "links": "int64"}
    kept = []
    for group in _buckets(batches):
        links = similar([shingles.of(t) for t in group["text"]], _mask(group))
        if not links.any():
            continue
        rid, weight = group["rid"].to_numpy(), group["weight"].to_numpy()
        gained = links @ weight + links.T @ weight
        edges = _spanning(links)
        kept.append(pd.DataFrame({
            "rid": np.concatenate([rid, rid[[a for a, _ in edges]]]),
            "other": pd.array([None] * len(rid) + list(rid[[b for _, b in edges]]), dtype="Int64"),
            "links": np.concatenate([gained, np.zeros(len(edges), np.int64)]),
        }))
        if sum(map(len, kept)) > 20_000:
            yield pd.concat(kept).astype(kind)
            kept = []
    if kept:
        yield pd.concat(kept).astype(kind)


def components(edges: DataFrame) -> DataFrame:
    """(rid, label): the least id in the connected part of each end of ``edges`` (rid, other).

    Labels take the least label next to them and then that label's own, until none changes; each round is stored.
    """
    both = stored(edges.select("rid", "other").unionByName(edges.select(F.col("other").alias("rid"), F.col("rid").alias("other"))).distinct(), "edges")
    labels = stored(both.groupBy("rid").agg(F.least("rid", F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("rid", "other"), "other").select("rid", "label")
        least = labels.unionByName(near).groupBy("rid").agg(F.min("label").alias("next"))
        jump = labels.select(F.col("rid").alias("next"), F.col("label").alias("far"))
        moved = least.join(jump, "next", "left").select("rid", F.least("next", F.coalesce("far", "next")).alias("label"))
        moved = stored(moved, "labels")
        changed = moved.join(labels.withColumnRenamed("label", "before"), "rid").filter(F.col("label") != F.col("before")).limit(1).count()
        labels = moved
        if not changed:
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, class_id, copy_of, n_links, kept, _file, _at``.

    ``n_links`` counts the other rows whose similarity reaches 0.8, copies and repeated rows among them. ``class_id``
    is the smallest doc_id of all rows that links connect, ``copy_of`` that of the rows with the same shingles; one row
    of a class is ``kept``: the smallest doc_id (null last), then the first stored. A text without words, null or
    empty, has no links and is a class of its own; a null doc_id yields a null class_id only where the class has no
    other. An empty table gives no rows. Other columns are left out; whole texts count, however long.
    """
    named = with_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "_file", "_at", text_of().alias("text"))
    sketches = stored(named.mapInPandas(_sketches, "doc_id long, _file long, _at long, shingles int, k1 long, k2 long, tokens binary"), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_file", "_at")
    reps = sketches.filter("shingles > 0").groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("weight"), F.min(first).alias("best"), F.max("tokens").alias("tokens"), F.max("shingles").cast("long").alias("shingles"))
    reps = stored(reps.withColumn("rid", F.monotonically_increasing_id()), "classes")

    def longer(needy: DataFrame) -> DataFrame:
        """``needy`` with the tokens of all runs."""
        places = needy.join(reps.select("rid", "tokens", "shingles", F.col("best._file").alias("_file"), F.col("best._at").alias("_at")), "rid")
        later = named.select("_file", "_at", "text").join(places.select("rid", "_file", "_at"), ["_file", "_at"]).select("rid", "text")
        later = later.mapInPandas(_more_tokens, "rid long, later binary")
        return places.join(later, "rid").select("rid", "shingles", F.concat("tokens", "later").alias("tokens"))

    members, depths, long_tokens = _paths(reps, longer)
    first_runs = members.filter(F.col("run") < RUNS).join(reps.select("rid", "tokens"), "rid")
    rows = first_runs if long_tokens is None else first_runs.unionByName(members.filter(F.col("run") >= RUNS).join(long_tokens.select("rid", "tokens"), "rid"))
    rows = rows.join(depths, "rid", "left")
    spread = lambda df: df.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "rid")
    shape = "bucket long, tile int, block int, run int, rid long, tokens binary, depths array<int>"
    rows = rows.select(*[c.split()[0] for c in shape.split(", ")])
    promising = stored(spread(rows).mapInPandas(_promising, shape), "promising")

    wanted = promising.select("rid").distinct().join(reps.select("rid", "weight", F.col("best._file").alias("_file"), F.col("best._at").alias("_at")), "rid")
    texts = stored(named.select("_file", "_at", "text").join(wanted, ["_file", "_at"]).select("rid", "weight", "text"), "texts")
    linked = stored(spread(promising.join(texts, "rid")).mapInPandas(_linked, "rid long, other long, links long"), "links")

    labels = components(linked.filter(F.col("other").isNotNull()))
    gained = linked.groupBy("rid").agg(F.sum("links").alias("gained"))
    classes = reps.select("rid", "k1", "k2", "weight", "best").join(labels, "rid", "left").join(gained, "rid", "left")
    classes = stored(classes.withColumn("label", F.coalesce("label", "rid")).drop("rid"), "labelled")
    heads = classes.groupBy("label").agg(F.min("best").alias("head"))
    classes = classes.join(heads, "label").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("best.doc_id").alias("copy_of"), "head",
        (F.col("weight") - 1 + F.coalesce("gained", F.lit(0))).alias("links"))
    classes = stored(classes, "class-links")

    out = sketches.join(classes, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("shingles") > 0), "left")
    alone = F.col("head").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        (alone | ((F.col("_file") == F.col("head._file")) & (F.col("_at") == F.col("head._at")))).alias("kept"),
        "_file", "_at")


def _settled(walk: DataFrame, tokens: DataFrame) -> DataFrame:
    """Where the paths of ``walk`` (rid, tokens, shingles, run) end among others: (rid, run, depth, bucket, n, v, shingles), n sets of v shingles."""
    walk = walk.withColumn("depth", F.lit(DEPTH)).withColumn("bucket", _path("depth"))
    sizes = stored(walk.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("v")).filter("n > 1"), "buckets")
    members = stored(walk.join(sizes, "bucket").select("rid", "run", "depth", "bucket", "n", "v", "shingles"), "members")
    settled, deeper = members.filter(F.col("n") <= LARGE), members.filter(F.col("n") > LARGE)
    for depth in range(DEPTH, DEEPEST):
        if deeper.limit(1).count() == 0:
            break
        # agreement on the next token, averaged over the pairs of a bucket
        down = deeper.join(tokens, "rid").withColumn("depth", F.lit(depth + 1)).withColumn("below", _path("depth"))
        counts = stored(down.groupBy("bucket", "n", "below").agg(F.count(F.lit(1)).alias("m"), F.sum("shingles").alias("w")), "below")
        split = stored(counts.groupBy("bucket", "n").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("alike"))
                       .filter(F.col("alike") < 0.5 * F.col("n") * F.col("n")).select("bucket"), "split")
        settled = settled.unionByName(deeper.join(split, "bucket", "left_anti").select(settled.columns))
        down = down.join(split, "bucket", "left_semi").drop("bucket", "n", "v").withColumnRenamed("below", "bucket")
        down = stored(down.join(counts.filter("m > 0").select(F.col("below").alias("bucket"), F.col("m").alias("n"), F.col("w").alias("v")), "bucket")
                      .select("rid", "run", "depth", "bucket", "n", "v", "shingles"), "deeper")
        settled, deeper = settled.unionByName(down.filter(F.col("n") <= LARGE)), down.filter(F.col("n") > LARGE)
    return settled.unionByName(deeper.select(settled.columns))


def _paths(reps: DataFrame, longer) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Members of all buckets of two or more, (bucket, tile, block, run, rid), the depths of sets that went deeper, and the
    tokens of those in more runs than ``RUNS``, which ``longer`` adds to (rid); None if there are none."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run")
    tokens = reps.select("rid", "tokens")
    settled = _settled(reps.select("rid", "tokens", "shingles", runs), tokens)

    needy = stored(settled.filter(F.col("depth") > DEPTH).select("rid").distinct(), "needy")
    long_tokens = None
    if needy.limit(1).count():
        long_tokens = stored(longer(needy), "long-tokens")
        runs = F.explode(F.sequence(F.lit(RUNS), F.lit(MOST_RUNS - 1))).alias("run")
        settled = settled.unionByName(_settled(long_tokens.select("rid", "tokens", "shingles", runs), long_tokens.select("rid", "tokens")))

    own = settled.filter(F.col("depth") > DEPTH).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("run", "depth"))).alias("own"))
    depths = own.select("rid", F.transform(F.sequence(F.lit(0), F.lit(MOST_RUNS - 1)), lambda r: F.coalesce(F.element_at("own", r), F.lit(DEPTH))).alias("depths"))

    blocks = F.greatest(
        F.when(F.col("n") > TILE, F.ceil(F.col("n") * 2 / TILE)).otherwise(1),
        F.when(F.col("v") > VOLUME, F.ceil(F.col("v") * 2 / VOLUME)).otherwise(1)).cast("int")
    block = F.pmod(F.xxhash64("rid", F.lit("block")), F.col("blocks").cast("long")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("block")) * F.col("blocks") + F.greatest(j, F.col("block")))
    dealt = settled.filter("n > 1").withColumn("blocks", blocks).withColumn("block", block)
    return dealt.select("bucket", F.explode(tiles).alias("tile"), "block", "run", "rid"), depths, long_tokens


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with their columns."""
    docs = as_scan(docs)
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("_file").alias("gone_file"), F.col("_at").alias("gone_at"))
    return with_rows(docs).join(gone, (F.col("_file") == F.col("gone_file")) & (F.col("_at") == F.col("gone_at")), "left_anti").select(*docs.columns)
