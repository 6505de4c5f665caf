"""Exact top-k inner products by a dual-tree search over one cover tree of queries and data.

The tree's nodes are centres taken farthest-first from a bounded sample: those still more than R / 2^i from all earlier
ones make level i, so levels nest, and a node hangs below its nearest node of the level before. Every row belongs to
the nearest leaf; a leaf's covering radius is measured over all its rows, and once more over its queries alone. Each
group of queries first meets the leaves that promise most, which gives every query a k-th score. Then both trees are
walked together from their roots: a pair of nodes whose best possible product, from centres and radii, stays below the
worst k-th score of the query group is cut with all that hangs below it. What is left is compared exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Rows that the tree is built from, leaves, rows of a block and queries that meet a block at once.
SAMPLE, LEAVES, BLOCK, QUERIES = 4096, 192, 1024, 16_384


def quantised(vectors: DataFrame, *, scale: int = 64) -> DataFrame:
    """(vec_id, x) with x = floor(scale * component) of every vector that takes part.

    Null ids, null vectors and vectors with null or non-finite components don't. Of rows with one vec_id the smallest
    vector counts. Shorter vectors are compared as if padded with zeros.
    """
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))


@dataclass(frozen=True)
class CoverTree:
    """Centres in farthest-first order, and for each level how many of them it has; the last level's are the leaves."""

    centres: np.ndarray
    levels: tuple[int, ...]

    @classmethod
    def build(cls, sample: np.ndarray, leaves: int = LEAVES) -> CoverTree:
        away = np.linalg.norm(sample - sample[0], axis=1)
        order, reach = [0], []
        while len(order) < min(leaves, len(sample)) and away.max() > 0:
            far = int(away.argmax())
            reach.append(away[far])
            order.append(far)
            away = np.minimum(away, np.linalg.norm(sample - sample[far], axis=1))
        levels, at = [1], 0
        while at < len(reach):
            at = sum(r > reach[0] / 2 ** len(levels) for r in reach)
            if at + 1 > levels[-1]:
                levels.append(at + 1)
            if len(levels) > 60:
                levels.append(len(order))
                break
        return cls(sample[order], tuple(levels))

    def parents(self, level: int) -> np.ndarray:
        """The node of the level before that each node of ``level`` hangs below."""
        upper, own = self.centres[:self.levels[level - 1]], self.centres[:self.levels[level]]
        return _distances(own, upper).argmin(1)

    def radii(self, leaf_radii: np.ndarray) -> list[np.ndarray]:
        """Covering radius of every node by level; below zero where nothing hangs."""
        out = [leaf_radii]
        for level in range(len(self.levels) - 1, 0, -1):
            up, below = self.parents(level), out[0]
            gap = np.linalg.norm(self.centres[:len(up)] - self.centres[up], axis=1)
            r = np.full(self.levels[level - 1], -1.0)
            np.maximum.at(r, up, np.where(below >= 0, below + gap, -1.0))
            out.insert(0, r)
        return out

    def bounds(self, q: np.ndarray, rq: np.ndarray, p: np.ndarray, rp: np.ndarray) -> np.ndarray:
        """Best product that rows of node pairs can have, with slack for rounding."""
        a, b = self.centres[q], self.centres[p]
        best = (a * b).sum(1) + rq * np.linalg.norm(b, axis=1) + rp * np.linalg.norm(a, axis=1) + rq * rp
        return best + 1e-6 * (1 + np.abs(best))

    def surviving(self, query_radii: np.ndarray, data_radii: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf pairs (query leaf, data leaf, bound) left by the walk; ``worst`` is the least k-th score of each query leaf."""
        rq, rp = self.radii(query_radii), self.radii(data_radii)
        goal = [worst]
        for level in range(len(self.levels) - 1, 0, -1):
            least = np.full(self.levels[level - 1], np.inf)
            np.minimum.at(least, self.parents(level), goal[0])
            goal.insert(0, least)
        q, p = np.zeros(1, int), np.zeros(1, int)
        for level in range(len(self.levels)):
            if level:
                up = self.parents(level)
                below = [np.flatnonzero(up == i) for i in range(self.levels[level - 1])]
                q, p = (np.concatenate(x) if x else np.zeros(0, int) for x in zip(*[
                    (np.repeat(below[i], len(below[j])), np.tile(below[j], len(below[i]))) for i, j in zip(q, p)])) if len(q) else (q, p)
            bound = self.bounds(q, rq[level][q], p, rp[level][p])
            keep = (rq[level][q] >= 0) & (rp[level][p] >= 0) & (bound >= goal[level][q])
            q, p, bound = q[keep], p[keep], bound[keep]
        return q, p, bound


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows: in doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 2 ** 63:
        return a @ b.T
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64)  # raises where a score is no long


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k highest scores, ties to smaller ids; ids ascend."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    if float(np.abs(scores).max(initial=0)) * n < 2 ** 62:
        return np.argpartition(-(scores * n - np.arange(n)), k - 1, axis=1)[:, :k]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _padded(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def exact_top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, sample: int = SAMPLE, leaves: int = LEAVES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest products with the other rows, ties to smaller vec_id.

    ``vectors`` is (vec_id, x array<long>) as ``quantised`` gives it, with unique ids; ``is_query`` chooses the queries
    by vec_id. A query with fewer than k other rows gets all of them; without queries or rows the result is empty;
    equal vectors tie. The tree is built from at most ``sample`` rows and has at most ``leaves`` leaves; all rows are
    indexed and no pair is left out that could reach a result. A hot leaf only has more blocks.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = stored(vectors.select("vec_id", "x", F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    dim = rows.agg(F.max(F.size("x"))).head()[0]
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").collect()
    if not picked:
        return spark.createDataFrame([], result)
    tree = CoverTree.build(_padded([r["x"] for r in picked], dim).astype(float), leaves)
    shared = spark.sparkContext.broadcast(tree.centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _padded(pdf["x"].tolist(), dim)
            gaps = _distances(x.astype(float), shared.value)
            leaf = gaps.argmin(1)
            # measured again without cancellation, and rounded up
            away = np.linalg.norm(x - shared.value[leaf], axis=1) * (1 + 1e-9) + 1e-9
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "asks": pdf["asks"], "leaf": leaf, "away": away, "x": [v.astype("<i8").tobytes() for v in x]})

    placed = stored(rows.mapInPandas(place, "vec_id long, asks boolean, leaf int, away double, x binary"), "placed")
    found = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"), F.count(F.when(F.col("asks"), 1)).alias("q"),
                                       F.max(F.when(F.col("asks"), F.col("away"))).alias("rq")).collect()
    size = len(tree.centres)
    count, queries, rp, rq = np.zeros(size, int), np.zeros(size, int), np.full(size, -1.0), np.full(size, -1.0)
    for f in found:
        count[f["leaf"]], queries[f["leaf"]], rp[f["leaf"]] = f["n"], f["q"], f["r"]
        rq[f["leaf"]] = f["rq"] if f["q"] else -1.0
    if not queries.sum():
        return spark.createDataFrame([], result)
    parts = np.maximum(1, -(-count // BLOCK))
    shares = max(1, -(-int(queries.sum()) // QUERIES))

    def packed(members: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
        names = ["ids", "xs", *extra]

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("vec_id")
            row = {c: [pdf[c].iloc[0]] for c in keys}
            row |= {"ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "xs": [b"".join(pdf["x"])]}
            row |= {e: [pdf[e].to_numpy("<i8").tobytes()] for e in extra}
            return pd.DataFrame(row)

        return members.groupBy(*keys).applyInPandas(pack, ", ".join([f"{c} int" for c in keys] + [f"{c} binary" for c in names]))

    block_of = F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*[F.lit(int(n)) for n in parts]), F.col("leaf") + 1).cast("long")).cast("int")
    blocks = stored(packed(placed.withColumn("block", block_of), ["leaf", "block"], []), "blocks")

    def compare(pairs: np.ndarray, asking: DataFrame) -> DataFrame:
        """Candidates of every (query leaf, data leaf) pair; ``asking`` has each query's k-th score so far in ``kth``."""
        table = spark.createDataFrame(pd.DataFrame(pairs, columns=["q_leaf", "leaf", "bound"]).astype({"q_leaf": int, "leaf": int, "bound": float}), "q_leaf int, leaf int, bound double")
        spread = F.explode(F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(int(n)) for n in parts]), F.col("leaf") + 1) - 1))
        wanted = asking.withColumnRenamed("leaf", "q_leaf").join(table, "q_leaf").filter(F.col("bound") >= F.col("kth"))
        wanted = wanted.withColumn("block", spread).withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int"))
        held = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))) if shares > 1 else blocks.withColumn("share", F.lit(0))

        def meet(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(block):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            ids = np.frombuffer(block["ids"].iloc[0], "<i8")
            data = np.frombuffer(block["xs"].iloc[0], "<i8").reshape(len(ids), dim)
            out = []
            for at in range(0, len(asked), 2048):
                part = asked.iloc[at: at + 2048]
                q = part["vec_id"].to_numpy()
                x = np.frombuffer(b"".join(part["x"]), "<i8").reshape(len(part), dim)
                scores = _products(x, data)
                # one more than k, since the query itself may be among them
                best = _best(scores, ids, k + 1)
                got = np.take_along_axis(scores, best, 1)
                keep = (ids[best] != q[:, None]) & (got >= part["kth"].to_numpy()[:, None])
                i, j = np.nonzero(keep)
                out.append(pd.DataFrame({"query_id": q[i], "vec_id": ids[best[i, j]], "score": got[i, j]}))
            return pd.concat(out)

        keys = ["leaf", "block", "share"]
        return wanted.select(*keys, "vec_id", "x", "kth").groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")

    def top(candidates: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    # the leaves that promise most to each query leaf, until they hold enough rows
    asks, holds = np.flatnonzero(queries), np.flatnonzero(count)
    q, p = np.repeat(asks, len(holds)), np.tile(holds, len(asks))
    promise = ((tree.centres[q] * tree.centres[p]).sum(1) + rp[p] * np.linalg.norm(tree.centres[q], axis=1)).reshape(len(asks), -1)
    first = []
    for i, row in zip(asks, promise):
        order = holds[np.argsort(-row, kind="stable")]
        own = np.concatenate([[i], order[order != i]])
        enough = int(np.searchsorted(np.cumsum(count[own]), 4 * k + 1)) + 1
        first += [(i, j) for j in own[:enough]]
    seeds = np.array([(i, j, np.inf) for i, j in first])
    least = -(2 ** 63) + 1
    asking = placed.filter("asks").select("vec_id", "leaf", "x")
    begun = stored(compare(seeds, asking.withColumn("kth", F.lit(least))), "seeds")
    kth = top(begun).groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("low"))
    kth = kth.select("vec_id", F.when(F.col("have") >= k, F.col("low")).otherwise(F.lit(least)).alias("kth"))
    asking = stored(asking.join(kth, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(least))), "asking")

    worst = np.full(size, np.inf)
    for r in asking.groupBy("leaf").agg(F.min("kth").alias("kth")).collect():
        worst[r["leaf"]] = r["kth"]
    done = set(map(tuple, first))
    left = [(i, j, b) for i, j, b in zip(*tree.surviving(rq, rp, worst)) if (i, j) not in done]
    every = begun.unionByName(compare(np.array(left), asking)) if left else begun
    return top(every).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
