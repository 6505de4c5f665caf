"""Two-dimensional clusters of every column pair at once, and rank correlations inside them.

Each pair of columns is a small clustering of its own. All of them take their steps together: a round of Lloyd's
iteration is one job over the packed points of all pairs (assign every point to its nearest centre, sum per
centre), and only the centres, a few numbers per pair, pass from round to round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.local import local_table
from .blocks import totals
from .pairranks import Labels, PairPoints, Ranked, pair_points, ranked
from .stats import MIN_GROUP, correlation_p

#: x columns with so few distinct values or fewer are not clustered.
FEW_VALUES = 5
#: Points that are compared with the centres at once, so that the work stays in a core's cache.
SLICE = 8192


def _seeds(sums: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """``k`` centres, evenly spread over 1.5 deviations to both sides along the main axis of a pair's points, and this deviation."""
    n, sx, sy, sxx, sxy, syy = sums
    mx, my = sx / n, sy / n
    a, b, c = sxx / n - mx * mx, sxy / n - mx * my, syy / n - my * my
    turn = math.atan2(2 * b, a - c) / 2
    spread = math.sqrt(max((a + c + math.sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 0.0))
    at = np.array([1.5 * (2 * i + 1 - k) / k for i in range(k)])
    return np.stack([mx + at * spread * math.cos(turn), my + at * spread * math.sin(turn)], 1), spread


def nearest(centres: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each point, the first of equals."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), SLICE):
        px, py = x[i:i + SLICE], y[i:i + SLICE]
        least, at = None, np.zeros(len(px), np.int64)
        for c, (cx, cy) in enumerate(centres):
            away = (px - cx) * (px - cx) + (py - cy) * (py - cy)
            if least is None:
                least = away
            else:
                at[away < least] = c
                np.minimum(least, away, out=least)
        out[i:i + SLICE] = at
    return out


def _assigned(centres: dict):
    """Per pair and centre the sums of 1, x and y over the points nearest to it."""
    def part(key, data):
        if key not in centres:
            return {}
        x, y, w = data
        at = nearest(centres[key], x, y)
        return {key: np.stack([np.bincount(at, weights=v, minlength=len(centres[key])) for v in (w, w * x, w * y)])}

    return part


def pair_centres(p: PairPoints, k: int = 3, *, rounds: int = 100, still: float = 1e-9, few: int = 0) -> dict[tuple, np.ndarray]:
    """Centres (cx, cy) per pair after Lloyd's iteration on its points, weighted by their copies.

    It ends when no centre moved by more than ``still`` of its pair's deviation, or after ``rounds``; a pair whose centres
    stand still takes no part in later rounds. A centre that loses all points stays where it is. Pairs with ``few``
    distinct x or fewer have none; the first look must have counted these.
    """
    start = {key: _seeds(look.sums, k) for key, look in p.look.items() if len(look.least) > few}
    centres, spreads = {key: c for key, (c, _) in start.items()}, {key: s for key, (_, s) in start.items()}
    moving = set(centres)
    for _ in range(rounds if centres else 0):
        most = 0.0
        for key, (n, sx, sy) in totals(p.blocks, _assigned({key: centres[key] for key in moving})).items():
            held = n > 0
            new = np.where(held[:, None], np.stack([sx, sy], 1) / np.where(held, n, 1.0)[:, None], centres[key])
            moved = float(np.abs(new - centres[key]).max())
            if spreads[key] > 0:
                most = max(most, moved / spreads[key])
            if moved == 0:
                moving.discard(key)
            centres[key] = new
        if most <= still:
            break
    return centres


def _cluster(centres: dict, key: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return nearest(centres[key], x, y) if key in centres else np.zeros(len(x), np.int64)


def clusters_of(centres: dict, k: int) -> tuple[Labels, int]:
    """The labelling of points by their cluster; pairs without centres are one group."""
    return partial(_cluster, centres), k


def rank_table(p: PairPoints, centres: dict, found: dict[tuple, Ranked], at: int) -> DataFrame:
    """Rows, Spearman and its p per pair and cluster; ``at`` is the place of the clusters among the labellings."""
    rows = []
    for key in centres:
        copies, rho = found[key].groups[at]
        rows += [(*key, c, int(n), r) for c, (n, r) in enumerate(zip(copies, rho)) if n]
    kinds = [{"bigint": "long"}.get(kind, kind) for kind in (p.pairs.schema[c].dataType.simpleString() for c in p.by)]
    table = local_table(p.pairs.sparkSession, rows, ", ".join([*[f"{c} {kind}" for c, kind in zip(p.by, kinds)], "cluster int", "n long", "spearman double"]))
    return table.withColumn("p", correlation_p(F.col("spearman"), F.col("n")))


def cluster_ranks(pairs: DataFrame, by: Sequence[str], x: str, y: str, k: int = 3, *, few: int = FEW_VALUES) -> DataFrame:
    """Per pair and cluster: rows, Spearman and its p; pairs with ``few`` distinct x or fewer have no clusters; ``by`` are texts or numbers."""
    with pair_points(pairs, by, x, y, few=few) as p:
        centres = pair_centres(p, k, few=few)
        return rank_table(p, centres, ranked(p, [clusters_of(centres, k)]), 0)


def best_cluster_p(ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per pair the number of clusters and the least p of those of at least five rows."""
    usable = (F.col("n") >= MIN_GROUP) & ~F.isnan("p")
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), F.min(F.when(usable, F.col("p"))).alias("cluster_p"))
