"""Ranks, correlations and quantile bins of every column pair at once, over packed points.

Each pair's points are cut into value chunks along both axes, by a few hundred cut points that a sample gives. The weight
of every chunk, one short row per pair, tells the ranks before it; a value that is a cut point is a chunk of its own,
whose rank follows from that alone. Only points between cut points are dealt by chunk, first along x, then along y, and
ordered there, so no task sees a whole pair or a hot value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import known
from .blocks import packed_cells, packed_pairs, totals

#: Points of a chunk, about, and cut points of a pair at least.
CHUNK, FEWEST = 1 << 18, 64
#: One of so many points of a block is a candidate for a cut point; a task keeps so many at most.
STEP, CANDIDATES = 512, 4096

Labels = Callable[[tuple, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Look:
    """Of one pair: points, copies, sums of x, y, xx, xy, yy, ends of both columns, least distinct x and candidates for cut points."""

    points: int
    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    picks: tuple[np.ndarray, np.ndarray]

    def constant(self, axis: int) -> bool:
        return bool(self.low[axis] == self.high[axis])


@dataclass(frozen=True)
class PairPoints:
    """Packed points of all pairs, the names of the columns that key them, and a first look at each pair."""

    pairs: DataFrame
    by: list[str]
    blocks: RDD
    look: dict[tuple, Look]


def _look(few: int):
    def part(key, data):
        x, y, w = data
        sums = np.array([(w * v).sum() for v in (np.ones_like(x), x, y, x * x, x * y, y * y)])
        picks = tuple(v[len(v) % STEP // 2::STEP] if len(v) >= STEP else v[::max(1, len(v) // 8)] for v in (x, y))
        return {key: Look(len(x), sums, np.array([x.min(), y.min()]), np.array([x.max(), y.max()]), np.unique(x)[: few + 1], picks)}

    def thin(v):
        return v if len(v) <= CANDIDATES else np.sort(v)[::2]

    def add(a, b):
        return Look(a.points + b.points, a.sums + b.sums, np.minimum(a.low, b.low), np.maximum(a.high, b.high), np.unique(np.concatenate([a.least, b.least]))[: few + 1],
                    tuple(thin(np.concatenate([p, q])) for p, q in zip(a.picks, b.picks)))

    return part, add


@contextmanager
def pair_points(pairs: DataFrame, by: Sequence[str], x: str, y: str, *, few: int = 0):
    """``PairPoints`` of the rows whose x and y are both known; their copies are released at the end.

    What ``joins.column_pairs`` made is packed from the rows it was made of, one number per column instead of one row per pair.
    """
    by = list(by)
    source = getattr(pairs, "unpacked_from", None) if (by, x, y) == (["x", "y"], "vx", "vy") else None
    if source:
        blocks, kept = packed_pairs(*source)
    else:
        rows = pairs.select(*by, *[known(F.col(c).cast("double")).alias(c) for c in (x, y)]).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        blocks, kept = packed_cells(rows, x, y, by)
    try:
        yield PairPoints(pairs, by, blocks, totals(blocks, *_look(few)))
    finally:
        kept.unpersist()


def whole(key: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All points of a pair as one group."""
    return np.zeros(len(x), np.int64)


# ---- chunks

def _cuts(look: Look) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cut points of both columns, from the candidates at about equal steps."""
    count = max(FEWEST, -(-look.points // CHUNK))
    out = []
    for v in look.picks:
        v = np.sort(v)
        out.append(np.unique(v[np.arange(1, count) * len(v) // count]))
    return out[0], out[1]


def _place(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Even numbers for stretches between cut points, odd ones for the cut points themselves."""
    below = np.searchsorted(cuts, v)
    return 2 * below + (cuts[np.minimum(below, len(cuts) - 1)] == v)


def _parts(labels: Sequence[tuple[Labels, int]], key: tuple, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    return [f(key, x, y) for f, _ in labels]


def _weights(cuts: dict, means: dict, labels: Sequence[tuple[Labels, int]]):
    """Per pair the copies in each chunk of both columns, per group of each labelling, and the centred products of all points and each group."""
    def part(key, data):
        x, y, w = data
        held = [_place(v, c) for v, c in zip((x, y), cuts[key])]
        out = []
        for at, (_, k) in zip(_parts(labels, key, x, y), labels):
            for place, c in zip(held, cuts[key]):
                width = 2 * len(c) + 1
                out.append(np.bincount(at * width + place, weights=w, minlength=k * width).reshape(k, width))
        dx, dy = x - means[key][0], y - means[key][1]
        out.append(np.array([(w * a).sum() for a in (dx * dx, dx * dy, dy * dy)]))
        return {key: out}

    def add(a, b):
        return [p + q for p, q in zip(a, b)]

    return part, add


@dataclass(frozen=True)
class _Chunks:
    """Of one pair and column: cut points and, per labelling, copies per group and chunk, copies before it, and the groups' mean ranks."""

    cuts: np.ndarray
    copies: list[np.ndarray]
    before: list[np.ndarray]
    middle: list[np.ndarray]

    @classmethod
    def of(cls, cuts: np.ndarray, copies: list[np.ndarray]) -> _Chunks:
        return cls(cuts, copies, [c.cumsum(1) - c for c in copies], [(c.sum(1) + 1) / 2 for c in copies])

    def known_ranks(self, place: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Centred ranks of points whose chunk is a single value."""
        return [b[at, place] + (c[at, place] + 1) / 2 - m[at] for c, b, m, at in zip(self.copies, self.before, self.middle, parts)]

    def ordered_ranks(self, chunk: int, v: np.ndarray, w: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Centred ranks of all points of one chunk."""
        out = []
        for b, m, at in zip(self.before, self.middle, parts):
            ranks = np.empty(len(v))
            for group in np.unique(at):
                mine = np.flatnonzero(at == group)
                _, which = np.unique(v[mine], return_inverse=True)
                n = np.bincount(which, weights=w[mine])
                ranks[mine] = (b[group, chunk] + n.cumsum() - (n - 1) / 2 - m[group])[which]
            out.append(ranks)
        return out


# ---- ranks

def _products(w, parts, ranks_x, ranks_y, labels) -> np.ndarray:
    """Per labelling and group the sums of the products of ranks: xx, xy, yy."""
    sums = []
    for at, rx, ry, (_, k) in zip(parts, ranks_x, ranks_y, labels):
        sums.append(np.stack([np.bincount(at, weights=w * a * b, minlength=k) for a, b in ((rx, rx), (rx, ry), (ry, ry))], 1))
    return np.concatenate(sums)


def _pieces(key: tuple, place: np.ndarray, data: np.ndarray):
    """The columns of a matrix by their chunk."""
    order = np.argsort(place, kind="stable")
    ends = np.flatnonzero(np.diff(place[order])) + 1
    for rows in np.split(order, ends):
        if len(rows):
            yield (key, int(place[rows[0]])), data[:, rows]


DONE = "done"


def _first_deal(axes: dict, labels, items):
    """Points between the cut points of x, by x chunk."""
    for key, data in items:
        place = _place(data[0], axes[key][0].cuts)
        open_ = place % 2 == 0
        if open_.any():
            yield from _pieces(key, place[open_], data[:, open_])


def _second_deal(axes: dict, labels, ranks_x, key: tuple, data: np.ndarray, sums: dict):
    """Points with known ranks of x: added to ``sums`` where y is a cut point, else given on by y chunk."""
    x, y, w = data
    place = _place(y, axes[key][1].cuts)
    here = place % 2 == 1
    if here.any():
        parts = [p[here] for p in _parts(labels, key, x, y)]
        found = _products(w[here], parts, [r[here] for r in ranks_x], axes[key][1].known_ranks(place[here], parts), labels)
        sums[key] = sums[key] + found if key in sums else found
    if not here.all():
        yield from _pieces(key, place[~here], np.stack([x, y, w, *ranks_x])[:, ~here])


def _direct(axes: dict, labels, items):
    """Points at the cut points of x go on at once."""
    sums: dict = {}
    for key, data in items:
        place = _place(data[0], axes[key][0].cuts)
        data, place = data[:, place % 2 == 1], place[place % 2 == 1]
        if len(place):
            yield from _second_deal(axes, labels, axes[key][0].known_ranks(place, _parts(labels, key, data[0], data[1])), key, data, sums)
    yield from (((key, DONE), s) for key, s in sums.items())


def _gathered(items) -> dict:
    held: dict = {}
    for name, data in items:
        held.setdefault(name, []).append(data)
    return held


def _after_x(axes: dict, labels, wanted: dict, items):
    """Ranks of x in each chunk, the values at wanted positions, and the points by y chunk."""
    sums: dict = {}
    held = _gathered(items)
    while held:
        (key, chunk), parts = held.popitem()
        data = np.concatenate(parts, axis=1)
        x, y, w = data
        if (key, chunk) in wanted:
            u, which = np.unique(x, return_inverse=True)
            upto = np.bincount(which, weights=w).cumsum()
            yield (key, DONE), {at: float(u[np.searchsorted(upto, inside, side="right")]) for at, inside in wanted[key, chunk]}
        yield from _second_deal(axes, labels, axes[key][0].ordered_ranks(chunk, x, w, _parts(labels, key, x, y)), key, data, sums)
    yield from (((key, DONE), s) for key, s in sums.items())


def _after_y(axes: dict, labels, items):
    """Per pair the sums of products and the values at wanted positions."""
    sums: dict = {}
    values: dict = {}
    held = _gathered(items)
    while held:
        (key, chunk), parts = held.popitem()
        if chunk == DONE:
            for part in parts:
                if isinstance(part, dict):
                    values.setdefault(key, {}).update(part)
                else:
                    sums[key] = sums[key] + part if key in sums else part
            continue
        x, y, w, *ranks_x = np.concatenate(parts, axis=1)
        at = _parts(labels, key, x, y)
        found = _products(w, at, ranks_x, axes[key][1].ordered_ranks(chunk, y, w, at), labels)
        sums[key] = sums[key] + found if key in sums else found
    yield sums, values


@dataclass(frozen=True)
class Ranked:
    """Of one pair: Pearson's correlation, per labelling the copies and Spearman's of each group, and the asked quantiles of x."""

    pearson: float | None
    groups: list[tuple[np.ndarray, list[float | None]]]
    quantiles: list[float]


def _corr(xx: float, xy: float, yy: float) -> float | None:
    both = (xx * yy) ** 0.5
    return float(xy / both) if both else None


def ranked(p: PairPoints, labels: Sequence[tuple[Labels, int]], probs: Sequence[float] = ()) -> dict[tuple, Ranked]:
    """``Ranked`` per pair. ``labels`` are functions of (key, x, y) that number the groups, and how many there are.

    Quantiles interpolate between neighbours and ask for ``whole`` as the first labelling.
    """
    keys = list(p.look)
    means = {key: look.sums[1:3] / look.sums[0] for key, look in p.look.items()}
    cuts = {key: _cuts(look) for key, look in p.look.items()}
    found = totals(p.blocks, *_weights(cuts, means, labels))
    axes, wanted, spots = {}, {}, {}
    for key in keys:
        copies = found[key][:-1]
        axes[key] = tuple(_Chunks.of(c, copies[i::2]) for i, c in enumerate(cuts[key]))
        if probs:
            n, x = p.look[key].sums[0], axes[key][0]
            for at in {int(f((n - 1) * q)) for q in probs for f in (np.floor, np.ceil)}:
                chunk = int(np.searchsorted(x.copies[0][0].cumsum(), at, side="right"))
                if chunk % 2:
                    spots.setdefault(key, {})[at] = float(x.cuts[chunk // 2])
                else:
                    wanted.setdefault((key, chunk), []).append((at, at - x.before[0][0, chunk]))
    sc = p.pairs.sparkSession.sparkContext
    points = sum(look.points for look in p.look.values())
    tasks = max(int(p.pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points // (4 * CHUNK)))
    by_x = p.blocks.mapPartitions(partial(_first_deal, axes, labels)).partitionBy(tasks, _deal)
    by_y = sc.union([p.blocks.mapPartitions(partial(_direct, axes, labels)), by_x.mapPartitions(partial(_after_x, axes, labels, wanted))]).partitionBy(tasks, _deal)
    sums: dict = {}
    for some, values in by_y.mapPartitions(partial(_after_y, axes, labels)).collect() if keys else []:
        for key, s in some.items():
            sums[key] = sums[key] + s if key in sums else s
        for key, v in values.items():
            spots.setdefault(key, {}).update(v)
    out = {}
    for key in keys:
        flat = any(p.look[key].constant(i) for i in (0, 1))
        at, groups = 0, []
        for (_, k), copies in zip(labels, axes[key][0].copies):
            groups.append((copies.sum(1), [_corr(*map(float, s)) for s in sums[key][at:at + k]]))
            at += k
        quantiles = []
        for q in probs:
            place = (p.look[key].sums[0] - 1) * q
            low, high = (spots[key][int(f(place))] for f in (np.floor, np.ceil))
            quantiles.append(float(low + (high - low) * (place - np.floor(place))))
        out[key] = Ranked(None if flat else _corr(*map(float, found[key][-1])), groups, quantiles)
    return out


def _deal(name: tuple) -> int:
    """The same number in every process, whatever the seed of Python's hashes."""
    import zlib

    return zlib.crc32(repr(name).encode())


# ---- bins

def bin_sums(p: PairPoints, edges: dict[tuple, np.ndarray]) -> dict[tuple, list[tuple[int, int, float, float]]]:
    """Per pair ``(bin, n, mean, sum of squares around it)`` of y for the right-closed bins that its ascending edges make of x."""
    means = {key: float(look.sums[2] / look.sums[0]) for key, look in p.look.items()}

    def part(key, data):
        x, y, w = data
        k = max(len(edges[key]) - 1, 1)
        at = np.clip(np.searchsorted(edges[key], x) - 1, 0, k - 1)
        d = y - means[key]
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        np.minimum.at(low, at, y)
        np.maximum.at(high, at, y)
        return {key: (np.stack([np.bincount(at, weights=v, minlength=k) for v in (w, w * d, w * d * d)]), low, high)}

    def add(a, b):
        return a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])

    out = {}
    for key, ((n, s, q), low, high) in totals(p.blocks, part, add).items():
        rows = []
        for i in np.flatnonzero(n):
            # a bin of one value has no squares, not even those of rounding
            flat = low[i] == high[i]
            rows.append((int(i), int(n[i]), float(low[i] if flat else means[key] + s[i] / n[i]), 0.0 if flat else max(float(q[i] - s[i] * s[i] / n[i]), 0.0)))
        out[key] = rows
    return out
