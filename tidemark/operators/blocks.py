"""Points as blocks of numbers, for fits that read them round after round.

Rows are packed once into blocks of up to ``BLOCK`` points of one key, which executors keep as bytes. A round sends a few
parameters to all blocks and brings back short sums, one set per task; rows never pass through the driver.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 65_536
#: Points that a packing task holds at most, whatever the number of keys.
HELD = 32 * BLOCK


def _packer(columns: Sequence[str], keys: Sequence[str]):
    names = [*keys, "data"]

    def block(held: list) -> pa.RecordBatch:
        key, parts = held
        data = np.concatenate(parts, axis=1).tobytes()
        return pa.RecordBatch.from_arrays([*key, pa.array([data], pa.binary())], names=names)

    def run(batches):
        held: dict = {}
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float, copy=False) for c in columns])
            if keys:
                found = pa.Table.from_batches([batch.select(list(keys))]).to_pandas().groupby(list(keys), sort=False).indices
            else:
                found = {(): slice(None)}
            for name, at in found.items():
                if name not in held:
                    first = int(at[0]) if keys else 0
                    held[name] = [[batch.column(k).slice(first, 1) for k in keys], []]
                held[name][1].append(values[:, at])
                if sum(p.shape[1] for p in held[name][1]) >= BLOCK:
                    total -= sum(p.shape[1] for p in held[name][1][:-1])
                    yield block(held.pop(name))
                else:
                    total += held[name][1][-1].shape[1]
            if total >= HELD:
                yield from map(block, held.values())
                held, total = {}, 0
        yield from map(block, held.values())

    return run


def packed(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> RDD:
    """Pairs of a key (tuple) and a matrix of doubles with a row per column; rows with a null key are left out.

    The caller keeps them with ``persist`` and releases them.
    """
    shape = T.StructType([*[df.schema[k] for k in keys], T.StructField("data", T.BinaryType())])
    rows = len(columns)
    blocks = df.select(*keys, *columns).mapInArrow(_packer(columns, keys), shape)
    return blocks.rdd.map(lambda r: (tuple(r)[:-1], np.frombuffer(r[-1]).reshape(rows, -1)))


#: Numbers that a task gathers before it counts equal points together, and counted points of all keys that it holds at most.
GATHERED, HELD_CELLS = 256 * BLOCK, 128 * BLOCK


def _cells(ux: np.ndarray, cx: np.ndarray, uy: np.ndarray, cy: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Distinct points and their copies, as rows x, y and copies, from the places of x in ``ux`` and of y in ``uy``."""
    code = cx * len(uy) + cy
    if w is None:
        code.sort()
    else:
        order = np.argsort(code)
        code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    n = np.diff(np.append(first, len(code))) if w is None else np.add.reduceat(w[order], first)
    code = code[first]
    return np.stack([ux[code // len(uy)], uy[code % len(uy)], n])


def _counted(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    return _cells(*np.unique(x, return_inverse=True), *np.unique(y, return_inverse=True), w)


class _Copies:
    """Counted points of each key that a task holds while waiting for more copies of them."""

    def __init__(self):
        self.held: dict = {}

    def add(self, name, cells: np.ndarray, rows: int):
        """Takes the points of ``rows`` more rows; gives back those that are not worth waiting for."""
        old = self.held.pop(name, None)
        few = cells.shape[1] * 2 > rows
        if old is not None:
            cells = _counted(*np.concatenate([old, cells], axis=1))
        if few:
            yield name, cells
        else:
            self.held[name] = cells
        if sum(c.shape[1] for c in self.held.values()) >= HELD_CELLS:
            yield from self.rest()

    def rest(self):
        held, self.held = self.held, {}
        yield from held.items()


def _cut(cells: np.ndarray):
    """Bytes of up to ``BLOCK`` points each; copies are left out where there are none."""
    for i in range(0, cells.shape[1], BLOCK):
        some = cells[:, i:i + BLOCK]
        yield (1 if (some[2] == 1).all() else 0), some.shape[1], (some[:2] if (some[2] == 1).all() else some).tobytes()


def _uncut(single: int, n: int, data: bytes) -> np.ndarray:
    rows = np.frombuffer(data).reshape(-1, n)
    return np.concatenate([rows, np.ones((1, n))]) if single else rows


def _by_key(batch: pa.RecordBatch, keys: Sequence[str]):
    """The rows of each key in a batch; rows with a null key are left out."""
    names, codes, there = [()], np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
    for k in keys:
        column = batch.column(k).dictionary_encode()
        there &= column.indices.is_valid().to_numpy(zero_copy_only=False)
        codes = codes * max(len(column.dictionary), 1) + column.indices.fill_null(0).to_numpy(zero_copy_only=False)
        names = [(*n, v) for n in names for v in column.dictionary.to_pylist() or [None]]
        # only the keys that occur are carried on
        seen, codes = np.unique(codes, return_inverse=True)
        names = [names[c] for c in seen]
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(names)))
    for name, rows in zip(names, np.split(order, ends[:-1])):
        rows = rows[there[rows]]
        if len(rows):
            yield name, rows


def _long_packer(x: str, y: str, keys: Sequence[str], kinds: Sequence[pa.DataType]):
    def blocks(found):
        for name, cells in found:
            for single, n, data in _cut(cells):
                values = [*[pa.array([v], kind) for v, kind in zip(name, kinds)], pa.array([single], pa.int32()), pa.array([n], pa.int32()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(values, names=[*keys, "single", "n", "data"])

    def run(batches):
        raw: dict = {}
        sizes: dict = {}
        copies = _Copies()

        def take(name):
            n = sizes.pop(name)
            return copies.add(name, _counted(*np.concatenate(raw.pop(name), axis=1)), n)

        for batch in batches:
            if not batch.num_rows:
                continue
            # adding zero makes -0.0 the same as 0.0
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) + 0.0 for c in (x, y)])
            for name, rows in _by_key(batch, keys):
                raw.setdefault(name, []).append(values[:, rows])
                sizes[name] = sizes.get(name, 0) + len(rows)
            if 2 * sum(sizes.values()) >= GATHERED:
                for name in list(raw):
                    yield from blocks(take(name))
        for name in list(raw):
            yield from blocks(take(name))
        yield from blocks(copies.rest())

    return run


def packed_cells(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> tuple[RDD, RDD]:
    """Pairs of a key (tuple) and a matrix of x, y and copies, and the persisted blocks that these are read from, which the caller releases.

    Equal points of a task are counted together; a point may come again in another matrix. x and y are doubles without
    null and NaN; rows with a null key are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    shape = T.StructType([*[df.schema[k] for k in keys], T.StructField("single", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())])
    kinds = [to_arrow_type(df.schema[k].dataType) for k in keys]
    kept = df.select(*keys, x, y).mapInArrow(_long_packer(x, y, keys, kinds), shape).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    return kept.map(lambda r: (r[:-3], _uncut(*r[-3:]))), kept


def _wide_packer(count: int, pairs: Sequence[tuple[int, int]]):
    names = ["i", "j", "single", "n", "data"]

    def blocks(found):
        for (i, j), cells in found:
            for single, n, data in _cut(cells):
                yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (i, j, single, n)], pa.array([data], pa.binary())], names=names)

    def run(batches):
        raw: list = []
        copies = _Copies()

        def take():
            values = np.concatenate(raw, axis=1)
            raw.clear()
            there = ~np.isnan(values)
            coded = [np.unique(v, return_inverse=True) for v in values]
            for i, j in pairs:
                both = there[i] & there[j]
                n = int(both.sum())
                if n:
                    (ux, cx), (uy, cy) = coded[i], coded[j]
                    yield from copies.add((i, j), _cells(ux, cx, uy, cy) if n == len(both) else _cells(ux, cx[both], uy, cy[both]), n)

        for batch in batches:
            if not batch.num_rows:
                continue
            # adding zero makes -0.0 the same as 0.0
            raw.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) + 0.0 for c in range(count)]))
            if sum(r.size for r in raw) >= GATHERED:
                yield from blocks(take())
        if raw:
            yield from blocks(take())
        yield from blocks(copies.rest())

    return run


def packed_pairs(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> tuple[RDD, RDD]:
    """As ``packed_cells`` for pairs of columns, keyed by their names, straight from the rows: both orders of a pair are read from the same blocks."""
    place = {c: i for i, c in enumerate(columns)}
    wanted: dict = {}
    for a, b in pairs:
        wanted.setdefault(tuple(sorted((place[a], place[b]))), []).append((a, b))
    shape = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("i", "j", "single", "n")], T.StructField("data", T.BinaryType())])
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    kept = numbers.mapInArrow(_wide_packer(len(columns), list(wanted)), shape).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def unpack(row):
        i, j, *rest = row
        data = _uncut(*rest)
        return [((a, b), data if place[a] == i else data[[1, 0, 2]]) for a, b in wanted[i, j]]

    return kept.flatMap(unpack), kept


def totals(blocks: RDD, part: Callable[[tuple, np.ndarray], dict], add: Callable = operator.add) -> dict:
    """The sums, by name, of what ``part(key, matrix)`` gives for every block: first per task, then in the order of the tasks."""
    def merge(a: dict, b: dict) -> dict:
        return a | {name: add(a[name], v) if name in a else v for name, v in b.items()}

    def run(items):
        return [reduce(merge, (part(key, data) for key, data in items), {})]

    return reduce(merge, blocks.mapPartitions(run).collect(), {})
