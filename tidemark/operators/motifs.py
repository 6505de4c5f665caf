"""The closest pairs of windows of a series (motifs), exactly and without a list of all pairs.

A window is scaled to mean 0 and deviation 1 (one that never changes becomes zeros). The means of its ``PARTS`` parts,
times the root of their lengths, are its summary; two windows are never closer than their summaries. Windows of alike
summaries are compared first, which bounds the k-th least distance. Summaries then fall into cells as wide as that
bound, so only windows in the same or a touching cell can be closer, and only those are compared. A full cell is dealt
as tiles, so that a job holds ``2 * TILE`` windows at most. A key of so many windows is one job, and done with the
first round.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.values import known
from ..session import ensure_checkpoint_dir
from .timeline import Timeline, framed, running

PARTS = 4
TILE = 512
PLACES = 9
#: Cells are at least this wide; a bound below it (windows that are copies) is rounding alone.
LEAST = 1e-6
_STEPS = [s for s in itertools.product((-1, 0, 1), repeat=PARTS) if s > (0,) * PARTS]


def _scaled(size: int):
    edges = np.linspace(0, size, PARTS + 1).astype(int)

    @pandas_udf(T.StructType([T.StructField("z", T.BinaryType()), T.StructField("s", T.ArrayType(T.DoubleType()))]))
    def scale(windows: pd.Series) -> pd.DataFrame:
        if not len(windows):
            return pd.DataFrame({"z": [], "s": []})
        raw = np.array(windows.tolist(), dtype=np.float64).reshape(-1, size)
        flat = raw.min(1) == raw.max(1)
        spread = np.where(flat, 1.0, raw.std(1))
        z = np.where(flat[:, None], 0.0, (raw - raw.mean(1)[:, None]) / np.where(spread == 0, 1.0, spread)[:, None])
        sums = np.add.reduceat(z, edges[:-1], axis=1) / np.sqrt(np.diff(edges))
        return pd.DataFrame({"z": [row.tobytes() for row in z], "s": sums.tolist()})

    return scale


def windows_of(df: DataFrame, line: Timeline, value: str, size: int) -> DataFrame:
    """Every complete window as ``keys, at, z, s``: position of its first row, scaled values, summary.

    ``at`` counts a key's rows from 0. A window with a null, NaN or infinite value is left out.
    """
    v = known(F.col(value).cast("double"))
    rows = df.select(*line.keys, *line.order, F.when(F.abs(v) < float("inf"), v).alias("_v"))
    rows = running(rows, line, {"_at": ("sum", F.lit(1))})
    full = framed(rows, line, {"_w": lambda w: F.collect_list("_v").over(w.rowsBetween(0, size - 1))}, before=0, after=size - 1)
    parts = full.filter(F.size("_w") == size).select(*line.keys, (F.col("_at") - 1).cast("long").alias("at"), _scaled(size)("_w").alias("_p"))
    return parts.select(*line.keys, "at", "_p.z", "_p.s")


def _best(at, other, d, k: int):
    """The ``k`` windows with the least distances, each with its nearest and then earliest partner."""
    at, other, d = np.concatenate([at, other]), np.concatenate([other, at]), np.concatenate([d, d])
    order = np.lexsort((other, at, d))
    _, once = np.unique(at[order], return_index=True)
    order = order[np.sort(once)[:k]]
    return at[order], other[order], d[order]


def _compared(pa, a, pb, b, alone: bool, apart: int, k: int):
    """Best windows of one job and how many pairs it compared; ``alone`` compares one set with itself."""
    found, compared = [], 0
    norm = (b * b).sum(1)
    for lo in range(0, len(a), 128):
        x, px = a[lo:lo + 128], pa[lo:lo + 128]
        open_ = np.abs(px[:, None] - pb) > apart
        if alone:
            open_ &= px[:, None] < pb
        compared += int(open_.sum())
        near = (x * x).sum(1)[:, None] + norm - 2 * (x @ b.T)
        near[~open_] = np.inf
        # products screen, differences decide: all that may be the least of a row or of a column
        slack = 1e-9 * a.shape[1]
        i, j = np.nonzero(np.isfinite(near) & ((near <= near.min(1, keepdims=True) + slack) | (near <= near.min(0) + slack)))
        for part in range(0, len(i), 65536):
            p, q = i[part:part + 65536], j[part:part + 65536]
            found.append(_best(px[p], pb[q], np.round(np.sqrt(((x[p] - b[q]) ** 2).sum(1)), PLACES), k))
    if not compared:
        return None
    at, other, d = (np.concatenate(c) for c in zip(*found))
    # every entry names its own nearest partner already; the other way round holds too
    return *_best(at, other, d, k), compared


def _jobs(keys: Sequence[str], size: int, k: int, apart: int):
    """Runs all jobs of a bin: the moving windows (side 1) of a job against its resting ones (side 0), without any the resting among themselves."""
    names = [*keys, "at", "other", "distance", "pairs"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in names}
        for _, job in rows.groupby([*keys, "job"], dropna=False, sort=False):
            at, side = job["at"].to_numpy(), job["side"].to_numpy()
            z = np.frombuffer(b"".join(job["z"]), dtype=np.float64).reshape(-1, size)
            alone = not side.any()
            rest, move = (side == 0), (side == 0) if alone else (side == 1)
            best = _compared(at[move], z[move], at[rest], z[rest], alone, apart, k) if rest.any() else None
            if best is None:
                continue
            n = len(best[0])
            for c in keys:
                out[c] += [job[c].iloc[0]] * n
            for c, values in zip(("at", "other", "distance"), best):
                out[c] += values.tolist()
            out["pairs"] += [best[3]] + [0] * (n - 1)
        return pd.DataFrame({c: pd.Series(out[c], dtype=object if c in keys else None) for c in names})

    return run


def _first(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The ``k`` best windows per key; a task gave at most ``k``, so this orders few rows."""
    nearest = found.groupBy(*keys, "at").agg(F.min(F.struct("distance", "other")).alias("_b"))
    order = Window.partitionBy(*keys).orderBy("_b.distance", "at")
    return nearest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*keys, "rank", "at", "_b.other", "_b.distance")


@pandas_udf(T.ArrayType(T.StringType()))
def _cells(s: pd.Series, width: pd.Series) -> pd.Series:
    """The cell of a summary, then those of its later neighbours (each pair of cells is met from one side) that reach within ``width``."""
    at, w = np.array(s.tolist(), dtype=np.float64).reshape(-1, PARTS), width.to_numpy()[:, None]
    cell = np.floor(at / w)
    gap = {-1: at - cell * w, 0: np.zeros_like(at), 1: (cell + 1) * w - at}
    names = lambda cells: ["/".join(map(str, c)) for c in cells.astype(np.int64).tolist()]
    out = [[c] for c in names(cell)]
    for step in _STEPS:
        far = sum(gap[d][:, i] ** 2 for i, d in enumerate(step))
        near = np.flatnonzero(far <= w[:, 0] ** 2)
        for row, name in zip(near.tolist(), names(cell[near] + np.array(step))):
            out[row].append(name)
    return pd.Series(out)


def motifs(df: DataFrame, line: Timeline, value: str, size: int, k: int = 3) -> DataFrame:
    """Per key the ``k`` windows with the nearest partners: ``rank, at, other, distance, compared, windows``.

    ``at`` and ``other`` are the first rows of both windows, counted from 0; partners start more than a quarter of a
    window apart. Distances are Euclidean between scaled windows, to nine places; ties go to the smaller ``at``, then
    ``other``. ``compared`` counts the pairs that were compared for the key. Keys whose series has no two windows apart
    have no rows; null keys are a key like others. Work beyond the first round grows with the pairs of windows whose
    summaries are about as close as the k-th best pair: few for smooth series, nearly all for white noise.
    """
    if size < PARTS:
        raise ValueError(f"a window has at least {PARTS} rows")
    keys, apart = list(line.keys), -(-size // 4)
    ensure_checkpoint_dir(df.sparkSession)
    plain = {c: f"_k{i}" for i, c in enumerate(keys)}
    named = list(plain.values())
    rows = windows_of(df, line, value, size).withColumnsRenamed(plain).checkpoint()
    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(c, fields[c]) for c in named] + [T.StructField("at", T.LongType()), T.StructField("other", T.LongType()),
                                                                        T.StructField("distance", T.DoubleType()), T.StructField("pairs", T.LongType())])
    run = _jobs(named, size, k, apart)

    def done(jobs: DataFrame, held: int) -> DataFrame:
        """Results of all jobs; small ones share a bin, of which ``held`` rows in all make up the number."""
        bins = max(1, -(-held // (2 * TILE)))
        return jobs.withColumn("bin", F.pmod(F.xxhash64(*named, "job"), F.lit(bins))).groupBy("bin").applyInPandas(run, schema).checkpoint()

    def same(other: str) -> Column:
        cond = F.lit(True)
        for c in named:
            cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"{other}.{c}"))
        return cond

    # round 1: windows whose parts lie in the same bands, a large band dealt by position; any pair bounds the k-th best.
    # A key with more windows is told apart by more parts.
    count = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("windows")).checkpoint()
    total = count.agg(F.sum("windows")).first()[0] or 0
    small = F.col("n.windows") <= 2 * TILE
    letters = [F.when(F.col("s")[i] < -0.7, "a").when(F.col("s")[i] < 0, "b").when(F.col("s")[i] < 0.7, "c").otherwise("d") for i in range(PARTS)]
    banded = rows.alias("l").join(count.alias("n"), same("n")).select("l.*", small.alias("_small"), F.when(small, 0).otherwise(F.greatest(F.ceil(F.log("n.windows") / F.log(F.lit(4.0)) - F.log(F.lit(TILE)) / F.log(F.lit(4.0))), F.lit(0))).cast("int").alias("_l"))
    banded = banded.withColumn("band", F.concat(F.lit("b"), *[F.when(F.col("_l") > i, letters[i]).otherwise("") for i in range(PARTS)]))
    sizes = banded.groupBy(*named, "band").agg(F.count(F.lit(1)).alias("_n"))
    slot = F.pmod(F.xxhash64("l.at"), F.when(F.col("l._small"), 1).otherwise(F.ceil(F.col("n._n") / TILE)))
    dealt = banded.alias("l").join(sizes.alias("n"), same("n") & (F.col("l.band") == F.col("n.band"))).select(
        *[f"l.{c}" for c in named], "l.at", "l.z", F.lit(0).alias("side"), F.concat_ws("/", "l.band", slot).alias("job"))
    first = done(dealt, total)
    best = _first(first, named, k)
    bound = best.groupBy(*named).agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("_u"))

    # round 2, for the keys whose windows did not all meet: cells as wide as the bound; without one (fewer than k partners known) everything is one cell
    reach = F.greatest(F.col("_u") * (1 + 1e-9) + 10.0 ** -PLACES, F.lit(LEAST))
    left = rows.alias("l").join(count.alias("n").filter(~small), same("n"), "left_semi")
    wide = left.alias("l").join(bound.alias("u"), same("u"), "left").select("l.*", F.coalesce(reach, F.lit(1e9)).alias("_width"))
    cells = F.when(F.col("_width") < 1e9, _cells("s", "_width")).otherwise(F.array(F.lit("all")))
    placed = wide.select(*named, "at", "z", F.posexplode(cells).alias("side", "cell")).withColumn("side", F.least("side", F.lit(1)))
    # who meets whom is decided on counts; tiles of a side are dealt by position
    met = placed.groupBy(*named, "cell").agg(
        F.count_if(F.col("side") == 0).alias("_h"), F.count_if(F.col("side") == 1).alias("_g"))
    met = met.filter((F.col("_h") > 1) | ((F.col("_h") == 1) & (F.col("_g") > 0))).select(
        *named, "cell", F.ceil(F.col("_h") / TILE).alias("_h"), F.ceil(F.col("_g") / TILE).alias("_g"), (F.col("_h") + F.col("_g")).alias("_rows")).checkpoint()
    held = met.agg(F.sum(F.col("_rows") * (F.col("_h") + F.col("_g")))).first()[0] or 0
    both = placed.alias("l").join(met.alias("m"), same("m") & (F.col("l.cell") == F.col("m.cell"))).select("l.*", "m._h", "m._g")
    own = F.pmod(F.xxhash64("at"), F.when(F.col("side") == 0, F.col("_h")).otherwise(F.col("_g")))
    both = both.withColumn("own", own)

    def task(kind: str, rest: Column, move: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), rest.cast("long").alias("rest"), move.cast("long").alias("move"))

    tiles = F.sequence(F.lit(0).cast("long"), F.col("_h") - 1)
    crowd = F.when(F.col("_g") > 0, F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)).otherwise(F.array().cast("array<bigint>"))
    # a resting tile meets itself, every earlier tile as a moving one, and every tile of guests
    resting = F.concat(F.transform(F.filter(tiles, lambda m: m <= F.col("own")), lambda m: task("home", F.col("own"), m)), F.transform(crowd, lambda m: task("guest", F.col("own"), m)))
    moving = F.when(F.col("side") == 0, F.transform(F.filter(tiles, lambda r: r > F.col("own")), lambda r: task("home", r, F.col("own")))).otherwise(F.transform(tiles, lambda r: task("guest", r, F.col("own"))))
    sent = both.filter("side = 0").select(*named, "cell", "at", "z", F.lit(0).alias("side"), F.explode(resting).alias("task")).unionByName(
        both.select(*named, "cell", "at", "z", F.lit(1).alias("side"), F.explode(moving).alias("task")))
    job = F.concat_ws("/", "cell", "task.kind", "task.rest", "task.move")
    second = done(sent.select(*named, "at", "z", "side", job.alias("job")), held)

    found = first.unionByName(second)
    work = found.groupBy(*named).agg(F.sum("pairs").alias("compared"))
    out = _first(found, named, k).alias("l").join(work.alias("w"), same("w")).join(count.alias("c"), same("c"))
    back = {v: c for c, v in plain.items()}
    return out.select(*[F.col(f"l.{c}").alias(back[c]) for c in named], "l.rank", "l.at", "l.other", "l.distance", "w.compared", "c.windows")
