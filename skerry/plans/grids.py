"""Sums of Gaussian kernels over points of few axes by way of a grid: work in proportion to the points, no pairs.

A kernel is a sum over the points g of a regular grid, exp(-(x - y)^2 / 2) = sqrt(2 / pi) STEP sum_g exp(-(x - g)^2) exp(-(y - g)^2),
with a relative error of 2 exp(-pi^2 / (2 STEP^2)), 1e-13, on each axis. So centres are spread over the grid and queries gather
from it. A centre or query reaches the grid points within `reach` on each axis: what it leaves out is below exp(-reach^2) a centre.

The grid comes in tiles, of which only those near centres exist; a tile with what the next ones have along its edges is a row of
a table. Points go to tasks by tile; a tile of very many is dealt out. No task holds more than a tile and MOST queries.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.plans.storage import bounded_batches, settle

#: More axes than this would make a point reach too many points of the grid.
MOST_AXES = 3
STEP = 0.4
#: Grid points along a tile and along a cell, whose points share a window of the grid.
SIDE, CELL = 32, 4
#: Most rows of a tile in a task at once.
MOST = 1 << 16
_FAR = 1 << 30
_SLICE = 1 << 20


def _margin(reach: float) -> int:
    """Grid points within reach; a tile's edge is no wider than a tile."""
    margin = math.ceil(reach / STEP)
    if margin >= SIDE:
        raise ValueError("the reach is beyond a tile")
    return margin


def _placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tiles, numbers of the cells in them, and places from the cells' starts. Points that aren't finite go far away."""
    cell = np.floor(np.clip(np.where(np.isfinite(x), x, np.inf) / (STEP * CELL), -_FAR, _FAR)).astype(np.int64)
    tile = cell // (SIDE // CELL)
    inside = cell - tile * (SIDE // CELL)
    return tile, inside @ (SIDE // CELL) ** np.arange(x.shape[1])[::-1], x - cell * (STEP * CELL)


def _factors(offset: np.ndarray, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Kernels of a cell's points at its window's grid points: along the first axis, and products along the others."""
    e = np.exp(-((offset[:, :, None] - STEP * (np.arange(CELL + 2 * margin + 1) - margin)) ** 2))
    rest = np.ones((len(e), 1))
    for k in range(1, e.shape[1]):
        rest = (rest[:, :, None] * e[:, k, None]).reshape(len(e), -1)
    return e[:, 0], rest


def _windows(cells: np.ndarray, d: int, margin: int) -> Iterator[tuple[slice, tuple[slice, ...]]]:
    """For cells in order: slices of rows of one cell, as many as memory allows, and the window's place in its tile."""
    width = CELL + 2 * margin + 1
    most = max(1, _SLICE // width ** (d - 1))
    cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
    for low, high in itertools.pairwise(cuts):
        if low < high:
            at = np.unravel_index(int(cells[low]), (SIDE // CELL,) * d)
            window = tuple(slice(int(k) * CELL, int(k) * CELL + width) for k in at)
            for k in range(low, high, most):
                yield slice(k, min(high, k + most)), window


def _pieces(d: int, margin: int) -> list[tuple[tuple[int, ...], tuple[slice, ...], tuple[slice, ...]]]:
    """How a tile with edges lies over tiles: which neighbour, the place in the wide tile, the place in the neighbour."""
    axis = [(-1, slice(0, margin), slice(SIDE - margin, SIDE)), (0, slice(margin, margin + SIDE), slice(0, SIDE)), (1, slice(margin + SIDE, SIDE + 2 * margin + 1), slice(0, margin + 1))]
    return [tuple(zip(*p, strict=True)) for p in itertools.product(axis, repeat=d)]


def _names(d: int) -> list[str]:
    return [f"tile{k}_" for k in range(d)]


def _runs(b: pa.RecordBatch, d: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """Tile, first and last row of each run of rows with the same tile."""
    tile = np.stack([b.column(k).to_numpy() for k in range(d)], 1)
    cuts = [0, *(np.flatnonzero((np.diff(tile, axis=0) != 0).any(1)) + 1).tolist(), len(tile)]
    for low, high in itertools.pairwise(cuts):
        if low < high:
            yield tuple(tile[low].tolist()), low, high


def _added(pieces: DataFrame, d: int, shape: int, place: Callable[[int], tuple[slice, ...]], out: Callable[[tuple[int, ...], np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The pieces (tile, number of its place, values) of each tile added up, and what `out` makes of the sums."""
    parts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in it:
            for tile, low, high in _runs(b, d):
                if tile != now:
                    if now is not None:
                        yield from out(now, total)
                    now, total = tile, np.zeros((shape,) * d)
                for k in range(low, high):
                    at = total[place(b.column(d)[k].as_py())]
                    at += np.frombuffer(b.column(d + 1)[k].as_buffer()).reshape(at.shape)
        if now is not None:
            yield from out(now, total)

    return pieces.repartition(parts, *_names(d)).sortWithinPartitions(*_names(d)).mapInArrow(run, _schema(d))


def _schema(d: int) -> str:
    return ", ".join([*(f"{t} int" for t in _names(d)), "piece int", "grid binary"])


def _row(tile: tuple[int, ...], piece: int, v: np.ndarray, d: int) -> pa.RecordBatch:
    values = [*(pa.array([t], pa.int32()) for t in (*tile, piece)), pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(values, [*_names(d), "piece", "grid"])


def _dealt(df: DataFrame, d: int) -> DataFrame:
    """Adds salt_, and salts_ of the tile: as many as it takes for MOST rows each. df: a written table, whose rows keep their places."""
    counts = df.groupBy(*_names(d)).agg(F.ceil(F.count("*") / MOST).alias("salts_"))
    return df.withColumn("place_", F.monotonically_increasing_id()).join(counts, _names(d)).withColumn("salt_", F.col("place_") % F.col("salts_")).drop("place_")


def spread(blocks: DataFrame, d: int, reach: float) -> DataFrame:
    """Tiles with their edges (tile, grid) that hold the kernels of all centres. blocks: points and weights of finite centres, as doubles."""
    bounded_batches(blocks.sparkSession)
    margin, parts = _margin(reach), max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = _pieces(d, margin)
    names = [*_names(d), "cell_", *(f"y{k}" for k in range(d)), "w"]
    schema = ", ".join(f"{n} {'int' if n.endswith('_') else 'double'}" for n in names)

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for p, w in zip(b.column(0), b.column(1), strict=True):
                tile, cell, offset = _placed(np.frombuffer(p.as_buffer()).reshape(-1, d))
                yield pa.RecordBatch.from_arrays([*(pa.array(t, pa.int32()) for t in (*tile.T, cell)), *(pa.array(np.ascontiguousarray(y)) for y in offset.T), pa.array(np.frombuffer(w.as_buffer()))], names)

    def share(tile: tuple[int, ...], wide: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, (step, there, _) in enumerate(pieces):
            if wide[there].any():
                yield _row(tuple(t + s for t, s in zip(tile, step, strict=True)), k, wide[there], d)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wide = None, None
        for b in it:
            cells, offset, w = b.column(d).to_numpy(), np.stack([b.column(d + 1 + k).to_numpy() for k in range(d)], 1), b.column(2 * d + 1).to_numpy()
            for tile, low, high in _runs(b, d):
                if tile != now:
                    if now is not None:
                        yield from share(now, wide)
                    now, wide = tile, np.zeros((SIDE + 2 * margin + 1,) * d)
                for some, window in _windows(cells[low:high], d, margin):
                    first, rest = _factors(offset[low:high][some], margin)
                    at = wide[window]
                    at += ((first * w[low:high][some, None]).T @ rest).reshape(at.shape)
        if now is not None:
            yield from share(now, wide)

    def back(tile: tuple[int, ...], grid: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, (step, _, here) in enumerate(pieces):
            if grid[here].any():
                yield _row(tuple(t - s for t, s in zip(tile, step, strict=True)), k, grid[here], d)

    rows = _dealt(settle(blocks.select("points", "weights").mapInArrow(place, schema)), d)
    sent = rows.repartition(parts, *_names(d), "salt_").sortWithinPartitions(*_names(d), "cell_").select(*names)
    tiles = _added(sent.mapInArrow(run, _schema(d)), d, SIDE, lambda k: pieces[k][2], back)
    wide = _added(tiles, d, SIDE + 2 * margin + 1, lambda k: pieces[k][1], lambda tile, v: iter([_row(tile, 0, v, d)]))
    return settle(wide.select(*_names(d), "grid"))


def gather(df: DataFrame, columns: list[str], points: Callable[[np.ndarray], np.ndarray], grid: DataFrame, d: int, reach: float, name: str) -> DataFrame:
    """df with the sums at its rows' points; 0 where no centre is near, NaN for points that aren't finite."""
    bounded_batches(df.sparkSession)
    margin, parts = _margin(reach), max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names, scale = df.columns, (math.sqrt(2 / math.pi) * STEP) ** d
    places = [names.index(c) for c in columns]
    added = [*_names(d), "cell_", *(f"offset{k}_" for k in range(d))]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            tile, cell, offset = _placed(points(np.stack([b.column(p).to_numpy(zero_copy_only=False) for p in places], 1).astype(float)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(t, pa.int32()) for t in (*tile.T, cell)), *(pa.array(np.ascontiguousarray(y), from_pandas=False) for y in offset.T)], [*names, *added])

    def sums(rows: pa.Table, wide: pa.Table) -> pa.Table:
        out = np.zeros(len(rows))
        offset = np.stack([rows.column(c).to_numpy() for c in added[d + 1 :]], 1)
        if len(wide) and len(rows):
            v = np.frombuffer(wide.column("grid")[0].as_buffer()).reshape((SIDE + 2 * margin + 1,) * d)
            cells = rows.column("cell_").to_numpy()
            order = np.argsort(cells, kind="stable")
            for some, window in _windows(cells[order], d, margin):
                first, rest = _factors(offset[order[some]], margin)
                out[order[some]] = scale * np.einsum("ja,ja->j", first @ v[window].reshape(len(first[0]), -1), rest)
        out[~np.isfinite(offset).all(1)] = np.nan
        return rows.select(names).append_column(name, pa.array(out))

    schema = ", ".join([*kept, *(f"{c} {'double' if c.startswith('offset') else 'int'}" for c in added)])
    rows = _dealt(settle(df.mapInArrow(place, schema)), d)
    salts = rows.groupBy(*_names(d)).agg(F.max("salts_").alias("salts_"))  # a row a tile
    copies = grid.join(salts, _names(d)).select(*_names(d), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts_") - 1)).alias("salt_"), "grid")
    keys = [*_names(d), "salt_"]
    left, right = (x.repartition(parts, *keys).groupBy(*keys) for x in (rows.drop("salts_"), copies))
    return left.cogroup(right).applyInArrow(sums, ", ".join([*kept, f"`{name}` double"]))
