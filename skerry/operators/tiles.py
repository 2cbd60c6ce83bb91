"""Grams of large dictionaries as tables of tiles, and solves that only multiply by them.

With m terms a gram has m x m cells; here no task and no driver holds them. Terms fall into tiles, and pairs of tiles into
blocks of bounded bytes. For each block Spark scans the rows once and every task adds up its partial products, keyed by tile
row and tile column; the partial tiles of a key are added one after the other, so a task holds one block, or two tiles. Only
tiles on and above the diagonal are kept.

Solves are conjugate gradients on the diagonally scaled system: each step is one pass over the tiles that multiplies them by a
thin matrix of m rows, which is all that the driver holds. A dictionary of Hermite terms on normal scores is nearly diagonal
after scaling, so few steps are needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.hermite import Index, feature_blocks, total_degrees
from skerry.plans.storage import bounded_batches, settle

TILE = 512
BLOCK_BYTES = 128 << 20
_CELLS = 1 << 20
_TILES = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("v", pa.list_(pa.float64()))])
_TILES_SQL = "row int, col int, v array<double>"
#: In place of a column of tiles: the right side, the number of rows, and from here on the means of first derivatives by axis.
_RIGHT, _COUNT, _CENTRING = -1, -2, -3


@dataclass
class Tiled:
    """The gram A, as tiles (row, col, v) with row <= col, and what is as short as the dictionary: b and C."""

    tiles: DataFrame
    n: int
    m: int
    size: int
    b: np.ndarray
    C: np.ndarray

    def product(self, x: np.ndarray) -> np.ndarray:
        """A x for a vector or a thin matrix of m rows: one pass over the tiles."""
        thin = x.reshape(self.m, -1)
        size, m, wide = self.size, self.m, thin.shape[1]

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}

            def add(k: int, part: np.ndarray) -> None:
                sums[k] = sums[k] + part if k in sums else part

            for b in it:
                for i, j, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    tile = v.values.to_numpy().reshape(min(size, m - i * size), -1)
                    add(i, tile @ thin[j * size : (j + 1) * size])
                    if i != j:
                        add(j, tile.T @ thin[i * size : (i + 1) * size])
            if sums:
                yield _batch([(k, 0, v.ravel()) for k, v in sums.items()])

        out = np.zeros((m, wide))
        added = summed(self.tiles.mapInArrow(run, _TILES_SQL))
        for k, v in zip(*(added.toArrow().column(c) for c in (0, 2)), strict=True):  # m x wide numbers
            k = k.as_py()
            out[k * size : (k + 1) * size] = v.values.to_numpy().reshape(-1, wide)
        return out.reshape(x.shape)

    def diagonal(self) -> np.ndarray:
        size, m, out = self.size, self.m, np.zeros(self.m)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield _batch([(k, 0, np.diagonal(v.values.to_numpy().reshape(min(size, m - k * size), -1))) for k, v in zip(b.column(0).to_pylist(), b.column(2), strict=True)])

        for k, _, v in self.tiles.where("row = col").mapInArrow(run, _TILES_SQL).collect():  # m numbers
            out[k * size : k * size + len(v)] = v
        return out


def _batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TILES, strict=True)], schema=_TILES)


def summed(parts: DataFrame) -> DataFrame:
    """Rows of equal row and col added up, one after the other: a task holds two tiles, however many parts there are."""
    bounded_batches(parts.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in it:
            for i, j, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if key != (i, j):
                    if key:
                        yield _batch([(*key, total)])
                    key, total = (i, j), v.values.to_numpy().copy()
                else:
                    total += v.values.to_numpy()
        if key:
            yield _batch([(*key, total)])

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "row", "col").sortWithinPartitions("row", "col").mapInArrow(run, _TILES_SQL)


def blocks_of(m: int, size: int, block_bytes: int) -> list[tuple[range, range]]:
    """Pairs of ranges of tiles, the second not before the first, whose sums fit the bytes."""
    side = max(1, int((block_bytes / 8) ** 0.5) // size)
    many = -(-m // size)
    strips = [range(k, min(k + side, many)) for k in range(0, many, side)]
    return [(a, b) for i, a in enumerate(strips) for b in strips[i:]]


def tiled_statistics(df: DataFrame, columns: list[str], indices: list[Index], size: int = TILE, block_bytes: int = BLOCK_BYTES) -> Tiled:
    """Means over the rows of df whose values are all finite: A = E sum_i f_i f_i' in tiles, b = E sum_i (z_i f_i - f_ii) and
    C[i] = E f_i. df is read once for each block of tiles; the rows' columns are written before if there is more than one."""
    m, d = len(indices), len(columns)
    blocks = blocks_of(m, size, block_bytes)
    z = df.select(*(F.col(c).cast("double") for c in columns))
    if len(blocks) > 1:
        z = settle(z)
    bounded_batches(z.sparkSession)
    tasks = max(1, z.sparkSession.sparkContext.defaultParallelism // len(blocks))  # partial sums are as many as tasks

    def partial(block: tuple[range, range]):
        rows, cols = ([*range(s.start * size, min(m, s.stop * size))] for s in block)
        left, right = [indices[k] for k in rows], [indices[k] for k in cols]
        same = block[0] == block[1]

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, right_side, centring, n = np.zeros((len(left), len(right))), np.zeros(len(left)), np.zeros((d, len(left))), 0
            step = max(64, _CELLS // max(1, len(left) + len(right)))
            for b in it:
                every = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(d)], 1).astype(float)
                every = every[np.isfinite(every).all(1)]
                n += len(every)
                for at in range(0, len(every), step):
                    x = every[at : at + step]
                    for i in range(d):
                        here, first, second = feature_blocks(x, left, i, same)
                        there, other = (here, first) if same else feature_blocks(x, right, i, False)[:2]
                        if len(here) and len(there):
                            total[np.ix_(here, there)] += first.T @ other
                        if same and len(here):
                            right_side[here] += x[:, i] @ first - second.sum(0)
                            centring[i, here] += first.sum(0)
            if not n:
                return
            for a, i in enumerate(block[0]):
                for c, j in enumerate(block[1]):
                    if i <= j:
                        yield _batch([(i, j, total[a * size : (a + 1) * size, c * size : (c + 1) * size].ravel())])
                if same:
                    cut = slice(a * size, (a + 1) * size)
                    yield _batch([(i, _RIGHT, right_side[cut]), *((i, _CENTRING - k, centring[k, cut]) for k in range(d))])
            if block[0].start == block[1].start == 0:
                yield _batch([(0, _COUNT, np.array([float(n)]))])

        return run

    parts = reduce(DataFrame.unionByName, [z.coalesce(tasks).mapInArrow(partial(b), _TILES_SQL) for b in blocks])
    every = settle(summed(parts))
    counted = every.where(F.col("col") == _COUNT).collect()
    n = int(counted[0]["v"][0]) if counted else 0
    b, C = np.zeros(m), np.zeros((d, m))
    for i, j, v in every.where((F.col("col") < 0) & (F.col("col") != _COUNT)).collect():  # (d + 1) x m numbers
        (b if j == _RIGHT else C[_CENTRING - j])[i * size : i * size + len(v)] = v
    tiles = every.where("col >= 0").withColumn("v", F.transform("v", lambda x: x / max(n, 1)))
    return Tiled(tiles, n, m, size, b / max(n, 1), C / max(n, 1))


def solve(gram: Tiled, right: np.ndarray, strength: float, tolerance: float = 1e-11, most: int = 500) -> tuple[np.ndarray, dict]:
    """(A + strength I) theta = right by conjugate gradients on the system scaled by its diagonal; a report says how it ended."""
    scale = 1 / np.sqrt(np.maximum(gram.diagonal() + strength, 1e-300))
    apply = lambda y: scale * (gram.product(scale * y) + strength * scale * y)
    rest = scale * right
    y, way, left, goal = np.zeros_like(rest), rest.copy(), float(rest @ rest), float(rest @ rest) * tolerance**2
    steps = 0
    while left > goal and steps < most:
        ahead = apply(way)
        far = left / float(way @ ahead)
        y, rest = y + far * way, rest - far * ahead
        left, before = float(rest @ rest), left
        way = rest + left / before * way
        steps += 1
    return scale * y, {"steps": steps, "residual": float(np.sqrt(left / max(goal, 1e-300)) * tolerance), "converged": left <= goal}


def degree_traces(gram: Tiled, indices: list[Index], theta: np.ndarray) -> np.ndarray:
    """E |t_k|^2 of the score's part of each total degree, all degrees in one pass over the tiles."""
    degrees = total_degrees(indices)
    parts = np.where(degrees[:, None] == np.arange(1, degrees.max() + 1), theta[:, None], 0.0)
    return (parts * gram.product(parts)).sum(0)
