"""Leading eigenpairs of the second moment of long vectors, without the moment matrix.

The rows are a tall matrix T of n rows and d columns. A thin block Q of d rows is carried through passes T'(T Q): each task
multiplies its rows, sends one block, and blocks are added in a tree. What a pass adds to the directions so far is the next
block, and the best combinations of all directions are the estimates. At the end each task takes the QR of its rows times
these and sends the small triangle; triangles are stacked and factored again in the same tree, so the last one is that of all
rows. Its singular values and vectors give the eigenpairs. Tasks hold blocks of d x (rank + extra) numbers, the driver one for
each pass, of d x d numbers at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.subspace import orthonormal

_PART = pa.schema([("task", pa.int32()), ("v", pa.list_(pa.float64()))])
_PART_SQL = "task int, v array<double>"

Merge = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch that have d finite values."""
    column = batch.column(0).drop_null()
    column = column.filter(pa.compute.equal(pa.compute.list_value_length(column), d))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    return x[np.isfinite(x).all(1)]


def reduced(vectors: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], merge: Merge) -> np.ndarray | None:
    """part(rows) of every batch, merged in each task, then in a tree of two levels, then here. None without rows."""
    fan = max(1, int(vectors.rdd.getNumPartitions() ** 0.5))

    def merged(values: Iterator[np.ndarray], task: int) -> Iterator[pa.RecordBatch]:
        total = None
        for v in values:
            total = v if total is None else merge(total, v)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], schema=_PART)

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from merged((part(x) for b in it if len(x := _rows(b, d))), TaskContext.get().partitionId() % fan)

    def second(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged((v.values.to_numpy().reshape(-1, width) for b in it for v in b.column(1)), 0)

    width = part(np.zeros((1, d))).shape[1]
    found = vectors.mapInArrow(first, _PART_SQL).repartition(fan, "task").mapInArrow(second, _PART_SQL)
    total = None
    for v in found.select("v").toArrow().column(0):  # a block for each of `fan` tasks
        block = v.values.to_numpy().reshape(-1, width)
        total = block if total is None else merge(total, block)
    return total


def eigenpairs(df: DataFrame, vector: str | Column, d: int, rank: int, extra: int = 8, most: int = 60, tolerance: float = 1e-10, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest eigenvalues of E[t t'], descending, their vectors as columns, and the number of rows. vector: an array column
    of d numbers; rows that are null, of another length or not finite are left out. Passes end when no estimate of an eigenvalue
    changes by more than the tolerance, as a share of the largest, or after `most`; one more follows."""
    if rank > d:
        raise ValueError("the rank exceeds the dimension")
    vectors = df.select((F.col(vector) if isinstance(vector, str) else vector).cast("array<double>").alias("v"))
    q = orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, rank + extra))))
    basis, image, before = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros(rank)
    for _ in range(most):
        block = reduced(vectors, d, lambda x, q=q: x.T @ (x @ q), np.add)
        if block is None:
            return np.zeros(rank), np.eye(d)[:, :rank], 0
        basis, image = np.column_stack([basis, q]), np.column_stack([image, block])
        now, w = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        now = now[::-1][:rank]
        if basis.shape[1] >= d or abs(now - before).max() <= tolerance * max(now[0], 1e-300):
            break
        before = now
        for _ in range(2):  # what the block adds to the directions so far
            block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        q = u[:, s > 1e-12 * max(float(np.linalg.norm(image)), 1e-300)][:, : d - basis.shape[1]]
        if not q.shape[1]:
            break
    q = orthonormal(basis @ w[:, ::-1][:, :rank])
    k = q.shape[1]

    def triangle(x: np.ndarray) -> np.ndarray:
        """R of the rows, and under it a row with their number."""
        r = np.zeros((k + 1, k))
        r[: min(k, len(x))] = np.linalg.qr(x @ q, "r")
        r[k, 0] = len(x)
        return r

    def stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.vstack([np.linalg.qr(np.vstack([a[:k], b[:k]]), "r"), a[k:] + b[k:]])

    r = reduced(vectors, d, triangle, stacked)
    n = int(r[k, 0])
    _, s, w = np.linalg.svd(r[:k])
    v = q @ w.T[:, :rank]
    v *= np.where(np.take_along_axis(v, np.abs(v).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)  # the largest entry is positive
    return s[:rank] ** 2 / n, v, n
