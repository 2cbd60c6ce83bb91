"""Score matching over a Hermite dictionary: sufficient statistics in one pass, solves on the driver.

Statistics (n, A, b, C) are sums over rows, so they merge across partitions, folds and micro-batches. The production path
adds numpy blocks up on Arrow batches, one row of partial sums a partition and axis; grams of a few terms can also be SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.hermite import Index, feature_blocks, gradient_sql, term_sql, total_degrees, values
from skerry.functions.sqltext import num


@dataclass
class Stats:
    """Means over n rows: A = E sum_i f_i f_i', b = E sum_i (z_i f_i - f_ii), C[i] = E f_i, all over the dictionary."""

    n: int
    A: np.ndarray
    b: np.ndarray
    C: np.ndarray

    def merged(self, other: Stats) -> Stats:
        n = self.n + other.n
        p, q = self.n / n, other.n / n
        return Stats(n, p * self.A + q * other.A, p * self.b + q * other.b, p * self.C + q * other.C)


def block_sums(z: np.ndarray, indices: list[Index], weights: np.ndarray | None = None, scores: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the rows of z. weights: one a coordinate. scores: rows of score labels in place of the derivative form."""
    m, d = len(indices), z.shape[1]
    A, b, C = np.zeros((m, m)), np.zeros(m), np.zeros((d, m))
    for i in range(d):
        here, first, second = feature_blocks(z, indices, i, scores is None)
        w = 1.0 if weights is None else float(weights[i])
        A[np.ix_(here, here)] += w * (first.T @ first)
        b[here] += w * (first.T @ scores[:, i] if scores is not None else z[:, i] @ first - second.sum(0))
        C[i, here] += first.sum(0)
    return A, b, C


_ROWS_SQL = "fold int, k int, v array<double>"


def _added_up(parts: DataFrame) -> dict[int, dict[int, np.ndarray]]:
    """Rows of partial sums (fold, k, v) of all partitions, added up in Spark: by fold and k."""

    def added(table: pa.Table) -> pa.Table:
        rows = np.stack(table.column("v").to_pylist())
        return pa.table([table.column("fold")[:1].cast(pa.int32()), table.column("k")[:1].cast(pa.int32()), pa.array([rows.sum(0)], pa.list_(pa.float64()))], names=["fold", "k", "v"])

    sums = parts.groupBy("fold", "k").applyInArrow(added, _ROWS_SQL).toArrow()
    raw: dict[int, dict[int, np.ndarray]] = {}
    for f, k, v in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), sums.column(2), strict=True):
        raw.setdefault(f, {})[k] = v.values.to_numpy()
    return raw


@dataclass
class ScoreMoments:
    """Means over n rows of a score field t and its rows z: C = E t t', TZ = E t z', ZZ = E z z', and E |t|^4."""

    n: int
    C: np.ndarray
    TZ: np.ndarray
    ZZ: np.ndarray
    fourth: float

    def stein_residual(self) -> float:
        """How far TZ is from ZZ - I, relative to the latter."""
        s = self.ZZ - np.eye(len(self.ZZ))
        scale = np.linalg.norm(s)
        return float(np.linalg.norm(self.TZ - s) / (scale if scale >= 1e-12 else 1.0))


def score_moments(df: DataFrame, columns: list[str], indices: list[Index], theta: np.ndarray) -> ScoreMoments:
    """The moments of the score field t_i = sum_k theta_k d_i H_k in one pass; the field itself is never stored.

    Each partition returns 2 d + 1 rows. Rows with values that are not finite are left out.
    """
    d = len(columns)
    schema = pa.schema([("fold", pa.int32()), ("k", pa.int32()), ("v", pa.list_(pa.float64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * d + 1, 2 * d))
        for b in it:
            z = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(d)], 1).astype(float)
            z = z[np.isfinite(z).all(1)]
            t = np.empty_like(z)
            for i in range(d):
                here, first, _ = feature_blocks(z, indices, i, False)
                t[:, i] = first @ theta[here]
            both = np.concatenate((t, z), 1)
            total[: 2 * d] += both.T @ both
            total[2 * d, :2] += len(z), ((t**2).sum(1) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(total)), pa.int32()), pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=schema)

    raw = _added_up(df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(run, _ROWS_SQL))[0]
    n, fourth = raw[2 * d][:2]
    sums = np.stack([raw[k] for k in range(2 * d)]) / max(n, 1.0)
    return ScoreMoments(int(n), sums[:d, :d], sums[:d, d:], sums[d:, d:], float(fourth / max(n, 1.0)))


def statistics(df: DataFrame, columns: list[str], indices: list[Index], weights: np.ndarray | None = None, scores: list[str] | None = None, fold: str | None = None) -> dict[int, Stats]:
    """Statistics by fold (one fold 0 without a fold column), in one pass; partial sums are added up by Spark.

    Each partition returns one row a fold and matrix row, so the driver reads folds x dictionary rows.
    """
    m, d = len(indices), len(columns)
    schema = pa.schema([("fold", pa.int32()), ("k", pa.int32()), ("v", pa.list_(pa.float64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in it:
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns - 1)], 1).astype(float)
            folds = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            ok = np.isfinite(table).all(1)
            table, folds = table[ok], folds[ok]
            for f in np.unique(folds).tolist():
                rows = table[folds == f]
                got = block_sums(rows[:, :d], indices, weights, rows[:, d:] if scores else None)
                old = sums.setdefault(int(f), [np.zeros((m, m)), np.zeros(m), np.zeros((d, m)), np.zeros(1)])
                for x, y in zip(old, (*got, np.array([float(len(rows))])), strict=True):
                    x += y
        for f, (A, b, C, n) in sums.items():
            rows = [*A, b, *C, n]
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], schema=schema)

    picked = df.select(*(F.col(c).cast("double") for c in [*columns, *(scores or [])]), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))
    raw = _added_up(picked.mapInArrow(run, _ROWS_SQL))  # folds x (m + d + 2) rows
    out: dict[int, Stats] = {}
    for f, x in raw.items():
        n = float(x[m + 1 + d][0])
        out[f] = Stats(int(n), np.stack([x[k] for k in range(m)]) / n, x[m] / n, np.stack([x[m + 1 + i] for i in range(d)]) / n)
    return out


def gram_sql(df: DataFrame, columns: list[str], indices: list[Index]) -> DataFrame:
    """i, j, a for i <= j: the gram of a small dictionary by built-in aggregates alone."""
    cells, names = [], []
    for i, p in enumerate(indices):
        for j, q in enumerate(indices[i:], i):
            shared = [k for k in range(len(columns)) if k in p[0] and k in q[0]]
            text = " + ".join(f"{gradient_sql(p, columns, k)} * {gradient_sql(q, columns, k)}" for k in shared) or num(0.0)
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.expr(f"avg({text})").alias("a")))
            names.append((i, j))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def rhs_sql(df: DataFrame, columns: list[str], indices: list[Index]) -> DataFrame:
    """k, b by built-in aggregates."""
    cells = []
    for k, index in enumerate(indices):
        parts = [f"{columns[i]} * {gradient_sql(index, columns, i)}" for i in index[0]]
        parts += [f"-({s})" for i in index[0] if (s := gradient_sql(index, columns, i, 2))]
        cells.append(F.struct(F.lit(k).alias("k"), F.expr(f"avg({' + '.join(parts)})").alias("b")))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def centering_sql(df: DataFrame, columns: list[str], indices: list[Index]) -> DataFrame:
    """axis, k, c: means of the first derivatives."""
    cells = [F.struct(F.lit(i).alias("axis"), F.lit(k).alias("k"), F.expr(f"avg({g or num(0.0)})").alias("c")) for k, index in enumerate(indices) for i in range(len(columns)) for g in [gradient_sql(index, columns, i)]]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def features(df: DataFrame, columns: list[str], indices: list[Index], prefix: str = "psi") -> DataFrame:
    """Adds the dictionary's polynomials as columns."""
    return df.select("*", *(F.expr(term_sql(index, columns)).alias(f"{prefix}{k}") for k, index in enumerate(indices)))


def polynomial(theta: np.ndarray, columns: list[str], indices: list[Index]):
    """sum_k theta_k H_k as one column."""
    return F.expr(" + ".join(f"{num(t)} * {term_sql(index, columns)}" for t, index in zip(theta, indices, strict=True)) or num(0.0))


def score_columns(df: DataFrame, columns: list[str], indices: list[Index], theta: np.ndarray, prefix: str = "t") -> DataFrame:
    """Adds the score field t_i = sum_k theta_k d_i H_k, by numpy on Arrow batches."""
    keep = [c for c in df.columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"{prefix}{i} double" for i in range(len(columns)))])
    places = [keep.index(c) for c in columns]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            z = np.stack([b.column(p).to_numpy(zero_copy_only=False) for p in places], 1).astype(float)
            out = []
            for i in range(len(columns)):
                here, first, _ = feature_blocks(z, indices, i, False)
                out.append(pa.array(first @ theta[here]))
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *(f"{prefix}{i}" for i in range(len(columns)))])

    return df.mapInArrow(run, schema)


def second_moments(df: DataFrame, left: list[str], right: list[str] | None = None) -> DataFrame:
    """i, j, m = E[left_i right_j]; for one list, i <= j."""
    cells = []
    for i, a in enumerate(left):
        for j, b in enumerate(right or left):
            if right is not None or i <= j:
                cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.avg(F.col(a) * F.col(b)).alias("m")))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def matrix(cells: DataFrame, rows: int, cols: int, value: str, symmetric: bool = True) -> np.ndarray:
    """A small matrix from its cells."""
    out = np.zeros((rows, cols))
    for r in cells.collect():  # rows x cols at most
        out[r[0], r[1]] = r[value]
        if symmetric:
            out[r[1], r[0]] = r[value]
    return out


def stein_residual(df: DataFrame, columns: list[str], scores: list[str]) -> float:
    """How far E[t z'] is from E[z z'] - I, relative to the latter."""
    d = len(columns)
    tz = matrix(second_moments(df, scores, columns), d, d, "m", False)
    s = matrix(second_moments(df, columns), d, d, "m") - np.eye(d)
    scale = np.linalg.norm(s)
    return float(np.linalg.norm(tz - s) / (scale if scale >= 1e-12 else 1.0))


def degree_traces(stats: Stats, indices: list[Index], theta: np.ndarray) -> np.ndarray:
    """E |t_k|^2 of the score's part of each total degree, from the gram: no pass over the data."""
    degrees = total_degrees(indices)
    return np.array([theta[m] @ stats.A[np.ix_(m, m)] @ theta[m] if len(m := np.flatnonzero(degrees == k)) else 0.0 for k in range(1, degrees.max() + 1)])


def psi(z: np.ndarray, indices: list[Index]) -> np.ndarray:
    return values(z, indices)
