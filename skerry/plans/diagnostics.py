"""Diagnostics over fits: dictionaries of growing size, split-sample bounds, hierarchical truncation, decompositions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.hermite import Index, dictionary, total_degrees, values
from skerry.operators import solvers
from skerry.operators.ranks import asof_values, hash_halves, hash_parts, rank_gaussianize
from skerry.operators.scorematch import Stats, score_moments, statistics
from skerry.operators.subspace import complement, top_eigenvectors
from skerry.functions.normal import ndtri_sql


def align(theta: np.ndarray, small: list[Index], large: list[Index]) -> np.ndarray:
    """Coefficients over the larger dictionary, zero where the smaller one has no term."""
    known = dict(zip(small, theta, strict=True))
    if set(known) - set(large):
        raise ValueError("the larger dictionary lacks a term")
    return np.array([known.get(k, 0.0) for k in large])


def restrict(stats: Stats, large: list[Index], small: list[Index]) -> Stats:
    """The statistics of a dictionary that is part of another's: no pass over the data."""
    place = {k: i for i, k in enumerate(large)}
    at = [place[k] for k in small]
    return Stats(stats.n, stats.A[np.ix_(at, at)], stats.b[at], stats.C[:, at])


def saturation(ranked: DataFrame, z: list[str], ladder: list[tuple[int, int]], strength: float | None = None, most_bytes: float = 2e9) -> list[dict]:
    """Terms and trace of the fitted score's second moment for each (degree, order); one pass over the largest that fits."""
    fits = [c for c in ladder if 8.0 * len(dictionary(len(z), *c, linear=True)) ** 2 <= most_bytes]
    top = dictionary(len(z), max(c[0] for c in fits), max(c[1] for c in fits), linear=True)
    stats = statistics(ranked, z, top)[0]
    out = []
    for degree, order in fits:
        indices = dictionary(len(z), degree, order, linear=True)
        s = restrict(stats, top, indices)
        theta = solvers.ridge(s, indices, strength).theta
        out.append({"degree": degree, "order": order, "terms": len(indices), "trace": float(theta @ s.A @ theta)})
    return out


def transfer_ranks(pool: DataFrame, queries: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key and the normal quantiles of the queries' clipped ranks in the pool, for queries whose columns are all finite. Rows get
    them by value; no row is looked up by its key."""
    out = queries.select(key, *(F.col(c).cast("double").alias(f"{c}_of_") for c in columns))
    sizes = pool.agg(*(F.count(F.when(F.abs(F.col(c).cast("double")) < float("inf"), 1)).alias(f"n{k}") for k, c in enumerate(columns))).first()
    for n, c in zip(sizes, columns, strict=True):
        cdf = (F.greatest(F.lit(1), F.least(F.lit(n), F.col("below"))) / (n + 1)).cast("double").alias("cdf")
        found = asof_values(pool, queries, c).select(F.col("x").alias(f"{c}_of_"), cdf).select(f"{c}_of_", F.expr(ndtri_sql("cdf")).alias(f"{c}_z"))
        out = out.join(found, f"{c}_of_")
    return out.select(key, *(f"{c}_z" for c in columns))


def a_posteriori_bound(df: DataFrame, columns: list[str], key: str, r: int, degree: int, order: int, delta: float = 0.05) -> dict[str, float]:
    """Fit on one half; the other half's tail eigenvalues, and a bound on the mass outside that holds with 1 - delta."""
    halves = hash_halves(df.select(key, *columns), key)
    first, second = halves.where("fold = 0"), halves.where("fold = 1")
    z, d = [f"{c}_z" for c in columns], len(columns)
    indices = dictionary(d, degree, order)
    theta = solvers.ridge(statistics(rank_gaussianize(first, columns), z, indices)[0], indices).theta
    held = score_moments(transfer_ranks(first, second, columns, key).select(*z), z, indices, theta)
    tail = float(np.sort(np.linalg.eigvalsh(held.C))[: d - r].sum())
    return {"tail": tail, "fourth": held.fourth, "bound": tail + math.sqrt(d - r) * math.sqrt(held.fourth / (held.n * delta))}


def truncation_gap(ranked: DataFrame, z: list[str], key: str, small: tuple[int, int], large: tuple[int, int], strength: float | None = None) -> dict[str, float]:
    """Squared size of what the larger dictionary adds: two fits on a quarter each, crossed over the gram of the other half.

    One pass over the rows: the smaller dictionary's statistics are read off the larger one's. Parts are places in the order of
    one hash: the second half, and the quarters of the first. strength: of the ridge fits, by default a share of the gram's norm.
    """
    placed = hash_parts(ranked.select(key, *z), key, [4, 2], "part")
    a, b = dictionary(len(z), *small), dictionary(len(z), *large)
    stats = statistics(placed.select(*z, "part"), z, b, fold="part")
    gap = [solvers.ridge(stats[k], b, strength).theta - align(solvers.ridge(restrict(stats[k], b, a), a, strength).theta, a, b) for k in (0, 1)]
    held = stats[2].A
    return {"crossed": float(gap[0] @ held @ gap[1]), "naive": float(math.sqrt(max(gap[0] @ held @ gap[0], 0.0)))}


def penalised_risk(stats: Stats, held: Stats, indices: list[Index], penalty: str, strength: float) -> float:
    """Held-out risk of a solve under mean derivatives zero. penalty: identity, sobolev1 or sobolev2 (degree to the power 0, 1 or
    2) with _fixed (the strength itself) or _rows (over the number of rows); combined (the strength is c_cov); none."""
    degrees = total_degrees(indices).astype(float)
    base, _, kind = penalty.partition("_")
    if base == "combined":
        matrix_ = solvers.combined_penalty(stats, indices, stats.n, strength)
    else:
        power = {"none": 0, "identity": 0, "sobolev1": 1, "sobolev2": 2}[base]
        matrix_ = np.diag(strength / (stats.n if kind == "rows" else 1) * degrees**power)
    return solvers.heldout_risk(solvers.centred(stats, matrix_).theta, held)


def centring(stats: Stats, held: Stats, indices: list[Index]) -> list[dict]:
    """constraint, risk, residual: the combined penalty with and without mean derivatives held at zero, from the same statistics."""
    penalty = solvers.combined_penalty(stats, indices, stats.n)
    fits = {"centred": solvers.centred(stats, penalty).theta, "free": np.linalg.solve(stats.A + penalty, stats.b)}
    return [{"constraint": name, "risk": solvers.heldout_risk(t, held), "residual": float(np.linalg.norm(stats.C @ t))} for name, t in fits.items()]


#: Strengths that a search starts from, by penalty and kind.
STRENGTHS = {"combined": np.array([0.3, 1.0, 3.0, 10.0, 30.0]), "fixed": np.logspace(-6, 0, 19), "rows": np.logspace(-1, 4, 16)}


def ablation(stats: Stats, held: Stats, indices: list[Index]) -> list[dict]:
    """penalty, strength, risk of nine choices: the combined penalty at its published strength and tuned, identity and Sobolev
    penalties of order 1 and 2 tuned in both kinds, and none. Tuning takes the best of a grid, then of it and a third and three
    times of it. All solves start from the same statistics."""
    risk = lambda name, s: penalised_risk(stats, held, indices, name, s)
    out = [{"penalty": "combined", "strength": solvers.TRACE_C, "risk": risk("combined", solvers.TRACE_C)}]
    for name in ("combined", *(f"{b}_{k}" for b in ("identity", "sobolev1", "sobolev2") for k in ("fixed", "rows"))):
        best = min(STRENGTHS[name.partition("_")[2] or "combined"], key=lambda s: risk(name, s))
        best = min((best, best / 3, best * 3), key=lambda s: risk(name, s))
        out.append({"penalty": f"{name}_tuned", "strength": float(best), "risk": risk(name, best)})
    return [*out, {"penalty": "none", "strength": 1e-10, "risk": risk("none", 1e-10)}]


def capped_means(df: DataFrame, columns: list[str], indices: list[Index], thetas: np.ndarray, cap: float) -> DataFrame:
    """k, mean: the mean of min(potential, cap) for each row of coefficients, all over one pass of the features.

    Features and products stay in Arrow batches; a batch returns a row a coefficient vector.
    """
    places = [df.columns.index(c) for c in columns]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.stack([b.column(p).to_numpy(zero_copy_only=False) for p in places], 1).astype(float)
            total = np.minimum(values(x, indices) @ thetas.T, cap).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(thetas)), pa.int32()), pa.array(total), pa.array(np.full(len(thetas), len(x)), pa.int64())], ["k", "s", "n"])

    return df.mapInArrow(run, "k int, s double, n bigint").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("mean"))


def align_coefficients(small: DataFrame, large: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The larger dictionary's terms with the smaller one's coefficients, 0 where it has none."""
    return large.select(*keys).join(small.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def audit(claims: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, claimed, found, status of claims(keys, claimed, digits) against results(keys, found): ok where the result rounds to
    the claim, else differs, or missing."""
    joined = claims.join(results.select(*keys, "found"), keys, "left")
    near = F.abs(F.col("found") - F.col("claimed")) <= 0.5000001 * F.pow(F.lit(10.0), -F.col("digits"))
    status = F.when(F.col("found").isNull() | F.isnan("found"), "missing").when(near, "ok").otherwise("differs")
    return joined.select(*keys, "claimed", "found", status.alias("status"))


def divergence(df: DataFrame, truth: str, model: str, group: list[str]) -> DataFrame:
    """group, n, kl and its standard error: means of log-density differences."""
    gap = F.col(truth) - F.col(model)
    return df.groupBy(*group).agg(F.count(gap).alias("n"), F.avg(gap).alias("kl"), (F.stddev_samp(gap) / F.sqrt(F.count(gap))).alias("se"))


def decomposition(df: DataFrame, steps: list[str]) -> dict[str, float]:
    """Mean gap between each log density and the next: the parts of the first one's divergence from the last."""
    row = df.agg(*(F.avg(F.col(a) - F.col(b)).alias(f"{a}_{b}") for a, b in zip(steps, steps[1:], strict=False))).first()
    return row.asDict()


def quadrature_kl(log_joint, log_reduced, u: np.ndarray, outside: int, nodes: int = 7) -> np.ndarray:
    """For each u, E of exp(l) * l over Gauss-Hermite nodes outside the subspace, l the excess of the joint over the reduced."""
    x, w = np.polynomial.hermite_e.hermegauss(nodes)
    grid = np.stack(np.meshgrid(*[x] * outside, indexing="ij"), -1).reshape(-1, outside)
    weight = np.prod(np.stack(np.meshgrid(*[w / w.sum()] * outside, indexing="ij"), -1).reshape(-1, outside), 1)
    gap = np.stack([log_joint(np.column_stack([np.repeat(row[None], len(grid), 0), grid])) - log_reduced(row[None]) for row in u])
    return (weight * np.exp(gap) * gap).sum(1)


def outside_mass(c: np.ndarray, r: int) -> float:
    v = top_eigenvectors(c, r)[1]
    p = complement(v)
    return float(np.trace(p.T @ c @ p))
