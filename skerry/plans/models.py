"""Density models over a DataFrame of samples: fit with Spark aggregates, evaluate with Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import normal_np as N
from skerry.functions.hermite import Index, dictionary, feature_blocks, values
from skerry.functions.normal import LOG_2PI
from skerry.functions.sobol import sobol
from skerry.operators import solvers
from skerry.operators.constrained import fit_constrained
from skerry.operators.marginals import Marginal, fit_marginals
from skerry.operators.ranks import hash_halves, quantiles, rank_gaussianize
from skerry.operators.scorematch import matrix, score_columns, score_moments, second_moments, statistics
from skerry.operators.samples import column_groups
from skerry.operators.subspace import top_eigenvectors
from skerry.plans import grids, pairs
from skerry.plans.storage import settle

CAP_SHARE = 0.999


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """Adds double columns that fn makes from the rows of the given columns."""
    places = [df.columns.index(c) for c in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` double" for n in names)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.stack([b.column(p).to_numpy(zero_copy_only=False) for p in places], 1).astype(float)
            made = fn(x)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(made[n], pa.float64()) for n in names)], [*b.schema.names, *names])

    return df.mapInArrow(run, schema)


@dataclass
class ProductOfMarginals:
    columns: list[str]
    marginals: list[Marginal] = field(default_factory=list)

    def fit(self, df: DataFrame) -> ProductOfMarginals:
        """A marginal for each column; columns with the same values share one."""
        same = column_groups(df, self.columns) if len(self.columns) > 1 else {c: c for c in self.columns}
        fitted = fit_marginals(df, list(dict.fromkeys(same.values())))
        self.marginals = [fitted[same[c]] for c in self.columns]
        return self

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return sum(m.log_pdf(x[:, j]) for j, m in enumerate(self.marginals))

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """Normal quantiles of the marginals' distribution functions."""
        return np.stack([N.ndtri(m.distribution(x[:, j])) for j, m in enumerate(self.marginals)], 1)

    def evaluate(self, df: DataFrame, name: str = "log_density") -> DataFrame:
        return map_rows(df, self.columns, lambda x: {name: self.log_density(x)}, [name])


def log_copula_of(log_density: Callable[[np.ndarray], np.ndarray], marginals: list[Marginal], z: np.ndarray) -> np.ndarray:
    """log density of normal scores z against the standard normal, for a density of the columns whose marginals are fitted."""
    x = np.stack([m.quantile(N.ndtr(z[:, j])) for j, m in enumerate(marginals)], 1)
    return log_density(x) - sum(m.log_pdf(x[:, j]) for j, m in enumerate(marginals))


@dataclass
class GaussianCopula(ProductOfMarginals):
    correlation: np.ndarray | None = None
    log_mass: float = 0.0

    def fit(self, df: DataFrame) -> GaussianCopula:
        super().fit(df)
        z = [f"{c}_z" for c in self.columns]
        ranked = map_rows(df, self.columns, lambda x: dict(zip(z, self.ranks(x).T, strict=True)), z)
        d = len(z)
        cells = ranked.agg(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.corr(z[i], z[j]).alias("r")) for i in range(d) for j in range(i, d))).alias("c"))
        self.correlation = matrix(cells.select(F.explode("c").alias("c")).select("c.*"), d, d, "r") + 1e-6 * np.eye(d)
        self.log_mass = log_mass(self.marginals, self.log_factor)
        return self

    def log_factor(self, x: np.ndarray) -> np.ndarray:
        """The copula's part, before its mass under the marginals is taken off."""
        z = self.ranks(x)
        excess = np.linalg.inv(self.correlation) - np.eye(z.shape[1])
        return -0.5 * np.linalg.slogdet(self.correlation)[1] - 0.5 * np.einsum("ni,ij,nj->n", z, excess, z)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return super().log_density(x) + self.log_factor(x) - self.log_mass


@dataclass
class KernelDensity:
    """A full-dimensional Gaussian kernel density with Scott's bandwidth on the marginals' normal scores, pulled back to the
    columns. Every row is a centre; equal rows are one with a weight. Rows without finite values are no centres.

    Up to three columns are summed by way of a grid (`grids`), with work in proportion to the rows; with more, a row meets only the
    centres within a reach of it. What either leaves out stays below `TRUNCATED`; rows whose sum is so small that this matters are
    summed over all centres.
    """

    columns: list[str]
    base: ProductOfMarginals | None = None
    centres: DataFrame | None = None
    tree: pairs.Tree | None = None
    grid: DataFrame | None = None
    n: int = 0
    root: np.ndarray | None = None

    def fit(self, df: DataFrame) -> KernelDensity:
        self.base = ProductOfMarginals(self.columns).fit(df)
        d = len(self.columns)
        z = [f"z{j}" for j in range(d)]
        base = self.base
        ranked = map_rows(df.select(*self.columns), self.columns, lambda x: dict(zip(z, base.ranks(x).T, strict=True)), z)
        ranked = ranked.where(" AND ".join(f"NOT isnan({c})" for c in z))
        cells = ranked.agg(F.count("*").alias("n"), *(F.covar_samp(z[i], z[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(d))).first()
        self.n = cells["n"]
        cov = np.array([[cells[f"c{i}_{j}"] for j in range(d)] for i in range(d)])
        self.root = root = np.linalg.inv(np.linalg.cholesky(cov * self.n ** (-2 / (d + 4))))
        whiten = lambda x: base.ranks(x) @ root.T
        rows = settle(pairs.weighted(df, self.columns))
        self.tree = pairs.tree_of(rows, self.columns, whiten)
        self.centres = pairs.pack(rows, self.columns, whiten, self.tree, weight="w_", keep=False)
        self.grid = grids.spread(self.centres, d, self._reach()) if d <= grids.MOST_AXES else None
        return self

    def evaluate(self, df: DataFrame, name: str = "log_density") -> DataFrame:
        d = len(self.columns)
        # the workers get what they need; the table of centres stays with the driver
        base, root, log_norm = self.base, self.root, math.log(self.n) + d / 2 * LOG_2PI - float(np.log(np.diag(self.root)).sum())
        if self.grid is None:
            sums = self._pair_sums(df)
        else:
            sums = settle(grids.gather(df, self.columns, lambda x: base.ranks(x) @ root.T, self.grid, d, self._reach(), _SUM))
            small = F.col(_SUM) < 1e6 * TRUNCATED
            if sums.where(small).limit(1).count():  # rows far from all centres
                sums = sums.where(~small).unionByName(self._pair_sums(sums.where(small).drop(_SUM)))

        def log(x: np.ndarray) -> dict[str, np.ndarray]:
            x, total = x[:, :-1], x[:, -1]
            back = base.log_density(x) + (0.5 * base.ranks(x) ** 2).sum(1) + d / 2 * LOG_2PI
            return {name: np.log(np.maximum(total, 1e-300)) - log_norm + back}

        return map_rows(sums, [*self.columns, _SUM], log, [name]).select(*df.columns, name)

    def _reach(self) -> float:
        """How far a row's part of the grid goes, so that what all centres leave out stays below TRUNCATED."""
        return math.sqrt(math.log(max(self.n, 2) / TRUNCATED))

    def _pair_sums(self, df: DataFrame) -> DataFrame:
        """df with its rows' sums over near centres, and over all for blocks with a row far from all centres."""
        d, base, root = len(self.columns), self.base, self.root
        whiten = lambda x: base.ranks(x) @ root.T
        queries = pairs.pack(df, self.columns, whiten, self.tree)
        near = pairs.near_leaves(queries, self.centres, d, math.sqrt(2 * math.log(max(self.n, 2) / TRUNCATED)))
        sums = settle(pairs.over_pairs(queries, self.centres, near, d, kernel_sums, np.add))

        def small(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                low = [number for number, v in zip(b.column(0).to_pylist(), b.column(1), strict=True) if np.nanmin(np.frombuffer(v.as_buffer()), initial=1.0) < 1e6 * TRUNCATED]
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64())], ["block"])

        left = queries.select("block").join(sums.select("block"), "block", "left_anti").unionByName(sums.select("block", "value").mapInArrow(small, "block bigint"))
        rest = queries.join(settle(left), "block")
        if rest.count():  # blocks with a row far from all centres
            whole = pairs.over_pairs(rest, self.centres, pairs.near_leaves(rest, self.centres, d, math.inf), d, kernel_sums, np.add)
            sums = sums.join(left, "block", "left_anti").unionByName(whole)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{_SUM} double"])

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for rows, value in zip(b.column(0), b.column(1), strict=True):
                    at, total = 0, np.frombuffer(value.as_buffer())
                    for r in pairs.unpack(rows):
                        yield pa.RecordBatch.from_arrays([*r.columns, pa.array(total[at : at + r.num_rows], pa.float64())], [*r.schema.names, _SUM])
                        at += r.num_rows

        return queries.select("block", "rows").join(sums.select("block", "value"), "block").select("rows", "value").mapInArrow(run, schema)


_SUM = "kernel_sum_"
#: What the kernels of all centres out of reach may add up to.
TRUNCATED = 1e-11


def kernel_sums(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of standard Gaussian kernels, without their constant, at a over the centres b of weights w."""
    q = a @ b.T
    q -= 0.5 * (a**2).sum(1)[:, None]
    q -= 0.5 * (b**2).sum(1)
    return (np.exp(np.minimum(q, 0, out=q), out=q) @ w)[:, None]


def log_mean_exp(x: np.ndarray) -> float:
    """-inf values count; NaN or +inf is an error."""
    if np.isnan(x).any() or np.isposinf(x).any():
        raise ValueError("a value is NaN or +inf")
    top = x.max()
    return float(top + np.log(np.exp(x - top).mean())) if np.isfinite(top) else -math.inf


def log_mass(marginals: list[Marginal], log_factor: Callable[[np.ndarray], np.ndarray], points: int = 1 << 14, seed: int = 0) -> float:
    """log E of a factor under the product of the marginals, by shifted Sobol points. Their distribution functions are those of the smoothed
    densities, so a quantile is a centre and its jitter in one."""
    u = sobol(points, len(marginals), seed)
    return log_mean_exp(log_factor(np.stack([m.quantile(u[:, j]) for j, m in enumerate(marginals)], 1)))


@dataclass
class ReducedDensity:
    """log p(x) = L(V' z(x)) + sum_i log f_i(x_i) - log Z - log M: ranks, a subspace from score matching on z, a polynomial from
    score matching on the projections, kernel marginals, and the mass M that all this has.

    secondary: rank the projections again and fit on these scores. rho: weigh coordinate j of the inner fit by 1 + rho / (l_j +
    eps_w), with l the subspace's eigenvalues or those given. labels: fit the inner part to the first stage's projected scores
    in place of the derivative form.
    """

    columns: list[str]
    r: int
    degree: int = 4
    order: int = 2
    inner_degree: int = 4
    inner_order: int | None = None
    even: bool = False
    scheme: str = "heldout"
    constrained: bool = False
    points: int = 1 << 14
    seed: int = 0
    secondary: bool = False
    rho: float = 0.0
    eps_w: float = 1e-2
    eigenvalues: np.ndarray | None = None
    labels: bool = False
    base: ProductOfMarginals | None = None
    second: ProductOfMarginals | None = None
    V: np.ndarray | None = None
    theta: np.ndarray | None = None
    inner: list[Index] = field(default_factory=list)
    cap: float = math.inf
    log_z: float = 0.0
    log_mass: float = 0.0
    info: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, key: str, V: np.ndarray | None = None) -> ReducedDensity:
        """key: a column that tells rows apart, for the held-out halves."""
        d = len(self.columns)
        self.base = ProductOfMarginals(self.columns).fit(df)
        z = [f"z{j}" for j in range(d)]
        ranked = map_rows(df.select(key, *self.columns), self.columns, lambda x: dict(zip(z, self.base.ranks(x).T, strict=True)), z).select(key, *z)
        if V is None:
            ranked = settle(ranked)  # read twice for the subspace, and once more
        first = subspace_of(ranked, z, self.r, self.degree, self.order, self.even) if V is None else None
        self.V = V if first is None else first[0]
        u = [f"u{j}" for j in range(self.r)]
        weights = None
        if self.rho:
            if self.eigenvalues is None and first is None:
                raise ValueError("weights need the subspace's eigenvalues")
            weights = 1 + self.rho / (np.asarray(first[1]["eigenvalues"] if self.eigenvalues is None else self.eigenvalues, float) + self.eps_w)
        if self.labels:
            if first is None:
                raise ValueError("labels need the first stage's score")
            t = [f"t{j}" for j in range(d)]
            scored = score_columns(ranked.select(key, *z), z, first[1]["indices"], first[1]["theta"])
            ranked = project(scored, t, self.V, [f"s{j}" for j in range(self.r)])
        labels = [f"s{j}" for j in range(self.r)] if self.labels else []
        projected = project(ranked, z, self.V, u).select(key, *u, *labels)
        if self.secondary:
            projected = settle(projected)
            self.second = ProductOfMarginals(u).fit(projected)
            projected = self._ranked_again(projected, u, labels)
        self.inner = dictionary(self.r, self.inner_degree, self.inner_order or self.r, linear=True)
        halves = hash_halves(settle(projected), key, self.seed).select("fold", *u, *labels)
        folds = statistics(halves, u, self.inner, weights, labels or None, fold="fold")
        both = folds[0].merged(folds[1]) if len(folds) == 2 else next(iter(folds.values()))
        solution = solvers.by_scheme(self.scheme, both, self.inner, (folds[0], folds[1]) if len(folds) == 2 else None)
        self.theta = solution.theta
        potential = halves.select(_poly(u, self.theta, self.inner).alias("l_"))
        level = float(quantiles(potential, "l_", {"level": CAP_SHARE}, []).first().level)
        if self.constrained:
            radius = float(halves.agg(F.max(F.sqrt(sum((F.col(c) ** 2 for c in u), F.lit(0.0))))).first()[0])
            n = both.n
            c = (solution.info.get("c_cov", solvers.TRACE_C), solution.info.get("c_sob", solvers.SOBOLEV))
            m = both.A + solvers.combined_penalty(both, self.inner, n, *c)
            self.theta, self.info = fit_constrained(m, both.b, both.C, self.inner, self.inner_degree, level, self.theta, max(18.0, 1.5 * radius), self.r)
        else:
            self.cap = level
        nodes = N.ndtri(sobol(self.points, self.r, self.seed))
        self.log_z = log_mean_exp(self.potential(nodes))
        self.log_mass = log_mass(self.base.marginals, self.log_factor, self.points, self.seed)
        return self

    def _ranked_again(self, projected: DataFrame, u: list[str], labels: list[str]) -> DataFrame:
        """Scores of the projections' own marginals in place of the projections; labels follow by the chain rule."""
        second, r = self.second, self.r

        def again(x: np.ndarray) -> dict[str, np.ndarray]:
            v = second.ranks(x[:, :r])
            back = [-0.5 * v[:, j] ** 2 - 0.5 * LOG_2PI - second.marginals[j].log_pdf(x[:, j]) for j in range(r)]
            return {f"v{j}": v[:, j] for j in range(r)} | {f"w{j}": x[:, r + j] * np.exp(back[j]) for j in range(len(labels))}

        names = [*(f"v{j}" for j in range(r)), *(f"w{j}" for j in range(len(labels)))]
        key = projected.columns[0]
        made = map_rows(projected, [*u, *labels], again, names).select(key, *names)
        return made.toDF(key, *u, *labels)

    def log_factor(self, x: np.ndarray) -> np.ndarray:
        """The reduced part, before its mass under the marginals is taken off."""
        return self._reduced(self.base.ranks(x) @ self.V)

    def _reduced(self, u: np.ndarray) -> np.ndarray:
        """log density of the projections against the standard normal."""
        if not self.secondary:
            return self.potential(u) - self.log_z
        return self.potential(self.second.ranks(u)) - self.log_z + self.second.log_density(u) + (0.5 * u**2).sum(1) + 0.5 * u.shape[1] * LOG_2PI

    def potential(self, u: np.ndarray) -> np.ndarray:
        return np.minimum(values(u, self.inner) @ self.theta, self.cap)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return self.log_factor(x) + self.base.log_density(x) - self.log_mass

    def log_density_u(self, u: np.ndarray) -> np.ndarray:
        """Density of the projections under the model."""
        return self._reduced(u) - 0.5 * (u**2).sum(1) - 0.5 * u.shape[1] * LOG_2PI

    def gradient_u(self, u: np.ndarray) -> np.ndarray:
        """Gradient of log_density_u from the polynomials' derivatives; zero slope of the potential above the cap."""
        if self.secondary:
            raise NotImplementedError("the gradient is that of the model on the projections themselves")
        open_ = values(u, self.inner) @ self.theta < self.cap
        out = -u.copy()
        for j in range(u.shape[1]):
            here, slope, _ = feature_blocks(u, self.inner, j, False)
            out[:, j] += np.where(open_, slope @ self.theta[here], 0.0)
        return out

    def evaluate(self, df: DataFrame, name: str = "log_density") -> DataFrame:
        return map_rows(df, self.columns, lambda x: {name: self.log_density(x)}, [name])


def _poly(columns: list[str], theta: np.ndarray, indices: list[Index]):
    from skerry.operators.scorematch import polynomial

    return polynomial(theta, columns, indices)


def project(df: DataFrame, columns: list[str], V: np.ndarray, names: list[str]) -> DataFrame:
    """Adds u = V' z as unrolled dot products."""
    return df.select("*", *(sum((F.col(c) * float(V[i, j]) for i, c in enumerate(columns)), F.lit(0.0)).alias(n) for j, n in enumerate(names)))


def subspace_of(ranked: DataFrame, z: list[str], r: int, degree: int = 4, order: int = 2, even: bool = False, strength: float | None = None):
    """Leading eigenvectors of the fitted copula score's second moment, its eigenvalues and the fit. Two passes."""
    indices = dictionary(len(z), degree, order, even=even)
    stats = statistics(ranked, z, indices)[0]
    solution = solvers.ridge(stats, indices, strength)
    moments = score_moments(ranked.select(*z), z, indices, solution.theta)
    c = moments.C
    l, v = top_eigenvectors(c, r)
    return v, {"eigenvalues": l, "stein": moments.stein_residual(), "fourth": moments.fourth, "trace": float(np.trace(c)), "rest": float(np.trace(c) - l.sum()), "stats": stats, "theta": solution.theta, "C": c, "indices": indices}


def fit_subspace(df: DataFrame, columns: list[str], r: int, degree: int = 4, order: int = 2, even: bool = False):
    """The same from raw samples, by average ranks."""
    ranked = settle(rank_gaussianize(df.select(*columns), columns).select(*(f"{c}_z" for c in columns)))  # read twice
    return subspace_of(ranked, [f"{c}_z" for c in columns], r, degree, order, even)


def pca_subspace(ranked: DataFrame, z: list[str], r: int) -> np.ndarray:
    return top_eigenvectors(matrix(second_moments(ranked, z), len(z), len(z), "m"), r)[1]


def posterior_grid(spark, residual: Callable[[np.ndarray], np.ndarray], log_noise: Callable[[np.ndarray], np.ndarray], points: int = 80, half: float = 6.0, prior_sd: float = 1.0) -> DataFrame:
    """i, j, x, y, log_posterior (unnormalised) on a square grid for an observation's residuals."""
    axis = spark.range(points).select(F.col("id").cast("int").alias("i"), (F.col("id") * (2 * half / (points - 1)) - half).alias("x"))
    grid = axis.crossJoin(axis.select(F.col("i").alias("j"), F.col("x").alias("y")))  # points x points, a parameter

    def value(x: np.ndarray) -> dict[str, np.ndarray]:
        return {"log_posterior": -0.5 * (x**2).sum(1) / prior_sd**2 - math.log(2 * math.pi * prior_sd**2) + log_noise(residual(x))}

    return map_rows(grid, ["x", "y"], value, ["log_posterior"])
