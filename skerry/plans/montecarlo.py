"""Nested Monte Carlo and quadrature of conditional densities; one task a block of outer points.

For an orthonormal V, z = V u + W v with W its complement. Each outer point u asks for the integral of exp(log c(V u + W v))
against the standard normal in v, where log c is a law's log copula density.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.subspace import complement
from skerry.plans import pairs
from skerry.plans.storage import settle
from skerry.sources.laws import LAWS

#: How an integral went. Others: rank_deficient, ill_conditioned, too_many_nodes, no_mode, not_finite, collapsed, stuck, low_ess, high_se.
OK = "ok"


def _log_mean(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).mean(axis, keepdims=True))).squeeze(axis)


def nested_kl(law, V: np.ndarray, outer: int, inner: int, seed: int = 0) -> dict[str, float]:
    """KL from the law to its conditional expectation on the subspace, common inner draws for all outer points."""
    if np.abs(V.T @ V - np.eye(V.shape[1])).max() > 1e-8:
        raise ValueError("V must be orthonormal")
    from skerry.functions import normal_np as N

    z = N.inv_logit_phi(law.sample(outer, np.random.default_rng(seed)))
    W = complement(V)
    v = np.random.default_rng(seed + 1).standard_normal((inner, W.shape[1])) @ W.T
    own = law.log_copula_z(z)
    parts, ess = [], []
    for row in z @ V @ V.T:
        logs = law.log_copula_z(row + v)
        parts.append(_log_mean(logs))
        w = np.exp(logs - logs.max())
        ess.append(w.sum() ** 2 / (w**2).sum())
    gap = own - np.array(parts)
    return {"kl": float(gap.mean()), "se": float(gap.std(ddof=1) / np.sqrt(outer)), "ess": float(np.mean(ess))}


def newton_mode(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 40, h: float = 1e-3) -> tuple[np.ndarray, np.ndarray] | None:
    """A maximum of f and minus the Hessian there. The Hessian's spectrum is shifted below zero for the step."""
    x = start.astype(float).copy()
    d = len(x)
    eye = np.eye(d) * h
    for _ in range(rounds):
        points = [x] + [x + s * e for e in eye for s in (1, -1)] + [x + a * eye[i] + b * eye[j] for i in range(d) for j in range(i) for a in (1, -1) for b in (1, -1)]
        v = f(np.array(points))
        if not np.isfinite(v).all():
            return None
        up, down = v[1 : 2 * d + 1 : 2], v[2 : 2 * d + 2 : 2]
        grad = (up - down) / (2 * h)
        hess = np.diag((up - 2 * v[0] + down) / h**2)
        k = 2 * d + 1
        for i in range(d):
            for j in range(i):
                hess[i, j] = hess[j, i] = (v[k] - v[k + 1] - v[k + 2] + v[k + 3]) / (4 * h * h)
                k += 4
        l, q = np.linalg.eigh(-hess)
        step = q @ ((q.T @ grad) / np.maximum(l, 0.05))
        t = 1.0
        while t > 1e-4 and not f((x + t * step)[None])[0] > v[0] - 1e-12:
            t /= 2
        x = x + t * step
        if np.linalg.norm(t * step) < 1e-6:
            return x, (q * np.maximum(l, 0.05)) @ q.T
    return x, (q * np.maximum(l, 0.05)) @ q.T


def distinct_modes(modes: list[tuple[np.ndarray, np.ndarray]], distance: float = 1e-3) -> list[tuple[np.ndarray, np.ndarray]]:
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for m in modes:
        if all(np.linalg.norm(m[0] - k[0]) > distance for k in kept):
            kept.append(m)
    return kept


def hmc(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, draws: int, rng: np.random.Generator, step: float = 0.2, leaps: int = 8, h: float = 1e-4) -> tuple[np.ndarray, float]:
    """Draws of many chains at once and the share of accepted moves over the last 50."""
    d = x.shape[1]

    def grad(y: np.ndarray) -> np.ndarray:
        return np.stack([(f(y + h * e) - f(y - h * e)) / (2 * h) for e in np.eye(d)], 1)

    out, rates, value = [], [], f(x)
    for _ in range(draws):
        p = rng.standard_normal(x.shape)
        y, q = x.copy(), p + 0.5 * step * grad(x)
        for k in range(leaps):
            y = y + step * q
            q = q + step * (0.5 if k == leaps - 1 else 1.0) * grad(y)
        new = f(y)
        ok = np.log(rng.random(len(x))) < new - value + 0.5 * ((p**2).sum(1) - (q**2).sum(1))
        x, value = np.where(ok[:, None], y, x), np.where(ok, new, value)
        rates.append(ok.mean())
        out.append(x)
        if len(rates) % 50 == 0:
            step *= 0.8 if np.mean(rates[-50:]) < 0.6 else 1.25 if np.mean(rates[-50:]) > 0.9 else 1.0
    return np.array(out), float(np.mean(rates[-50:]))


@dataclass(frozen=True)
class Inner:
    """What an integrator says of exp(f) against the standard normal: log of the integral, the mean of f under the normalised
    integrand, the share of effective points, the relative standard error, and how it went."""

    log_mass: float = math.nan
    mean: float = math.nan
    ess_share: float = 0.0
    rel_se: float = math.inf
    status: str = OK

    @property
    def kl(self) -> float:
        return self.mean - self.log_mass


def _weighed(logw: np.ndarray, f: np.ndarray) -> Inner:
    """From importance weights and values at the draws; the gate decides on the status."""
    if not np.isfinite(logw).all():
        return Inner(status="not_finite")
    w = np.exp(logw - logw.max())
    share = float(w.sum() ** 2 / (w**2).sum() / len(w))
    rel = float(np.sqrt(max(0.0, 1 / share - 1) / len(w)))
    return Inner(float(_log_mean(logw)), float(w @ f / w.sum()), share, rel, "low_ess" if share < 1e-3 else "high_se" if rel > 0.10 else OK)


def _mixture_draws(centres: list[np.ndarray], roots: list[np.ndarray], shares: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Draws of a normal mixture (roots: of the covariances) and its log density there, without the 2 pi."""
    pick = rng.choice(len(centres), n, p=shares)
    noise = rng.standard_normal((n, len(centres[0])))
    x = np.stack(centres)[pick] + np.einsum("nij,nj->ni", np.stack(roots)[pick], noise)
    logs = [np.log(p) - 0.5 * (np.linalg.solve(r, (x - c).T) ** 2).sum(0) - np.linalg.slogdet(r)[1] for p, c, r in zip(shares, centres, roots, strict=True)]
    return x, np.logaddexp.reduce(np.stack(logs), 0)


def _modes(f: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator, starts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct maxima of f less half the square norm, from several starts."""
    g = lambda v: f(v) - 0.5 * (v**2).sum(1)
    found = [newton_mode(g, x) for x in [np.zeros(d), *rng.standard_normal((starts - 1, d))]]
    return distinct_modes([m for m in found if m is not None])


def laplace_inner(f: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator, draws: int = 4000, starts: int = 4) -> Inner:
    """Importance sampling from normal pieces at the integrand's modes, a little wider than it."""
    modes = _modes(f, d, rng, starts)
    if not modes:
        return Inner(status="no_mode")
    heights = np.array([f(m[None])[0] - 0.5 * m @ m - 0.5 * np.linalg.slogdet(h)[1] for m, h in modes])
    shares = np.exp(heights - heights.max())
    shares = 0.9 * shares / shares.sum() + 0.1 / len(modes)
    x, logq = _mixture_draws([m for m, _ in modes], [np.linalg.cholesky(1.2 * np.linalg.inv(h)) for _, h in modes], shares, draws, rng)
    values = f(x)
    return _weighed(values - 0.5 * (x**2).sum(1) - logq, values)


def quadrature_inner(f: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator, nodes: int = 9, starts: int = 4, most: int = 200_000) -> Inner:
    """Gauss-Hermite nodes around each mode; a point counts for a mode as much as that mode's normal piece has of all pieces
    there, so that overlapping pieces don't count twice."""
    if nodes**d > most:
        return Inner(status="too_many_nodes")
    modes = _modes(f, d, rng, starts)
    if not modes:
        return Inner(status="no_mode")
    if max(np.linalg.cond(h) for _, h in modes) > 1e10:
        return Inner(status="ill_conditioned")
    x, w = np.polynomial.hermite_e.hermegauss(nodes)
    grid = np.stack(np.meshgrid(*[x] * d, indexing="ij"), -1).reshape(-1, d)
    logw = np.log(np.stack(np.meshgrid(*[w / w.sum()] * d, indexing="ij"), -1).reshape(-1, d)).sum(1)
    roots = [np.linalg.cholesky(np.linalg.inv(h)) for _, h in modes]
    logs, values = [], []
    for k, ((m, _), root) in enumerate(zip(modes, roots, strict=True)):
        at = m + grid @ root.T
        pieces = np.stack([-0.5 * (np.linalg.solve(r, (at - c).T) ** 2).sum(0) - np.linalg.slogdet(r)[1] for (c, _), r in zip(modes, roots, strict=True)])
        values.append(f(at))
        logs.append(logw + values[-1] - 0.5 * (at**2).sum(1) + 0.5 * (grid**2).sum(1) + np.linalg.slogdet(root)[1] + pieces[k] - np.logaddexp.reduce(pieces, 0))
    logs, values = np.concatenate(logs), np.concatenate(values)
    if not np.isfinite(logs).all():
        return Inner(status="not_finite")
    share = np.exp(logs - np.logaddexp.reduce(logs))
    # All the mass on one node of many: the nodes miss the integrand.
    return Inner(float(np.logaddexp.reduce(logs)), float(share @ values), float(1 / (share**2).sum() / len(share)), 0.0, "collapsed" if len(share) > 1 and share.max() > 0.999 else OK)


def fit_mixture(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 30) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Centres, covariance roots and shares of a normal mixture by expectation-maximisation."""
    n, d = x.shape
    centres, spread = x[rng.choice(n, k, replace=False)], np.atleast_2d(np.cov(x.T)) + 1e-6 * np.eye(d)
    covs, shares = [spread] * k, np.full(k, 1 / k)
    for _ in range(rounds):
        logs = []
        for j in range(k):
            root = np.linalg.cholesky(covs[j])
            logs.append(np.log(shares[j]) - 0.5 * (np.linalg.solve(root, (x - centres[j]).T) ** 2).sum(0) - np.linalg.slogdet(root)[1])
        logs = np.stack(logs)
        part = np.exp(logs - np.logaddexp.reduce(logs, 0))
        size = part.sum(1) + 1e-9
        shares = size / size.sum()
        centres = (part @ x) / size[:, None]
        covs = [((x - c).T * p) @ (x - c) / s + 1e-3 * spread for c, p, s in zip(centres, part, size, strict=True)]
    return list(centres), [np.linalg.cholesky(c) for c in covs], shares


def mixture_inner(f: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator, draws: int = 4000, chains: int = 32, steps: int = 120, pieces: int = 3) -> Inner:
    """Importance sampling from a normal mixture fitted to Hamiltonian draws of the integrand, with a wide piece beside it."""
    path, rate = hmc(lambda v: f(v) - 0.5 * (v**2).sum(1), rng.standard_normal((chains, d)), steps, rng)
    if not np.isfinite(path).all() or rate < 0.05:
        return Inner(status="stuck")
    kept = path[steps // 2 :].reshape(-1, d)
    centres, roots, shares = fit_mixture(kept, pieces, rng)
    roots = [1.2 * r for r in roots]
    x, logq = _mixture_draws([*centres, kept.mean(0)], [*roots, 2.0 * np.linalg.cholesky(np.atleast_2d(np.cov(kept.T)) + 1e-6 * np.eye(d))], np.append(0.9 * shares, 0.1), draws, rng)
    values = f(x)
    return _weighed(values - 0.5 * (x**2).sum(1) - logq, values)


INTEGRATORS = {"quadrature": quadrature_inner, "laplace": laplace_inner, "mixture": mixture_inner}


def inner_by_any(f: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator, methods: tuple[str, ...] = ("quadrature", "laplace", "mixture")) -> tuple[str, Inner]:
    """The first method whose status is ok, and its answer; where none is, the last one tried."""
    name, got = methods[0], Inner(status="untried")
    for name in methods:
        got = INTEGRATORS[name](f, d, rng)
        if got.status == OK:
            break
    return name, got


def conditional_kl_table(spark: SparkSession, law: str, V: np.ndarray, outer: int, seed: int = 0, methods: tuple[str, ...] = ("quadrature", "laplace", "mixture")) -> DataFrame:
    """point, method, status, kl, log_mass, ess_share, rel_se: for each outer draw the divergence of the law's conditional outside
    the subspace from the standard normal. A row a point; each has a generator of its own, so results don't depend on the
    partitions. A V without full column rank gives rows with status rank_deficient."""
    schema = pa.schema([("point", pa.int64()), ("method", pa.string()), ("status", pa.string()), *((c, pa.float64()) for c in ("kl", "log_mass", "ess_share", "rel_se"))])
    full = np.linalg.matrix_rank(V) == V.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from skerry.functions import normal_np as N

        known = LAWS[law]()
        basis = np.linalg.qr(V)[0]
        outside = complement(basis)
        for batch in it:
            rows = []
            for point in batch.column(0).to_pylist():
                if not full:
                    rows.append((point, "", "rank_deficient", math.nan, math.nan, 0.0, math.inf))
                    continue
                rng = np.random.default_rng([seed, point])
                at = N.inv_logit_phi(known.sample(1, rng))[0] @ basis @ basis.T
                name, got = inner_by_any(lambda v, at=at: known.log_copula_z(at + v @ outside.T), outside.shape[1], rng, methods)
                rows.append((point, name, got.status, got.kl, got.log_mass, got.ess_share, got.rel_se))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    points = spark.range(outer).repartition(max(1, min(outer, spark.sparkContext.defaultParallelism)))
    return points.mapInArrow(run, "point bigint, method string, status string, kl double, log_mass double, ess_share double, rel_se double")


def nested_kl_table(spark: SparkSession, law: str, bases: dict[str, np.ndarray], outer: int, inner: int, seeds: list[int]) -> DataFrame:
    """basis, seed, kl, se, ess: a task a basis and seed."""
    schema = pa.schema([("basis", pa.string()), ("seed", pa.int64()), ("kl", pa.float64()), ("se", pa.float64()), ("ess", pa.float64())])
    cells = [(b, s) for b in bases for s in seeds]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for basis, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = nested_kl(LAWS[law](), bases[basis], outer, inner, seed)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (basis, seed, got["kl"], got["se"], got["ess"])], schema=schema)

    return spark.createDataFrame(cells, "basis string, seed bigint").repartition(max(1, len(cells))).mapInArrow(run, "basis string, seed bigint, kl double, se double, ess double")


def two_point_weights(k: int, d: int) -> dict[int, float]:
    """Weights on neighbours k // 4 and k that sum to 1 and cancel the first bias term of dimensions 4 to 7."""
    if not 4 <= d < 8:
        raise ValueError("two points serve dimensions 4 to 7")
    near = max(1, k // 4)
    g = {j: math.exp(math.lgamma(j + 2 / d) - math.lgamma(j)) for j in (near, k)}
    return {near: g[k] / (g[k] - g[near]), k: g[near] / (g[near] - g[k])}


def digamma(n: int) -> float:
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


#: Columns beyond which no tree tells near points from others, and most points of a block then.
WIDE, MOST_BLOCK = 16, 1 << 14


def wide_nearest(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: int, known: np.ndarray | None = None) -> np.ndarray:
    """The k + 1 least squared distances from a to b, a point of b counting w times; only those that known ones don't surpass, if given.
    Differences are taken only of pairs that a matrix product, less its rounding, leaves in question."""
    aa, bb = (a**2).sum(1), (b**2).sum(1)
    q = a @ b.T
    q *= -2
    q += aa[:, None]
    q += bb
    most = np.full(len(a), np.inf) if known is None else known.max(1)
    if np.isinf(most).any() and len(b) > k + 1:
        most = np.minimum(most, np.partition(q, k, axis=1)[:, k])
    slack = 16 * (a.shape[1] + 2) * np.finfo(float).eps * (aa.max(initial=0.0) + bb.max(initial=0.0))
    at, to = np.nonzero(~(q > (most + slack)[:, None]))  # all, where squares are too large for numbers
    exact = np.concatenate([((a[at[i : i + 4096]] - b[to[i : i + 4096]]) ** 2).sum(1) for i in range(0, max(1, len(at)), 4096)])
    order = np.lexsort((exact, at))
    copies = np.minimum(w[to[order]], k + 1).astype(np.int64)
    at, exact = np.repeat(at[order], copies), np.repeat(exact[order], copies)
    place = np.arange(len(at)) - np.searchsorted(at, at)
    out = np.full((len(a), k + 1), np.inf)
    out[at[place <= k], place[place <= k]] = exact[place <= k]
    return out


def neighbour_distances(df: DataFrame, columns: list[str], k: int, block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact k nearest neighbours of all rows by a k-d tree. Returns the blocks of distinct points (with how often each is there),
    their values (block, width, value: for each point the k + 1 least squared distances, its own among them, copies counted
    one by one), and the pairs of a block and a leaf that were searched beyond each block's own leaf.

    A point's own leaf is searched first; the distance of its k-th neighbour there bounds how far away a nearer one can be, and
    only leaves whose boxes come that close to a point of the block are searched next.

    Beyond WIDE columns nearly all pairs of blocks are met, so distances are matrix products, of which those that may count are taken
    exactly; blocks grow with the rows to some 64, so that the bytes moved grow with the rows and not with their square.
    """
    d = len(columns)
    rows = settle(pairs.weighted(df, columns))
    if block is None:
        block = pairs.BLOCK if d <= WIDE else min(MOST_BLOCK, max(pairs.BLOCK, -(-rows.count() // 64)))
    same = lambda x: x
    points = pairs.pack(rows, columns, same, pairs.tree_of(rows, columns, same, block=block), weight="w_", keep=False, block=block)

    def nearest(a: np.ndarray, b: np.ndarray, w: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        if d > WIDE:
            return wide_nearest(a, b, w, k, known)
        q = np.zeros((len(a), len(b)))
        for j in range(d):
            q += (a[:, j, None] - b[:, j]) ** 2
        some = min(k + 1, len(b))
        at = np.argpartition(q, some - 1, axis=1)[:, :some] if some < len(b) else np.broadcast_to(np.arange(len(b)), q.shape)
        near = np.take_along_axis(q, at, 1)
        order = np.argsort(near, axis=1)
        near, copies = np.take_along_axis(near, order, 1), np.cumsum(np.take_along_axis(w[at], order, 1), 1)
        out = np.full((len(a), k + 1), np.inf)
        for i in range(k + 1):  # the i-th with copies: the first that they reach
            place = (copies <= i).sum(1)
            here = place < near.shape[1]
            out[here, i] = near[here, place[here]]
        return out

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.partition(np.concatenate([a, b], 1), k, axis=1)[:, : k + 1]

    home = settle(pairs.over_pairs(points, points, points.select("block", F.col("leaf").alias("other")), d, nearest, merge))
    near = pairs.reached_leaves(points, home, points, d)
    more = pairs.over_pairs(points, points, near, d, nearest, merge, known=home)
    return points, pairs.merge_values(home, more, merge), near


def neighbour_entropy(df: DataFrame, columns: list[str], key: str, weights: dict[int, float] | None = None) -> dict[str, float]:
    """entropy (nats), se and n: weighted means over all rows with finite values of log xi_j = d log rho_j + log V_d + log(n - 1) -
    digamma(j), with rho_j the distance to the j-th neighbour; the variance is that of the weighted terms, at least 0.

    weights: by j, by default all on the fourth. NaN for too few rows. key: the rows' name, which plays no part.
    """
    weights = weights or {4: 1.0}
    k, d = max(weights), len(columns)
    points, values, _ = neighbour_distances(df.select(key, *columns), columns, k)
    order = sorted(weights)

    def logs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            far = [np.log(np.maximum(np.sqrt(np.sort(np.frombuffer(v.as_buffer()).reshape(-1, k + 1), 1)[:, order]), 1e-300)) for v in b.column(0)]
            w = [np.frombuffer(x.as_buffer()) for x in b.column(1)]
            sums = [pa.array([(u * x[:, i]).sum() if p == 1 else (u * x[:, i] ** 2).sum() for x, u in zip(far, w, strict=True)], pa.float64()) for i in range(len(order)) for p in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in w], pa.int64()), *sums], ["n", *names])

    names = [f"s{p}_{j}" for j in order for p in (1, 2)]
    found = values.join(points.select("block", "weights"), "block").select("value", "weights").mapInArrow(logs, ", ".join(["n bigint", *(f"{x} double" for x in names)])).groupBy().sum("n", *names).first()
    n = found[0] or 0
    if n <= k:
        return {"entropy": math.nan, "se": math.nan, "n": n}
    mean = square = 0.0
    for i, j in enumerate(order):
        shift = d / 2 * math.log(math.pi) - math.lgamma(d / 2 + 1) + math.log(n - 1) - digamma(j)
        s1, s2 = found[1 + 2 * i] / n, found[2 + 2 * i] / n
        mean += weights[j] * (d * s1 + shift)
        square += weights[j] * (d * d * s2 + 2 * d * shift * s1 + shift * shift)
    return {"entropy": mean, "se": math.sqrt(max(square - mean * mean, 0.0) / n), "n": n}
