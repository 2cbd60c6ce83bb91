"""Synthetic laws with closed-form densities, as Spark sources.

A law lives on a latent vector W: some coordinates are normal given functions of earlier ones, the rest are standard
normal; a rotation mixes the first coordinates, and eta is the logit of the normal distribution function of each. Rows come
from blocks of a fixed size, each with a generator of its own, so the table is the same for any number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import normal_np as N
from skerry.functions.normal import LOG_2PI

BLOCK = 10_000
ROTATION = (8, 20260714)  # coordinates that the rotation mixes, and its seed


def haar_rotation(d: int, mixed: int = ROTATION[0], seed: int = ROTATION[1]) -> np.ndarray:
    """A rotation drawn uniformly over the first coordinates; signs are fixed so that it is unique."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((mixed, mixed)))
    out = np.eye(d)
    out[:mixed, :mixed] = q * np.sign(np.diag(r))
    return out


def gauss_nodes(n: int = 129) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights that integrate against the standard normal."""
    x, w = np.polynomial.hermite_e.hermegauss(n)
    return x, w / w.sum()


@dataclass(frozen=True)
class Bend:
    """Coordinate `out` is normal around mean(W[inputs]) with the given variance."""

    out: int
    inputs: tuple[int, ...]
    mean: Callable[..., np.ndarray]
    variance: float


@dataclass(frozen=True)
class Law:
    name: str
    d: int
    active: int
    bends: tuple[Bend, ...]
    rotation: np.ndarray | None

    def latent(self, n: int, rng: np.random.Generator) -> np.ndarray:
        w = rng.standard_normal((n, self.d))
        for b in self.bends:
            w[:, b.out] = b.mean(*(w[:, i] for i in b.inputs)) + np.sqrt(b.variance) * w[:, b.out]
        return w

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        w = self.latent(n, rng)
        return N.logit_phi(w if self.rotation is None else w @ self.rotation.T)

    def log_density(self, eta: np.ndarray) -> np.ndarray:
        z = N.inv_logit_phi(np.atleast_2d(eta))
        w = z if self.rotation is None else z @ self.rotation
        out = -0.5 * self.d * LOG_2PI + N.log_jacobian(z).sum(1)
        bent = {b.out: b for b in self.bends}
        for j in range(self.d):
            if j in bent:
                b = bent[j]
                out = out - 0.5 * (w[:, j] - b.mean(*(w[:, i] for i in b.inputs))) ** 2 / b.variance - 0.5 * np.log(b.variance)
            else:
                out = out - 0.5 * w[:, j] ** 2
        return out

    def log_copula_z(self, z: np.ndarray) -> np.ndarray:
        """log density of z = inv_logit_phi(eta) against the standard normal (marginals taken as logistic)."""
        return self.log_density(N.logit_phi(z)) - (N.log_ndtr(z) + N.log_ndtr(-z)).sum(1)

    def score_z(self, z: np.ndarray, step: float = 1e-4) -> np.ndarray:
        """Central differences of log_copula_z."""
        out = np.empty_like(z)
        for j in range(self.d):
            up, down = z.copy(), z.copy()
            up[:, j] += step
            down[:, j] -= step
            out[:, j] = (self.log_copula_z(up) - self.log_copula_z(down)) / (2 * step)
        return out

    def mixture(self, j: int) -> tuple[np.ndarray, np.ndarray, float]:
        """A latent coordinate as a normal mixture over quadrature nodes of its inputs: means, weights and the standard deviation.

        Exact up to the quadrature for laws without a rotation, whose coordinates are the latent ones.
        """
        bent = next((b for b in self.bends if b.out == j), None)
        if bent is None:
            return np.zeros(1), np.ones(1), 1.0
        x, w = gauss_nodes()
        grid = np.meshgrid(*[x] * len(bent.inputs), indexing="ij")
        weight = np.prod(np.meshgrid(*[w] * len(bent.inputs), indexing="ij"), axis=0)
        return bent.mean(*grid).ravel(), weight.ravel(), float(np.sqrt(bent.variance))

    def marginal_log_pdf(self, j: int, w: np.ndarray) -> np.ndarray:
        m, share, sd = self.mixture(j)
        t = (np.asarray(w, float)[:, None] - m) / sd
        return np.log(np.exp(-0.5 * t**2) @ share) - np.log(sd) - 0.5 * LOG_2PI

    def marginal_cdf(self, j: int, w: np.ndarray) -> np.ndarray:
        m, share, sd = self.mixture(j)
        return N.ndtr((np.asarray(w, float)[:, None] - m) / sd) @ share

    def exact_scores(self, w: np.ndarray) -> np.ndarray:
        """Normal scores of latent rows under the exact marginals."""
        bent = {b.out for b in self.bends}
        return np.stack([N.ndtri(self.marginal_cdf(j, w[:, j])) if j in bent else w[:, j] for j in range(self.d)], 1)

    def exact_log_copula(self, w: np.ndarray) -> np.ndarray:
        """log density of the exact scores against the standard normal, at latent rows. Coordinates that aren't bent cancel."""
        if self.rotation is not None:
            raise ValueError("a rotated law's marginals aren't those of its latent coordinates")
        out = np.zeros(len(w))
        for b in self.bends:
            gap = w[:, b.out] - b.mean(*(w[:, i] for i in b.inputs))
            out += -0.5 * gap**2 / b.variance - 0.5 * np.log(b.variance) - 0.5 * LOG_2PI - self.marginal_log_pdf(b.out, w[:, b.out])
        return out

    def sample_scores(self, n: int, rng: np.random.Generator, V: np.ndarray | None = None) -> np.ndarray:
        """Draws of the exact scores, or of their projections."""
        z = self.exact_scores(self.latent(n, rng))
        return z if V is None else z @ V

    def moments(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """M = E[z z'], H = E[(s - z)(s - z)'] and C = E[s s'] by sampling, s the copula score."""
        z = N.inv_logit_phi(self.sample(n, np.random.default_rng(seed)))
        s = self.score_z(z)
        t = s - z
        return z.T @ z / n, t.T @ t / n, s.T @ s / n

    def subspace(self, r: int, n: int = 20_000, seed: int = 0) -> np.ndarray:
        """Leading eigenvectors of C; exact coordinates of the active block where nothing is mixed."""
        c = self.moments(n, seed)[2]
        return np.linalg.eigh(c)[1][:, ::-1][:, :r]


def _conformal(name: str, arguments: tuple[Callable, Callable], a: float = 0.7) -> Law:
    x, w = gauss_nodes()
    grid = np.meshgrid(x, x, indexing="ij")
    weight = np.outer(w, w)
    bends = []
    for out, f in zip((2, 3), arguments, strict=True):
        v = np.tanh(f(*grid))
        c = a / np.sqrt((weight * v * v).sum() - (weight * v).sum() ** 2)
        bends.append(Bend(out, (0, 1), lambda p, q, f=f, c=c: c * np.tanh(f(p, q)), 1 - a * a))
    return Law(name, 20, 4, tuple(bends), haar_rotation(20))


def conformal_square(m: float = 2.5) -> Law:
    return _conformal("conformal_square", (lambda p, q: (p * p - q * q) / m, lambda p, q: 2 * p * q / m))


def conformal_cube(m: float = 4.0) -> Law:
    return _conformal("conformal_cube", (lambda p, q: (p**3 - 3 * p * q * q) / m, lambda p, q: (3 * p * p * q - q**3) / m))


def even_fold(gamma: float = 0.5, a: float = 0.7) -> Law:
    x, w = gauss_nodes()
    v = np.tanh(gamma * (x * x - 1))
    centre = (w * v).sum()
    c = a / np.sqrt((w * v * v).sum() - centre**2)
    mean = lambda p: c * (np.tanh(gamma * (p * p - 1)) - centre)
    return Law("even_fold", 20, 4, tuple(Bend(2 * k + 1, (2 * k,), mean, 1 - a * a) for k in range(2)), haar_rotation(20))


def cubic_bend(a: float = 0.6) -> Law:
    return Law("cubic_bend", 25, 6, tuple(Bend(2 * k + 1, (2 * k,), lambda p: a / np.sqrt(15) * p**3, 1 - a * a) for k in range(3)), None)


def cusp_bend(a: float = 0.8) -> Law:
    mean = lambda p: a * (np.abs(p) - np.sqrt(2 / np.pi))
    return Law("cusp_bend", 20, 4, tuple(Bend(2 * k + 1, (2 * k,), mean, 1 - a * a * (1 - 2 / np.pi)) for k in range(2)), None)


@dataclass(frozen=True)
class QuarticPairs:
    """Pairs of coordinates coupled by a quartic in their sum; the other coordinates are standard normal.

    In a pair's rotated coordinates s = (w0 + w1) / sqrt 2 and t = (w0 - w1) / sqrt 2 the law is a product: t is normal
    and s has density exp(-s^2 / 2 - strength s^4 / 12) up to a factor. So draws of s invert its distribution function, and
    the marginals of w0 and w1 are normal distributions mixed over Gauss-Legendre nodes of s.
    """

    strengths: tuple[float, ...] = (1.0, 1.0, 1.0)
    d: int = 20
    name: str = "quartic_pairs"
    active: int = 6

    def sum_law(self, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Nodes of s with their probabilities, and the log of the density's integral."""
        x, w = np.polynomial.legendre.leggauss(400)
        s = 9.0 * x
        mass = 9.0 * w * np.exp(-0.5 * s**2 - self.strengths[k] * s**4 / 12)
        return s, mass / mass.sum(), float(np.log(mass.sum()))

    def marginal(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points w, their normal scores and log densities; the law is even, so the lower half gives the upper one."""
        s, share, _ = self.sum_law(k)
        w = np.linspace(-8.0, 0.0, 2049)
        apart = np.sqrt(2) * w[:, None] - s
        z = N.ndtri(N.ndtr(apart) @ share)
        z[-1] = 0.0
        log_pdf = np.log(np.exp(-0.5 * apart**2) @ share) + 0.5 * np.log(2) - 0.5 * LOG_2PI
        return np.concatenate((w, -w[-2::-1])), np.concatenate((z, -z[-2::-1])), np.concatenate((log_pdf, log_pdf[-2::-1]))

    def draw_sum(self, k: int, u: np.ndarray) -> np.ndarray:
        """Quantiles of s."""
        grid = np.linspace(-9.0, 9.0, 40_001)
        pdf = np.exp(-0.5 * grid**2 - self.strengths[k] * grid**4 / 12)
        cdf = np.concatenate(([0.0], np.cumsum((pdf[1:] + pdf[:-1]) / 2)))
        return np.interp(u, cdf / cdf[-1], grid)

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        z = rng.standard_normal((n, self.d))
        for k in range(len(self.strengths)):
            s, t = self.draw_sum(k, rng.uniform(size=n)), z[:, 2 * k]
            pair = np.stack((s + t, s - t), 1) / np.sqrt(2)
            w, score, _ = self.marginal(k)
            z[:, 2 * k : 2 * k + 2] = np.interp(pair, w, score)
        return N.logit_phi(z)

    def log_density(self, eta: np.ndarray) -> np.ndarray:
        z = N.inv_logit_phi(np.atleast_2d(eta))
        out = N.log_jacobian(z).sum(1) - 0.5 * (z**2).sum(1) - 0.5 * self.d * LOG_2PI
        for k, strength in enumerate(self.strengths):
            w, score, log_pdf = self.marginal(k)
            pair = np.interp(z[:, 2 * k : 2 * k + 2], score, w)
            s, t = pair.sum(1) / np.sqrt(2), (pair[:, 0] - pair[:, 1]) / np.sqrt(2)
            out += -0.5 * (s**2 + t**2) - strength * s**4 / 12 - 0.5 * LOG_2PI - self.sum_law(k)[2] - np.interp(pair, w, log_pdf).sum(1)
        return out


LAWS: dict[str, Callable[[], Law | QuarticPairs]] = {
    "conformal_square": conformal_square, "even_fold": even_fold, "conformal_cube": conformal_cube,
    "cubic_bend": cubic_bend, "cusp_bend": cusp_bend, "quartic_pairs": QuarticPairs,
}


def sample_law(spark: SparkSession, name: str, n: int, seed: int = 0) -> DataFrame:
    """row_id, eta (array) and log_density of n draws."""
    schema = pa.schema([("row_id", pa.int64()), ("eta", pa.list_(pa.float64())), ("log_density", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        law = LAWS[name]()
        for b in it:
            for block in b.column(0).to_pylist():
                size = min(BLOCK, n - block * BLOCK)
                eta = law.sample(size, np.random.default_rng([seed, block]))
                ids = np.arange(size) + block * BLOCK
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(eta), pa.list_(pa.float64())), pa.array(law.log_density(eta))], schema=schema)

    return spark.range(-(-n // BLOCK)).mapInArrow(run, "row_id bigint, eta array<double>, log_density double")


def law_moments(spark: SparkSession, name: str, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """M, H and C as Law.moments, over blocks of draws on the executors; the sums are 3 d x d numbers a block's task."""
    schema = pa.schema([("k", pa.int32()), ("v", pa.list_(pa.float64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        law = LAWS[name]()
        total = np.zeros((2 * law.d, 2 * law.d))
        for b in it:
            for block in b.column(0).to_pylist():
                z = N.inv_logit_phi(law.sample(min(BLOCK, n - block * BLOCK), np.random.default_rng([seed, block])))
                both = np.concatenate((z, law.score_z(z)), 1)
                total += both.T @ both
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=schema)

    def added(table: pa.Table) -> pa.Table:
        return pa.table([table.column("k")[:1], pa.array([np.stack(table.column("v").to_pylist()).sum(0)], pa.list_(pa.float64()))], schema=schema)

    parts = spark.range(-(-n // BLOCK)).mapInArrow(run, "k int, v array<double>")
    rows = sorted((r.k, r.v) for r in parts.groupBy("k").applyInArrow(added, "k int, v array<double>").collect())  # 2 d rows
    s = np.array([v for _, v in rows]) / n
    d = len(s) // 2
    m, c, cross = s[:d, :d], s[d:, d:], s[:d, d:]
    return m, c - cross - cross.T + m, c


def widen(df: DataFrame, column: str, d: int, prefix: str = "x") -> DataFrame:
    """The array column as columns x0 .. x{d-1}."""
    return df.select("*", *(F.col(column)[k].alias(f"{prefix}{k}") for k in range(d))).drop(column)
