"""Regularised solves of (A + R) theta = b on the driver, over sufficient statistics.

A penalty is either a diagonal or a block matrix by total degree. All penalties are one family: for each degree block with
eigenvalues l_i and mean variance s = trace / n, the shrinkage of an eigendirection is

    floor + whitening weight * (l_max - l_i) [+ Sobolev term]

and the named solvers choose floor and weight.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from skerry.functions.hermite import Index, total_degrees
from skerry.operators.scorematch import Stats

#: Published defaults, fixed values.
RIDGE_SHARE = 1e-4
BLOCK_SHARE = 1e-3
TRACE_C, TRACE_P = 3.0, 4.0
SOBOLEV = 1e-5


@dataclass
class Solution:
    theta: np.ndarray
    penalty: np.ndarray
    info: dict = field(default_factory=dict)


def operator_norm(a: np.ndarray) -> float:
    return float(np.linalg.norm(a, 2)) if a.size else 0.0


def _blocks(stats: Stats, indices: list[Index]):
    degrees = total_degrees(indices)
    for k in sorted(set(degrees.tolist()) - {0}):
        at = np.flatnonzero(degrees == k)
        yield k, at, stats.A[np.ix_(at, at)]


def _spectral(stats: Stats, indices: list[Index], shrink: Callable[[int, np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, dict]:
    """Block penalty U diag(shrink(k, l, size)) U' for each degree."""
    out, info = np.zeros_like(stats.A), {}
    for k, at, block in _blocks(stats, indices):
        l, u = np.linalg.eigh(block)
        tau = np.asarray(shrink(k, l, len(at)), float) * np.ones(len(l))
        out[np.ix_(at, at)] = (u * tau) @ u.T
        info[k] = {"least": float(tau.min()), "most": float(tau.max()), "size": len(at)}
    return out, info


def _solve(stats: Stats, penalty: np.ndarray, info: dict | None = None) -> Solution:
    m = stats.A + penalty
    return Solution(np.linalg.solve((m + m.T) / 2, stats.b), penalty, info or {})


def ridge(stats: Stats, indices: list[Index], strength: float | None = None, by_degree: bool = True) -> Solution:
    """strength (by default a share of the norm of A) times squared total degree, or times 1."""
    strength = RIDGE_SHARE * operator_norm(stats.A) if strength is None else strength
    weight = total_degrees(indices).astype(float) ** 2 if by_degree else np.ones(len(indices))
    return _solve(stats, np.diag(strength * weight), {"strength": strength})


def block_ridge(stats: Stats, indices: list[Index], share: float = BLOCK_SHARE, scales: dict[int, float] | None = None) -> Solution:
    """A share of each degree block's norm, or of the scale given for the degree (a robust norm)."""
    return _solve(stats, *_spectral(stats, indices, lambda k, l, n: share * (scales[k] if scales else abs(l).max())))


def block_norms(parts: list[Stats], indices: list[Index]) -> dict[int, float]:
    """Median over parts of each degree block's norm."""
    norms: dict[int, list[float]] = {}
    for part in parts:
        for k, _, block in _blocks(part, indices):
            norms.setdefault(k, []).append(operator_norm(block))
    return {k: float(np.median(v)) for k, v in norms.items()}


def median_block_ridge(stats: Stats, indices: list[Index], parts: list[Stats] | None, share: float = BLOCK_SHARE) -> Solution:
    """block_ridge with medians over parts of the rows; without parts plain block_ridge."""
    return block_ridge(stats, indices, share, block_norms(parts, indices) if parts else None)


def quantile_ridge(stats: Stats, indices: list[Index], share: float = BLOCK_SHARE, quantile: float = 0.5) -> Solution:
    return _solve(stats, *_spectral(stats, indices, lambda k, l, n: share * np.quantile(l, quantile)))


def _noise_weight(l: np.ndarray, noise: float, power: float) -> np.ndarray:
    return np.zeros_like(l) if noise <= 0 or l.max() <= 0 else 1 / (1 + (np.maximum(l, 1e-30) / noise) ** power)


def sigmoid_ridge(stats: Stats, indices: list[Index], share: float = BLOCK_SHARE, power: float = 2.0, rows: int | None = None) -> Solution:
    """Whitening of the directions below the noise scale trace / rows; without rows plain block_ridge."""
    if not rows or rows <= 0:
        return block_ridge(stats, indices, share)
    return _solve(stats, *_spectral(stats, indices, lambda k, l, n: share * l.max() + _noise_weight(l, l.sum() / rows, power) * (l.max() - l)))


def trace_ridge(stats: Stats, indices: list[Index], rows: int, c: float = TRACE_C, power: float = TRACE_P, sobolev: float = 0.0) -> Solution:
    """c * trace / rows in place of the norm's share; sobolev adds a floor that grows with squared degree."""
    if not rows or rows <= 0:
        raise ValueError("the number of rows is needed")
    norm = operator_norm(stats.A)
    return _solve(stats, *_spectral(stats, indices, lambda k, l, n: c * l.sum() / rows + _noise_weight(l, l.sum() / rows, power) * (l.max() - l) + sobolev * norm * k * k))


def blend_ridge(stats: Stats, indices: list[Index], share: float = BLOCK_SHARE, rows: int | None = None, alpha: float = 4.0, mode: str = "sample_size") -> Solution:
    """Whitening of a share of each block: by its size against the rows, or by its lack of stable rank."""

    def shrink(k: int, l: np.ndarray, n: int) -> np.ndarray:
        if mode == "sample_size":
            beta = min(1.0, alpha * n / rows) if rows else 0.0
        elif mode == "deficiency":
            beta = max(0.0, 1 - l.sum() / l.max() / n) if l.max() > 0 else 0.0
        else:
            raise ValueError(f"unknown mode {mode}")
        return share * l.max() + beta * (l.max() - l)

    return _solve(stats, *_spectral(stats, indices, shrink))


def _by_mode(mode: str, share: float) -> Callable[[int, np.ndarray, int], np.ndarray]:
    def shrink(k: int, l: np.ndarray, n: int) -> np.ndarray:
        top = l.max()
        if mode == "whiten":
            return top - l + share * top
        if mode == "proportional":
            return np.full_like(l, share * top)
        if mode == "inverse":
            return share * top * (1 + top / np.maximum(l, top / 1e6))
        raise ValueError(f"unknown mode {mode}")

    return shrink


def spectral_ridge(stats: Stats, indices: list[Index], share: float = BLOCK_SHARE, mode: str = "whiten") -> Solution:
    """whiten, proportional or inverse shrinkage in each degree block's eigenbasis."""
    return _solve(stats, *_spectral(stats, indices, _by_mode(mode, share)))


def full_ridge(stats: Stats, share: float = BLOCK_SHARE, mode: str = "whiten") -> Solution:
    """The same in the eigenbasis of all of A."""
    l, u = np.linalg.eigh(stats.A)
    return _solve(stats, (u * _by_mode(mode, share)(0, l, len(l))) @ u.T)


def degree_scaled_ridge(stats: Stats, indices: list[Index], rows: int, c: float = TRACE_C, alpha: float = 0.0, sobolev: float = SOBOLEV) -> Solution:
    norm = operator_norm(stats.A)
    return _solve(stats, *_spectral(stats, indices, lambda k, l, n: c * k**alpha * l.sum() / rows + sobolev * norm * k * k))


def combined_penalty(stats: Stats, indices: list[Index], rows: int, c_cov: float = TRACE_C, c_sob: float = SOBOLEV) -> np.ndarray:
    """Per degree c_cov * trace / rows, plus c_sob * norm of A * squared degree."""
    degrees = total_degrees(indices)
    diagonal = c_sob * operator_norm(stats.A) * degrees.astype(float) ** 2
    for _, at, block in _blocks(stats, indices):
        diagonal[at] += c_cov * max(np.trace(block) / rows, 0.0)
    return np.diag(diagonal)


def centred(stats: Stats, penalty: np.ndarray, constraints: np.ndarray | None = None) -> Solution:
    """The solve under constraints @ theta = 0 (by default mean derivatives zero), by the Schur complement."""
    c = stats.C if constraints is None else constraints
    m = stats.A + penalty
    x = np.linalg.solve(m, np.column_stack([stats.b, c.T]))
    schur = c @ x[:, 1:]
    try:
        mult = np.linalg.solve(schur, c @ x[:, 0])
    except np.linalg.LinAlgError:
        mult = np.linalg.lstsq(schur, c @ x[:, 0], rcond=None)[0]
    theta = x[:, 0] - x[:, 1:] @ mult
    return Solution(theta, penalty, {"residual": float(np.linalg.norm(c @ theta))})


def theoretical(stats: Stats, indices: list[Index], rows: int, c_cov: float = TRACE_C, c_sob: float = SOBOLEV) -> Solution:
    if not rows or rows <= 0:
        raise ValueError("the number of rows is needed")
    return centred(stats, combined_penalty(stats, indices, rows, c_cov, c_sob))


def heldout_risk(theta: np.ndarray, stats: Stats) -> float:
    """The score-matching objective without penalty."""
    return float(0.5 * theta @ stats.A @ theta - theta @ stats.b)


def heldout_select(halves: tuple[Stats, Stats], indices: list[Index], c_cov: np.ndarray | None = None, c_sob: np.ndarray | None = None) -> Solution:
    """The pair of constants with the least risk on the second half, then a refit on both. Needs 8 rows."""
    fit, held = halves
    if fit.n + held.n < 8:
        return theoretical(fit.merged(held), indices, fit.n + held.n)
    c_cov = np.logspace(-1, 2, 5) if c_cov is None else c_cov
    c_sob = np.logspace(-7, -3, 5) if c_sob is None else c_sob
    risks = {(a, b): heldout_risk(theoretical(fit, indices, fit.n, a, b).theta, held) for a in c_cov for b in c_sob}
    best = min(risks, key=risks.get)
    both = fit.merged(held)
    out = theoretical(both, indices, both.n, *best)
    out.info |= {"c_cov": best[0], "c_sob": best[1], "risk": risks[best]}
    return out


def parse_scheme(text: str) -> tuple[str, dict[str, float]]:
    """name:key=value,key=value"""
    name, _, rest = text.partition(":")
    return name, {k: float(v) for k, _, v in (p.partition("=") for p in rest.split(",") if p)}


def by_scheme(text: str, stats: Stats, indices: list[Index], halves: tuple[Stats, Stats] | None = None) -> Solution:
    """The solver that a scheme string names."""
    name, given = parse_scheme(text)
    n = stats.n
    table: dict[str, Callable[..., Solution]] = {
        "ridge": lambda **g: ridge(stats, indices, **g),
        "block": lambda **g: block_ridge(stats, indices, **g),
        "quantile": lambda **g: quantile_ridge(stats, indices, **g),
        "sigmoid": lambda **g: sigmoid_ridge(stats, indices, rows=n, **g),
        "trace": lambda **g: trace_ridge(stats, indices, n, **g),
        "hybrid": lambda **g: trace_ridge(stats, indices, n, **({"sobolev": SOBOLEV} | g)),
        "blend": lambda **g: blend_ridge(stats, indices, rows=n, **g),
        "whiten": lambda **g: spectral_ridge(stats, indices, mode="whiten", **g),
        "inverse": lambda **g: spectral_ridge(stats, indices, mode="inverse", **g),
        "full": lambda **g: full_ridge(stats, **g),
        "scaled": lambda **g: degree_scaled_ridge(stats, indices, n, **g),
        "theoretical": lambda **g: theoretical(stats, indices, n, **g),
        "heldout": lambda **g: heldout_select(halves or (stats, stats), indices, **g),
    }
    if name not in table:
        raise ValueError(f"unknown scheme {name}")
    return table[name](**given)


def barrier_qp(m: np.ndarray, b: np.ndarray, equal: np.ndarray, g: np.ndarray, h: np.ndarray, tol: float = 1e-9, steps: int = 200) -> tuple[np.ndarray, dict]:
    """min x'Mx/2 - b'x with equal @ x = 0 and g @ x <= h: null space of the equalities, then a primal-dual interior point."""
    if len(equal):
        _, s, vt = np.linalg.svd(equal)
        z = vt[int((s > 1e-10 * max(s.max(), 1e-300)).sum()) :].T
    else:
        z = np.eye(len(b))
    p, q, a = z.T @ m @ z, z.T @ b, g @ z
    x = np.linalg.solve(p, q)
    slack = np.maximum(h - a @ x, 1.0)
    dual = np.ones(len(h))
    for _ in range(steps):
        r1, r2 = p @ x - q + a.T @ dual, a @ x + slack - h
        gap = float(slack @ dual) / max(len(h), 1)
        if gap < tol and abs(r1).max() < 1e-7 * (1 + abs(q).max()) and abs(r2).max(initial=0) < 1e-7 * (1 + abs(h).max(initial=0)):
            break
        w = dual / slack
        r3 = slack * dual - 0.1 * gap
        dx = np.linalg.solve(p + (a.T * w) @ a, -r1 - a.T @ (w * r2 - r3 / slack))
        ds = -r2 - a @ dx
        dd = -(r3 + dual * ds) / slack
        t = 1.0
        for v, dv in ((slack, ds), (dual, dd)):
            down = dv < 0
            if down.any():
                t = min(t, 0.995 * float((-v[down] / dv[down]).min()))
        x, slack, dual = x + t * dx, slack + t * ds, dual + t * dd
    return z @ x, {"active": int((slack < 1e-6).sum()), "gap": float(slack @ dual), "feasible": bool((a @ x <= h + 1e-6 * (1 + abs(h))).all())}
