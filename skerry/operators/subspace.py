"""Subspaces from small moment matrices: angles, bounds and descent. All of this runs on the driver on d x d matrices."""

from __future__ import annotations

import numpy as np


def orthonormal(v: np.ndarray) -> np.ndarray:
    return np.linalg.qr(v)[0]


def complement(v: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the orthogonal complement of the columns."""
    return np.linalg.svd(v, full_matrices=True)[0][:, v.shape[1] :]


def top_eigenvectors(c: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """The r largest eigenvalues, descending, and their vectors."""
    if r > len(c):
        raise ValueError("r exceeds the dimension")
    l, u = np.linalg.eigh((c + c.T) / 2)
    return l[::-1][:r], u[:, ::-1][:, :r]


def randomized_eigenvectors(apply, d: int, r: int, extra: int = 10, rounds: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Leading pairs of a symmetric operator that is only known by apply(block)."""
    q = orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, r + extra))))
    for _ in range(rounds):
        q = orthonormal(apply(q))
    l, u = top_eigenvectors(q.T @ apply(q), r)
    return l, q @ u


def haar_basis(d: int, r: int, seed: int) -> np.ndarray:
    """r orthonormal columns, uniformly distributed."""
    q, t = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, r)))
    return q * np.sign(np.diag(t))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(np.linalg.svd(orthonormal(a).T @ orthonormal(b), compute_uv=False), 0.0, 1.0)


def principal_angle(a: np.ndarray, b: np.ndarray) -> float:
    """The largest principal angle in degrees."""
    return float(np.degrees(np.arccos(_cosines(a, b)).max()))


def sin_theta(a: np.ndarray, b: np.ndarray) -> float:
    """Frobenius norm of the sines of the principal angles."""
    return float(np.sqrt(np.maximum(0.0, 1 - _cosines(a, b) ** 2).sum()))


def angle_per_direction(s: float, r: int) -> float:
    return float(np.degrees(np.arcsin(min(s / np.sqrt(r), 1.0))))


def upper_bound(v: np.ndarray, m: np.ndarray, h: np.ndarray) -> float | None:
    """(tr M_perp - (d - r) + log det H_perp) / 2; None where H_perp is not positive definite."""
    p = complement(v)
    l = np.linalg.eigvalsh(p.T @ h @ p)
    if len(l) and l.min() <= 1e-12:
        return None
    return 0.5 * float(np.trace(p.T @ m @ p) - p.shape[1] + np.log(l).sum())


def _parts(v: np.ndarray, m: np.ndarray, h: np.ndarray, ridge: float):
    p = complement(v)
    hp = p.T @ h @ p
    return p, np.linalg.inv(hp + ridge * np.eye(len(hp))), p.T @ m @ v, p.T @ h @ v


def gradient(v: np.ndarray, m: np.ndarray, h: np.ndarray, ridge: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of upper_bound in coordinates of the complement, and the complement."""
    p, inverse, dm, dh = _parts(v, m, h, ridge)
    return -(dm + inverse @ dh), p


def curvature(b: np.ndarray, v: np.ndarray, m: np.ndarray, h: np.ndarray, ridge: float = 1e-10) -> float:
    """Second-order coefficient of upper_bound along v + t * complement @ b."""
    p, inverse, _, dh = _parts(v, m, h, ridge)
    k = inverse @ (b @ dh.T + dh @ b.T)
    parts = (np.trace(v.T @ m @ v @ b.T @ b) - np.trace(p.T @ m @ p @ b @ b.T) + np.trace(inverse @ b @ (v.T @ h @ v) @ b.T) - (b**2).sum()) / 2
    return float(parts - np.trace(k @ k) / 4)


def descend(v: np.ndarray, m: np.ndarray, h: np.ndarray, rounds: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, list[float]]:
    """Steepest descent of upper_bound over subspaces with halved steps and QR retractions."""
    value, trail = upper_bound(v, m, h), []
    for _ in range(rounds):
        if value is None:
            break
        trail.append(value)
        g, p = gradient(v, m, h)
        if np.linalg.norm(g) < tol:
            break
        step = 1.0
        while step > 1e-12:
            trial = orthonormal(v - step * p @ g)
            new = upper_bound(trial, m, h)
            if new is not None and new < value - 1e-4 * step * (g**2).sum():
                break
            step /= 2
        else:
            break
        v, value = trial, new
    return v, trail


def bounds(v: np.ndarray, m: np.ndarray, h: np.ndarray) -> dict[str, float | None]:
    """Upper and lower bound and half the trace of C = H-like moments outside the subspace."""
    p = complement(v)
    l = np.linalg.eigvalsh(p.T @ h @ p)
    mp = p.T @ m @ p
    sign, log_m = np.linalg.slogdet(mp)
    low = 0.5 * float(p.shape[1] - np.trace(np.linalg.inv(p.T @ h @ p)) - log_m) if len(l) and l.min() > 1e-12 and sign > 0 else None
    return {"upper": upper_bound(v, m, h), "lower": None if low is None else max(low, 0.0), "half_trace": 0.5 * float(np.trace(p.T @ (m + h - 2 * np.eye(len(m))) @ p))}


def tail_sum_bounds(c: np.ndarray, c_hat: np.ndarray, r: int) -> dict[str, float]:
    """How far the mass outside the estimated subspace can exceed the optimum: by operator norm, and by the sum of the r
    largest singular values, of the difference."""
    s = np.sort(np.abs(np.linalg.eigvalsh(c_hat - c)))[::-1]
    p = complement(top_eigenvectors(c_hat, r)[1])
    excess = float(np.trace(p.T @ c @ p) - np.sort(np.linalg.eigvalsh(c))[: len(c) - r].sum())
    return {"excess": excess, "operator": float(2 * r * s[0]), "ky_fan": float(2 * s[:r].sum())}


def certificate(v: np.ndarray, c: np.ndarray) -> float:
    """Half the mass of C outside the subspace."""
    p = complement(orthonormal(v))
    return 0.5 * float(np.trace(p.T @ c @ p))
