"""numpy forms of the normal distribution's functions, for kernels on Arrow batches and for solves on the driver."""

from __future__ import annotations

import math

import numpy as np

from skerry.functions.normal import AS241, HALF_LOG_2PI, HART_BOTTOM, HART_TOP


def _poly(c: list[float], x: np.ndarray) -> np.ndarray:
    return np.polynomial.polynomial.polyval(x, c)


def ndtri(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, float)
    q = p - 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        (ca, cb), (sa, sb), (ta, tb) = AS241
        x = 0.180625 - q * q
        centre = q * _poly(ca, x) / _poly(cb, x)
        near, far = tail - 1.6, tail - 5.0
        out = np.where(tail <= 5, _poly(sa, near) / _poly(sb, near), _poly(ta, far) / _poly(tb, far))
    return np.where(abs(q) <= 0.425, centre, np.where((p > 0) & (p < 1), np.sign(q) * out, np.where(p <= 0, -np.inf, np.inf)))


def upper_tail(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        e = np.exp(-0.5 * x * x)
    f = x + 0.65
    for k in (4, 3, 2, 1):
        f = x + k / f
    return np.where(x < 7.07106781186547, e * _poly(HART_TOP, np.minimum(x, 8)) / _poly(HART_BOTTOM, np.minimum(x, 8)), e / f / 2.506628274631)


def ndtr(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    t = upper_tail(np.abs(x))
    return np.where(x > 0, 1 - t, t)


def log_ndtr(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    t = upper_tail(np.abs(np.clip(x, -37, None)))
    far = np.minimum(x, -20.0)
    inverse = 1 / (far * far)
    series = -0.5 * far * far - np.log(-far) - HALF_LOG_2PI + np.log1p(inverse * (-1 + inverse * (3 + inverse * (-15 + 105 * inverse))))
    with np.errstate(divide="ignore"):
        return np.where(x < -20, series, np.where(x <= 0, np.log(t), np.log1p(-np.minimum(t, 0.5))))


def logit_phi(z: np.ndarray) -> np.ndarray:
    return log_ndtr(z) - log_ndtr(-np.asarray(z))


def inv_logit_phi(eta: np.ndarray) -> np.ndarray:
    eta = np.asarray(eta, float)
    a = np.abs(eta)
    tail = np.exp(-np.minimum(a, 700.0))
    inside = -ndtri(tail / (1 + tail))
    b = np.maximum(a, 600.0)
    z = np.sqrt(2 * b - np.log(4 * math.pi * b))
    z = z + (b + log_ndtr(-z)) / (z + 1 / z)
    return np.sign(eta) * np.where(a < 700, inside, z)


def log_jacobian(z: np.ndarray) -> np.ndarray:
    return log_ndtr(z) + log_ndtr(-z) + 0.5 * z * z + HALF_LOG_2PI
