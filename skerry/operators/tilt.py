"""Marginals as windowed Hermite tilts of a logistic base: score matching by column moments, tables for the maps.

For w = quantile of sigmoid(eta), the density is normal times exp(window(w) * (t2 h2(w) + t4 h4(w))). The fit needs a few
means a column; where the tilt is small the column counts as logistic and all maps are the identity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import normal_np as N
from skerry.functions.hermite import hermite_sql, hermite_values
from skerry.functions.normal import ndtri_sql
from skerry.functions.sqltext import num

#: Degrees of the tilt, where the window begins and ends, the grid, and the size of a tilt that counts.
DEGREES = (2, 4)
WINDOW = (3.5, 6.0)
GRID = (-12.0, 12.0, 8001)
LEAST = 3e-3


def window(w: np.ndarray) -> np.ndarray:
    """1 inside, a raised cosine, 0 outside."""
    t = np.clip((np.abs(w) - WINDOW[0]) / (WINDOW[1] - WINDOW[0]), 0.0, 1.0)
    return 0.5 * (1 + np.cos(np.pi * t))


def tilt(theta: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = hermite_values(w, max(DEGREES))
    return window(w) * sum(t * h[..., k] for t, k in zip(theta, DEGREES, strict=True))


@dataclass(frozen=True)
class TiltedMarginal:
    theta: np.ndarray
    log_norm: float
    cdf: np.ndarray | None  # on GRID; None for a logistic column

    def to_z(self, w: np.ndarray) -> np.ndarray:
        return w if self.cdf is None else N.ndtri(np.clip(np.interp(w, np.linspace(*GRID), self.cdf), 1e-12, 1 - 1e-12))

    def to_w(self, z: np.ndarray) -> np.ndarray:
        return z if self.cdf is None else np.interp(np.clip(N.ndtr(z), 1e-12, 1 - 1e-12), self.cdf, np.linspace(*GRID))

    def correction(self, w: np.ndarray) -> np.ndarray:
        """log density against the normal base."""
        return np.zeros(len(w)) if self.cdf is None else tilt(self.theta, w) - self.log_norm


def tabulate(theta: np.ndarray) -> TiltedMarginal:
    if np.abs(theta).max() <= LEAST:
        return TiltedMarginal(np.zeros(len(DEGREES)), 0.0, None)
    w = np.linspace(*GRID)
    density = np.exp(tilt(theta, w) - 0.5 * w * w) / math.sqrt(2 * math.pi)
    area = np.concatenate(([0.0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(w))))
    return TiltedMarginal(theta, math.log(area[-1]), area / area[-1])


def fit_tilts(df: DataFrame, columns: list[str]) -> list[TiltedMarginal]:
    """A tilt for each column of eta, all from one aggregation."""
    cells = []
    for c in columns:
        p = f"greatest({num(1e-12)}, least({num(1 - 1e-12)}, {num(1.0)} / ({num(1.0)} + exp(-{c}))))"
        df = df.withColumn(f"{c}_w", F.expr(ndtri_sql(p)))
        w = f"{c}_w"
        first = {k: f"{num(math.sqrt(k))} * {hermite_sql(w, k - 1)}" for k in DEGREES}
        cells += [F.expr(f"avg({first[a]} * {first[b]})").alias(f"{c}_{a}_{b}") for a in DEGREES for b in DEGREES]
        cells += [F.expr(f"avg({w} * {first[k]} - {num(math.sqrt(k * (k - 1)))} * {hermite_sql(w, k - 2)})").alias(f"{c}_{k}") for k in DEGREES]
    row = df.agg(*cells).first()
    out = []
    for c in columns:
        m = np.array([[row[f"{c}_{a}_{b}"] for b in DEGREES] for a in DEGREES])
        out.append(tabulate(np.linalg.solve(m + 1e-10 * np.eye(len(DEGREES)), np.array([row[f"{c}_{k}"] for k in DEGREES]))))
    return out
