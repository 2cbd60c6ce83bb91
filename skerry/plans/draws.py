"""Draws from a fitted estimator, one for each key of a table.

A proposal takes each column by the inverse of its marginal; it is kept with the ratio of the potential to its upper bound, the
cap, as probability. All numbers follow from the key, the seed and the number of the trial, so a rerun and another
partitioning give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.plans.models import ReducedDensity

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TRIALS = 16
_ROWS = 4096


def _uniforms(seeds: np.ndarray, first: int, count: int) -> np.ndarray:
    """Numbers in (0, 1): a row a seed, `count` of its sequence from the first on. Every bit of a place's number is spread by
    multiplications and shifts."""
    x = seeds[:, None] + (np.arange(first, first + count, dtype=np.uint64) + np.uint64(1)) * _ODD
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def upper_bound(model: ReducedDensity) -> float:
    """What the potential stays below: the cap, or the level of a constrained fit."""
    bound = model.info.get("tau", math.inf) if model.constrained else model.cap
    if model.secondary or not math.isfinite(bound):
        raise ValueError("draws need a potential with an upper bound, on the projections themselves")
    return bound


def acceptance(model: ReducedDensity) -> float:
    """The share of proposals that is kept, by the model's own masses."""
    return math.exp(min(0.0, model.log_z + model.log_mass - upper_bound(model)))


def draw(model: ReducedDensity, keys: DataFrame, key: str, seed: int = 0, most_trials: int = 1 << 20) -> DataFrame:
    """key and the model's columns: a draw for each row. Null keys are one key, and equal keys draw alike. A row that keeps no
    proposal out of most_trials is an error, as is a potential above the bound."""
    bound, base, v, columns = upper_bound(model), model.base, model.V, model.columns
    potential = model.potential
    slack = 1e-6 + (1e-2 * max(1.0, abs(bound)) if model.constrained else 0.0)  # between the points that a constrained fit looked at
    schema = f"`{key}` {keys.schema[key].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in columns)
    d = len(columns)

    def proposals(seeds: np.ndarray, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        u = _uniforms(seeds, first * (d + 1), count * (d + 1)).reshape(-1, d + 1)
        x = np.stack([m.quantile(u[:, j]) for j, m in enumerate(base.marginals)], 1)
        level = potential(base.ranks(x) @ v)
        if (level > bound + slack).any():
            raise ValueError("the potential is above its bound")
        return x.reshape(len(seeds), count, d), (np.log(u[:, d]) < level - bound).reshape(len(seeds), count)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            seeds = b.column(1).to_numpy().view(np.uint64)
            out = np.empty((len(seeds), d))
            for low in range(0, len(seeds), _ROWS):
                left, trial = np.arange(low, min(len(seeds), low + _ROWS)), 0
                while len(left):
                    if trial >= most_trials:
                        raise ValueError("no proposal was kept")
                    x, kept = proposals(seeds[left], trial, _TRIALS)
                    some = kept.any(1)
                    out[left[some]] = x[some, kept[some].argmax(1)]
                    left, trial = left[~some], trial + _TRIALS
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, j]) for j in range(d))], [key, *columns])

    return keys.select(key, F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("seed_")).mapInArrow(run, schema)
