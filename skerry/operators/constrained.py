"""The score-matching quadratic under shape constraints, by cutting planes.

Equalities: mean derivatives zero, no terms above the largest even degree. Inequalities, both linear in the coefficients: the
leading form at most -eps in every direction, the potential at most tau at every point of a ball.

A ball is searched by rays. A table of directions, quasi-random points on the sphere that Spark makes from a range, is scanned
in parallel, beside a coarse net that is cut from the start; along each ray the potential is a polynomial in the radius, taken at Chebyshev nodes. The rows of the largest
violations come back (a top-n query), are refined by clouds of points that shrink around them, and become cuts; cuts with
slack leave again. The solve ends when no violation is above the tolerance. If the level can't be met together with the rest, a
second phase raises it as little as it takes, by one more variable in the solve, and says so.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skerry.functions import normal_np as N
from skerry.functions.hermite import Index, total_degrees, values
from skerry.functions.sobol import sobol
from skerry.operators.solvers import barrier_qp

FORM, LEVEL, BAD = 0, 1, 2
#: Directions of the table and radii of a ray, as shares of the ball's radius.
DIRECTIONS = 1 << 13
RADII = (1 - np.cos(np.pi * np.arange(1, 33) / 32)) / 2
_FOUND = pa.schema([("kind", pa.int32()), ("excess", pa.float64()), ("point", pa.list_(pa.float64()))])
_FOUND_SQL = "kind int, excess double, point array<double>"


def leading_rows(indices: list[Index], degree: int, at: np.ndarray) -> np.ndarray:
    """Rows that map coefficients to the form of the given degree: u^alpha / sqrt(alpha!)."""
    out = np.zeros((len(at), len(indices)))
    for k, (support, powers) in enumerate(indices):
        if sum(powers) == degree:
            out[:, k] = np.prod([at[:, i] ** g for i, g in zip(support, powers, strict=True)], 0) / math.sqrt(math.prod(map(math.factorial, powers)))
    return out


def on_sphere(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def into_ball(x: np.ndarray, radius: float) -> np.ndarray:
    return x * np.minimum(1.0, radius / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))


@dataclass
class Shape:
    """What is asked of the coefficients, and how far a point breaks it. Sent to the tasks of the search."""

    indices: list[Index]
    even: int
    r: int
    radius: float
    eps: float
    tau: float
    evaluate: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def excess(self, kind: int, theta: np.ndarray, at: np.ndarray) -> np.ndarray:
        if kind == FORM:
            return leading_rows(self.indices, self.even, at) @ theta + self.eps
        return (self.evaluate(at, theta) if self.evaluate else values(at, self.indices) @ theta) - self.tau

    def inside(self, kind: int, at: np.ndarray) -> np.ndarray:
        return on_sphere(at) if kind == FORM else into_ball(at, self.radius)

    def rows(self, kind: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts g theta <= h at the points, of length one."""
        g = leading_rows(self.indices, self.even, at) if kind == FORM else values(at, self.indices)
        scale = np.maximum(np.linalg.norm(g, axis=1), 1e-12)
        return g / scale[:, None], (-self.eps if kind == FORM else self.tau) / scale


def directions(numbers: np.ndarray, count: int, r: int) -> np.ndarray:
    """The directions of the given numbers below count."""
    return on_sphere(N.ndtri(sobol(count, r, 11)[numbers]))


def _scan(shape: Shape, theta: np.ndarray, at: np.ndarray, most: int) -> list[tuple[int, float, list[float]]]:
    """The largest excesses of each kind over the rays in these directions, and how many values weren't finite."""
    out: list[tuple[int, float, list[float]]] = []
    form = shape.excess(FORM, theta, at)
    out += [(FORM, float(form[k]), at[k].tolist()) for k in np.argsort(-form)[:most]]
    ray = (at[:, None, :] * (shape.radius * RADII)[:, None]).reshape(-1, shape.r)
    level = shape.excess(LEVEL, theta, ray)
    bad = ~np.isfinite(level)
    level[bad] = -np.inf
    best = level.reshape(len(at), -1).argmax(1) + np.arange(len(at)) * len(RADII)  # one point a ray
    best = best[np.argsort(-level[best])[:most]]
    out += [(LEVEL, float(level[k]), ray[k].tolist()) for k in best if np.isfinite(level[k])]
    return [*out, (BAD, float(bad.sum()), [])]


def worst_points(spark: SparkSession | None, shape: Shape, theta: np.ndarray, most: int = 40, count: int = DIRECTIONS) -> dict[int, list[tuple[float, list[float]]]]:
    """By kind, the points of the largest excesses over the table of directions. Each task sends its own `most`."""
    if spark is None:
        found = _scan(shape, theta, directions(np.arange(count), count, shape.r), most)
        return {kind: [(e, p) for k, e, p in found if k == kind] for kind in (FORM, LEVEL, BAD)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = _scan(shape, theta, directions(b.column(0).to_numpy(), count, shape.r), most)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND)

    tasks = max(1, min(spark.sparkContext.defaultParallelism, count // 1024))
    found = spark.range(0, count, 1, tasks).mapInArrow(run, _FOUND_SQL)
    top = F.slice(F.sort_array(F.collect_list(F.struct("excess", "point")), False), 1, most)
    rows = found.groupBy("kind").agg(F.when(F.col("kind") != BAD, top).alias("top"), F.sum("excess").alias("total")).collect()  # three rows
    out: dict[int, list] = {FORM: [], LEVEL: [], BAD: []}
    for row in rows:
        out[row["kind"]] = [(row["total"], [])] if row["kind"] == BAD else [(x["excess"], list(x["point"])) for x in row["top"]]
    return out


def refine(shape: Shape, kind: int, theta: np.ndarray, at: np.ndarray, seed: int, cloud: int = 48, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """Each point moved to the best of a cloud around it, again and again, the cloud shrinking: (points, excesses, values that
    weren't finite)."""
    rng = np.random.default_rng(seed)
    size = (1.0 if kind == FORM else shape.radius) * 0.2
    at = shape.inside(kind, at)
    best, bad = shape.excess(kind, theta, at), 0
    for _ in range(rounds):
        tried = shape.inside(kind, (at[:, None, :] + size * rng.standard_normal((len(at), cloud, shape.r))).reshape(-1, shape.r))
        new = shape.excess(kind, theta, tried)
        bad += int((~np.isfinite(new)).sum())
        new = np.where(np.isfinite(new), new, -np.inf).reshape(len(at), cloud)
        pick = new.argmax(1)
        better = new[np.arange(len(at)), pick] > best
        at = np.where(better[:, None], tried.reshape(len(at), cloud, -1)[np.arange(len(at)), pick], at)
        best = np.maximum(best, new.max(1))
        size *= 0.55
    return at, best, bad


def highest_form(theta: np.ndarray, indices: list[Index], degree: int, r: int, seed: int) -> tuple[float, np.ndarray]:
    """The leading form's largest value on the sphere that the search finds, and where."""
    shape = Shape(indices, degree, r, 1.0, 0.0, math.inf)
    at = np.array([p for _, p in worst_points(None, shape, theta)[FORM]])
    at, value, _ = refine(shape, FORM, theta, at, seed)
    return float(value.max()), at


@dataclass
class Cuts:
    kind: list[int] = field(default_factory=list)
    point: list[np.ndarray] = field(default_factory=list)
    idle: list[int] = field(default_factory=list)

    def add(self, kind: int, points: np.ndarray) -> None:
        for p in points:
            self.kind.append(kind)
            self.point.append(p)
            self.idle.append(0)

    def rows(self, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        g, h = np.zeros((len(self.kind), len(shape.indices))), np.zeros(len(self.kind))
        for kind in (FORM, LEVEL):
            mine = [k for k, x in enumerate(self.kind) if x == kind]
            if mine:
                g[mine], h[mine] = shape.rows(kind, np.array([self.point[k] for k in mine]))
        return g, h

    def drop_slack(self, slack: np.ndarray, patience: int = 10) -> None:
        """Cuts that didn't bind for some rounds leave; if they are needed again, the search finds them again."""
        self.idle = [0 if s < 1e-4 else n + 1 for n, s in zip(self.idle, slack.tolist(), strict=True)]
        kept = [k for k, n in enumerate(self.idle) if n < patience]
        self.kind, self.point, self.idle = ([x[k] for k in kept] for x in (self.kind, self.point, self.idle))


def _spread(points: np.ndarray, apart: float) -> np.ndarray:
    """The points, in their order, without those close to one that was taken."""
    kept: list[np.ndarray] = []
    for p in points:
        if all(np.linalg.norm(p - q) > apart for q in kept):
            kept.append(p)
    return np.array(kept).reshape(-1, points.shape[1])


def _elastic_solve(m: np.ndarray, b: np.ndarray, equal: np.ndarray, g: np.ndarray, h: np.ndarray, per_unit: np.ndarray) -> tuple[np.ndarray, float, dict]:
    """The solve with one more variable, how far the level is raised, at a price far above the cost's slopes. per_unit: what
    raising it by one adds to each cut's bound."""
    n = len(b)
    wide, price = np.zeros((n + 1, n + 1)), 100.0 * (1.0 + abs(b).max())
    wide[:n, :n], wide[n, n] = m, 1e-6
    rows = np.vstack([np.column_stack([g, -per_unit]), np.append(np.zeros(n), -1.0)])
    x, solved = barrier_qp(wide, np.append(b, -price), np.column_stack([equal, np.zeros(len(equal))]), rows, np.append(h, 0.0))
    return x[:n], max(0.0, float(x[n])), solved


def _cut_until_met(spark: SparkSession | None, m: np.ndarray, b: np.ndarray, equal: np.ndarray, shape: Shape, cuts: Cuts, rounds: int, elastic: bool = False) -> tuple[np.ndarray, dict]:
    report: dict = {}
    asked = shape
    for k in range(1, rounds + 1):
        g, h = cuts.rows(asked)
        if elastic:
            unit = np.array(cuts.kind) == LEVEL
            per_unit = np.where(unit, cuts.rows(replace(asked, tau=asked.tau + 1.0))[1] - h, 0.0)
            theta, raised, solved = _elastic_solve(m, b, equal, g, h, per_unit)
            shape = replace(asked, tau=asked.tau + raised)
            h = h + raised * per_unit
        else:
            theta, solved = barrier_qp(m, b, equal, g, h)
        if len(h):
            cuts.drop_slack(h - g @ theta)
        found, largest, bad = worst_points(spark, shape, theta), {}, 0
        bad += int(found[BAD][0][0])
        for kind, allowed in ((FORM, 0.2 * shape.eps), (LEVEL, 1e-3 * max(1.0, abs(shape.tau)))):
            points = np.array([p for _, p in found[kind]]).reshape(-1, shape.r)
            if not len(points):
                largest[kind] = (-math.inf, True)
                continue
            at, excess, more = refine(shape, kind, theta, points, k)
            bad += more
            largest[kind] = (float(excess.max()), bool(excess.max() <= allowed))
            over = excess > 0
            if not largest[kind][1]:
                cuts.add(kind, _spread(at[over][np.argsort(-excess[over])], 0.02 * (1.0 if kind == FORM else shape.radius)))
        met = largest[FORM][1] and largest[LEVEL][1]
        report = {"tau": shape.tau, "form": largest[FORM][0] - shape.eps, "level": largest[LEVEL][0] + shape.tau, "rounds": k, "active": solved["active"], "cuts": len(cuts.kind), "not_finite": bad, "form_met": largest[FORM][1], "level_met": largest[LEVEL][1], "converged": met and not bad}
        if met:
            break
    return theta, report


def fit_constrained(m: np.ndarray, b: np.ndarray, centring: np.ndarray, indices: list[Index], degree: int, tau: float, start: np.ndarray, radius: float, r: int, eps: float = 1e-3, rounds: int = 30, evaluate=None) -> tuple[np.ndarray, dict]:
    """Coefficients and a report. start: coefficients without the constraints, whose worst points are cuts from the start, too.

    converged: both kinds are met and the search saw only finite values. relaxed: tau couldn't be held together with the rest,
    so the least level that could is held in its place; the report has both, tau_asked and tau.
    """
    even = degree - degree % 2
    over = np.flatnonzero(total_degrees(indices) > even)
    equal = np.vstack([centring, np.eye(len(indices))[over]])
    spark, cuts = SparkSession.getActiveSession(), Cuts()
    shape = Shape(indices, even, r, radius, eps, tau, evaluate)
    coarse = directions(np.arange(64 * r), DIRECTIONS, r)  # a net to begin with, so that few rounds are needed
    cuts.add(FORM, coarse)
    cuts.add(LEVEL, (coarse[:, None, :] * (radius * RADII[3::4])[:, None]).reshape(-1, r))
    first = worst_points(spark, shape, start)
    for kind in (FORM, LEVEL):
        points = np.array([p for e, p in first[kind] if e > 0]).reshape(-1, r)
        cuts.add(kind, _spread(points, 0.02 * (1.0 if kind == FORM else radius)))
    theta, report = _cut_until_met(spark, m, b, equal, shape, cuts, rounds)
    relaxed = not report["level_met"]
    if relaxed:
        before = report
        theta, report = _cut_until_met(spark, m, b, equal, shape, cuts, rounds, elastic=True)
        report["rounds"] += before["rounds"]
        report["not_finite"] += before["not_finite"]
        report["converged"] = report["converged"] and not before["not_finite"]
    return theta, report | {"tau_asked": tau, "relaxed": relaxed, "eps": eps, "even_degree": even, "zeroed": len(over)}
