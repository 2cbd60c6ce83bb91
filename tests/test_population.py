"""Derivatives as text against differences, moments of densities against numpy, and draws against their model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import jets
from skerry.operators.population import density_moments, score_texts
from skerry.plans import draws, models


def bent(x):
    a, b = x
    return jets.log(1 + a * a) * b - 0.3 * jets.exp(-(b**2)) + jets.tanh(a * b) / (2 + a**2) - a**4 * 0.01 + 3


def at(v):
    a, b = v
    return math.log(1 + a * a) * b - 0.3 * math.exp(-b * b) + math.tanh(a * b) / (2 + a * a) - 0.01 * a**4 + 3


def test_derivatives(spark):
    got = bent(jets.variables(["a", "b"]))
    rows = [(0.3, -1.2), (2.0, 0.7), (-1.5, -0.1), (0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double").select("a", "b", *(F.expr(t).alias(n) for n, t in (("v", got.text), ("da", got.first[0]), ("db", got.first[1]), ("daa", got.second[0]), ("dbb", got.second[1]))))
    e = 1e-4
    for r in df.collect():
        v = np.array([r.a, r.b])
        assert abs(r.v - at(v)) < 1e-12
        for k, (one, two) in enumerate(((r.da, r.daa), (r.db, r.dbb))):
            h = e * np.eye(2)[k]
            assert abs(one - (at(v + h) - at(v - h)) / (2 * e)) < 1e-6 and abs(two - (at(v + h) - 2 * at(v) + at(v - h)) / e**2) < 1e-4
    assert jets.variables(["a"])[0].second == (None,) and (2.0 - jets.variables(["a"])[0]).first[0] is not None


def test_moments_of_a_density(spark):
    """A normal law whose scores are known: H is the inverse correlation, and C its excess squared, times M."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 2)) @ np.array([[2.0, 0.0], [0.9, 0.5]]).T + [1.0, -2.0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0), (float("nan"), 0.0)], "a double, b double")
    p = np.linalg.inv(np.array([[4.0, 1.8], [1.8, 0.81 + 0.25]]))
    s = np.sqrt([4.0, 1.06])

    def density(v):
        a, b = v[0] - 1.0, v[1] + 2.0
        return (a * a * p[0, 0] + 2 * p[0, 1] * a * b + b * b * p[1, 1]) * -0.5

    got = {(r.i, r.j): r for r in density_moments(df, ["a", "b"], density, [lambda v: (v[0] - 1.0) / s[0], lambda v: (v[0] + 2.0) / s[1]]).collect()}
    z = (x - [1.0, -2.0]) / s
    t = -(x - [1.0, -2.0]) @ p * s
    for (i, j), r in got.items():
        assert math.isclose(r.m, (z[:, i] * z[:, j]).mean(), rel_tol=1e-9) and math.isclose(r.h, (t[:, i] * t[:, j]).mean(), rel_tol=1e-9)
        assert math.isclose(r.c, ((t + z)[:, i] * (t + z)[:, j]).mean(), rel_tol=1e-8, abs_tol=1e-12)
    with pytest.raises(ValueError):
        score_texts(["a", "b"], density, [lambda v: v[0] * 0.0 + 1.0, lambda v: v[0]])


@pytest.mark.parametrize("constrained", [False, True])
def test_draws_follow_the_model(spark, constrained):
    rng = np.random.default_rng(3)
    w = rng.standard_normal((5000, 2))
    w[:, 1] = 0.85 * (w[:, 0] ** 2 - 1) / math.sqrt(2) + math.sqrt(1 - 0.85**2) * w[:, 1]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(w)], "id bigint, a double, b double").repartition(3)
    model = models.ReducedDensity(["a", "b"], r=2, inner_degree=4, constrained=constrained, points=1 << 12).fit(df, "id")
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).repartition(5)
    got = {r.key: (r.a, r.b) for r in draws.draw(model, keys, "key").collect()}
    assert len(got) == 20_000
    some = keys.where("key < 'k2'").coalesce(1)
    assert all(got[r.key] == (r.a, r.b) for r in draws.draw(model, some, "key").collect())
    x = np.array(list(got.values()))
    # the model's own moments, by a grid
    g = [np.linspace(m.grid[0], m.grid[-1], 401) for m in model.base.marginals]
    at_ = np.stack(np.meshgrid(*g, indexing="ij"), -1).reshape(-1, 2)
    p = np.exp(model.log_density(at_))
    p /= p.sum()
    for f in (lambda v: v[:, 0], lambda v: v[:, 1], lambda v: v[:, 0] ** 2, lambda v: v[:, 1] ** 2, lambda v: v[:, 0] ** 2 * v[:, 1]):
        mean = p @ f(at_)
        assert abs(f(x).mean() - mean) < 5 * math.sqrt(max(p @ f(at_) ** 2 - mean**2, 0) / len(x)) + 0.01
    for j in (0, 1):  # distribution functions
        inside = [(p * (at_[:, j] <= q)).sum() for q in np.quantile(x[:, j], [0.1, 0.5, 0.9])]
        assert np.allclose(inside, [0.1, 0.5, 0.9], atol=0.02)
    if not constrained:
        u = draws._uniforms(np.arange(2000, dtype=np.uint64) * np.uint64(7919), 0, 3)
        x0 = np.stack([m.quantile(u[:, j]) for j, m in enumerate(model.base.marginals)], 1)
        share = np.mean(np.exp(model.potential(model.base.ranks(x0) @ model.V) - model.cap))
        assert abs(share - draws.acceptance(model)) < 0.2 * draws.acceptance(model) + 0.01
        assert abs(u.mean() - 0.5) < 0.02 and len(np.unique(u)) == u.size
    model.secondary = True
    with pytest.raises(ValueError):
        draws.upper_bound(model)
