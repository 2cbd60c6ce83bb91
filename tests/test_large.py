"""Tiled grams, distributed solves and the range finder against the dense computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions.hermite import dictionary
from skerry.operators import range_finder, scorematch, tiles
from skerry.plans import grids, models, montecarlo, pairs


@pytest.fixture(scope="module")
def normal(spark):
    rng = np.random.default_rng(0)
    z = rng.standard_normal((3000, 6))
    z[:, 1] += 0.4 * (z[:, 0] ** 2 - 1)
    z[:, 4] = 0.8 * z[:, 3] + 0.6 * z[:, 4]
    names = [f"z{k}" for k in range(6)]
    rows = [tuple(map(float, r)) for r in z] + [(float("nan"),) * 6, (None,) * 6, (float("inf"), *[0.0] * 5)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5).cache(), names, z


@pytest.mark.parametrize(("size", "block_bytes"), [(512, 1 << 27), (50, 8 * 120**2), (7, 1)])
def test_tiled_gram_is_the_dense_one(normal, size, block_bytes):
    df, names, z = normal
    terms = dictionary(6, 3 if size == 7 else 4, 3, linear=True)[: 40 if size == 7 else None]
    A, b, C = (x / len(z) for x in scorematch.block_sums(z, terms))
    got = tiles.tiled_statistics(df, names, terms, size, block_bytes)
    assert got.n == len(z) and np.allclose(got.b, b) and np.allclose(got.C, C)
    x = np.random.default_rng(1).standard_normal((len(terms), 3))
    assert np.allclose(got.product(x), A @ x) and np.allclose(got.product(x[:, 0]), A @ x[:, 0])
    assert np.allclose(got.diagonal(), np.diag(A))
    assert got.tiles.where("row > col").count() == 0 and got.tiles.agg(F.max(F.size("v"))).first()[0] <= size**2


def test_solve_at_three_hundred_terms(normal):
    df, names, z = normal
    terms = dictionary(6, 5, 3)
    assert len(terms) > 300
    got = tiles.tiled_statistics(df, names, terms, 64, 8 * 200**2)
    dense = scorematch.statistics(df, names, terms)[0]
    theta, report = tiles.solve(got, got.b, 0.05)
    want = np.linalg.solve(dense.A + 0.05 * np.eye(len(terms)), dense.b)
    assert report["converged"] and report["steps"] < 300 and np.allclose(theta, want, atol=1e-7)
    assert np.allclose(tiles.degree_traces(got, terms, theta), scorematch.degree_traces(dense, terms, theta))
    cut, stopped = tiles.solve(got, got.b, 0.05, most=2)
    assert not stopped["converged"] and stopped["steps"] == 2


def test_no_block_is_as_large_as_the_gram():
    for m, size, most in ((25_770, 512, 1 << 27), (5_000, 512, 1 << 25), (10, 512, 1 << 27), (100, 7, 1)):
        blocks = tiles.blocks_of(m, size, most)
        many = -(-m // size)
        assert sorted((i, j) for a, b in blocks for i in a for j in b if i <= j) == [(i, j) for i in range(many) for j in range(i, many)]
        assert all(8 * len(a) * len(b) * size**2 <= max(most, 8 * size**2) for a, b in blocks)


@pytest.mark.parametrize("parts", [1, 9])
def test_eigenpairs(spark, parts):
    rng = np.random.default_rng(3)
    t = rng.standard_normal((500, 40)) * np.linspace(3, 0.1, 40)
    rows = [(r.tolist(),) for r in t] + [(None,), ([1.0],), ([float("nan")] * 40,), ([None] + [0.0] * 39,)]
    values, vectors, n = range_finder.eigenpairs(spark.createDataFrame(rows, "v array<double>").repartition(parts), "v", 40, 5)
    want, full = np.linalg.eigh(t.T @ t / 500)
    assert n == 500 and np.allclose(values, want[::-1][:5], rtol=1e-6)
    assert np.allclose(np.abs((full[:, ::-1][:, :5] * vectors).sum(0)), 1, atol=1e-5)
    assert np.allclose(vectors.T @ vectors, np.eye(5))


def test_eigenpairs_of_few_or_no_rows(spark):
    df = spark.createDataFrame([([3.0, 0.0, 4.0],)], "v array<double>").repartition(3)
    values, vectors, n = range_finder.eigenpairs(df, "v", 3, 2)
    assert n == 1 and np.allclose(values, [25, 0]) and np.allclose(vectors[:, 0], [0.6, 0, 0.8])
    assert range_finder.eigenpairs(df.limit(0), "v", 3, 2)[2] == 0
    with pytest.raises(ValueError):
        range_finder.eigenpairs(df, "v", 3, 4)


def neighbours(x, k):
    q = np.sort(((x[:, None] - x[None]) ** 2).sum(2), 1)
    return q[:, : k + 1]


@pytest.mark.parametrize("block", [1024, 40])
def test_neighbours_by_tree(spark, block):
    """Clusters, lone points and a third of all rows on one point; most pairs of leaves are never met."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((500, 3)), 0.01 * rng.standard_normal((300, 3)) + 5, np.full((400, 3), -2.5), rng.uniform(-90, 90, (8, 3))])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)] + [(-1, None, 0.0, 0.0), (-2, float("nan"), 0.0, 0.0)], "id int, a double, b double, c double").repartition(5)
    points, values, near = montecarlo.neighbour_distances(df, ["a", "b", "c"], 5, block)
    got = {}
    for r in values.join(points.select("block", "points", "weights"), "block").collect():
        for p, w, v in zip(np.frombuffer(r.points).reshape(-1, 3), np.frombuffer(r.weights), np.frombuffer(r.value).reshape(-1, 6), strict=True):
            got[tuple(p)] = (int(w), np.sort(v))
    want = neighbours(x, 5)
    assert sum(w for w, _ in got.values()) == len(x)
    assert all(np.allclose(got[tuple(p)][1], q, atol=1e-12) for p, q in zip(x, want, strict=True))
    if block == 40:
        leaves = points.select("leaf").distinct().count()
        assert leaves > 15 and near.count() < 0.5 * leaves * points.count()
        assert points.agg(F.max(F.length("weights"))).first()[0] <= 8 * block


def test_too_few_rows_for_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "id int, a double")
    got = montecarlo.neighbour_entropy(df, ["a"], "id")
    assert np.isnan(got["entropy"]) and got["n"] == 2 and montecarlo.neighbour_entropy(df.limit(0), ["a"], "id")["n"] == 0


def test_kernel_sums_within_reach(spark):
    """Rows of their own, copies, and rows far from every centre, which are summed over all of them."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((2500, 2)), np.tile([[0.3, -0.2]], (900, 1))])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id bigint, a double, b double").repartition(4)
    model = models.KernelDensity(["a", "b"]).fit(df)
    asked = np.concatenate([x[::50], [[40.0, -40.0], [8.0, 8.0], [3.5, -3.7]]])
    queries = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(asked)] + [(900, float("nan"), 0.0)], "id bigint, a double, b double")
    got = {r.id: r.log_density for r in model.evaluate(queries).collect()}
    y, c = (model.base.ranks(v) @ model.root.T for v in (asked, x))
    total = np.exp(-0.5 * ((y[:, None] - c[None]) ** 2).sum(2)).sum(1)
    norm = np.log(len(x)) + np.log(2 * np.pi) - np.log(np.diag(model.root)).sum()
    want = np.log(np.maximum(total, 1e-300)) - norm + model.base.log_density(asked) + 0.5 * (model.base.ranks(asked) ** 2).sum(1) + np.log(2 * np.pi)
    assert model.n == len(x) and np.allclose([got[k] for k in range(len(asked))], want, atol=1e-5) and np.isnan(got[900])
    near = pairs.near_leaves(model.centres, model.centres, 2, 1.0)
    assert near.join(model.centres.select("block", "leaf"), "block").where("leaf = other").count() == model.centres.count()


@pytest.mark.parametrize("d", [1, 2, 3])
def test_kernel_sums_meet_no_pairs(spark, d, monkeypatch):
    """Rows near centres are summed by way of the grid alone, tiles of many rows dealt out among tasks."""
    monkeypatch.setattr(pairs, "over_pairs", lambda *a: pytest.fail("pairs were met"))
    monkeypatch.setattr(grids, "MOST", 100)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((700, d)) @ (np.eye(d) + 0.7 * np.eye(d, k=1)), np.full((250, d), 0.2), rng.uniform(-30, 30, (20, d))])
    names = ["a", "b", "c"][:d]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)] + [(-1, *[float("nan")] * d), (-2, *[None] * d)], f"id int, {', '.join(f'{n} double' for n in names)}").repartition(3)
    model = models.KernelDensity(names).fit(df.where("id >= 0"))
    got = {r.id: r.log_density for r in model.evaluate(df).collect()}
    y = model.base.ranks(x) @ model.root.T
    total = np.exp(-0.5 * ((y[:, None] - y[None]) ** 2).sum(2)).sum(1)
    norm = np.log(len(x)) + d / 2 * np.log(2 * np.pi) - np.log(np.diag(model.root)).sum()
    want = np.log(total) - norm + model.base.log_density(x) + 0.5 * (model.base.ranks(x) ** 2).sum(1) + d / 2 * np.log(2 * np.pi)
    assert len(got) == len(x) + 2 and np.isnan(got[-1]) and np.isnan(got[-2])
    assert np.isfinite(want).all() and np.abs(np.array([got[k] for k in range(len(x))]) - want).max() < 1e-9
    assert model.grid.count() > 0


def test_neighbours_of_wide_vectors(spark):
    """Distances by matrix products, exact also for copies and for near copies far from the origin."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((300, 20)) + 50
    x = np.concatenate([x, x[:60] + 1e-7 * rng.standard_normal((60, 20)), x[:40], x[:40], np.full((7, 20), 3.0)])
    want = neighbours(x, 4)
    got = montecarlo.wide_nearest(x, x, np.ones(len(x)), 4)
    assert np.allclose(got, want, rtol=1e-9, atol=0)
    known = montecarlo.wide_nearest(x, x[:200], np.ones(200), 4)
    more = montecarlo.wide_nearest(x, x[200:], np.ones(len(x) - 200), 4, known)
    assert np.allclose(np.sort(np.concatenate([known, more], 1), 1)[:, :5], want, rtol=1e-9, atol=0)
    names = [f"v{j}" for j in range(20)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(3)
    points, values, _ = montecarlo.neighbour_distances(df, names, 4, 40)
    found = {}
    for r in values.join(points.select("block", "points"), "block").collect():
        found |= {tuple(p): np.sort(v) for p, v in zip(np.frombuffer(r.points).reshape(-1, 20), np.frombuffer(r.value).reshape(-1, 5), strict=True)}
    assert all(np.allclose(found[tuple(p)], q, rtol=1e-9, atol=0) for p, q in zip(x, want, strict=True))
    assert np.isfinite(montecarlo.wide_nearest(x * 1e150, x * 1e150, np.ones(len(x)), 4)[:, 0]).all()
