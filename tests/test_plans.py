"""Laws, models, selection, nested Monte Carlo, cells and streams."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import normal_np as N
from skerry.functions.hermite import dictionary
from skerry.operators.scorematch import stein_residual
from skerry.operators.subspace import sin_theta
from skerry.plans import models, montecarlo, registry, selection
from skerry.sources import laws, tables
from skerry.streaming.accumulate import Accumulator, windowed_moments

NAMES = sorted(laws.LAWS)


@pytest.mark.parametrize("name", NAMES)
def test_law_obeys_steins_identity(name):
    law = laws.LAWS[name]()
    z = N.inv_logit_phi(law.sample(6000, np.random.default_rng(0)))
    assert abs(z.mean(0)).max() < 0.08 and abs(z.std(0) - 1).max() < 0.08
    h, step = 1e-4, np.zeros(law.d)
    for j in (0, 1, law.d - 1):
        step[:] = 0
        step[j] = h
        f = lambda x: law.log_density(N.logit_phi(x)) - N.log_jacobian(x)[:, :].sum(1)  # noqa: E731  density of z
        score = (f(z + step) - f(z - step)) / (2 * h)
        assert abs((score * z[:, j]).mean() + 1) < 0.15 and abs(score.mean()) < 0.1


def test_sample_is_the_same_for_any_partitioning(spark):
    a = laws.sample_law(spark, "cusp_bend", 25_000, 3)
    assert a.count() == 25_000 and a.select("row_id").distinct().count() == 25_000
    b = laws.sample_law(spark, "cusp_bend", 25_000, 3).repartition(7)
    mark = lambda d: d.agg(F.sum(F.col("eta")[3]), F.sum("log_density")).first()
    assert np.allclose(mark(a), mark(b))


def test_quartic_pairs_normaliser():
    law = laws.QuarticPairs(strengths=(1.0,), d=2)
    g = np.linspace(-7, 7, 281)
    z = np.stack(np.meshgrid(g, g, indexing="ij"), -1).reshape(-1, 2)
    mass = np.exp(law.log_density(N.logit_phi(z)) - N.log_jacobian(z).sum(1)).sum() * (g[1] - g[0]) ** 2
    assert abs(mass - 1) < 0.02


def test_subspace_recovery(spark):
    law = laws.even_fold()
    df = laws.widen(laws.sample_law(spark, "even_fold", 10_000, 1), "eta", 20)
    columns = [f"x{k}" for k in range(20)]
    V, info = models.fit_subspace(df, columns, 4, 3, 2)
    exact = law.subspace(4, 10_000)
    random = np.linalg.qr(np.random.default_rng(0).standard_normal((20, 4)))[0]
    assert sin_theta(V, exact) < 0.75 and sin_theta(V, exact) < 0.5 * sin_theta(random, exact)
    assert math.isclose(info["trace"], info["eigenvalues"].sum() + info["rest"])


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(2)
    w = rng.standard_normal((6000, 3))
    w[:, 1] = 0.9 * (w[:, 0] ** 2 - 1) / math.sqrt(2) + math.sqrt(1 - 0.81) * w[:, 1]
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(w)], "id bigint, a double, b double, c double").persist()


def test_models_rank_as_they_should(pairs):
    train, test = pairs.where("id < 4500"), pairs.where("id >= 4500")
    score = {}
    for name, model in (("product", models.ProductOfMarginals(["a", "b", "c"]).fit(train)), ("copula", models.GaussianCopula(["a", "b", "c"]).fit(train)), ("kde", models.KernelDensity(["a", "b", "c"]).fit(train)), ("reduced", models.ReducedDensity(["a", "b", "c"], r=2, inner_degree=6).fit(train, "id"))):
        score[name] = model.evaluate(test).agg(F.avg("log_density")).first()[0]
    assert score["reduced"] > max(score["product"], score["copula"]) + 0.1 and all(map(math.isfinite, score.values()))
    assert abs(score["product"] - score["copula"]) < 0.1


def test_every_row_is_a_kernel_centre(pairs):
    model = models.KernelDensity(["a", "b", "c"]).fit(pairs)
    got = {r.id: r.log_density for r in model.evaluate(pairs).collect()}
    x = np.array([[r.a, r.b, r.c] for r in pairs.orderBy("id").collect()])
    base = models.ProductOfMarginals(["a", "b", "c"]).fit(pairs)
    z = base.ranks(x)
    cov = np.cov(z.T) * len(z) ** (-2 / 7)
    inv = np.linalg.inv(cov)
    for k in (0, 17, 3000, 5999):
        q = np.einsum("ni,ij,nj->n", z - z[k], inv, z - z[k])
        log_f = math.log(np.exp(-0.5 * q).sum() / len(z)) - 0.5 * np.linalg.slogdet(2 * math.pi * cov)[1]
        back = base.log_density(x[k : k + 1])[0] + 0.5 * (z[k] ** 2).sum() + 1.5 * math.log(2 * math.pi)
        assert abs(got[k] - log_f - back) < 1e-9
    assert model.n == len(got) == 6000


@pytest.mark.parametrize("kind", ["copula", "reduced"])
def test_densities_have_mass_one(spark, kind):
    """Few rows: ranks end early, so they aren't normal."""
    rng = np.random.default_rng(5)
    w = rng.standard_normal((40, 2))
    w[:, 1] = 0.95 * w[:, 0] + 0.3 * w[:, 1]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(w)], "id bigint, a double, b double")
    model = models.GaussianCopula(["a", "b"]).fit(df) if kind == "copula" else models.ReducedDensity(["a", "b"], r=2, inner_degree=4).fit(df, "id")
    g = [np.linspace(m.grid[0], m.grid[-1], 801) for m in (model if kind == "copula" else model.base).marginals]
    x = np.stack(np.meshgrid(*g, indexing="ij"), -1).reshape(-1, 2)
    mass = np.exp(model.log_density(x)).sum() * (g[0][1] - g[0][0]) * (g[1][1] - g[1][0])
    assert abs(mass - 1) < 0.005 and abs(model.log_mass) > 1e-3


def test_reduced_density_parts(pairs):
    model = models.ReducedDensity(["a", "b", "c"], r=2, inner_degree=4, constrained=True, points=1 << 12).fit(pairs, "id")
    g = np.linspace(-6, 6, 121)
    u = np.stack(np.meshgrid(g, g, indexing="ij"), -1).reshape(-1, 2)
    assert abs(np.exp(model.log_density_u(u)).sum() * 0.01 - 1) < 0.05
    assert model.gradient_u(u[:5]).shape == (5, 2) and model.info["zeroed"] == 0 and np.allclose(model.V.T @ model.V, np.eye(2), atol=1e-8)


def test_scores_satisfy_stein(pairs):
    from skerry.operators.ranks import rank_gaussianize
    from skerry.operators.scorematch import score_columns

    z = ["a_z", "b_z", "c_z"]
    ranked = rank_gaussianize(pairs.selectExpr("a", "0.7 * a + 0.7 * b AS b", "c"), ["a", "b", "c"]).select(*z)
    _, info = models.subspace_of(ranked, z, 2, 4, 2)
    scored = score_columns(ranked, z, info["indices"], info["theta"])
    assert stein_residual(scored, z, ["t0", "t1", "t2"]) < 0.6


def test_log_mass_of_constant_factors(pairs):
    base = models.ProductOfMarginals(["a", "b"]).fit(pairs)
    assert abs(models.log_mass(base.marginals, lambda x: np.zeros(len(x)), 4096)) < 1e-12
    assert abs(models.log_mass(base.marginals, lambda x: np.full(len(x), math.log(2.5)), 4096) - math.log(2.5)) < 1e-9
    with pytest.raises(ValueError):
        models.log_mean_exp(np.array([0.0, np.nan]))
    assert models.log_mean_exp(np.array([-np.inf, 0.0])) == math.log(0.5)


def test_selection(spark):
    left = lambda grid, d, most: [grid[r.place] for r in selection.within_memory(selection.candidate_table(spark, grid, d), most).orderBy("place").collect()]
    assert left([(4, 2, False), (4, 4, False)], 40, 1e9) == [(4, 2, False)]
    assert left([(4, 4, False), (4, 3, False)], 40, 1.0) == [(4, 3, False)]
    assert left([(4, 3), (5, 3)], 4, None) == [(4, 3), (5, 3)]


def test_one_standard_error(spark):
    risks = [("a", 1.0, 3, 0), ("a", 3.0, 3, 0), ("b", 1.9, 2, 1), ("b", 1.9, 2, 1), ("c", 1.95, 2, 2), ("c", 1.95, 2, 2)]
    rows = spark.createDataFrame(risks, "candidate string, risk double, size int, place int")
    assert selection.one_standard_error(rows, "candidate", "risk", "size", "place").first().candidate == "b"


def test_quartic_pairs_marginals():
    """Draws of the pairs have normal scores, and the density of a pair's sum is the one stated."""
    z = N.inv_logit_phi(laws.QuarticPairs().sample(40_000, np.random.default_rng(5)))
    assert np.all(np.abs(z.mean(0)) < 0.03) and np.all(np.abs(z.std(0) - 1) < 0.02) and abs((z[:, 0] ** 4).mean() - 3) < 0.2
    law = laws.QuarticPairs(strengths=(2.0,), d=2)
    g = np.linspace(-9, 9, 20_001)
    density = np.exp(-0.5 * g**2 - 2.0 * g**4 / 12)
    s = law.draw_sum(0, np.random.default_rng(6).uniform(size=200_000))
    assert abs((s**2).mean() - (g**2 * density).sum() / density.sum()) < 0.01
    assert np.corrcoef(z[:, 0], z[:, 1])[0, 1] < -0.1


def test_nested_kl_is_zero_at_the_exact_subspace(spark):
    law = laws.cusp_bend()
    exact = montecarlo.nested_kl(law, np.eye(20)[:, :4], 50, 512)
    assert abs(exact["kl"]) < 1e-6 and math.isclose(exact["ess"], 512)
    assert montecarlo.nested_kl(law, np.eye(20)[:, 4:8], 50, 512)["kl"] > 0.1
    with pytest.raises(ValueError):
        montecarlo.nested_kl(law, 2 * np.eye(20)[:, :4], 5, 5)


def over_normal(density):
    """f with exp(f) times the standard normal density the given one."""
    return lambda x: density(x) + 0.5 * (x**2).sum(1) + 0.5 * x.shape[1] * math.log(2 * math.pi)


def test_integrals_of_known_functions():
    rng = np.random.default_rng(0)
    f = over_normal(lambda x: -0.5 * ((x - 1) ** 2 / 0.25).sum(1) - x.shape[1] * math.log(0.5 * math.sqrt(2 * math.pi)) + 0.7)
    # E f under the normalised integrand, a normal law with mean 1 and deviation 1/2, by hand.
    mean = 3 * (-0.5 - math.log(0.5) + 0.5 * 1.25) + 0.7
    for name, integrate in montecarlo.INTEGRATORS.items():
        got = integrate(f, 3, rng)
        assert got.status == "ok" and abs(got.log_mass - 0.7) < 0.03 and abs(got.mean - mean) < 0.08 and abs(got.kl - (mean - 0.7)) < 0.1, name
    two = over_normal(lambda x: np.logaddexp(-0.5 * ((x - 3) ** 2).sum(1), -0.5 * ((x + 3) ** 2).sum(1)) - math.log(2) - 0.5 * x.shape[1] * math.log(2 * math.pi))
    assert abs(montecarlo.laplace_inner(two, 2, rng, 6000, 8).log_mass) < 0.1 and abs(montecarlo.quadrature_inner(two, 2, rng, starts=8).log_mass) < 0.02
    draws, rate = montecarlo.hmc(lambda x: -0.5 * (x**2).sum(1), np.zeros((40, 2)), 200, rng)
    assert rate > 0.5 and abs(draws[50:].std() - 1) < 0.1


def test_integrators_say_why_they_stop():
    rng = np.random.default_rng(1)
    nothing = lambda x: np.full(len(x), np.nan)
    assert montecarlo.laplace_inner(nothing, 2, rng).status == montecarlo.quadrature_inner(nothing, 2, rng).status == "no_mode"
    assert montecarlo.quadrature_inner(lambda x: np.zeros(len(x)), 9, rng).status == "too_many_nodes"
    flat = lambda x: 0.5 * (x[:, 0] ** 2) * (1 - 1e-12) - 1e6 * x[:, 1] ** 2
    assert montecarlo.quadrature_inner(flat, 2, rng).status in ("ill_conditioned", "ok")
    name, got = montecarlo.inner_by_any(lambda x: np.zeros(len(x)), 9, rng)
    assert name == "laplace" and got.status == "ok" and abs(got.kl) < 4 * got.rel_se


def test_conditional_kl_by_point(spark):
    exact = montecarlo.conditional_kl_table(spark, "cusp_bend", np.eye(20)[:, :4], 6, methods=("laplace",)).collect()
    assert len(exact) == 6 and all(r.status == "ok" and abs(r.kl) < 4 * r.rel_se for r in exact)
    other = montecarlo.conditional_kl_table(spark, "cusp_bend", np.eye(20)[:, [0, 2]], 6, seed=1).collect()
    assert {r.point for r in other} == set(range(6)) and all(r.method in ("laplace", "mixture") for r in other)
    assert np.mean([r.kl for r in other if r.status == "ok"]) > 0.2
    again = montecarlo.conditional_kl_table(spark, "cusp_bend", np.eye(20)[:, [0, 2]], 6, seed=1).repartition(1).collect()
    assert sorted((r.point, r.kl) for r in again) == sorted((r.point, r.kl) for r in other)
    lame = montecarlo.conditional_kl_table(spark, "cusp_bend", np.zeros((20, 2)), 3).collect()
    assert [r.status for r in lame] == ["rank_deficient"] * 3 and all(math.isnan(r.kl) for r in lame)


def test_entropy(spark):
    x = np.random.default_rng(0).standard_normal((1500, 2))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id bigint, a double, b double")
    assert abs(montecarlo.neighbour_entropy(df, ["a", "b"], "id")["entropy"] - math.log(2 * math.pi * math.e)) < 0.1


def test_entropy_of_all_rows(spark):
    """The first 5,000 ids lie close together, the others don't."""
    x = np.random.default_rng(1).standard_normal((6000, 2)) * np.where(np.arange(6000) < 5000, 0.01, 10.0)[:, None]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id bigint, a double, b double")
    far = np.concatenate([np.sqrt(np.partition(((x[a : a + 500, None] - x[None]) ** 2).sum(2), 4, axis=1)[:, 4]) for a in range(0, 6000, 500)])
    digamma = lambda m: -0.5772156649015329 + sum(1 / i for i in range(1, m))
    assert abs(montecarlo.neighbour_entropy(df, ["a", "b"], "id")["entropy"] - (math.log(5999) - digamma(4) + math.log(math.pi) + 2 * np.log(far).mean())) < 1e-9


def test_cells_resume(spark, tmp_path):
    path, schema = str(tmp_path / "cells"), "value double, example string, n int"
    assert not tables.read_cells(spark, path, schema).collect()
    tables.append_cells(spark.createDataFrame([(0.5, "a", 500)], schema), path, ["example", "n"])
    grid = spark.createDataFrame([("a", 500), ("a", 1000)], "example string, n int")
    from skerry.operators.weights import all_done, unfinished

    assert unfinished(grid, tables.read_cells(spark, path, schema), ["example", "n"]).collect() == [("a", 1000)]
    assert not all_done(grid, tables.read_cells(spark, path, schema), ["example", "n"])
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert tables.materialise(make, spark, str(tmp_path / "t")).count() == tables.materialise(make, spark, str(tmp_path / "t")).count() == 3 and len(calls) == 1
    pool = tables.sorted_pool(spark.range(50).selectExpr("id * 7 % 11 AS a", "-id AS b"), ["a", "b"], str(tmp_path / "pool"))
    assert all(r.ok for r in tables.check_pool(pool, 50).collect()) and not any(r.ok for r in tables.check_pool(pool, 49).collect())


def test_stream_adds_up_to_the_batch(spark, tmp_path):
    from skerry.operators.scorematch import statistics

    rows = spark.createDataFrame([(float(x), float(y)) for x, y in np.random.default_rng(1).standard_normal((300, 2))], "a double, b double")
    for k in range(3):
        rows.where(F.pmod(F.hash("a"), F.lit(3)) == k).write.mode("append").parquet(str(tmp_path / "in"))
    indices = dictionary(2, 3, 2)
    acc = Accumulator(["a", "b"], indices)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    acc.start(stream, str(tmp_path / "ck")).awaitTermination()
    whole = statistics(rows, ["a", "b"], indices)[0]
    assert acc.stats.n == 300 and np.allclose(acc.stats.A, whole.A) and np.allclose(acc.stats.b, whole.b) and acc.seen >= 1
    acc.add(rows, acc.seen)
    assert acc.stats.n == 300


def test_windowed_moments(spark):
    events = spark.createDataFrame([("2024-01-01 00:00:01", 1.0), ("2024-01-01 00:00:59", 3.0), ("2024-01-01 00:01:00", 5.0)], "t string, v double").withColumn("t", F.to_timestamp("t"))
    got = sorted((r.n, r["mean"], r.second) for r in windowed_moments(events, "t", "v", "1 minute", "10 minutes").collect())
    assert got == [(1, 5.0, 25.0), (2, 2.0, 5.0)]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    """Every query with SQL, on the smallest tables."""
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = registry.queries()[name](spark, SMALL)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str)
    expected = sorted(want.fetchall(), key=str)
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, float(y), rel_tol=1e-5, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), (a, b)
