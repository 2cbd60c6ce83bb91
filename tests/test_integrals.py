"""Sobol points, keyed draws, nested integrals, exact marginals of laws, estimator options and the command line."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry import __main__ as cli
from skerry.functions import normal_np as N
from skerry.functions.hermite import dictionary
from skerry.functions.sobol import primitive_polynomials, sobol
from skerry.operators import integrals, marginals, ranks, samples
from skerry.operators.scorematch import statistics
from skerry.plans import diagnostics, models, montecarlo, registry
from skerry.sources import laws
from skerry.streaming.accumulate import Accumulator


def test_primitive_polynomials_by_degree():
    found = {}
    for degree, _ in primitive_polynomials():
        if degree > 6:
            break
        found[degree] = found.get(degree, 0) + 1
    assert found == {1: 1, 2: 1, 3: 2, 4: 2, 5: 6, 6: 6}  # phi(2^s - 1) / s


def test_sobol_points_are_stratified(spark):
    x = sobol(256, 12, 5)
    assert all(sorted(np.floor(x[:, j] * 256).astype(int)) == list(range(256)) for j in range(12))
    got = np.array([[r.u0, r.u1, r.u2] for r in integrals.sobol_points(spark, 64, 3, 5).orderBy("id").collect()])
    assert np.array_equal(got, sobol(64, 3, 5))
    assert abs((sobol(4096, 6) ** 2).sum(1).mean() - 2) < 1e-3


def test_keyed_draws(spark):
    df = spark.range(20_000)
    kept = samples.accept(df, "id", "-0.5", 3)
    assert abs(kept.count() / 20_000 - math.exp(-0.5)) < 0.02 and kept.count() == samples.accept(df.repartition(7), "id", "-0.5", 3).count()
    one = samples.draw_one(df, "id", 1).collect()
    assert len(one) == 1 and one == samples.draw_one(df.repartition(5), "id", 1).collect() != samples.draw_one(df, "id", 2).collect()


def test_inner_tables_are_checked(spark):
    with pytest.raises(ValueError):
        integrals.checked(spark.range(11), 10)
    with pytest.raises(ValueError):
        marginals.kde_grid(spark.createDataFrame([(1.0,)], "x double"), "x", spark.range(marginals.MOST_GRID + 1).select(F.col("id").cast("double").alias("g")), 1.0)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal(301), np.full(200, 0.25)])
    df = spark.createDataFrame([(int(k % 2), float(v)) for k, v in enumerate(x)] + [(0, math.nan), (3, None)], "g int, x double")
    shares = {"a": 0.0, "b": 0.25, "c": 0.999, "d": 1.0}
    got = {r.g: r for r in ranks.quantiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == {0, 1} and all(math.isclose(got[g][n], np.quantile(x[g::2], q), abs_tol=1e-12) for g in got for n, q in shares.items())
    whole = ranks.quantiles(df, "x", {"m": 0.5}, []).first()
    assert math.isclose(whole.m, np.quantile(x, 0.5))


def test_order_check_sees_edges(spark):
    rows = [(g, k, float(k if (g, k) not in (("a", 40), ("b", 0)) else -5)) for g in "ab" for k in range(100)]
    got = {r.g: (r.n, r.drops, r.spread) for r in ranks.not_sorted(spark.createDataFrame(rows, "g string, k int, x double"), "g", "k", "x").collect()}
    assert got == {"a": (100, 1, 104.0), "b": (100, 0, 104.0)}


def test_equal_columns_share_a_fit(spark):
    x = np.random.default_rng(0).standard_normal((500, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a)) for a, b in x], "a double, b double, c double")
    assert samples.column_groups(df, ["a", "b", "c"]) == {"a": "a", "b": "b", "c": "a"}
    model = models.ProductOfMarginals(["a", "b", "c"]).fit(df)
    assert model.marginals[0] is model.marginals[2] and model.marginals[0] is not model.marginals[1]


def test_tails_are_the_kernels_sum(spark):
    x = np.random.default_rng(1).standard_normal(400)
    m = marginals.fit_marginal(spark.createDataFrame([(float(v),) for v in x], "x double"), "x")
    far = np.array([x.min() - 5, x.max() + 4, x.max() + 9])
    exact = np.log(np.exp(-0.5 * ((far[:, None] - x) / m.width) ** 2).sum(1)) - math.log(400 * m.width * math.sqrt(2 * math.pi))
    assert np.allclose(m.log_pdf(far), exact, rtol=2e-3) and np.isfinite(m.log_pdf(np.array([1e3]))).all()


def test_exact_marginals_of_a_law():
    law, rng = laws.cubic_bend(), np.random.default_rng(0)
    z = law.sample_scores(20_000, rng)
    assert np.abs(z.mean(0)).max() < 0.04 and np.abs(z.std(0) - 1).max() < 0.03
    g = np.linspace(-40, 40, 16_001)
    pdf = np.exp(law.marginal_log_pdf(1, g))
    assert abs(pdf.sum() * (g[1] - g[0]) - 1) < 1e-5 and np.abs(np.cumsum(pdf) * (g[1] - g[0]) - law.marginal_cdf(1, g)).max() < 2e-3
    # E exp(-log c) under the law is the mass of the independent one.
    w = law.latent(50_000, rng)
    assert law.exact_log_copula(w).mean() > 0.5 and abs(np.exp(-law.exact_log_copula(w)).mean() - 1) < 0.1
    assert law.sample_scores(10, rng, np.eye(25)[:, :3]).shape == (10, 3)
    with pytest.raises(ValueError):
        laws.even_fold().exact_log_copula(w[:, :20])


def test_nested_log_mean_with_weights(spark):
    outer = spark.createDataFrame([(0, 0.5), (1, 900.0)], "k int, u double")
    inner = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "v double, w double")
    got = {r.k: r for r in integrals.nested_log_mean(outer, inner, "k", "u * v", "w").collect()}
    assert math.isclose(got[0].log_mean, math.log((1 + 3 * math.exp(0.5)) / 4)) and math.isclose(got[1].log_mean, 900 + math.log(0.75)) and math.isclose(got[1].ess, 1.0)


def test_two_point_weights():
    w = montecarlo.two_point_weights(8, 4)
    g = lambda j: math.gamma(j + 0.5) / math.gamma(j)
    assert math.isclose(sum(w.values()), 1) and abs(sum(x * g(j) for j, x in w.items())) < 1e-12
    with pytest.raises(ValueError):
        montecarlo.two_point_weights(8, 3)


@pytest.fixture(scope="module")
def curved(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal(3000)
    b = 0.6 * (a**2 - 1) + 0.6 * rng.standard_normal(3000)
    return spark.createDataFrame([(k, float(x), float(y), float(v)) for k, (x, y, v) in enumerate(zip(a, b, rng.standard_normal(3000), strict=True))], "id bigint, a double, b double, c double").persist()


@pytest.mark.parametrize("options", [{}, {"secondary": True}, {"rho": 0.5}, {"rho": 1.0, "eigenvalues": np.array([1.0, 0.5])}, {"labels": True}, {"labels": True, "secondary": True}])
def test_estimator_options_beat_independence(curved, options):
    model = models.ReducedDensity(["a", "b", "c"], r=2, inner_degree=4, **options).fit(curved, "id")
    x = np.array([[r.a, r.b, r.c] for r in curved.limit(800).collect()])
    assert model.log_density(x).mean() > model.base.log_density(x).mean() + 0.1
    if not options:
        u, h = np.array([[0.3, -0.2], [1.0, 0.5]]), 1e-6
        for j in range(2):
            e = h * np.eye(2)[j]
            assert np.allclose(model.gradient_u(u)[:, j], (model.log_density_u(u + e) - model.log_density_u(u - e)) / (2 * h), atol=1e-5)


def test_estimator_options_need_a_first_stage(curved):
    for options in ({"rho": 1.0}, {"labels": True}):
        with pytest.raises(ValueError):
            models.ReducedDensity(["a", "b", "c"], r=2, **options).fit(curved, "id", V=np.eye(3)[:, :2])


def test_ablation_tunes(curved):
    folds = statistics(ranks.hash_halves(ranks.rank_gaussianize(curved, ["a", "b"]).select("id", "a_z", "b_z"), "id"), ["a_z", "b_z"], dictionary(2, 3, 2), fold="fold")
    got = {r["penalty"]: r["risk"] for r in diagnostics.ablation(folds[0], folds[1], dictionary(2, 3, 2))}
    assert len(got) == 9 and got["combined_tuned"] <= got["combined"] and all(math.isfinite(v) for v in got.values())


def test_audit(spark):
    claims = spark.createDataFrame([("a", 1.23, 2), ("b", 1.23, 2), ("c", 5.0, 0), ("d", 1.0, 1)], "name string, claimed double, digits int")
    results = spark.createDataFrame([("a", 1.2349), ("b", 1.24), ("d", math.nan)], "name string, found double")
    assert {r.name: r.status for r in diagnostics.audit(claims, results, ["name"]).collect()} == {"a": "ok", "b": "differs", "c": "missing", "d": "missing"}


def test_stream_sums_survive_a_restart(spark, tmp_path):
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in np.random.default_rng(3).standard_normal((90, 2))], "a double, b double")
    rows.limit(40).write.parquet(str(tmp_path / "in"))
    indices = dictionary(2, 2, 2)

    def go():
        acc = Accumulator(["a", "b"], indices)
        acc.start(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
        return acc

    assert go().stats.n == 40 and go().stats.n == 40  # nothing new the second time
    rows.exceptAll(rows.limit(40)).write.mode("append").parquet(str(tmp_path / "in"))
    acc = go()
    assert acc.stats.n == 90 and np.allclose(acc.stats.A, statistics(rows, ["a", "b"], indices)[0].A)


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list", "ecdf_grid", "cas_log_density"]) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["ecdf_grid", "cas_log_density  (no SQL)"]
    sf, out = "/root/testdata/sf0.001", str(tmp_path / "out")
    assert set(cli.run(spark, ["dictionary_sizes"], sf, out)) == {"dictionary_sizes"} and spark.read.parquet(f"{out}/dictionary_sizes").count() == 36
    assert cli.check(spark, ["dictionary_sizes", "cas_log_density"], sf) == {"dictionary_sizes": "equal", "cas_log_density": "no SQL"}
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such_query"])


def test_registry_has_sql_for_most():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.oracle_sql()) > 80


def test_moments_of_a_law_on_the_executors(spark):
    m, h, c = laws.law_moments(spark, "cubic_bend", 12_000, 3)
    law, total = laws.cubic_bend(), 0
    for block, size in enumerate((10_000, 2_000)):
        z = N.inv_logit_phi(law.sample(size, np.random.default_rng([3, block])))
        both = np.concatenate((z, law.score_z(z), law.score_z(z) - z), 1)
        total = total + both.T @ both / 12_000
    assert np.allclose(m, total[:25, :25]) and np.allclose(c, total[25:50, 25:50]) and np.allclose(h, total[50:, 50:], atol=1e-8)


def test_score_moments_in_one_pass(curved):
    from skerry.operators.scorematch import matrix, score_columns, score_moments, second_moments, stein_residual

    indices = dictionary(2, 3, 2)
    theta = np.random.default_rng(0).normal(0, 0.2, len(indices))
    rows = ranks.rank_gaussianize(curved, ["a", "b"]).select(F.col("a_z").alias("x"), F.col("b_z").alias("y"))
    got = score_moments(rows, ["x", "y"], indices, theta)
    field = score_columns(rows, ["x", "y"], indices, theta)
    assert got.n == 3000 and np.allclose(got.C, matrix(second_moments(field, ["t0", "t1"]), 2, 2, "m"))
    assert math.isclose(got.stein_residual(), stein_residual(field, ["x", "y"], ["t0", "t1"]), rel_tol=1e-9)


def test_copula_of_a_fitted_density(curved):
    """For independent columns the copula's log density is zero."""
    base = models.ProductOfMarginals(["a", "c"]).fit(curved)
    z = np.random.default_rng(1).standard_normal((200, 2))
    assert np.abs(models.log_copula_of(base.log_density, base.marginals, z)).max() < 1e-9


def test_random_bases():
    from skerry.operators.subspace import haar_basis

    q = np.stack([haar_basis(6, 2, k) for k in range(400)])
    assert np.allclose(np.einsum("nij,nik->njk", q, q), np.eye(2)) and np.allclose(np.einsum("nij,nkj->ik", q, q) / 400, np.eye(6) / 3, atol=0.06)
