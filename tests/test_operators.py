"""Ranks, marginals, score matching, solvers, subspaces and weights on small inputs with known answers."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions.hermite import dictionary, values
from skerry.operators import marginals, ranks, scorematch, solvers, subspace, weights
from skerry.operators.constrained import fit_constrained, highest_form, leading_rows
from skerry.plans.storage import running_total


def frame(spark, **columns):
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{k} {'double' if isinstance(v[0], float) else 'bigint'}" for k, v in columns.items()))


def test_average_rank_and_gaussianize(spark):
    x = np.random.default_rng(42).integers(0, 40, 500).astype(float)
    df = frame(spark, id=list(range(500)), x=x.tolist())
    got = {r.id: r.r for r in ranks.average_rank(df, "x", "r").collect()}
    order = np.sort(x)
    assert all(got[i] == (np.searchsorted(order, v) + np.searchsorted(order, v, "right") + 1) / 2 for i, v in enumerate(x))
    z = np.array([r.x_z for r in ranks.rank_gaussianize(df, ["x"]).collect()])
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05


@pytest.mark.parametrize(("bound", "joins"), [(200_000, 4), (12, 4), (0, 4), (0, 1)])
def test_scores_by_group_whatever_the_join(spark, monkeypatch, bound, joins):
    """Broadcast, plain joins and the long table give the plain ranks; null groups are one group, odd values have none."""
    monkeypatch.setattr(ranks, "_JOINS", joins)
    rng = np.random.default_rng(8)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0]
    rows = [(k, [None, "a", "b"][k % 3], float(rng.integers(0, 5)), float(rng.normal()), odd[k % 9] if k % 9 < 5 else float(rng.integers(0, 40))) for k in range(300)] + [(0, "a", 1.0, 1.0, 1.0)] * 3
    df = spark.createDataFrame(rows, "id int, g string, x double, y double, w double")
    for group in ([], ["g"]):
        got = ranks.rank_gaussianize(df, ["x", "y", "w"], group=group, broadcast_rows=bound).collect()
        want = []
        for row in rows:
            scores = []
            for c in (2, 3, 4):
                among = [r[c] for r in rows if (not group or r[1] == row[1]) and r[c] is not None and math.isfinite(r[c])]
                v = row[c]
                if v is None or not math.isfinite(v):
                    scores.append(None)
                else:
                    rank = sum(a < v for a in among) + (sum(a == v for a in among) + 1) / 2
                    scores.append(round(NormalDist().inv_cdf(rank / (len(among) + 1)), 9))
            want.append((*row[:2], *scores))
        assert sorted(((r.id, r.g, *(None if z is None else round(z, 9) for z in (r.x_z, r.y_z, r.w_z))) for r in got), key=str) == sorted(want, key=str)


def test_not_finite_values_have_no_rank(spark):
    df = frame(spark, id=[1, 2, 3, 4], x=[1.0, float("nan"), float("inf"), 0.0])
    assert {r.id: r.r for r in ranks.average_rank(df, "x", "r").collect()} == {1: 2.0, 2: None, 3: None, 4: 1.0}


def test_running_total_matches_a_window(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 101).alias("v"), (F.col("id") % 3).alias("g"))
    got = running_total(df, ["id"], "v", "s", ["g"]).collect()
    sums = [0, 0, 0]
    for r in sorted(got, key=lambda r: r.id):
        sums[r.g] += r.v
        assert r.s == sums[r.g]


def test_marginal(spark):
    x = np.random.default_rng(42).standard_normal(2000)
    m = marginals.fit_marginal(frame(spark, x=x.tolist()), "x")
    at = np.linspace(-3, 3, 50)
    exact = np.exp(-0.5 * ((at[:, None] - x) / m.width) ** 2).mean(1) / (m.width * math.sqrt(2 * math.pi))
    assert np.allclose(m.pdf(at), exact, rtol=2e-3) and abs(np.trapezoid(m.density, m.grid) - 1) < 1e-3
    assert (np.diff(m.distribution(np.linspace(-6, 6, 400))) >= 0).all() and np.allclose(m.distribution(m.quantile(np.array([0.1, 0.5, 0.9]))), [0.1, 0.5, 0.9], atol=1e-4)
    assert np.isfinite(m.log_pdf(np.array([-1e3, 1e3]))).all() and (m.log_pdf(np.array([50.0])) < -100).all()


def test_degenerate_bandwidth(spark):
    assert marginals.robust_bandwidth(frame(spark, x=[3.0, 3.0, 3.0]), ["x"]).first().h == 1.0


def test_statistics_agree_with_sql_and_merge(spark):
    rng = np.random.default_rng(0)
    z = rng.standard_normal((400, 2))
    indices = dictionary(2, 3, 2)
    df = frame(spark, x0=z[:, 0].tolist(), x1=z[:, 1].tolist(), f=[k % 2 for k in range(400)])
    s = scorematch.statistics(df, ["x0", "x1"], indices)[0]
    a, b, c = scorematch.block_sums(z, indices)
    assert np.allclose(s.A, a / 400) and np.allclose(s.b, b / 400) and np.allclose(s.C, c / 400) and s.n == 400
    assert np.allclose(scorematch.matrix(scorematch.gram_sql(df, ["x0", "x1"], indices), len(indices), len(indices), "a"), s.A)
    assert np.allclose([r.b for r in scorematch.rhs_sql(df, ["x0", "x1"], indices).orderBy("k").collect()], s.b)
    folds = scorematch.statistics(df, ["x0", "x1"], indices, fold="f")
    both = folds[0].merged(folds[1])
    assert np.allclose(both.A, s.A) and np.allclose(both.b, s.b)
    weighted = scorematch.statistics(df, ["x0", "x1"], indices, weights=np.array([2.0, 2.0]))[0]
    assert np.allclose(weighted.A, 2 * s.A) and np.allclose(weighted.b, 2 * s.b)


def test_score_labels_give_the_same_right_side_in_the_mean(spark):
    """By Stein's identity E[z f - f'] = E[f * (score + z)] when the labels are the score against the standard normal."""
    z = np.random.default_rng(1).standard_normal((100_000, 1)) * 0.9
    indices = dictionary(1, 4, 1)
    labels = z - z / 0.81
    plain, labelled = scorematch.block_sums(z, indices), scorematch.block_sums(z, indices, scores=labels)
    assert np.allclose(plain[1] / len(z), labelled[1] / len(z), atol=0.03)


@pytest.fixture(scope="module")
def stats():
    z = np.random.default_rng(3).standard_normal((600, 3)) @ np.array([[1, 0.4, 0], [0, 0.9, 0.2], [0, 0, 0.8]])
    indices = dictionary(3, 4, 2, linear=True)
    a, b, c = scorematch.block_sums(z, indices)
    return scorematch.Stats(600, a / 600, b / 600, c / 600), indices


SCHEMES = ["ridge", "block", "quantile", "sigmoid", "trace", "hybrid", "blend", "whiten", "inverse", "full", "scaled", "theoretical", "heldout"]


@pytest.mark.parametrize("scheme", SCHEMES)
def test_schemes_solve_their_penalised_system(stats, scheme):
    s, indices = stats
    out = solvers.by_scheme(scheme, s, indices)
    assert np.isfinite(out.theta).all()
    if scheme in ("theoretical", "heldout"):
        assert np.linalg.norm(s.C @ out.theta) < 1e-8
    else:
        assert np.allclose((s.A + out.penalty) @ out.theta, s.b, atol=1e-8)
        assert np.linalg.eigvalsh(out.penalty).min() > -1e-9


def test_scheme_limits(stats):
    s, indices = stats
    assert np.allclose(solvers.sigmoid_ridge(s, indices).theta, solvers.block_ridge(s, indices).theta)
    assert np.allclose(solvers.median_block_ridge(s, indices, None).theta, solvers.block_ridge(s, indices).theta)
    assert np.allclose(solvers.spectral_ridge(s, indices, mode="proportional").theta, solvers.block_ridge(s, indices).theta)
    assert np.allclose(solvers.blend_ridge(s, indices, rows=10**9).theta, solvers.block_ridge(s, indices).theta, atol=1e-5)
    assert solvers.parse_scheme("trace:c=2,power=3") == ("trace", {"c": 2.0, "power": 3.0})
    with pytest.raises(ValueError):
        solvers.trace_ridge(s, indices, 0)
    with pytest.raises(ValueError):
        solvers.by_scheme("none", s, indices)


def test_barrier_finds_the_constrained_minimum():
    theta, info = solvers.barrier_qp(np.eye(2), np.array([2.0, 1.0]), np.zeros((0, 2)), np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([1.0, 3.0]))
    assert np.allclose(theta, [1.0, 1.0], atol=1e-5) and info["active"] == 1 and info["feasible"]
    theta, _ = solvers.barrier_qp(np.eye(2), np.array([2.0, 1.0]), np.array([[1.0, -1.0]]), np.zeros((0, 2)), np.zeros(0))
    assert np.allclose(theta, [1.5, 1.5])


def test_constrained_fit_bounds_the_form(stats):
    s, indices = stats
    theta, report = fit_constrained(s.A + 1e-3 * np.eye(len(indices)), s.b, s.C, indices, 4, 5.0, np.zeros(len(indices)), 12.0, 3)
    assert report["form_met"] and highest_form(theta, indices, 4, 3, 99)[0] < 0 and np.linalg.norm(s.C @ theta) < 1e-6
    odd, more = fit_constrained(s.A + 1e-3 * np.eye(len(indices)), s.b, s.C, indices, 3, 5.0, np.zeros(len(indices)), 12.0, 3, rounds=2)
    assert more["even_degree"] == 2 and more["zeroed"] == sum(sum(d) > 2 for _, d in indices)


def test_values_that_are_not_finite_never_report_convergence(stats):
    s, indices = stats
    poisoned = lambda u, t: np.where(u[:, 0] > 3, np.nan, values(u, indices) @ t)
    report = fit_constrained(s.A + np.eye(len(indices)), s.b, s.C, indices, 4, 1e6, np.zeros(len(indices)), 12.0, 3, evaluate=poisoned)[1]
    assert report["not_finite"] > 0 and not report["converged"]


def test_leading_rows():
    assert np.allclose(leading_rows([((0, 1), (2, 2))], 4, np.array([[2.0, 3.0]])), 36 / 2)


def test_subspace_functions():
    rng = np.random.default_rng(5)
    m, h = (lambda a: a @ a.T / 20 + np.eye(10))(rng.standard_normal((10, 20))), (lambda a: a @ a.T / 20 + np.eye(10))(rng.standard_normal((10, 20)))
    v = subspace.orthonormal(rng.standard_normal((10, 3)))
    g, p = subspace.gradient(v, m, h)
    b = rng.standard_normal(g.shape)
    f = lambda t: subspace.upper_bound(subspace.orthonormal(v + t * p @ b), m, h)
    t = 1e-4
    assert math.isclose((f(t) - f(-t)) / (2 * t), (g * b).sum(), rel_tol=1e-3)
    assert math.isclose((f(t) - 2 * f(0) + f(-t)) / (2 * t * t), subspace.curvature(b, v, m, h), rel_tol=2e-2)
    w, trail = subspace.descend(v, m, h, 50)
    assert trail[-1] < trail[0] and all(x >= y - 1e-12 for x, y in zip(trail, trail[1:], strict=False)) and np.allclose(w.T @ w, np.eye(3))
    assert subspace.sin_theta(v, v) < 1e-6 and math.isclose(subspace.principal_angle(np.eye(4)[:, :1], np.eye(4)[:, 1:2]), 90.0)
    l, u = subspace.top_eigenvectors(m, 3)
    l2, u2 = subspace.randomized_eigenvectors(lambda x: m @ x, 10, 3, rounds=20)
    assert np.allclose(l, l2) and subspace.sin_theta(u, u2) < 1e-5 and abs(subspace.complement(v).T @ v).max() < 1e-10
    tail = subspace.tail_sum_bounds(m, m + 0.01 * (h - np.eye(10)), 3)
    assert -1e-12 <= tail["excess"] <= tail["ky_fan"] <= tail["operator"] + 1e-9 and subspace.certificate(u, m) > 0


def test_weights(spark):
    df = spark.createDataFrame([("a", 1000.0), ("a", 1001.0), ("b", -5.0), ("b", float("nan"))], "g string, v double")
    got = {r.g: r.log_mean_exp for r in weights.log_mean_exp(df, "v", ["g"]).collect()}
    assert math.isclose(got["a"], 1000 + math.log((1 + math.e) / 2)) and got["b"] == -5.0
    cells = spark.createDataFrame([(1, 0.30), (1, 0.28), (1, float("nan")), (1, 0.31), (1, 0.29)], "n int, v double")
    row = weights.cell_summary(cells, ["n"], "v").first()
    assert math.isclose(row["mean"], 0.295) and row["n"] == 4 or math.isclose(row[3], 0.295)
    risks = spark.createDataFrame([("a", 1.0, 5, 0), ("a", 3.0, 5, 0), ("b", 1.9, 9, 1), ("b", 1.9, 9, 1), ("c", 5.0, 1, 2)], "c string, r double, size int, place int")
    assert weights.one_standard_error(risks, "c", "r", "size", "place").first().c == "b"


def test_trimmed_mean_needs_rows(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(40)] + [("b", 1.0)], "g string, v double")
    assert {r.g: r.trimmed for r in ranks.trimmed_mean(df, "g", "v").collect()} == {"a": 19.5, "b": None}


def test_level_is_relaxed_when_it_cannot_be_held(stats):
    """A level below what the centred fit needs at the origin: the reached one is asked for, and both are reported."""
    s, indices = stats
    m = s.A + 1e-3 * np.eye(len(indices))
    theta, report = fit_constrained(m, s.b, s.C, indices, 4, -5.0, np.zeros(len(indices)), 12.0, 3, rounds=6)
    assert report["relaxed"] and report["tau_asked"] == -5.0 and report["tau"] > -5.0 and report["form_met"]
    grid = np.random.default_rng(1).uniform(-7, 7, (20_000, 3))
    assert report["level_met"] and (values(grid, indices) @ theta).max() <= report["tau"] + 0.01 * max(1, abs(report["tau"]))


def test_constraints_bind_and_hold_between_the_points(stats):
    """A quadratic whose minimum breaks both kinds: the solution keeps them on a fine grid and is no worse than scaled-down ones."""
    s, indices = stats
    m, b = s.A + 1e-2 * np.eye(len(indices)), s.b + 0.5 * leading_rows(indices, 4, np.array([[1.0, 0.2, 0.1]]))[0]
    free = solvers.barrier_qp(m, b, s.C, np.zeros((0, len(indices))), np.zeros(0))[0]
    theta, report = fit_constrained(m, b, s.C, indices, 4, 4.0, free, 6.0, 3)
    assert report["converged"] and not report["relaxed"] and report["active"] > 0
    v = np.random.default_rng(2).standard_normal((50_000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert (leading_rows(indices, 4, v) @ free).max() > 0 and (leading_rows(indices, 4, v) @ theta).max() <= 0
    assert (values(v * np.random.default_rng(3).uniform(0, 6, (50_000, 1)), indices) @ theta).max() <= 4.01
    cost = lambda x: 0.5 * x @ m @ x - b @ x
    assert cost(free) <= cost(theta) <= cost(0 * theta) and np.linalg.norm(s.C @ theta) < 1e-6
