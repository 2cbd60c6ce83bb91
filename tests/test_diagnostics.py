"""Tilts, saturation, bounds and decompositions on small inputs."""

import math

import numpy as np
import pytest

from skerry.functions import normal_np as N
from skerry.functions.hermite import dictionary
from skerry.operators import tilt
from skerry.operators.scorematch import Stats, block_sums
from skerry.plans import diagnostics as D


def test_logistic_columns_have_no_tilt(spark):
    rng = np.random.default_rng(0)
    w = rng.standard_normal((20_000, 2))
    w[:, 1] *= 0.8
    df = spark.createDataFrame([tuple(map(float, r)) for r in N.logit_phi(w)], "a double, b double")
    plain, narrow = tilt.fit_tilts(df, ["a", "b"])
    assert narrow.cdf is not None and narrow.theta[0] < -0.1
    z = narrow.to_z(w[:, 1])
    assert abs(z.std() - 1) < 0.05 and np.allclose(narrow.to_w(z[:50]), w[:50, 1], atol=1e-3)
    g = np.linspace(-8, 8, 2001)
    assert abs(np.trapezoid(np.exp(narrow.correction(g) - 0.5 * g * g), g) / math.sqrt(2 * math.pi) - 1) < 1e-3
    assert tilt.tabulate(np.array([1e-3, 0.0])).cdf is None and plain.to_z(w[:3, 0]).shape == (3,)
    assert tilt.window(np.array([0.0, 3.5, 4.75, 6.0, 9.0])).tolist() == pytest.approx([1, 1, 0.5, 0, 0])


def test_align_and_restrict():
    small, large = dictionary(2, 2, 2), dictionary(2, 3, 2)
    out = D.align(np.arange(1.0, len(small) + 1), small, large)
    assert out[out != 0].tolist() == [1.0, 2.0, 3.0]
    z = np.random.default_rng(0).standard_normal((50, 2))
    a, b = Stats(50, *block_sums(z, large)), Stats(50, *block_sums(z, small))
    assert np.allclose(D.restrict(a, large, small).A, b.A) and np.allclose(D.restrict(a, large, small).b, b.b)
    with pytest.raises(ValueError):
        D.align(np.ones(len(large)), large, small)


@pytest.fixture(scope="module")
def bent(spark):
    rng = np.random.default_rng(2)
    w = rng.standard_normal((4000, 3))
    w[:, 1] = 0.8 * (w[:, 0] ** 2 - 1) / math.sqrt(2) + 0.6 * w[:, 1]
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(w)], "id bigint, a double, b double, c double").persist()


def test_saturation_grows_with_the_dictionary(bent):
    ladder = D.saturation(bent, ["a", "b", "c"], [(2, 1), (2, 2), (3, 2), (4, 2)])
    traces = [x["trace"] for x in ladder]
    assert [x["terms"] for x in ladder] == sorted(x["terms"] for x in ladder) and traces[2] > 2 * traces[1]


def test_a_posteriori_bound_covers(bent):
    got = D.a_posteriori_bound(bent, ["a", "b", "c"], "id", 2, 3, 2)
    assert 0 <= got["tail"] < got["bound"]


def test_truncation_gap(bent):
    got = D.truncation_gap(bent, ["a", "b", "c"], "id", (2, 2), (3, 2))
    assert got["crossed"] > 0.1 and got["naive"] > 0.3


def test_ablation_and_decomposition(spark, bent):
    z = np.random.default_rng(1).standard_normal((400, 2))
    indices = dictionary(2, 3, 2)
    parts = [Stats(200, *(x / 200 for x in block_sums(p, indices))) for p in (z[:200], z[200:])]
    table = D.ablation(*parts, indices)
    assert len(table) == 9 and all(math.isfinite(x["risk"]) for x in table)
    df = spark.createDataFrame([("a", -1.0, -1.5, -2.0), ("a", -2.0, -2.5, -3.5)], "g string, p double, q double, r double")
    assert D.divergence(df, "p", "r", ["g"]).first().kl == 1.25 and D.decomposition(df, ["p", "q", "r"]) == {"p_q": 0.5, "q_r": 0.75}


def test_quadrature_kl_is_zero_without_excess():
    f = lambda x: np.zeros(len(x))
    assert abs(D.quadrature_kl(f, f, np.zeros((3, 2)), 2)).max() < 1e-12
    assert math.isclose(D.outside_mass(np.diag([3.0, 2.0, 1.0]), 2), 1.0)
