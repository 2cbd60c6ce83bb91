"""Normal and Hermite functions against the standard library, closed forms and each other."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from skerry.functions import normal as P
from skerry.functions import normal_np as N
from skerry.functions.hermite import dictionary, feature_blocks, hermite_sql, hermite_values, total_degrees, values

Z = [-36.0, -20.5, -20.0, -8.0, -7.07, -3.0, -1e-3, 0.0, 0.4, 2.0, 5.0, 7.5, 20.0, 36.0]


def column(spark, text, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    return [r.y for r in df.selectExpr(f"{text} AS y").collect()]


def test_quantile():
    p = np.array([1e-300, 1e-20, 1e-9, 1e-3, 0.07, 0.075, 0.5, 0.9, 0.999, 1 - 1e-9])
    want = [NormalDist().inv_cdf(x) for x in p]
    assert np.allclose(N.ndtri(p), want, rtol=1e-12, atol=1e-13)


def test_distribution():
    want = [0.5 * math.erfc(-z / math.sqrt(2)) for z in Z]
    assert np.allclose(N.ndtr(np.array(Z)), want, rtol=1e-7, atol=1e-300)
    assert np.allclose(N.log_ndtr(np.array(Z)), [math.log(w) if w > 1e-200 else N.log_ndtr(z) for w, z in zip(want, Z, strict=True)], rtol=1e-7, atol=1e-15)


def test_round_trips():
    z = np.linspace(-7, 7, 1001)
    assert abs(N.inv_logit_phi(N.logit_phi(z)) - z).max() < 1e-9
    eta = np.linspace(-14, 14, 1001)
    assert abs(N.logit_phi(N.inv_logit_phi(eta)) - eta).max() < 1e-8
    far = np.array([-1e4, -700.0, -100.0, 100.0, 699.0, 701.0, 5e3])
    assert np.allclose(N.logit_phi(N.inv_logit_phi(far)), far, rtol=1e-5) and np.isfinite(N.log_jacobian(np.array(Z))).all()
    h = 1e-5
    slope = (N.logit_phi(z + h) - N.logit_phi(z - h)) / (2 * h)
    assert np.allclose(-np.log(slope), N.log_jacobian(z), atol=1e-6)


def test_sql_is_numpy(spark):
    assert np.allclose(column(spark, P.log_ndtr_sql("x"), Z), N.log_ndtr(np.array(Z)), rtol=1e-9, atol=1e-12)
    assert np.allclose(column(spark, P.logit_phi_sql("x"), Z), N.logit_phi(np.array(Z)), rtol=1e-9, atol=1e-12)
    eta = [-5e3, -701.0, -50.0, -14.0, -1.0, 0.0, 3.0, 30.0, 699.0, 2e3]
    assert np.allclose(column(spark, P.inv_logit_phi_sql("x"), eta), N.inv_logit_phi(np.array(eta)), rtol=1e-7, atol=1e-12)
    assert column(spark, P.ndtri_sql("x"), [0.0, 1.0, -1.0]) == [None] * 3
    for k in range(7):
        assert np.allclose(column(spark, hermite_sql("x", k), [-2.0, 0.3, 4.0]), hermite_values(np.array([-2.0, 0.3, 4.0]), k)[:, k])


def test_hermite_is_orthonormal():
    x, w = np.polynomial.hermite_e.hermegauss(30)
    h = hermite_values(x, 8)
    assert abs((h.T * (w / w.sum())) @ h - np.eye(9)).max() < 1e-10


@pytest.mark.parametrize(("shape", "size"), [((20, 4, 2), 1200), ((4, 5, 3), 116)])
def test_dictionary_sizes(shape, size):
    indices = dictionary(*shape)
    assert len(indices) == size == len(set(indices)) and total_degrees(indices).min() == 2
    assert len(dictionary(*shape, linear=True)) == size + shape[0]
    assert all(t % 2 == 0 for t in total_degrees(dictionary(*shape, even=True)))


def test_derivatives():
    rng = np.random.default_rng(0)
    z, h, indices = rng.standard_normal((5, 3)), 1e-4, dictionary(3, 4, 3, linear=True)
    for i in range(3):
        here, first, second = feature_blocks(z, indices, i)
        e = np.eye(3)[i] * h
        up, mid, down = values(z + e, indices)[:, here], values(z, indices)[:, here], values(z - e, indices)[:, here]
        assert np.allclose((up - down) / (2 * h), first, atol=1e-6) and np.allclose((up - 2 * mid + down) / h**2, second, atol=1e-4)
