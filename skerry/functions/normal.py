"""The normal distribution and the logistic-normal change of variable, as SQL text and as Spark columns.

Neither Spark SQL nor most engines have erf or its inverse, so both are rational forms: the distribution function after
Hart as published by West, the quantile after Wichura's algorithm AS 241. All functions map NULL to NULL.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column

from skerry.functions.sqltext import column, horner, num

LOG_2PI = math.log(2 * math.pi)
HALF_LOG_2PI = 0.5 * LOG_2PI

#: AS 241, double precision: numerator and denominator for the centre, the shoulders and the tails.
AS241 = (
    (
        [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
        [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
    ),
    (
        [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
        [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
    ),
    (
        [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
        [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
    ),
)
#: Hart's rational form of the upper tail, from the constant term up.
HART_TOP = [220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-02]
HART_BOTTOM = [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02]


def ndtri_sql(p: str) -> str:
    """The quantile function: NULL outside (0, 1)."""
    q, tail = f"({p} - {num(0.5)})", f"sqrt(-ln(least({p}, {num(1.0)} - {p})))"
    centre = f"({num(0.180625)} - {q} * {q})"
    near, far = f"({tail} - {num(1.6)})", f"({tail} - {num(5.0)})"
    parts = [f"{horner(x, top)} / {horner(x, bottom)}" for x, (top, bottom) in zip((centre, near, far), AS241, strict=True)]
    sign = f"CASE WHEN {q} < 0 THEN {num(-1.0)} ELSE {num(1.0)} END"
    return (
        f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({q}) <= {num(0.425)} THEN {q} * {parts[0]} "
        f"WHEN {tail} <= {num(5.0)} THEN ({sign}) * {parts[1]} ELSE ({sign}) * {parts[2]} END END"
    )


def upper_tail_sql(x: str) -> str:
    """P(X > x) for x >= 0."""
    e = f"exp({num(-0.5)} * {x} * {x})"
    fraction = f"({x} + {num(0.65)})"
    for k in (4, 3, 2, 1):
        fraction = f"({x} + {num(k)} / {fraction})"
    near = f"{e} * {horner(x, HART_TOP)} / {horner(x, HART_BOTTOM)}"
    return f"CASE WHEN {x} < {num(7.07106781186547)} THEN {near} WHEN {x} <= {num(37.0)} THEN {e} / {fraction} / {num(2.506628274631)} ELSE {num(0.0)} END"


def ndtr_sql(x: str) -> str:
    tail = upper_tail_sql(f"abs({x})")
    return f"CASE WHEN {x} > 0 THEN {num(1.0)} - ({tail}) ELSE ({tail}) END"


def log_ndtr_sql(x: str) -> str:
    """log of the distribution function without loss in either tail."""
    series = f"({num(1.0)} - {num(1.0)} / ({x} * {x}) + {num(3.0)} / power({x}, 4) - {num(15.0)} / power({x}, 6) + {num(105.0)} / power({x}, 8))"
    far = f"{num(-0.5)} * {x} * {x} - ln(-({x})) - {num(HALF_LOG_2PI)} + ln{series}"
    t = f"({upper_tail_sql(f'abs({x})')})"
    return f"CASE WHEN {x} < {num(-20.0)} THEN {far} WHEN {x} <= 0 THEN ln{t} WHEN {x} < {num(4.0)} THEN ln({num(1.0)} - {t}) ELSE -{t} - {t} * {t} / {num(2.0)} - {t} * {t} * {t} / {num(3.0)} END"


def logit_phi_sql(z: str) -> str:
    """The logit of the distribution function."""
    return f"({log_ndtr_sql(z)}) - ({log_ndtr_sql(f'(-({z}))')})"


def log_jacobian_sql(z: str) -> str:
    """log |dz/d eta| of eta = logit_phi(z)."""
    return f"({log_ndtr_sql(z)}) + ({log_ndtr_sql(f'(-({z}))')}) + {num(0.5)} * {z} * {z} + {num(HALF_LOG_2PI)}"


def inv_logit_phi_sql(eta: str, far: float = 700.0) -> str:
    """z with logit_phi(z) = eta, by the quantile of the smaller tail, which keeps its digits; where the tail underflows,
    by Mills' asymptotic log tail solved for z with its logarithm taken at the first approximation."""
    a = f"abs({eta})"
    t = f"exp(-least({a}, {num(far)}))"
    near = f"-({ndtri_sql(f'({t} / ({num(1.0)} + {t}))')})"
    w = f"({num(2.0)} * {a} - ln({num(4 * math.pi)} * greatest({a}, {num(1.0)})))"
    beyond = f"sqrt({num(2.0)} * {a} - {num(LOG_2PI)} - ln({w}) + {num(2.0)} * ln({num(1.0)} - {num(1.0)} / {w} + {num(3.0)} / ({w} * {w})))"
    return f"CASE WHEN {eta} < 0 THEN {num(-1.0)} ELSE {num(1.0)} END * CASE WHEN {a} < {num(far)} THEN {near} ELSE {beyond} END"


def log_logistic_pdf_sql(eta: str) -> str:
    """log density of the standard logistic law; symmetric, so written in |eta| against overflow."""
    return f"-abs({eta}) - {num(2.0)} * ln({num(1.0)} + exp(-abs({eta})))"


def log_phi_sql(x: str) -> str:
    return f"{num(-0.5)} * {x} * {x} - {num(HALF_LOG_2PI)}"


def log_gauss_sql(names: list[str], mean: list[float], cov: list[list[float]]) -> str:
    """log density of a multivariate normal law; mean and covariance become literals."""
    inverse, (sign, log_det) = np.linalg.inv(cov), np.linalg.slogdet(cov)
    if sign <= 0:
        raise ValueError("the covariance isn't positive definite")
    gap = [f"({x} - {num(m)})" for x, m in zip(names, mean, strict=True)]
    square = " + ".join(f"{num(inverse[i][j])} * {gap[i]} * {gap[j]}" for i in range(len(gap)) for j in range(len(gap)))
    return f"{num(-0.5)} * ({square}) - {num(0.5 * (log_det + len(gap) * LOG_2PI))}"


def ndtri(p: str) -> Column:
    return column(ndtri_sql(p))


def ndtr(x: str) -> Column:
    return column(ndtr_sql(x))


def log_ndtr(x: str) -> Column:
    return column(log_ndtr_sql(x))


def logit_phi(z: str) -> Column:
    return column(logit_phi_sql(z))


def inv_logit_phi(eta: str) -> Column:
    return column(inv_logit_phi_sql(eta))
