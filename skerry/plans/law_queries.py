"""Queries of the synthetic laws and of integrals over them, held against SQL that computes the same constants."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import normal as P
from skerry.functions.hermite import hermite_sql
from skerry.functions.sobol import sobol_sql
from skerry.functions.sqltext import num
from skerry.operators import integrals
from skerry.plans import models, montecarlo
from skerry.plans.registry import query, rounded, table
from skerry.sources import laws

_SCALE = 6.0
_NODES = "nodes(x, w) AS (VALUES " + ", ".join(f"({num(x)}, {num(w)})" for x, w in zip(*laws.gauss_nodes(), strict=True)) + ")"


def _points(spark, sf_dir, d: int) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *((F.col("embedding")[k].cast("double") * _SCALE).alias(f"e{k}") for k in range(d)))


def _amplitude(mean: str, pair: bool) -> str:
    """The factor that gives 0.7 times tanh(..) unit variance, and its centre, over the nodes."""
    source = "nodes p, nodes q" if pair else "nodes p"
    weight = "p.w * q.w" if pair else "p.w"
    text = f"tanh({mean.replace('P', 'p.x').replace('Q', 'q.x')})"
    return f"SELECT sum({weight} * {text}) AS centre, 7.0e-1 / sqrt(sum({weight} * {text} * {text}) - power(sum({weight} * {text}), 2)) AS c FROM {source}"


#: By law: dimension, whether its coordinates are rotated, constants, and for each bent coordinate its mean (P, Q: the inputs) and variance.
_LAWS = {
    "conformal_square": (20, True, {"c2": ("(P * P - Q * Q) / 2.5e0", True), "c3": ("2.0e0 * P * Q / 2.5e0", True)}, {
        2: ((0, 1), "c2.c * tanh((P * P - Q * Q) / 2.5e0)", 0.51), 3: ((0, 1), "c3.c * tanh(2.0e0 * P * Q / 2.5e0)", 0.51)}),
    "conformal_cube": (20, True, {"c2": ("(P * P * P - 3.0e0 * P * Q * Q) / 4.0e0", True), "c3": ("(3.0e0 * P * P * Q - Q * Q * Q) / 4.0e0", True)}, {
        2: ((0, 1), "c2.c * tanh((P * P * P - 3.0e0 * P * Q * Q) / 4.0e0)", 0.51), 3: ((0, 1), "c3.c * tanh((3.0e0 * P * P * Q - Q * Q * Q) / 4.0e0)", 0.51)}),
    "even_fold": (20, True, {"c1": ("5.0e-1 * (P * P - 1.0e0)", False)}, {
        o: ((o - 1,), "c1.c * (tanh(5.0e-1 * (P * P - 1.0e0)) - c1.centre)", 0.51) for o in (1, 3)}),
    "cubic_bend": (25, False, {}, {o: ((o - 1,), f"{num(0.6 / math.sqrt(15))} * P * P * P", 0.64) for o in (1, 3, 5)}),
    "cusp_bend": (20, False, {}, {o: ((o - 1,), f"8.0e-1 * (abs(P) - {num(math.sqrt(2 / math.pi))})", 1 - 0.64 * (1 - 2 / math.pi)) for o in (1, 3)}),
}


def _density_sql(name: str) -> str:
    """Long form: a row a point and coordinate, so that each function's text stands once."""
    d, rotated, constants, bends = _LAWS[name]
    e = f"SELECT vec_id, k.range AS k, CAST(embedding[k.range + 1] AS DOUBLE) * {num(_SCALE)} AS e FROM embeddings, range(0, {d}) k"
    z = f"SELECT vec_id, k, {P.inv_logit_phi_sql('e')} AS z FROM ({e})"
    w = f"SELECT vec_id, k AS j, z AS w FROM ({z})"
    if rotated:
        q = laws.haar_rotation(d)
        cells = ", ".join(f"({i}, {j}, {num(q[i, j])})" for i in range(d) for j in range(d) if q[i, j])
        w = f"SELECT vec_id, j, sum(z * r) AS w FROM ({z}) JOIN (VALUES {cells}) q(i, j, r) ON k = i GROUP BY vec_id, j"
    used = sorted({j for o, (inputs, *_) in bends.items() for j in (o, *inputs)})
    wide = f"SELECT vec_id, sum(w * w) AS square, {', '.join(f'max(CASE WHEN j = {j} THEN w END) AS w{j}' for j in used)} FROM ({w}) GROUP BY vec_id"
    jac = f"SELECT vec_id, sum({P.log_jacobian_sql('z')}) AS jac FROM ({z}) GROUP BY vec_id"
    parts = ["jac", "-0.5e0 * square"]
    for o, (inputs, mean, variance) in bends.items():
        for letter, i in zip("PQ", inputs, strict=False):
            mean = re.sub(rf"\b{letter}\b", f"w{i}", mean)
        parts.append(f"0.5e0 * w{o} * w{o} - 0.5e0 * power(w{o} - {mean}, 2) / {num(variance)} - {num(0.5 * math.log(variance))}")
    tables = "".join(f", ({_amplitude(*given)}) {key}" for key, given in constants.items())
    return f"SELECT '{name}' AS law, vec_id, round({' + '.join(f'({x})' for x in parts)} - {num(0.5 * d * P.LOG_2PI)}, 5) + 0.0 AS log_density FROM ({wide}) JOIN ({jac}) USING (vec_id){tables}"


@query(f"WITH {_NODES} " + " UNION ALL ".join(map(_density_sql, _LAWS)))
def law_log_density(spark, sf_dir):
    """Closed-form log densities of the bent laws at given points; SQL computes their amplitudes by the same quadrature."""
    out = None
    for name, (d, *_) in _LAWS.items():
        law, columns = laws.LAWS[name](), [f"e{k}" for k in range(d)]
        rows = models.map_rows(_points(spark, sf_dir, d), columns, lambda x, law=law: {"log_density": law.log_density(x)}, ["log_density"])
        rows = rows.select(F.lit(name).alias("law"), "vec_id", "log_density")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "log_density", digits=5)


_A, _S = num(0.6 / math.sqrt(15)), num(0.8)


@query(f"""WITH {_NODES}, e AS (SELECT vec_id, b.range AS b, CAST(embedding[2 * b.range + 1] AS DOUBLE) * {num(_SCALE)} AS p, CAST(embedding[2 * b.range + 2] AS DOUBLE) * {num(_SCALE)} AS o FROM embeddings, range(0, 3) b),
f AS (SELECT vec_id, b, p, o, sum(w * exp(-0.5e0 * power((o - {_A} * x * x * x) / {_S}, 2))) AS f FROM e, nodes GROUP BY vec_id, b, p, o)
SELECT vec_id, round(sum(-0.5e0 * power((o - {_A} * p * p * p) / {_S}, 2) - ln(f)), 6) + 0.0 AS log_c FROM f GROUP BY vec_id""")
def exact_copula(spark, sf_dir):
    """The exact log copula density of a law whose marginals are quadrature mixtures."""
    law, columns = laws.cubic_bend(), [f"e{k}" for k in range(25)]
    out = models.map_rows(_points(spark, sf_dir, 25), columns, lambda x: {"log_c": law.exact_log_copula(x)}, ["log_c"])
    return rounded(out.select("vec_id", "log_c"), "log_c")


_CDF = P.ndtr_sql("t")


@query(f"""WITH {_NODES}, g AS (SELECT range AS k, -4.0e0 + range / 2.5e1 AS g FROM range(0, 201)), t AS (SELECT k, g, w, (g - {_A} * x * x * x) / {_S} AS t FROM g, nodes)
SELECT k, round(sum(w * ({_CDF})), 9) + 0.0 AS cdf, round(ln(sum(w * exp(-0.5e0 * t * t)) / {_S}) - {num(P.HALF_LOG_2PI)}, 6) + 0.0 AS log_pdf FROM t GROUP BY k""")
def bent_marginal_table(spark, sf_dir):
    """Distribution function and log density of a bent coordinate on a grid, averaged over quadrature nodes."""
    law = laws.cubic_bend()
    grid = spark.range(201).select(F.col("id").alias("k"), (F.col("id") / 25.0 - 4.0).alias("g"))
    out = models.map_rows(grid, ["g"], lambda x: {"cdf": law.marginal_cdf(1, x[:, 0]), "log_pdf": law.marginal_log_pdf(1, x[:, 0])}, ["cdf", "log_pdf"])
    return rounded(rounded(out.select("k", "cdf", "log_pdf"), "cdf", digits=9), "log_pdf")


_GRID = "SELECT range AS k, 9.0e2 + range * 2.5e0 AS g FROM range(0, 80)"


@query(f"""WITH g AS ({_GRID}), t AS (SELECT g, (g - p_retailprice) / 2.5e1 AS t FROM part, g), u AS (SELECT g, t, exp(-0.5e0 * t * t) AS k FROM t)
SELECT g, round(sum(k) / (count(*) * 2.5e1 * {num(math.sqrt(2 * math.pi))}), 9) + 0.0 AS density, round(sum({_CDF}) / count(*), 9) + 0.0 AS cdf, round(sum(-k * t / 2.5e1) / sum(k), 6) + 0.0 AS score FROM u GROUP BY g""")
def mixture_grid(spark, sf_dir):
    """A kernel mixture's density, distribution function and score on a grid."""
    grid = spark.range(80).select((F.col("id") * 2.5 + 900.0).alias("g"))
    out = integrals.mixture_table(table(spark, sf_dir, "part"), grid, "p_retailprice", 25.0, P.ndtr("t_"))
    return rounded(rounded(out, "density", "cdf", digits=9), "score")


# --- nested integrals ----------------------------------------------------------------------------------------------

_TERM = "3.0e-1 * u * v - 1.0e-1 * v * v + 5.0e-2 * u"


@query(f"""WITH o AS (SELECT c_custkey, c_acctbal / 5.0e3 AS u FROM customer), i AS (SELECT range / 1.6e1 - 2.0e0 AS v FROM range(0, 64)),
p AS (SELECT c_custkey, {_TERM} AS l FROM o, i), t AS (SELECT c_custkey, max(l) AS top FROM p GROUP BY 1)
SELECT c_custkey, round(top + ln(avg(exp(l - top))), 6) + 0.0 AS log_mean, round(power(sum(exp(l - top)), 2) / sum(power(exp(l - top), 2)), 6) AS ess FROM p JOIN t USING (c_custkey) GROUP BY c_custkey, top""")
def nested_mean(spark, sf_dir):
    """For each outer row the log mean over the same inner points, with the effective number of them."""
    outer = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 5e3).alias("u"))
    inner = spark.range(64).select((F.col("id") / 16.0 - 2.0).alias("v"))
    return rounded(integrals.nested_log_mean(outer, inner, "c_custkey", _TERM), "log_mean", "ess")


_NODE_COUNTS = [9, 5]
_HERMITE = [(float(a), float(b), float(x * y)) for a, x in zip(*laws.gauss_nodes(_NODE_COUNTS[0]), strict=True) for b, y in zip(*laws.gauss_nodes(_NODE_COUNTS[1]), strict=True)]
_EXCESS = "2.0e-1 * u * v0 - 1.0e-1 * v1 * v1 + 1.0e-1 * v0 * v1"


@query(f"""WITH n(v0, v1, w) AS (VALUES {', '.join(f'({num(a)}, {num(b)}, {num(w)})' for a, b, w in _HERMITE)}), o AS (SELECT c_custkey, c_acctbal / 5.0e3 AS u FROM customer), p AS (SELECT c_custkey, w, {_EXCESS} AS l FROM o, n)
SELECT c_custkey, round(sum(w * exp(l) * l), 6) + 0.0 AS kl FROM p GROUP BY c_custkey""")
def quadrature_divergence(spark, sf_dir):
    """An inner divergence by tensor Gauss-Hermite nodes, graded by coordinate, for each outer row."""
    outer = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 5e3).alias("u"))
    return rounded(integrals.inner_divergence(outer, integrals.tensor_nodes(spark, _NODE_COUNTS), "c_custkey", _EXCESS, "w"), "kl")


_BUDGETS, _SEEDS, _N = [256, 1024], [0, 1, 2], 1024
_U = [P.ndtri_sql(f"u{j}") for j in range(2)]
_FACTOR = f"least(2.0e0, 2.0e-1 * {hermite_sql('z0', 2)} - 1.0e-1 * z0 * {hermite_sql('z1', 2)})"


def _sobol_cells(k: str, seed: int) -> str:
    return ", ".join(f"{sobol_sql(k, _N, 2, j, seed, 'xor({}, {})')} AS u{j}" for j in range(2))


@query("WITH p AS (" + " UNION ALL ".join(f"SELECT {s} AS seed, range AS k, {_sobol_cells('range', s)} FROM range(0, {_N})" for s in _SEEDS) + f"""), z AS (SELECT seed, k, {', '.join(f'{x} AS z{j}' for j, x in enumerate(_U))} FROM p),
l AS (SELECT seed, k, {_FACTOR} AS l FROM z), b(budget) AS (VALUES (256), (1024))
SELECT budget, seed, round(ln(avg(exp(l))), 9) + 0.0 AS log_mass FROM l JOIN b ON k < budget GROUP BY 1, 2""")
def normaliser_stability(spark, sf_dir):
    """log normalisers over budgets and random shifts of Sobol points, made by built-in functions."""
    factor = _FACTOR.replace("z0", f"({_U[0]})").replace("z1", f"({_U[1]})")
    out = integrals.log_mass_table(spark, factor, 2, _BUDGETS, _SEEDS)
    return rounded(out.select(F.col("budget").cast("int").alias("budget"), "seed", "log_mass"), "log_mass", digits=9)


# --- neighbours ----------------------------------------------------------------------------------------------------


#: The vectors themselves, and their sums over every fourth dimension: few numbers that all dimensions are in.
_WHOLE = [f"CAST(embedding[{{{j}}}] AS DOUBLE)" for j in range(64)]
_FOURTHS = ["(" + " + ".join(_WHOLE[j::4]) + ")" for j in range(4)]


def _entropy_sql(parts: list[str], weights: dict[int, float]) -> str:
    d = len(parts)
    made = ", ".join(f"{x.format(*range(1, 65))} AS x{j}" for j, x in enumerate(parts))
    gap = " + ".join(f"power(a.x{j} - b.x{j}, 2)" for j in range(d))
    shift = lambda j: num(d / 2 * math.log(math.pi) - math.lgamma(d / 2 + 1) - montecarlo.digamma(j))
    cases = "CASE k " + " ".join(f"WHEN {j} THEN {num(w)}" for j, w in weights.items()) + " END AS w"
    shifts = "CASE k " + " ".join(f"WHEN {j} THEN {shift(j)}" for j in weights) + " END"
    return f"""WITH e AS (SELECT vec_id, {made} FROM embeddings), g AS (SELECT a.vec_id, {gap} AS q FROM e a, e b), r AS (SELECT vec_id, q, row_number() OVER (PARTITION BY vec_id ORDER BY q) - 1 AS k FROM g),
t AS (SELECT {cases}, {d} * ln(greatest(sqrt(q), 1.0e-300)) + {shifts} + ln((SELECT count(*) - 1.0e0 FROM embeddings)) AS x FROM r WHERE k IN ({', '.join(map(str, weights))})),
s AS (SELECT sum(w * x) / (SELECT count(*) FROM embeddings) AS h, sum(w * x * x) / (SELECT count(*) FROM embeddings) AS v FROM t)
SELECT round(h, 6) AS entropy, round(sqrt(greatest(v - h * h, 0.0e0) / (SELECT count(*) FROM embeddings)), 6) AS se, (SELECT count(*) FROM embeddings) AS n FROM s"""


def _entropy(spark, sf_dir, parts: list[str], weights: dict[int, float]) -> DataFrame:
    names = [f"x{j}" for j in range(len(parts))]
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", *(f"{x.format(*range(64))} AS {n}" for x, n in zip(parts, names, strict=True)))
    got = montecarlo.neighbour_entropy(rows, names, "vec_id", weights)
    return rounded(spark.createDataFrame([(got["entropy"], got["se"], got["n"])], "entropy double, se double, n bigint"), "entropy", "se")


@query(_entropy_sql(_WHOLE, {4: 1.0}))
def knn_entropy(spark, sf_dir):
    """Over all dimensions of the vectors."""
    return _entropy(spark, sf_dir, _WHOLE, {4: 1.0})


@query(_entropy_sql(_FOURTHS, montecarlo.two_point_weights(8, 4)))
def weighted_knn_entropy(spark, sf_dir):
    """The entropy weighted over two neighbours, without the first bias term, and its standard error."""
    return _entropy(spark, sf_dir, _FOURTHS, montecarlo.two_point_weights(8, 4))
