"""Queries over fits that are small enough for SQL to solve them in closed form: solvers, subspaces, tilts, statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import normal as P
from skerry.functions.hermite import dictionary, gradient_sql, hermite_sql, hermite_values, term_sql, values
from skerry.functions.sqltext import num
from skerry.operators import ranks, samples, scorematch, solvers, subspace, tilt, weights
from skerry.plans import diagnostics, models, selection
from skerry.plans.registry import query, rounded, table

_XS = ["x0", "x1"]
_EIG = lambda p: f"({p}00 + {p}11) / 2.0e0 + sqrt(power(({p}00 - {p}11) / 2.0e0, 2) + {p}01 * {p}01)"
_LOW = lambda p: f"({p}00 + {p}11) / 2.0e0 - sqrt(power(({p}00 - {p}11) / 2.0e0, 2) + {p}01 * {p}01)"
_TERMS = dictionary(2, 3, 1)  # second and third degree along each axis: the gram falls into a 2 x 2 block an axis
_ROWS = "SELECT o_orderkey, (o_totalprice - 2.5e5) / 1.4e5 AS x0, (o_custkey % 97) / 2.8e1 - 1.7e0 AS x1 FROM orders"


def _rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "(o_totalprice - 2.5e5) / 1.4e5 AS x0", "(o_custkey % 97) / 2.8e1 - 1.7e0 AS x1")


def _axis(i: int, weight: str = "1.0e0") -> str:
    """Means over one axis: the gram a, c, e of both terms, the right side p, q and the mean derivatives u, v."""
    two, three = ((i,), (2,)), ((i,), (3,))
    f2, f3 = gradient_sql(two, _XS, i), gradient_sql(three, _XS, i)
    s2, s3 = gradient_sql(two, _XS, i, 2), gradient_sql(three, _XS, i, 2)
    x = _XS[i]
    parts = {"a": f"{f2} * {f2}", "c": f"{f2} * {f3}", "e": f"{f3} * {f3}", "p": f"{x} * {f2} - {s2}", "q": f"{x} * {f3} - {s3}", "u": f2, "v": f3}
    return ", ".join(f"avg({t}) AS {k}{i}" for k, t in parts.items())


_NORM = "greatest(" + ", ".join(f"(a{i} + e{i}) / 2.0e0 + sqrt(power((a{i} - e{i}) / 2.0e0, 2) + c{i} * c{i})" for i in range(2)) + ")"
_MEANS = f"SELECT count(*) AS n, {_axis(0)}, {_axis(1)} FROM"
_KNOWN = f"SELECT *, {_NORM} AS norm, greatest(a0, a1) AS t2, greatest(e0, e1) AS t3, a0 + a1 AS s2, e0 + e1 AS s3 FROM"


def _theta(i: int, r2: str, r3: str) -> tuple[str, str]:
    """Both coefficients of an axis with a diagonal penalty."""
    det = f"((a{i} + {r2}) * (e{i} + {r3}) - c{i} * c{i})"
    return f"((p{i} * (e{i} + {r3}) - c{i} * q{i}) / {det})", f"((q{i} * (a{i} + {r2}) - c{i} * p{i}) / {det})"


def _noise(l: str, s: str, power: int) -> str:
    return f"(1.0e0 / (1.0e0 + power({l} / ({s} / n), {power})))"


_SHARE = num(solvers.BLOCK_SHARE)
#: By scheme the shrinkage of an eigenvalue l of a degree's block with sum s and largest value t, at degree k.
_SHRINK = {
    "ridge": "1.0e-4 * norm * {k} * {k}",
    "explicit": "1.0e-2 * {k} * {k}",
    "plain": "1.0e-2",
    "block": _SHARE + " * {t}",
    "quantile": _SHARE + " * {s} / 2.0e0",
    "sigmoid": _SHARE + " * {t} + {w2} * ({t} - {l})",
    "trace": "3.0e0 * {s} / n + {w4} * ({t} - {l})",
    "hybrid": "3.0e0 * {s} / n + {w4} * ({t} - {l}) + 1.0e-5 * norm * {k} * {k}",
    "blend": _SHARE + " * {t} + least(1.0e0, 8.0e0 / n) * ({t} - {l})",
    "deficiency": _SHARE + " * {t} + greatest(0.0e0, 1.0e0 - {s} / {t} / 2.0e0) * ({t} - {l})",
    "whiten": "{t} - {l} + " + _SHARE + " * {t}",
    "proportional": _SHARE + " * {t}",
    "inverse": _SHARE + " * {t} * (1.0e0 + {t} / greatest({l}, {t} / 1.0e6))",
    "scaled": "3.0e0 * {s} / n + 1.0e-5 * norm * {k} * {k}",
}


def _penalty(scheme: str, k: int, i: int) -> str:
    l, s, t = f"{'ae'[k - 2]}{i}", f"s{k}", f"t{k}"
    return "(" + _SHRINK[scheme].format(k=f"{k}.0e0", l=l, s=s, t=t, w2=_noise(l, s, 2), w4=_noise(l, s, 4)) + ")"


def _centred(i: int, r2: str, r3: str) -> tuple[str, str]:
    """The same under the constraint that the axis's mean derivative is zero."""
    t2, t3 = _theta(i, r2, r3)
    det = f"((a{i} + {r2}) * (e{i} + {r3}) - c{i} * c{i})"
    y2, y3 = f"((u{i} * (e{i} + {r3}) - c{i} * v{i}) / {det})", f"((v{i} * (a{i} + {r2}) - c{i} * u{i}) / {det})"
    m = f"((u{i} * {t2} + v{i} * {t3}) / (u{i} * {y2} + v{i} * {y3}))"
    return f"({t2} - {m} * {y2})", f"({t3} - {m} * {y3})"


def _combined(a: str, b: str, k: int) -> str:
    return f"({a} * s{k} / n + {b} * norm * {float(k * k):.1f}e0)"


def _cells(scheme: str, parts: list[str], source: str = "k") -> str:
    return " UNION ALL ".join(f"SELECT '{scheme}' AS scheme, {j} AS k, round({x}, 6) + 0.0 AS theta FROM {source}" for j, x in enumerate(parts))


_FAMILY = [_cells(s, [x for i in range(2) for x in _theta(i, _penalty(s, 2, i), _penalty(s, 3, i))]) for s in _SHRINK]
_FAMILY.append(_cells("full", [f"{x} / ((1.0e0 + {_SHARE}) * norm)" for x in ("p0", "q0", "p1", "q1")]))
_FAMILY.append(_cells("theoretical", [x for i in range(2) for x in _centred(i, _combined("3.0e0", "1.0e-5", 2), _combined("3.0e0", "1.0e-5", 3))]))


def solutions(s: scorematch.Stats) -> dict[str, np.ndarray]:
    """Coefficients by scheme."""
    n, at = s.n, _TERMS
    found = {
        "ridge": solvers.ridge(s, at), "explicit": solvers.ridge(s, at, 1e-2), "plain": solvers.ridge(s, at, 1e-2, by_degree=False), "block": solvers.block_ridge(s, at),
        "quantile": solvers.quantile_ridge(s, at), "sigmoid": solvers.sigmoid_ridge(s, at, rows=n), "trace": solvers.trace_ridge(s, at, n), "hybrid": solvers.trace_ridge(s, at, n, sobolev=solvers.SOBOLEV),
        "blend": solvers.blend_ridge(s, at, rows=n), "deficiency": solvers.blend_ridge(s, at, mode="deficiency"), "full": solvers.full_ridge(s), "scaled": solvers.degree_scaled_ridge(s, at, n), "theoretical": solvers.theoretical(s, at, n),
    } | {m: solvers.spectral_ridge(s, at, mode=m) for m in ("whiten", "proportional", "inverse")}
    return {k: v.theta for k, v in found.items()}


@query(f"WITH m AS ({_MEANS} ({_ROWS})), k AS ({_KNOWN} m) " + " UNION ALL ".join(_FAMILY))
def ridge_family(spark, sf_dir):
    """All regularised solves over one pass of sufficient statistics."""
    found = solutions(scorematch.statistics(_rows(spark, sf_dir), _XS, _TERMS)[0])
    return rounded(spark.createDataFrame([(s, k, float(x)) for s, t in found.items() for k, x in enumerate(t)], "scheme string, k int, theta double"), "theta")


_PARTS = "SELECT *, least(23, (row_number() OVER (ORDER BY o_orderkey) - 1) // (SELECT count(*) // 24 FROM orders)) AS part FROM"


@query(f"""WITH b AS (SELECT part, {_axis(0)}, {_axis(1)} FROM ({_PARTS} ({_ROWS})) GROUP BY part),
g AS (SELECT quantile_cont(greatest(a0, a1), 0.5) AS g2, quantile_cont(greatest(e0, e1), 0.5) AS g3 FROM b), k AS (SELECT * FROM ({_MEANS} ({_ROWS})), g)
SELECT 'norm' AS scheme, 2 AS k, round(g2, 6) AS theta FROM g UNION ALL SELECT 'norm', 3, round(g3, 6) FROM g UNION ALL """ + _cells("median", [x for i in range(2) for x in _theta(i, f"({_SHARE} * g2)", f"({_SHARE} * g3)")]))
def median_block_ridge(spark, sf_dir):
    """Medians over 24 contiguous blocks of rows of each degree block's operator norm, and the solve that they scale."""
    blocks = ranks.contiguous_blocks(_rows(spark, sf_dir), ["o_orderkey"], 24)
    parts = list(scorematch.statistics(blocks, _XS, _TERMS, fold="block").values())
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(p)
    norms, theta = solvers.block_norms(parts, _TERMS), solvers.median_block_ridge(whole, _TERMS, parts).theta
    return rounded(spark.createDataFrame([*(("norm", k, v) for k, v in norms.items()), *(("median", k, float(x)) for k, x in enumerate(theta))], "scheme string, k int, theta double"), "theta")


_FOLDS = f"SELECT CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-0'), o_orderkey) > (SELECT count(*) // 2 FROM orders) THEN 1 ELSE 0 END AS fold, x0, x1 FROM ({_ROWS})"
_GRID = ", ".join(f"({i}, {num(a)}, {num(b)})" for i, (a, b) in enumerate((a, b) for a in np.logspace(-1, 2, 5) for b in np.logspace(-7, -3, 5)))
_TRIED = [x for i in range(2) for x in _centred(i, _combined("ca", "cb", 2), _combined("ca", "cb", 3))]
_RISK = " + ".join(f"0.5e0 * (h.a{i} * th{2 * i} * th{2 * i} + 2.0e0 * h.c{i} * th{2 * i} * th{2 * i + 1} + h.e{i} * th{2 * i + 1} * th{2 * i + 1}) - h.p{i} * th{2 * i} - h.q{i} * th{2 * i + 1}" for i in range(2))


@query(f"""WITH f AS ({_FOLDS}), m AS ({_KNOWN} ({_MEANS} f WHERE fold = 0)), h AS ({_MEANS} f WHERE fold = 1), g(place, ca, cb) AS (VALUES {_GRID}),
t AS (SELECT place, ca, cb, {', '.join(f'{x} AS th{j}' for j, x in enumerate(_TRIED))} FROM m, g), r AS (SELECT place, ca, cb, {_RISK} AS risk FROM t, h), best AS (SELECT ca, cb, risk FROM r ORDER BY risk, place LIMIT 1),
k AS (SELECT * FROM ({_KNOWN} ({_MEANS} f)), best)
SELECT 'c_cov' AS scheme, 0 AS k, round(ca, 6) AS theta FROM best UNION ALL SELECT 'c_sob', 0, round(cb, 9) FROM best UNION ALL SELECT 'risk', 0, round(risk, 6) + 0.0 FROM best UNION ALL """ + _cells("heldout", _TRIED))
def heldout_closed(spark, sf_dir):
    """The pair of constants with the least held-out risk of a 5 x 5 grid, then a refit on all rows."""
    folds = scorematch.statistics(ranks.hash_halves(_rows(spark, sf_dir), "o_orderkey"), _XS, _TERMS, fold="fold")
    s = solvers.heldout_select((folds[0], folds[1]), _TERMS)
    rows = [("c_cov", 0, round(float(s.info["c_cov"]), 6)), ("c_sob", 0, round(float(s.info["c_sob"]), 9)), ("risk", 0, round(s.info["risk"], 6) + 0.0), *(("heldout", k, round(float(x), 6) + 0.0) for k, x in enumerate(s.theta))]
    return spark.createDataFrame(rows, "scheme string, k int, theta double")


_ABLATED = {"fixed": (1e-4, 1e-2), "rows": (3.0, 1e2)}


def _ablated(name: str, strength: float, r2: str, r3: str) -> str:
    theta = [x for i in range(2) for x in _centred(i, r2, r3)]
    return f"SELECT '{name}' AS penalty, {num(strength)} AS strength, " + ", ".join(f"{x} AS th{j}" for j, x in enumerate(theta)) + " FROM m"


_TABLE = [
    _ablated(f"{base}_{kind}", s, *(f"({num(s * k**order)}{' / n' if kind == 'rows' else ''})" for k in (2, 3)))
    for order, base in enumerate(("identity", "sobolev1", "sobolev2"))
    for kind, given in _ABLATED.items()
    for s in given
]
_TABLE += [_ablated("combined", c, _combined(num(c), "1.0e-5", 2), _combined(num(c), "1.0e-5", 3)) for c in (3.0, 10.0)] + [_ablated("none", 1e-10, "1.0e-10", "1.0e-10")]


@query(f"WITH f AS ({_FOLDS}), m AS ({_KNOWN} ({_MEANS} f WHERE fold = 0)), h AS ({_MEANS} f WHERE fold = 1), t AS ({' UNION ALL '.join(_TABLE)}) SELECT penalty, strength, round({_RISK}, 6) + 0.0 AS risk FROM t, h")
def penalty_ablation(spark, sf_dir):
    """Held-out risk of identity and Sobolev penalties with fixed strengths and with strengths over the rows, of the combined
    penalty and of none, all under the constraint of mean derivatives zero."""
    folds = scorematch.statistics(ranks.hash_halves(_rows(spark, sf_dir), "o_orderkey"), _XS, _TERMS, fold="fold")
    found = [(name, s, diagnostics.penalised_risk(folds[0], folds[1], _TERMS, name, s)) for name, s in [(f"{base}_{kind}", s) for base in ("identity", "sobolev1", "sobolev2") for kind, given in _ABLATED.items() for s in given] + [("combined", 3.0), ("combined", 10.0), ("none", 1e-10)]]
    return rounded(spark.createDataFrame(found, "penalty string, strength double, risk double"), "risk")


_FREE = [x for i in range(2) for x in _theta(i, _combined("3.0e0", "1.0e-5", 2), _combined("3.0e0", "1.0e-5", 3))]
_HELD_AT_ZERO = [x for i in range(2) for x in _centred(i, _combined("3.0e0", "1.0e-5", 2), _combined("3.0e0", "1.0e-5", 3))]


@query(f"WITH f AS ({_FOLDS}), m AS ({_KNOWN} ({_MEANS} f WHERE fold = 0)), h AS ({_MEANS} f WHERE fold = 1), t AS (" + " UNION ALL ".join(f"SELECT '{name}' AS name, u0, u1, v0, v1, {', '.join(f'{x} AS th{j}' for j, x in enumerate(theta))} FROM m" for name, theta in (("centred", _HELD_AT_ZERO), ("free", _FREE))) + f") SELECT name AS \"constraint\", round({_RISK}, 6) + 0.0 AS risk, round(sqrt(power(t.u0 * th0 + t.v0 * th1, 2) + power(t.u1 * th2 + t.v1 * th3, 2)), 6) + 0.0 AS residual FROM t, h")
def centring_ablation(spark, sf_dir):
    """Held-out risk with and without the constraint of mean derivatives zero."""
    folds = scorematch.statistics(ranks.hash_halves(_rows(spark, sf_dir), "o_orderkey"), _XS, _TERMS, fold="fold")
    rows = [tuple(x.values()) for x in diagnostics.centring(folds[0], folds[1], _TERMS)]
    return rounded(spark.createDataFrame(rows, "constraint string, risk double, residual double"), "risk", "residual")


def _first(i: int) -> str:
    """Means over one axis of a dictionary of the first and the second degree."""
    slope = f"({num(math.sqrt(2))} * x{i})"
    return f"avg({slope}) AS c{i}, avg({slope} * {slope}) AS e{i}, avg(x{i}) AS p{i}, avg(x{i} * {slope} - {num(math.sqrt(2))}) AS q{i}"


_LAMBDA = f"1.0e-4 * greatest({', '.join(f'(1.0e0 + e{i}) / 2.0e0 + sqrt(power((1.0e0 - e{i}) / 2.0e0, 2) + c{i} * c{i})' for i in range(2))})"
_BOTH = [(f"((p{i} * (e{i} + 4.0e0 * r) - c{i} * q{i}) / ((1.0e0 + r) * (e{i} + 4.0e0 * r) - c{i} * c{i}))", f"((q{i} * (1.0e0 + r) - c{i} * p{i}) / ((1.0e0 + r) * (e{i} + 4.0e0 * r) - c{i} * c{i}))") for i in range(2)]


@query(f"""WITH m AS (SELECT {_first(0)}, {_first(1)} FROM ({_ROWS})), k AS (SELECT *, {_LAMBDA} AS r FROM m), t AS (SELECT *, {', '.join(f'{x} AS t{2 * i + j}' for i, pair in enumerate(_BOTH) for j, x in enumerate(pair))} FROM k)
SELECT 1 AS degree, 2 AS terms, round(power(p0 / (1.0e0 + 1.0e-4), 2) + power(p1 / (1.0e0 + 1.0e-4), 2), 6) AS trace FROM t UNION ALL
SELECT 2, 4, round(t0 * t0 + 2.0e0 * c0 * t0 * t1 + e0 * t1 * t1 + t2 * t2 + 2.0e0 * c1 * t2 * t3 + e1 * t3 * t3, 6) FROM t""")
def saturation_closed(spark, sf_dir):
    """Traces of the fitted score's second moment over growing dictionaries, from one pass over the largest."""
    ladder = diagnostics.saturation(_rows(spark, sf_dir), _XS, [(1, 1), (2, 1)])
    return rounded(spark.createDataFrame([(x["degree"], x["terms"], x["trace"]) for x in ladder], "degree int, terms int, trace double"), "trace")


_RANKED = " , ".join(f"(rank() OVER (ORDER BY x{i}) + (count(*) OVER (PARTITION BY x{i}) - 1) / 2.0e0) / (count(*) OVER () + 1) AS r{i}" for i in range(2))
_CURVE = num(math.sqrt(2))


@query(f"""WITH r AS (SELECT {_RANKED} FROM ({_ROWS})), z AS (SELECT {', '.join(f'{P.ndtri_sql(f"r{i}")} AS z{i}' for i in range(2))} FROM r),
a AS (SELECT {', '.join(f'avg(2.0e0 * z{i} * z{i}) AS a{i}, avg({_CURVE} * z{i} * z{i} - {_CURVE}) AS b{i}' for i in range(2))} FROM z),
t AS (SELECT {', '.join(f'b{i} / (a{i} + 4.0e-4 * greatest(a0, a1)) * {_CURVE} * z{i} AS t{i}' for i in range(2))} FROM z, a),
c AS (SELECT avg(t0 * t0) AS m00, avg(t0 * t1) AS m01, avg(t1 * t1) AS m11 FROM t), e AS (SELECT *, {_EIG('m')} AS l FROM c)
SELECT round(l, 9) AS eigenvalue, round(m00 + m11, 9) AS trace, round(power(m01, 2) / (power(m01, 2) + power(l - m00, 2)), 6) AS share FROM e""")
def subspace_closed(spark, sf_dir):
    """Ranks, score matching and the leading direction, with a dictionary that SQL can solve: second degrees alone."""
    V, info = models.fit_subspace(_rows(spark, sf_dir), _XS, 1, 2, 1)
    return rounded(rounded(spark.createDataFrame([(float(info["eigenvalues"][0]), info["trace"], float(V[0, 0] ** 2))], "eigenvalue double, trace double, share double"), "eigenvalue", "trace", digits=9), "share")


_APART = ", ".join(f"(rank() OVER (PARTITION BY fold ORDER BY x{i}) + (count(*) OVER (PARTITION BY fold, x{i}) - 1) / 2.0e0) / (count(*) OVER (PARTITION BY fold) + 1) AS r{i}" for i in range(2))
_HALVES = f"f AS ({_FOLDS}), r AS (SELECT fold, {_APART} FROM f), z AS (SELECT fold, {', '.join(f'{P.ndtri_sql(f"r{i}")} AS x{i}' for i in range(2))} FROM r)"
_SECOND = [f"(p{i} / (a{i} + 4.0e-4 * greatest(a0, a1)))" for i in range(2)]
_THIRD = [x for i in range(2) for x in _theta(i, "(4.0e-4 * norm)", "(9.0e-4 * norm)")]
_LOW_RISK = " + ".join(f"0.5e0 * h.a{i} * th{i} * th{i} - h.p{i} * th{i}" for i in range(2))


@query(f"""WITH {_HALVES}, m AS ({_KNOWN} ({_MEANS} z WHERE fold = 0)), h AS ({_MEANS} z WHERE fold = 1),
s AS (SELECT {', '.join(f'{x} AS th{i}' for i, x in enumerate(_SECOND))} FROM m), t AS (SELECT {', '.join(f'{x} AS th{j}' for j, x in enumerate(_THIRD))} FROM m)
SELECT '(2, 1, False)' AS candidate, round({_LOW_RISK}, 9) + 0.0 AS risk FROM s, h UNION ALL SELECT '(3, 1, False)', round({_RISK}, 9) + 0.0 FROM t, h""")
def selection_closed(spark, sf_dir):
    """Held-out risks of two dictionaries, the halves ranked apart."""
    risks = selection.heldout_risks(_rows(spark, sf_dir), _XS, "o_orderkey", [(2, 1, False), (3, 1, False)])
    return rounded(spark.createDataFrame([(str(c), float(v)) for c, vs in risks.items() for v in vs], "candidate string, risk double"), "risk", digits=9)


_KEYED = _FOLDS.replace("AS fold, x0, x1", "AS fold, o_orderkey, x0, x1")
_BELOW = ", ".join(f"sum(CASE WHEN fold = 0 THEN 1 ELSE 0 END) OVER (ORDER BY x{i} RANGE UNBOUNDED PRECEDING) AS b{i}" for i in range(2))
_CLIPPED = ", ".join(f"greatest(1, least(n, b{i})) / (n + 1.0e0) AS r{i}" for i in range(2))
_T_HELD = ", ".join(f"{x} * {num(math.sqrt(2))} * ({P.ndtri_sql(f'r{i}')}) AS t{i}" for i, x in enumerate(_SECOND))


@query(f"""WITH {_HALVES}, m AS ({_KNOWN} ({_MEANS} z WHERE fold = 0)), g AS ({_KEYED}), b AS (SELECT fold, {_BELOW}, (SELECT count(*) FROM g WHERE fold = 0) AS n FROM g), q AS (SELECT {_CLIPPED} FROM b WHERE fold = 1),
t AS (SELECT {_T_HELD} FROM q, m), c AS (SELECT avg(t0 * t0) AS m00, avg(t0 * t1) AS m01, avg(t1 * t1) AS m11, avg(power(t0 * t0 + t1 * t1, 2)) AS fourth, count(*) AS n FROM t),
e AS (SELECT fourth, n, ({_LOW('m')}) AS tail FROM c)
SELECT 'tail' AS part, round(tail, 9) + 0.0 AS value FROM e UNION ALL SELECT 'fourth', round(fourth, 9) FROM e UNION ALL SELECT 'bound', round(tail + sqrt(fourth / (n * 0.05)), 9) FROM e""")
def a_posteriori_closed(spark, sf_dir):
    """A bound on the mass outside a fitted direction from the other half, whose ranks are taken in the first."""
    got = diagnostics.a_posteriori_bound(_rows(spark, sf_dir), _XS, "o_orderkey", 1, 2, 1)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in got.items()], "part string, value double"), "value", digits=9)


# --- subspaces of two dimensions -----------------------------------------------------------------------------------

_TWO = """WITH m AS (SELECT avg(x0 * x0) AS m00, avg(x0 * x1) AS m01, avg(x1 * x1) AS m11, avg(y0 * y0) AS h00, avg(y0 * y1) AS h01, avg(y1 * y1) AS h11
FROM (SELECT x0, x1, x0 + 5.0e-1 * x1 AS y0, 1.5e0 * x1 - 2.0e-1 * x0 AS y1 FROM (""" + _ROWS + ")))"
_FORM = lambda p, a, b: f"({p}00 * {a}0 * {b}0 + {p}01 * ({a}0 * {b}1 + {a}1 * {b}0) + {p}11 * {a}1 * {b}1)"


@query(_TWO + f""", e AS (SELECT *, {_EIG('m')} AS lm, {_LOW('m')} AS lm2, {_EIG('h')} AS lh, {_LOW('h')} AS lh2 FROM m),
r AS (SELECT *, m01 / sqrt(m01 * m01 + power(lm - m00, 2)) AS v0, (lm - m00) / sqrt(m01 * m01 + power(lm - m00, 2)) AS v1, h01 / sqrt(h01 * h01 + power(lh - h00, 2)) AS w0, (lh - h00) / sqrt(h01 * h01 + power(lh - h00, 2)) AS w1,
 m00 - h00 AS g00, m01 - h01 AS g01, m11 - h11 AS g11 FROM e),
q AS (SELECT *, -v1 AS p0, v0 AS p1 FROM r),
z AS (SELECT *, {_FORM('m', 'p', 'p')} AS mpp, {_FORM('h', 'p', 'p')} AS hpp, {_FORM('m', 'p', 'v')} AS mpv, {_FORM('h', 'p', 'v')} AS hpv, {_FORM('m', 'v', 'v')} AS mvv, {_FORM('h', 'v', 'v')} AS hvv,
 greatest(abs({_EIG('g')}), abs({_LOW('g')})) AS big, least(1.0e0, abs(v0 * w0 + v1 * w1)) AS cosine FROM q)
SELECT name, round(x, 6) + 0.0 AS x FROM (""" + " UNION ALL ".join(f"SELECT '{k}' AS name, {x} AS x FROM z" for k, x in {
    "eigenvalue_0": "lm", "eigenvalue_1": "lm2", "projector_00": "v0 * v0", "projector_01": "v0 * v1", "angle": "degrees(acos(cosine))", "sine": "sqrt(greatest(0.0e0, 1.0e0 - cosine * cosine))",
    "upper": "0.5e0 * (mpp - 1.0e0 + ln(hpp))", "lower": "greatest(0.0e0, 0.5e0 * (1.0e0 - 1.0e0 / hpp - ln(mpp)))", "half_trace": "0.5e0 * (mpp + hpp - 2.0e0)", "certificate": "0.5e0 * hpp",
    "gradient": "abs(mpv + hpv / (hpp + 1.0e-10))", "curvature": "(mvv - mpp + hvv / (hpp + 1.0e-10) - 1.0e0) / 2.0e0 - power(2.0e0 * hpv / (hpp + 1.0e-10), 2) / 4.0e0",
    "excess": "hpp - lh2", "operator": "2.0e0 * big", "ky_fan": "2.0e0 * big", "outside": "lm2", "per_direction": "degrees(asin(least(1.0e0, sqrt(greatest(0.0e0, 1.0e0 - cosine * cosine)))))",
}.items()) + ")")
def subspace_bounds(spark, sf_dir):
    """Leading direction of one moment matrix, its angle to another's, and the bounds, gradient and curvature between them."""
    rows = _rows(spark, sf_dir).selectExpr("x0", "x1", "x0 + 5.0e-1 * x1 AS y0", "1.5e0 * x1 - 2.0e-1 * x0 AS y1")
    m, h = (scorematch.matrix(scorematch.second_moments(rows, c), 2, 2, "m") for c in (["x0", "x1"], ["y0", "y1"]))
    l, u = subspace.randomized_eigenvectors(lambda b: m @ b, 2, 2)
    v, w = models.pca_subspace(rows, ["x0", "x1"], 1), subspace.top_eigenvectors(h, 1)[1]
    found = {"eigenvalue_0": l[0], "eigenvalue_1": l[1], "projector_00": u[0, 0] ** 2, "projector_01": v[0, 0] * v[1, 0], "angle": subspace.principal_angle(v, w), "sine": subspace.sin_theta(v, w)}
    found |= subspace.bounds(v, m, h) | subspace.tail_sum_bounds(h, m, 1) | {"certificate": subspace.certificate(v, h), "outside": diagnostics.outside_mass(m, 1)}
    found |= {"gradient": abs(subspace.gradient(v, m, h)[0][0, 0]), "curvature": subspace.curvature(np.eye(1), v, m, h), "per_direction": subspace.angle_per_direction(subspace.sin_theta(v, w), 1)}
    return rounded(spark.createDataFrame([(k, float(x)) for k, x in found.items()], "name string, x double"), "x")


# --- score fields and their statistics -----------------------------------------------------------------------------

_INDEX = dictionary(2, 3, 2)
_THETA = [0.3, -0.2, 0.15, 0.05, -0.1, 0.07, 0.02]
_T = [" + ".join(f"{num(t)} * {g}" for t, x in zip(_THETA, _INDEX, strict=True) if (g := gradient_sql(x, _XS, i))) for i in range(2)]
_FIELD = f"SELECT o_orderkey, x0, x1, {_T[0]} AS t0, {_T[1]} AS t1 FROM ({_ROWS})"


def _field(spark, sf_dir) -> DataFrame:
    return scorematch.score_columns(_rows(spark, sf_dir), _XS, _INDEX, np.array(_THETA))


@query(f"SELECT o_orderkey, round(t0, 6) + 0.0 AS t0, round(t1, 6) + 0.0 AS t1 FROM ({_FIELD})")
def score_field(spark, sf_dir):
    return rounded(_field(spark, sf_dir).select("o_orderkey", "t0", "t1"), "t0", "t1")


@query(f"SELECT o_orderkey, round({' + '.join(hermite_sql('x0', k) for k in range(7))}, 6) + 0.0 AS h FROM ({_ROWS})")
def hermite_recurrence(spark, sf_dir):
    """The normalised recurrence of the numpy kernel, against polynomials in Horner form."""
    return rounded(models.map_rows(_rows(spark, sf_dir), ["x0"], lambda x: {"h": hermite_values(x[:, 0], 6).sum(1)}, ["h"]).select("o_orderkey", "h"), "h")


@query(f"SELECT o_orderkey, {', '.join(f'round({term_sql(x, _XS)}, 6) + 0.0 AS psi{k}' for k, x in enumerate(_INDEX))} FROM ({_ROWS})")
def dictionary_values(spark, sf_dir):
    """The kernel that evaluates the polynomials alone."""
    names = [f"psi{k}" for k in range(len(_INDEX))]
    out = models.map_rows(_rows(spark, sf_dir), _XS, lambda x: dict(zip(names, values(x, _INDEX).T, strict=True)), names)
    return rounded(out.select("o_orderkey", *names), *names)


_SINGLE = "SELECT 1 AS m, i.range AS i, -1 AS j, a.range AS a, 0 AS b FROM range(0, 4) i, range(1, 5) a"
_DOUBLE = "SELECT 2 AS m, i.range AS i, j.range AS j, a.range AS a, b.range AS b FROM range(0, 4) i, range(0, 4) j, range(1, 5) a, range(1, 5) b WHERE i.range < j.range AND a.range + b.range <= 4"


@query(f"""WITH t AS (SELECT * FROM ({_SINGLE}) UNION ALL SELECT * FROM ({_DOUBLE})), kinds(kind) AS (VALUES ('plain'), ('linear'), ('even')),
k AS (SELECT kind, t.* FROM t, kinds WHERE (kind = 'linear' OR a + b > 1) AND (kind <> 'even' OR (a + b) % 2 = 0))
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY m, i, j, a + b, a) - 1 AS place, CASE WHEN m = 1 THEN i || '' ELSE i || ',' || j END AS support, CASE WHEN m = 1 THEN a || '' ELSE a || ',' || b END AS degrees, a + b AS total FROM k""")
def dictionary_table(spark, sf_dir):
    """The dictionary in its fixed order: without and with linear terms, and of even degrees only."""
    text = lambda x: ",".join(map(str, x))
    kinds = {"plain": {}, "linear": {"linear": True}, "even": {"even": True}}
    rows = [(kind, k, text(s), text(g), sum(g)) for kind, given in kinds.items() for k, (s, g) in enumerate(dictionary(4, 4, 2, **given))]
    return spark.createDataFrame(rows, "kind string, place bigint, support string, degrees string, total bigint")


def _pairs(cell) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {cell(i, j)}" for i in range(2) for j in range(i, 2))


@query(f"WITH f AS ({_FIELD}) " + _pairs(lambda i, j: f"round(avg(x{i} * x{j}), 6) + 0.0 AS m, round(avg(t{i} * t{j}), 6) + 0.0 AS h, round(avg((t{i} + x{i}) * (t{j} + x{j})), 6) + 0.0 AS c FROM f"))
def moments_of_two_tables(spark, sf_dir):
    """M, H and C from two stored tables, joined by the row's key."""
    field = _field(spark, sf_dir)
    return rounded(samples.joined_moments(field.select("o_orderkey", "x0", "x1"), field.select("o_orderkey", "t0", "t1"), "o_orderkey", ["x0", "x1"], ["t0", "t1"]), "m", "h", "c")


@query(f"WITH f AS ({_FIELD}), c AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, avg(t{i} * x{j}) AS tz, avg(x{i} * x{j}) - {float(i == j)} AS s FROM f" for i in range(2) for j in range(2)) + f") SELECT round(sqrt(sum(power(tz - s, 2))) / sqrt(sum(s * s)), 6) AS residual, (SELECT round(avg(power(t0 * t0 + t1 * t1, 2)), 6) FROM f) AS fourth FROM c")
def stein_check(spark, sf_dir):
    """Stein's residual of a score field and its fourth moment, in one pass that never stores the field."""
    got = scorematch.score_moments(_rows(spark, sf_dir), _XS, _INDEX, np.array(_THETA))
    return rounded(spark.createDataFrame([(got.stein_residual(), got.fourth)], "residual double, fourth double"), "residual", "fourth")


@query(f"WITH f AS ({_FIELD}) " + _pairs(lambda i, j: f"round(avg(t{i} * t{j}), 6) + 0.0 AS c FROM f"))
def score_second_moment(spark, sf_dir):
    """The score's second moment, from the same pass."""
    c = scorematch.score_moments(_rows(spark, sf_dir), _XS, _INDEX, np.array(_THETA)).C
    return rounded(spark.createDataFrame([(i, j, float(c[i, j])) for i in range(2) for j in range(i, 2)], "i int, j int, c double"), "c")


_BY_DEGREE = lambda k, i: " + ".join(f"{num(t)} * {g}" for t, x in zip(_THETA, _INDEX, strict=True) if sum(x[1]) == k and (g := gradient_sql(x, _XS, i))) or num(0.0)


@query(" UNION ALL ".join(f"SELECT {k} AS degree, round(avg(power({_BY_DEGREE(k, 0)}, 2) + power({_BY_DEGREE(k, 1)}, 2)), 6) AS energy FROM ({_ROWS})" for k in (2, 3)))
def degree_energy(spark, sf_dir):
    """The score's second moment by total degree, from the gram alone."""
    s = scorematch.statistics(_rows(spark, sf_dir), _XS, _INDEX)[0]
    got = scorematch.degree_traces(s, _INDEX, np.array(_THETA))
    return rounded(spark.createDataFrame([(k, float(x)) for k, x in enumerate(got, 1) if k > 1], "degree int, energy double"), "energy")


_W = (0.5, 2.0)
_LABELS = ("1.0e-1 - x0", "-5.0e-1 * x1")


@query(" UNION ALL ".join(f"SELECT {k} AS k, round(avg({' + '.join(f'{num(_W[i])} * {g} * {g}' for i in range(2) if (g := gradient_sql(x, _XS, i)))}), 6) AS a, round(avg({' + '.join(f'({_LABELS[i]}) * {g}' for i in range(2) if (g := gradient_sql(x, _XS, i)))}), 6) + 0.0 AS b FROM ({_ROWS})" for k, x in enumerate(_INDEX)))
def weighted_and_labelled(spark, sf_dir):
    """The gram's diagonal with a weight a coordinate, and the right side from score labels."""
    rows = _rows(spark, sf_dir).selectExpr("x0", "x1", *(f"{t} AS s{i}" for i, t in enumerate(_LABELS)))
    a = scorematch.statistics(rows, _XS, _INDEX, weights=np.array(_W))[0].A
    b = scorematch.statistics(rows, _XS, _INDEX, scores=["s0", "s1"])[0].b
    return rounded(spark.createDataFrame([(k, float(a[k, k]), float(b[k])) for k in range(len(b))], "k int, a double, b double"), "a", "b")


# --- tilts, caps, gates --------------------------------------------------------------------------------------------

_TILTED = {"x0": "c_acctbal / 2.0e3", "x1": "(c_custkey % 97) / 1.6e1 - 3.0e0"}
_WINDOW = "0.5e0 * (1.0e0 + cos({pi} * greatest(0.0e0, least(1.0e0, (abs(w) - 3.5e0) / 2.5e0))))".format(pi=num(math.pi))


def _tilt_means(x: str) -> str:
    w = P.ndtri_sql(f"greatest({num(1e-12)}, least({num(1 - 1e-12)}, {num(1.0)} / ({num(1.0)} + exp(-({x})))))")
    first = {k: f"{num(math.sqrt(k))} * {hermite_sql('w', k - 1)}" for k in tilt.DEGREES}
    rhs = {k: f"w * {first[k]} - {num(math.sqrt(k * (k - 1)))} * {hermite_sql('w', k - 2)}" for k in tilt.DEGREES}
    return f"SELECT avg({first[2]} * {first[2]}) + 1.0e-10 AS a, avg({first[2]} * {first[4]}) AS c, avg({first[4]} * {first[4]}) + 1.0e-10 AS e, avg({rhs[2]}) AS p, avg({rhs[4]}) AS q FROM (SELECT {w} AS w FROM customer)"


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM ({_tilt_means(x)})" for k, x in enumerate(_TILTED.values())) + f"""),
t AS (SELECT k, (p * e - c * q) / (a * e - c * c) AS t2, (q * a - c * p) / (a * e - c * c) AS t4 FROM m),
g AS (SELECT range AS j, -1.2e1 + 2.4e1 * range / 8.0e3 AS w FROM range(0, 8001)),
d AS (SELECT k, t2, t4, j, exp({_WINDOW} * (t2 * {hermite_sql('w', 2)} + t4 * {hermite_sql('w', 4)}) - 0.5e0 * w * w) / {num(math.sqrt(2 * math.pi))} AS d FROM t, g)
SELECT k, round(t2, 6) + 0.0 AS t2, round(t4, 6) + 0.0 AS t4, round(ln(sum(CASE WHEN j IN (0, 8000) THEN 0.5e0 * d ELSE d END) * 3.0e-3), 6) + 0.0 AS log_norm FROM d GROUP BY k, t2, t4""")
def tilted_marginals(spark, sf_dir):
    """Windowed tilts of the logistic base; both columns here are active (a tilt beyond 0.003)."""
    rows = table(spark, sf_dir, "customer").selectExpr(*(f"{x} AS {c}" for c, x in _TILTED.items()))
    found = tilt.fit_tilts(rows, _XS)
    return rounded(spark.createDataFrame([(k, *map(float, t.theta), float(t.log_norm)) for k, t in enumerate(found)], "k int, t2 double, t4 double, log_norm double"), "t2", "t4", "log_norm")


_POLY = " + ".join(f"{num(t)} * {term_sql(x, _XS)}" for t, x in zip(_THETA, _INDEX, strict=True))


@query(f"WITH p AS (SELECT o_orderkey, {_POLY} AS l FROM ({_ROWS})) SELECT o_orderkey, round(least(l, (SELECT quantile_cont(l, 0.999) FROM p)), 6) + 0.0 AS l FROM p")
def capped_potential(spark, sf_dir):
    """A polynomial cut at its 99.9th percentile."""
    rows = _rows(spark, sf_dir).select("o_orderkey", scorematch.polynomial(np.array(_THETA), _XS, _INDEX).alias("l"))
    cap = ranks.quantiles(rows, "l", {"cap": models.CAP_SHARE}, [])
    return rounded(rows.crossJoin(F.broadcast(cap)).select("o_orderkey", F.least("l", "cap").alias("l")), "l")  # one row


_THETAS = [[t * s for t in _THETA] for s in (0.5, 1.0, -1.0)]


@query(" UNION ALL ".join(f"SELECT {k} AS k, round(avg(least({' + '.join(f'{num(t)} * {term_sql(x, _XS)}' for t, x in zip(theta, _INDEX, strict=True))}, 2.0e0)), 6) + 0.0 AS mean FROM ({_ROWS})" for k, theta in enumerate(_THETAS)))
def means_of_many_fits(spark, sf_dir):
    """Capped potentials of several coefficient vectors over the same features, in one pass."""
    return rounded(diagnostics.capped_means(_rows(spark, sf_dir), _XS, _INDEX, np.array(_THETAS), 2.0), "mean")


_GATE = "SELECT event_type, value, CASE WHEN value / 1.0e3 < 1.0e-3 THEN 'low_ess' WHEN (user_id % 13) / 1.0e2 > 0.1 THEN 'high_se' ELSE 'ok' END AS status FROM events"


@query(f"SELECT event_type, status, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY event_type) AS DOUBLE), 9) AS share FROM ({_GATE}) GROUP BY 1, 2")
def acceptance_counts(spark, sf_dir):
    """How many integrals pass the gate on effective draws and relative error, by status."""
    rows = table(spark, sf_dir, "events").selectExpr("event_type", "value / 1.0e3 AS ess_share", "(user_id % 13) / 1.0e2 AS rel_se")
    return rounded(samples.status_counts(weights.accepted(rows), ["event_type"]), "share", digits=9)


@query("""WITH c(place, candidate, size) AS (VALUES (0, '(4, 2, False)', 300), (1, '(4, 3, False)', 780), (2, '(4, 3, True)', 560), (3, '(4, 4, False)', 990)), b(most) AS (VALUES (1.0e7), (1.0e6), (1.0e2))
SELECT most, candidate, size FROM c, b WHERE 8.0 * size * size <= most OR (size = 300 AND NOT EXISTS (SELECT 1 FROM c c2 WHERE 8.0 * c2.size * c2.size <= most))""")
def memory_gate(spark, sf_dir):
    """Candidates whose gram fits a budget; the smallest where none does."""
    candidates = [(4, 2, False), (4, 3, False), (4, 3, True), (4, 4, False)]
    out = None
    for most in (1e7, 1e6, 1e2):
        kept = selection.within_memory(selection.candidate_table(spark, candidates, 10), most).select(F.lit(most).alias("most"), "candidate", F.col("size").cast("int").alias("size"))
        out = kept if out is None else out.unionByName(kept)
    return out


@query("SELECT event_type, round(least(avg(value) / avg(value * value), 8.0e-3), 9) AS x FROM events GROUP BY event_type")
def bounded_minimum(spark, sf_dir):
    """A quadratic's minimum under a bound, by the interior point solver: one variable a group."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.col("value") * F.col("value")).alias("m"), F.avg("value").alias("b")).collect()  # a row a type
    found = [(r.event_type, float(solvers.barrier_qp(np.array([[r.m]]), np.array([r.b]), np.zeros((0, 1)), np.array([[1.0]]), np.array([8e-3]), tol=1e-13)[0][0])) for r in rows]
    return rounded(spark.createDataFrame(found, "event_type string, x double"), "x", digits=9)


@query("""WITH g AS (SELECT event_type, value / 1.0e2 AS a, ln(value + 1.0) AS b, sqrt(value) / 3.0e0 AS c FROM events)
SELECT event_type, count(*) AS n, round(avg(a - b), 6) + 0.0 AS kl, round(stddev_samp(a - b) / sqrt(count(*)), 6) AS se, (SELECT round(avg(a - b), 6) + 0.0 FROM g) AS first, (SELECT round(avg(b - c), 6) + 0.0 FROM g) AS second FROM g GROUP BY event_type""")
def divergence_parts(spark, sf_dir):
    """Mean log-density gaps by group with their errors, and a chain of gaps that add up."""
    rows = table(spark, sf_dir, "events").selectExpr("event_type", "value / 1.0e2 AS a", "ln(value + 1.0) AS b", "sqrt(value) / 3.0e0 AS c")
    chain = diagnostics.decomposition(rows, ["a", "b", "c"])
    out = diagnostics.divergence(rows, "a", "b", ["event_type"]).withColumn("first", F.lit(chain["a_b"])).withColumn("second", F.lit(chain["b_c"]))
    return rounded(out, "kl", "se", "first", "second")
