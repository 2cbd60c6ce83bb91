"""Queries of the operators for large dictionaries and wide vectors, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skerry.functions.hermite import dictionary, gradient_sql
from skerry.functions.sqltext import num
from skerry.operators import range_finder, ranks, tiles
from skerry.operators.population import density_moments
from skerry.plans import diagnostics, draws, models, selection
from skerry.plans.registry import query, rounded, table
from skerry.plans.storage import shared_dir
from skerry.streaming import chains

_NAMES = ["x0", "x1", "x2", "x3"]
#: The columns on a scale near one, as the dictionary's terms ask for.
_SCALE = "(l_quantity - 25.5) / 14.4 AS x0, (l_extendedprice - 53000) / 30000 AS x1, (l_discount - 0.05) / 0.032 AS x2, (l_tax - 0.04) / 0.026 AS x3"
_TERMS = dictionary(4, 3, 3)


def _slope(axis: int) -> str:
    """The field sum_k d_axis H_k / (k + 1)."""
    return " + ".join(f"{num(1 / (k + 1))} * {g}" for k, t in enumerate(_TERMS) if (g := gradient_sql(t, _NAMES, axis)))


_FIELD = ", ".join(f"{_slope(i)} AS t{i}" for i in range(4))
_MEANS = ", ".join(
    "struct_pack(k := {}, y := avg({}), b := avg({}))".format(
        k,
        " + ".join(f"{gradient_sql(t, _NAMES, i)} * t{i}" for i in t[0]),
        " + ".join([f"{_NAMES[i]} * {gradient_sql(t, _NAMES, i)}" for i in t[0]] + [f"-({s})" for i in t[0] if (s := gradient_sql(t, _NAMES, i, 2))]),
    )
    for k, t in enumerate(_TERMS)
)


@query(f"""WITH z AS (SELECT {_SCALE} FROM lineitem), t AS (SELECT *, {_FIELD} FROM z), m AS (SELECT unnest([{_MEANS}]) AS u FROM t)
SELECT u.k AS k, round(u.y, 6) + 0.0 AS y, round(u.b, 6) + 0.0 AS b FROM m""")
def tiled_gram_product(spark, sf_dir):
    """The gram in tiles times the vector 1 / (k + 1), and the right side. In SQL the product is a mean over rows of the slopes
    times the field that the vector makes of them."""
    import numpy as np

    gram = tiles.tiled_statistics(table(spark, sf_dir, "lineitem").selectExpr(*_SCALE.split(", ")), _NAMES, _TERMS, size=8, block_bytes=8 * 16**2)
    y = gram.product(1 / (np.arange(len(_TERMS)) + 1.0))
    return rounded(spark.createDataFrame([(k, float(y[k]), float(gram.b[k])) for k in range(len(_TERMS))], "k int, y double, b double"), "y", "b")


@query()
def tiled_ridge(spark, sf_dir):
    """Coefficients of the ridge fit over all dimensions of the vectors on their normal scores, a system of 2,080 terms that is
    solved through its tiles."""
    vectors = table(spark, sf_dir, "embeddings")
    names = [f"e{j}" for j in range(64)]
    scores = ranks.rank_gaussianize(vectors.selectExpr(*(f"CAST(embedding[{j}] AS DOUBLE) AS {n}" for j, n in enumerate(names))), names).select(*(f"{n}_z" for n in names))
    terms = dictionary(64, 2, 2)
    gram = tiles.tiled_statistics(scores, [f"{n}_z" for n in names], terms)
    theta, _ = tiles.solve(gram, gram.b, 0.05)
    rows = [("+".join(map(str, support)), float(t)) for (support, _), t in zip(terms, theta, strict=True)]
    return rounded(spark.createDataFrame(rows, "axes string, theta double"), "theta")


def _projector(name: str, source: str) -> str:
    """The projector on the leading eigenvector: squares of the matrix, scaled to trace 1, twenty-four times."""
    trace = "list_sum(list_transform(m, lambda r: list_dot_product(r, r)))"
    square = f"list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c) / {trace}))"
    return f"{name}s AS (SELECT 0 AS step, m FROM {source} UNION ALL SELECT step + 1, {square} FROM {name}s WHERE step < 24), {name} AS (SELECT m AS p FROM {name}s WHERE step = 24)"


def _eigen_sql(rank: int) -> str:
    made, shown = [], []
    for k in range(rank):
        made.append(_projector(f"p{k}", f"m{k}"))
        made.append(f"v{k} AS (SELECT m, p, list_sum(list_transform(range(1, 65), lambda i: list_dot_product(m[i], p[i]))) AS l FROM m{k}, p{k})")
        made.append(f"m{k + 1} AS (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: m[i][j] - l * p[i][j])) AS m FROM v{k})")
        shown.append(f"SELECT CAST({k} AS INTEGER) AS k, CAST(i - 1 AS INTEGER) AS i, round(l, 9) + 0.0 AS eigenvalue, round(p[i][i], 6) + 0.0 AS share FROM v{k}, (SELECT unnest(range(1, 65)) AS i)")
    return f"""WITH RECURSIVE e AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT i, j, avg(v[i] * v[j]) AS a FROM e, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j),
w AS (SELECT i, list(a ORDER BY j) AS r FROM c GROUP BY i), m0 AS (SELECT list(r ORDER BY i) AS m FROM w), {", ".join(made)} {" UNION ALL ".join(shown)}"""


@query(_eigen_sql(3))
def embedding_eigenpairs(spark, sf_dir):
    """The three leading eigenpairs of the vectors' second moment, each entry of a vector by its square."""
    values, vectors, _ = range_finder.eigenpairs(table(spark, sf_dir, "embeddings"), "embedding", 64, 3, tolerance=1e-14)
    rows = [(k, i, float(values[k]), float(vectors[i, k] ** 2)) for k in range(3) for i in range(64)]
    return rounded(rounded(spark.createDataFrame(rows, "k int, i int, eigenvalue double, share double"), "eigenvalue", digits=9), "share")


# --- dictionaries that are chosen, and what a larger one adds ----------------------------------------------------------

_PAIR = "(o_totalprice - 250000) / 140000 AS x0, (o_custkey - 7500) / 4300 AS x1"
_STRENGTH = 0.01


def _solve_three(k: int, g: str) -> str:
    """Coefficient k of the system with cells a, b, c, d, squared degrees times the strength on the diagonal, right side g0 to g2."""
    lam = 4 * _STRENGTH
    rows = [[f"(a + {lam})", "0", "b"], ["0", f"(d + {lam})", "b"], ["b", "b", f"(c + {lam})"]]

    def det(m):
        return " + ".join(f"{m[0][i]} * ({m[1][j]} * {m[2][l]} - {m[1][l]} * {m[2][j]})" for i, j, l in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))

    return f"({det([[f'{g}{i}' if j == k else v for j, v in enumerate(row)] for i, row in enumerate(rows)])}) / ({det(rows)})"


@query(f"""WITH k AS (SELECT {_PAIR}, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-0'), o_orderkey) AS k, (SELECT count(*) FROM orders) AS n FROM orders),
p AS (SELECT x0, x1, CASE WHEN k > n // 2 THEN 2 WHEN k > n // 4 THEN 1 ELSE 0 END AS part FROM k),
s AS (SELECT part, avg(2 * x0 * x0) AS a, avg(sqrt(2e0) * x0 * x1) AS b, avg(x0 * x0 + x1 * x1) AS c, avg(2 * x1 * x1) AS d, avg(sqrt(2e0) * (x0 * x0 - 1)) AS g0, avg(sqrt(2e0) * (x1 * x1 - 1)) AS g1, avg(2 * x0 * x1) AS g2 FROM p GROUP BY part),
t AS (SELECT part, {_solve_three(0, 'g')} - g0 / (a + {4 * _STRENGTH}) AS t0, {_solve_three(1, 'g')} - g1 / (d + {4 * _STRENGTH}) AS t1, {_solve_three(2, 'g')} AS t2 FROM s WHERE part < 2)
SELECT round(f.t0 * (a * e.t0 + b * e.t2) + f.t1 * (d * e.t1 + b * e.t2) + f.t2 * (b * e.t0 + b * e.t1 + c * e.t2), 9) + 0.0 AS crossed,
round(sqrt(greatest(f.t0 * (a * f.t0 + b * f.t2) + f.t1 * (d * f.t1 + b * f.t2) + f.t2 * (b * f.t0 + b * f.t1 + c * f.t2), 0.0)), 9) + 0.0 AS naive
FROM s, t f, t e WHERE s.part = 2 AND f.part = 0 AND e.part = 1""")
def truncation_gap(spark, sf_dir):
    """What pairs of columns add to the columns apart, by fits on two quarters of the rows."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_PAIR.split(", "))
    got = diagnostics.truncation_gap(rows, ["x0", "x1"], "o_orderkey", (2, 1), (2, 2), _STRENGTH)
    return rounded(spark.createDataFrame([(got["crossed"], got["naive"])], "crossed double, naive double"), "crossed", "naive", digits=9)


@query()
def greedy_enrichment(spark, sf_dir):
    """Terms that a dictionary over the line items takes up one by one, by held-out risk."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS key", *_SCALE.split(", "))
    pool = dictionary(4, 5, 3)
    _, folds = selection.fold_statistics(rows, _NAMES, "key", pool)
    got = selection.enrich(folds[0], folds[1], pool, dictionary(4, 2, 1), 1e-3)
    steps = [(k, "+".join(f"{j}:{g}" for j, g in zip(*s["term"], strict=True)), s["gain"], s["risk"]) for k, s in enumerate(got.steps)]
    return rounded(spark.createDataFrame(steps, "step int, term string, gain double, risk double"), "gain", "risk", digits=9)


@query()
def one_call_fit(spark, sf_dir):
    """Selection, fit and evaluation of the whole estimator in one call: mean log density by order status."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice AS x0", "CAST(o_custkey AS DOUBLE) AS x1", "CAST(datediff(o_orderdate, DATE'1992-01-01') AS DOUBLE) AS x2", "o_orderstatus")
    model, _ = selection.fit_selected(rows, ["x0", "x1", "x2"], "o_orderkey", 2, [(2, 2, False), (3, 2, False), (4, 2, True)], [(3, 2), (4, 2)])
    means = model.evaluate(rows).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg("log_density").alias("mean"))
    return rounded(means, "mean", digits=4)


# --- given densities over a table, and draws from a fitted one ---------------------------------------------------------


def _moments_sql(z: list[str], t: list[str]) -> str:
    pairs = [(i, j) for i in range(2) for j in range(i, 2)]
    made = f"SELECT {', '.join(f'{e} AS z{j}' for j, e in enumerate(z))}, {', '.join(f'{e} AS t{j}' for j, e in enumerate(t))} FROM (SELECT {_PAIR} FROM orders) o"
    return f"WITH s AS ({made}) " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round(avg(z{i} * z{j}), 6) + 0.0 AS m, round(avg(t{i} * t{j}), 6) + 0.0 AS h, round(avg((t{i} + z{i}) * (t{j} + z{j})), 6) + 0.0 AS c FROM s" for i, j in pairs)


@query(_moments_sql(["x0", "x1"], ["-(x0 - 0.3e0 * x1) / 0.91e0", "-(x1 - 0.3e0 * x0) / 0.91e0"]))
def normal_density_moments(spark, sf_dir):
    """Moments of a correlated normal density's score over the orders."""
    rows = table(spark, sf_dir, "orders").selectExpr(*_PAIR.split(", "))
    found = density_moments(rows, ["x0", "x1"], lambda x: (x[0] ** 2 - 0.6 * x[0] * x[1] + x[1] ** 2) * (-0.5 / 0.91), lambda x: x[0] * 1.0)
    return rounded(found, "m", "h", "c")


def _bent_slope(j: int) -> str:
    slope = ("-x0 - 0.2e0 * x0 * x1 * x1 - 0.2e0 * x0 * x0 * x0", "-x1 - 0.2e0 * x0 * x0 * x1")[j]
    return f"(({slope}) - 0.6e0 * x{j} / (1 + 0.3e0 * x{j} * x{j})) / (1 + 0.3e0 * x{j} * x{j})"


@query(_moments_sql([f"x{j} + 0.1e0 * x{j} * x{j} * x{j}" for j in range(2)], [_bent_slope(0), _bent_slope(1)]))
def quartic_density_moments(spark, sf_dir):
    """The same for a quartic density whose columns become scores by a cubic; in SQL with derivatives by hand."""
    rows = table(spark, sf_dir, "orders").selectExpr(*_PAIR.split(", "))
    quartic = lambda x: -0.5 * (x[0] ** 2 + x[1] ** 2) - 0.1 * x[0] ** 2 * x[1] ** 2 - 0.05 * x[0] ** 4
    return rounded(density_moments(rows, ["x0", "x1"], quartic, lambda x: x[0] + 0.1 * x[0] ** 3), "m", "h", "c")


@query()
def model_draws(spark, sf_dir):
    """A draw for each order from the estimator that is fitted on the orders."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_PAIR.split(", "))
    model = models.ReducedDensity(["x0", "x1"], r=2, inner_degree=4).fit(rows, "o_orderkey")
    return rounded(draws.draw(model, rows, "o_orderkey"), "x0", "x1")


# --- streams -----------------------------------------------------------------------------------------------------------


@query("""SELECT user_id, event_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0e0 ELSE 0.0e0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9) + 0.0 AS rate FROM events""")
def streamed_rolling_share(spark, sf_dir):
    """The share of purchases over each user's last twenty events, by a file stream with a state a user."""
    folder = f"{shared_dir(spark)}/chains-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events*.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source).withColumn("bought", F.col("event_type") == "purchase")
    rates = chains.rolling_share(stream, "user_id", "event_id", "bought", 20)
    rates.writeStream.format("parquet").option("checkpointLocation", f"{folder}/marks").option("path", f"{folder}/rates").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema("user_id bigint, event_id bigint, rate double").parquet(f"{folder}/rates"), "rate", digits=9)
