"""Queries of the library's operators over the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import normal as P
from skerry.functions.hermite import dictionary, gradient_sql, hermite_sql, term_sql, total_degrees
from skerry.functions.sobol import sobol_sql
from skerry.functions.sqltext import num
from skerry.operators import marginals, ranks, scorematch, solvers, subspace, weights
from skerry.plans import diagnostics, models, montecarlo, selection
from skerry.plans.registry import ORACLES, QUERIES, query, rounded, table
from skerry.sources import laws

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _avg_rank(column: str, source: str) -> str:
    return f"(rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0)"


# --- ranks ---------------------------------------------------------------------------------------------------------


@query(f"""
WITH r AS (SELECT event_id, {_avg_rank('value', 'events')} / (count(*) OVER () + 1) AS p FROM events)
SELECT event_id, round({P.ndtri_sql('p')}, 6) + 0.0 AS z FROM r""")
def rank_gaussianize(spark, sf_dir):
    out = ranks.rank_gaussianize(table(spark, sf_dir, "events").select("event_id", "value"), ["value"])
    return rounded(out.select("event_id", F.col("value_z").alias("z")), "z")


_Z = ", ".join(f"{P.ndtri_sql(f'p{k}')} AS z{k}" for k in range(4))
_P = ", ".join(f"{_avg_rank(c, 'lineitem')} / (count(*) OVER () + 1) AS p{k}" for k, c in enumerate(COLUMNS))
_PAIRS = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(corr(z{i}, z{j}), 6) + 0.0 AS rho FROM z" for i in range(4) for j in range(i + 1, 4))


@query(f"WITH p AS (SELECT {_P} FROM lineitem), z AS (SELECT {_Z} FROM p) {_PAIRS}")
def copula_corr(spark, sf_dir):
    """Correlations of the rank-Gaussianised columns."""
    out = ranks.rank_gaussianize(table(spark, sf_dir, "lineitem").select(*COLUMNS), COLUMNS)
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.corr(f"{COLUMNS[i]}_z", f"{COLUMNS[j]}_z").alias("rho")) for i, j in pairs))
    return rounded(out.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*"), "rho")


@query("""SELECT o_totalprice AS value, count(*) AS n, round(sum(count(*)) OVER (ORDER BY o_totalprice) / (SELECT count(*) + 1.0 FROM orders), 9) AS ecdf
FROM orders GROUP BY o_totalprice""")
def ecdf_grid(spark, sf_dir):
    return rounded(ranks.ecdf_grid(table(spark, sf_dir, "orders"), "o_totalprice"), "ecdf", digits=9)


@query("""WITH k AS (SELECT p_partkey, p_retailprice AS x, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS k FROM part)
SELECT p_partkey, x, round((k * 1e-10 * ((SELECT max(abs(p_retailprice)) FROM part) + 1)) * CASE WHEN (SELECT count(*) > count(DISTINCT p_retailprice) FROM part) THEN 1 ELSE 0 END, 5) + 0.0 AS moved FROM k""")
def tie_jitter(spark, sf_dir):
    out = ranks.tie_jitter(table(spark, sf_dir, "part"), "p_retailprice", ["p_partkey"])
    return rounded(out.select("p_partkey", "x", (F.col("jittered") - F.col("x")).alias("moved")), "moved", digits=5)


_ASOF = """WITH pool AS (SELECT o_totalprice AS x FROM orders WHERE o_orderstatus = 'F'), q AS (SELECT o_orderkey AS id, o_totalprice AS x FROM orders WHERE o_orderstatus <> 'F'),
u AS (SELECT x, 1 AS w, NULL AS id FROM pool UNION ALL SELECT x, 0, id FROM q),
c AS (SELECT id, x, sum(w) OVER (ORDER BY x RANGE UNBOUNDED PRECEDING) AS below FROM u) """


@query(_ASOF + "SELECT id, x, round((below + 0.5) / ((SELECT count(*) FROM pool) + 1), 9) AS cdf FROM c WHERE id IS NOT NULL")
def asof_cdf(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rounded(ranks.asof_cdf(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), "o_totalprice", "o_orderkey"), "cdf", digits=9)


@query(_ASOF + "SELECT id, x, round(greatest(1, least((SELECT count(*) FROM pool), below)) / ((SELECT count(*) FROM pool) + 1.0), 9) AS cdf FROM c WHERE id IS NOT NULL")
def asof_cdf_clipped(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rounded(ranks.asof_cdf(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), "o_totalprice", "o_orderkey", "clip"), "cdf", digits=9)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, round(avg(value) FILTER (WHERE k > floor(n * 0.05) AND k <= n - floor(n * 0.05)), 6) AS trimmed FROM r GROUP BY event_type, n""")
def trimmed_mean(spark, sf_dir):
    return rounded(ranks.trimmed_mean(table(spark, sf_dir, "events"), "event_type", "value"), "trimmed")


@query("""WITH k AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, (SELECT count(*) // 24 FROM orders) AS size FROM orders)
SELECT CAST(least(23, k // size) AS INTEGER) AS block, count(*) AS n, round(avg(x), 4) AS mean FROM k GROUP BY 1""")
def contiguous_blocks(spark, sf_dir):
    out = ranks.contiguous_blocks(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 24)
    return rounded(out.groupBy("block").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), "mean", digits=4)


@query("""WITH s AS (SELECT event_type, value, value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS s FROM events)
SELECT event_type, count(*) AS n, CAST(coalesce(sum(CASE WHEN s < 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS drops, round(max(value) - min(value), 6) AS spread FROM s GROUP BY event_type""")
def order_check(spark, sf_dir):
    return rounded(ranks.not_sorted(table(spark, sf_dir, "events"), "event_type", "event_id", "value"), "spread")


_HALVES = "WITH k AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-0'), o_orderkey) AS k FROM orders)"


@query(_HALVES + " SELECT CAST(CASE WHEN k > (SELECT count(*) // 2 FROM orders) THEN 1 ELSE 0 END AS INTEGER) AS fold, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM k GROUP BY 1")
def halves_split(spark, sf_dir):
    out = ranks.hash_halves(table(spark, sf_dir, "orders"), "o_orderkey")
    return rounded(out.groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


_DENSITY = "SELECT event_type, CAST(floor(value) AS BIGINT) AS x, count(*) AS c FROM events GROUP BY 1, 2"


@query(f"""WITH d AS ({_DENSITY}), a AS (SELECT *, coalesce((x - lag(x) OVER w) * (c + lag(c) OVER w) / 2.0, 0) AS a FROM d WINDOW w AS (PARTITION BY event_type ORDER BY x))
SELECT event_type, x, round(sum(a) OVER (PARTITION BY event_type ORDER BY x ROWS UNBOUNDED PRECEDING) / sum(a) OVER (PARTITION BY event_type), 9) AS cdf FROM a""")
def cum_trapezoid_cdf(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.floor("value").alias("x")).agg(F.count("*").alias("c"))
    return rounded(ranks.cumulative_trapezoid(d, "event_type", "x", "c").select("event_type", "x", "cdf"), "cdf", digits=9)


@query(f"WITH d AS ({_DENSITY}) SELECT event_type, x, round(sum(c) OVER (PARTITION BY event_type ORDER BY x ROWS UNBOUNDED PRECEDING) / CAST(sum(c) OVER (PARTITION BY event_type) AS DOUBLE), 9) AS cdf FROM d")
def cum_sum_cdf(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.floor("value").alias("x")).agg(F.count("*").alias("c"))
    return rounded(ranks.cumulative_sum_cdf(d, "event_type", "x", "c").select("event_type", "x", "cdf"), "cdf", digits=9)


# --- marginals -----------------------------------------------------------------------------------------------------

_LONG = " UNION ALL ".join(f"SELECT '{c}' AS coord, {c} AS x FROM lineitem" for c in COLUMNS)


@query(f"""WITH s AS (SELECT coord, count(*) AS n, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM ({_LONG}) GROUP BY coord)
SELECT coord, n, round(sd, 6) AS sd, round(iqr, 6) AS iqr, round(0.9 * (CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34) ELSE sd END) * power(n, -0.2) / sd, 9) AS h FROM s""")
def robust_bandwidth(spark, sf_dir):
    return rounded(rounded(marginals.robust_bandwidth(table(spark, sf_dir, "lineitem"), COLUMNS), "sd", "iqr"), "h", digits=9)


@query(f"""WITH g AS (SELECT CAST(range AS BIGINT) * 2.5 AS g FROM range(0, 200)), v AS (SELECT value AS x, count(*) AS c FROM events GROUP BY value)
SELECT CAST(g AS DOUBLE) AS g, round(sum(c * exp(-0.5 * power((g - x) / 4.0, 2))) / (sum(c) * 4.0 * {math.sqrt(2 * math.pi)!r}), 9) AS density FROM g, v GROUP BY g""")
def kde_grid(spark, sf_dir):
    grid = spark.range(200).select((F.col("id") * 2.5).alias("g"))
    return rounded(marginals.kde_grid(table(spark, sf_dir, "events"), "value", grid, 4.0), "density", digits=9)


@query("""WITH e AS (SELECT l_discount AS x, sum(count(*)) OVER (ORDER BY l_discount) / (SELECT count(*) + 1.0 FROM lineitem) AS y FROM lineitem GROUP BY l_discount),
s AS (SELECT x, y, x - lag(x) OVER w AS h0, lead(x) OVER w - x AS h1, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS d0, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d1 FROM e WINDOW w AS (ORDER BY x)),
t AS (SELECT *, lead(h1) OVER w AS h2, lead(d1) OVER w AS d2, lag(h0) OVER w AS hm, lag(d0) OVER w AS dm FROM s WINDOW w AS (ORDER BY x)),
e2 AS (SELECT *, ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2) AS lo, ((2 * h0 + hm) * d0 - h0 * dm) / (h0 + hm) AS hi FROM t)
SELECT x, round(y, 9) AS y, round(CASE
 WHEN d0 IS NULL THEN CASE WHEN lo * d1 <= 0 THEN 0 WHEN d1 * d2 <= 0 AND abs(lo) > 3 * abs(d1) THEN 3 * d1 ELSE lo END
 WHEN d1 IS NULL THEN CASE WHEN hi * d0 <= 0 THEN 0 WHEN d0 * dm <= 0 AND abs(hi) > 3 * abs(d0) THEN 3 * d0 ELSE hi END
 WHEN d0 * d1 > 0 THEN (3 * h1 + 3 * h0) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) ELSE 0 END, 6) AS slope FROM e2""")
def pchip_slopes(spark, sf_dir):
    e = ranks.ecdf_grid(table(spark, sf_dir, "lineitem"), "l_discount").select(F.lit(0).alias("one"), F.col("value").alias("x"), F.col("ecdf").alias("y"))
    return rounded(rounded(marginals.pchip_slopes(e, "one", "x", "y").select("x", "y", "slope"), "y", digits=9), "slope")


@query("""WITH t AS (SELECT range AS k, sqrt(range) AS y FROM range(0, 101)), p AS (SELECT c_custkey, greatest(0.0, least(100.0, (c_acctbal + 1000) / 110.0)) AS p FROM customer),
k AS (SELECT *, least(99, CAST(floor(p) AS BIGINT)) AS k FROM p)
SELECT c_custkey, round(a.y + (p - k.k) * (b.y - a.y), 6) AS y FROM k JOIN t a ON a.k = k.k JOIN t b ON b.k = k.k + 1""")
def interpolation_join(spark, sf_dir):
    grid = spark.range(101).select(F.col("id").cast("int").alias("k"), F.sqrt("id").alias("y"))
    out = marginals.interpolate_uniform(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", grid, -1000.0, 110.0, 101, "y")
    return rounded(out.select("c_custkey", "y"), "y")


# --- scalar functions ----------------------------------------------------------------------------------------------

_X = "(c_acctbal / 1.1e3)"


def _scalar(name: str, text: str) -> None:
    sql = f"SELECT c_custkey, round({text}, 6) + 0.0 AS y FROM customer"

    def run(spark, sf_dir):
        return rounded(table(spark, sf_dir, "customer").select("c_custkey", F.expr(text).alias("y")), "y")

    QUERIES[name], ORACLES[name] = run, sql


_scalar("logit_phi_bulk", P.logit_phi_sql(_X))
_scalar("inv_logit_phi", P.inv_logit_phi_sql("(c_acctbal / 1.0e1)"))
_scalar("log_jacobian", P.log_jacobian_sql(_X))
_scalar("normal_cdf", P.ndtr_sql(_X))
_scalar("log_logistic_pdf", P.log_logistic_pdf_sql(_X))
_scalar("log_prior", f"({P.log_phi_sql(_X)}) + ({P.log_phi_sql('(c_custkey / 1.0e4)')})")
_scalar("hermite_norm", " + ".join(hermite_sql("(c_acctbal / 5.0e3)", k) for k in range(1, 7)))


# --- dictionary and score matching ---------------------------------------------------------------------------------

_SCALED = ["x0", "x1"]
_SCALE = "(l_quantity - 2.55e1) / 1.44e1 AS x0, (l_discount - 5.0e-2) / 3.2e-2 AS x1"
_INDEX = dictionary(2, 3, 2)
_SIZES = [(d, k, q) for d in (2, 4, 10, 20) for k in (2, 3, 4) for q in (1, 2, 3)]


def _scaled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_SCALE.split(", "))


def _choose(n: str, m: int) -> str:
    return "(" + " * ".join([f"({n} - {j})" for j in range(m)]) + f" // {math.factorial(m)})"


@query("SELECT d, k, q, CAST(" + " + ".join(f"CASE WHEN q >= {m} THEN {_choose('d', m)} * {_choose('k', m)} ELSE 0 END" for m in (1, 2, 3)) + " - d AS BIGINT) AS terms FROM (VALUES " + ", ".join(map(str, _SIZES)) + ") t(d, k, q)")
def dictionary_sizes(spark, sf_dir):
    return spark.createDataFrame([(*s, len(dictionary(*s))) for s in _SIZES], "d int, k int, q int, terms bigint")


@query(f"WITH s AS (SELECT c_custkey, c_acctbal / 4.7123e3 AS x0, c_nationkey / 1.1731e1 - 1 AS x1 FROM customer) SELECT c_custkey, {', '.join(f'round({term_sql(i, _SCALED)}, 6) + 0.0 AS psi{k}' for k, i in enumerate(_INDEX))} FROM s")
def hermite_features(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal / 4.7123e3 AS x0", "c_nationkey / 1.1731e1 - 1 AS x1")
    names = [f"psi{k}" for k in range(len(_INDEX))]
    return rounded(scorematch.features(rows, _SCALED, _INDEX).select("c_custkey", *names), *names)


def _gram_cell(p, q) -> str:
    return " + ".join(f"{gradient_sql(p, _SCALED, k)} * {gradient_sql(q, _SCALED, k)}" for k in range(2) if k in p[0] and k in q[0]) or num(0.0)


_FROM = f"(SELECT {_SCALE} FROM lineitem) s"


@query(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(avg({_gram_cell(p, q)}), 6) + 0.0 AS a FROM {_FROM}" for i, p in enumerate(_INDEX) for j, q in enumerate(_INDEX) if i <= j))
def hsm_gram(spark, sf_dir):
    """The gram by the production kernel on Arrow batches; the SQL form of the operator is held against it in the tests."""
    a = scorematch.statistics(_scaled(spark, sf_dir), _SCALED, _INDEX)[0].A
    rows = [(i, j, float(a[i, j])) for i in range(len(a)) for j in range(i, len(a))]
    return rounded(spark.createDataFrame(rows, "i int, j int, a double"), "a")


def _rhs(index) -> str:
    return " + ".join([f"{_SCALED[i]} * {gradient_sql(index, _SCALED, i)}" for i in index[0]] + [f"-({s})" for i in index[0] if (s := gradient_sql(index, _SCALED, i, 2))])


@query(" UNION ALL ".join(f"SELECT {k} AS k, round(avg({_rhs(x)}), 6) + 0.0 AS b FROM {_FROM}" for k, x in enumerate(_INDEX)))
def hsm_rhs(spark, sf_dir):
    return rounded(scorematch.rhs_sql(_scaled(spark, sf_dir), _SCALED, _INDEX), "b")


@query(" UNION ALL ".join(f"SELECT {i} AS axis, {k} AS k, round(avg({gradient_sql(x, _SCALED, i) or num(0.0)}), 6) + 0.0 AS c FROM {_FROM}" for k, x in enumerate(_INDEX) for i in range(2)))
def centering_matrix(spark, sf_dir):
    return rounded(scorematch.centering_sql(_scaled(spark, sf_dir), _SCALED, _INDEX), "c")


@query(f"WITH d AS ({' UNION ALL '.join(f'SELECT {sum(x[1])} AS degree, avg({_gram_cell(x, x)}) AS a FROM {_FROM}' for x in _INDEX)}) SELECT degree, round(sum(a), 6) AS trace FROM d GROUP BY degree")
def degree_traces(spark, sf_dir):
    g = scorematch.gram_sql(_scaled(spark, sf_dir), _SCALED, _INDEX).where("i = j")
    degrees = spark.createDataFrame([(k, int(t)) for k, t in enumerate(total_degrees(_INDEX))], "i int, degree int")
    return rounded(g.join(F.broadcast(degrees), "i").groupBy("degree").agg(F.sum("a").alias("trace")), "trace")  # a row a term


_BLOCKS = f"(SELECT {_SCALE}, least(23, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1) // (SELECT count(*) // 24 FROM lineitem)) AS block FROM lineitem) s"


@query(f"WITH t AS (SELECT block, avg({' + '.join(_gram_cell(x, x) for x in _INDEX)}) AS t FROM {_BLOCKS} GROUP BY block) SELECT count(*) AS blocks, round(quantile_cont(t, 0.5), 6) AS median_trace FROM t")
def median_of_blocks_trace(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    blocks = ranks.contiguous_blocks(table(spark, sf_dir, "lineitem").select(*order), order, 24).selectExpr(*_SCALE.split(", "), "block")
    t = blocks.groupBy("block").agg(F.expr(f"avg({' + '.join(_gram_cell(x, x) for x in _INDEX)})").alias("t"))
    return rounded(t.agg(F.count("*").alias("blocks"), F.percentile("t", F.lit(0.5)).alias("median_trace")), "median_trace")


@query(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(avg({a} * {b}), 4) AS m FROM lineitem" for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS) if i <= j))
def second_moment(spark, sf_dir):
    return rounded(scorematch.second_moments(table(spark, sf_dir, "lineitem"), COLUMNS), "m", digits=4)


_V = np.linalg.qr(np.arange(32.0).reshape(16, 2) ** 1.5 % 7 - 3)[0]
_E = lambda k: f"CAST(embedding[{k + 1}] AS DOUBLE)"


@query("SELECT vec_id, " + ", ".join("round(" + " + ".join(f"{_E(i)} * {num(_V[i, j])}" for i in range(16)) + f", 6) + 0.0 AS u{j}" for j in range(2)) + " FROM embeddings")
def projection(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(16)))
    return rounded(models.project(rows, [f"x{k}" for k in range(16)], _V, ["u0", "u1"]).select("vec_id", "u0", "u1"), "u0", "u1")


_THETA = [0.3, -0.2, 0.15, 0.05, -0.1, 0.07, 0.02]


@query(f"WITH s AS (SELECT c_custkey, c_acctbal / 4.7123e3 AS x0, c_nationkey / 1.1731e1 - 1 AS x1 FROM customer) SELECT c_custkey, round({' + '.join(f'{num(t)} * {term_sql(i, _SCALED)}' for t, i in zip(_THETA, _INDEX, strict=True))}, 6) + 0.0 AS y FROM s")
def poly_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal / 4.7123e3 AS x0", "c_nationkey / 1.1731e1 - 1 AS x1")
    return rounded(rows.select("c_custkey", scorematch.polynomial(np.array(_THETA), _SCALED, _INDEX).alias("y")), "y")


# --- weights and cells ---------------------------------------------------------------------------------------------

_CELLS = "(SELECT event_type AS example, user_id AS seed, CASE WHEN value > 4.0e2 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value, value <= 4.0e2 AS valid FROM events) c"


def _cells(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_type AS example", "user_id AS seed", "CASE WHEN value > 4.0e2 THEN double('NaN') ELSE value END AS value", "value <= 4.0e2 AS valid")


@query("""WITH t AS (SELECT event_type, max(value) AS top FROM events GROUP BY event_type)
SELECT e.event_type, count(*) AS n, round(top + ln(avg(exp(value - top))), 6) AS log_mean_exp FROM events e JOIN t USING (event_type) GROUP BY e.event_type, top""")
def log_mean_exp(spark, sf_dir):
    return rounded(weights.log_mean_exp(table(spark, sf_dir, "events"), "value", ["event_type"]), "log_mean_exp")


@query("""SELECT event_type, count(*) AS n, round(power(sum(value), 2) / sum(value * value), 6) AS ess,
round(sqrt(greatest(0, count(*) * sum(value * value) / power(sum(value), 2) - 1) / count(*)), 9) AS rel_se FROM events GROUP BY event_type""")
def ess(spark, sf_dir):
    return rounded(rounded(weights.effective_size(table(spark, sf_dir, "events"), "value", ["event_type"]), "ess"), "rel_se", digits=9)


@query("""WITH m AS (SELECT l_returnflag AS flag, sum(l_quantity) AS s, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mean FROM lineitem GROUP BY 1)
SELECT flag, round(mean, 4) AS mean, round(sum(power(l_quantity / s, 2) * power(l_extendedprice - mean, 2)), 2) AS variance FROM lineitem JOIN m ON l_returnflag = flag GROUP BY flag, mean""")
def snis_moments(spark, sf_dir):
    out = weights.weighted_moments(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), "l_quantity", "l_extendedprice", ["flag"])
    return rounded(rounded(out, "mean", digits=4), "variance", digits=2)


@query(f"""SELECT example, count(v) AS n, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dropped, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd_pop,
round(stddev_samp(v) / sqrt(count(v)), 6) AS se, round(quantile_cont(v, 0.5), 6) AS median, min(v) AS least, max(v) AS most
FROM (SELECT example, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM {_CELLS}) GROUP BY example""")
def group_summary(spark, sf_dir):
    return rounded(weights.cell_summary(_cells(spark, sf_dir), ["example"], "value"), "mean", "sd_pop", "se", "median")


@query(f"SELECT example, seed, count(*) AS n, CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM {_CELLS} GROUP BY 1, 2 HAVING n_valid > 1 AND n_valid / n >= 0.98")
def validity_gate(spark, sf_dir):
    return weights.valid_cells(_cells(spark, sf_dir), ["example", "seed"], "valid")


@query("""WITH grid AS (SELECT DISTINCT event_type AS example, user_id AS seed FROM (SELECT DISTINCT event_type FROM events), (SELECT DISTINCT user_id FROM events)),
done AS (SELECT DISTINCT event_type AS example, user_id AS seed FROM events WHERE value > 1.0e2)
SELECT example, seed FROM grid ANTI JOIN done USING (example, seed)""")
def resume_anti_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    grid = e.select(F.col("event_type").alias("example")).distinct().crossJoin(e.select(F.col("user_id").alias("seed")).distinct())  # a small parameter grid
    done = e.where("value > 1.0e2").select(F.col("event_type").alias("example"), F.col("user_id").alias("seed")).distinct()
    return weights.unfinished(grid, done, ["example", "seed"])


@query("""WITH a AS (SELECT user_id AS seed, round(avg(value), 6) AS kl FROM events GROUP BY 1), b AS (SELECT user_id AS seed, round(max(value), 6) AS bound FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT seed, kl, bound, round(bound - kl, 6) AS slack FROM a LEFT JOIN b USING (seed)""")
def lookup_left_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.groupBy(F.col("user_id").alias("seed")).agg(F.round(F.avg("value"), 6).alias("kl"))
    b = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("seed")).agg(F.round(F.max("value"), 6).alias("bound"))
    return rounded(a.join(b, "seed", "left").withColumn("slack", F.col("bound") - F.col("kl")), "slack")


@query("""WITH c AS (SELECT user_id AS seed, event_type AS method, avg(value) AS v FROM events GROUP BY 1, 2), b AS (SELECT seed, v AS base FROM c WHERE method = 'click')
SELECT seed, method, round(v - base, 6) + 0.0 AS difference FROM c JOIN b USING (seed) WHERE method <> 'click'""")
def paired_differences(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seed"), F.col("event_type").alias("method")).agg(F.avg("value").alias("v"))
    return rounded(weights.paired_differences(c, ["seed"], "method", "v", "click"), "difference")


_RISKS = "(SELECT p_brand AS candidate, p_size AS split, CAST(length(p_brand) AS BIGINT) AS size, p_retailprice AS risk FROM part) r"


@query(f"""WITH s AS (SELECT candidate, size, avg(risk) AS mean, stddev_pop(risk) / sqrt(count(*)) AS se FROM {_RISKS} GROUP BY 1, 2),
b AS (SELECT mean + se AS lim FROM s ORDER BY mean, candidate LIMIT 1)
SELECT candidate, size, round(mean, 6) AS mean, round(se, 6) AS se FROM s, b WHERE mean <= lim ORDER BY size, candidate LIMIT 1""")
def one_se_select(spark, sf_dir):
    risks = table(spark, sf_dir, "part").selectExpr("p_brand AS candidate", "CAST(length(p_brand) AS BIGINT) AS size", "p_retailprice AS risk", "p_brand AS place")
    return rounded(weights.one_standard_error(risks, "candidate", "risk", "size", "place").drop("place"), "mean", "se")


_CELL = (12 / 79) ** 2
_GRID = f"SELECT i.range AS i, j.range AS j, {num(-6.0)} + i.range * {num(12 / 79)} AS x, {num(-6.0)} + j.range * {num(12 / 79)} AS y FROM range(0, 80) i, range(0, 80) j"
_LOGW = "-0.5 * (x * x + y * y) - 2.0 * power(y - 0.5 * x * x + 1.0, 2)"


@query(f"WITH g AS ({_GRID}), e AS (SELECT *, exp({_LOGW}) AS e FROM g) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(e / (sum(e) OVER () * {num(_CELL)}), 9) AS p FROM e")
def posterior_grid(spark, sf_dir):
    g = models.posterior_grid(spark, lambda x: x[:, 1] - 0.5 * x[:, 0] ** 2 + 1, lambda t: -2 * t**2)
    return rounded(weights.normalised_grid(g.withColumn("one", F.lit(0)), ["one"], "log_posterior", _CELL).select("i", "j", "p"), "p", digits=9)


@query(f"""WITH g AS ({_GRID}), e AS (SELECT exp({_LOGW}) AS a, exp(-0.5 * (x * x + y * y)) AS b FROM g), p AS (SELECT a / (sum(a) OVER () * {num(_CELL)}) AS p, b / (sum(b) OVER () * {num(_CELL)}) AS q FROM e)
SELECT round(sum(CASE WHEN p > 1e-15 THEN p * ln(p / greatest(q, 1e-300)) ELSE 0 END) * {num(_CELL)}, 6) AS kl FROM p""")
def grid_kl(spark, sf_dir):
    g = models.posterior_grid(spark, lambda x: x[:, 1] - 0.5 * x[:, 0] ** 2 + 1, lambda t: -2 * t**2).withColumn("one", F.lit(0)).withColumn("q_", F.expr("-0.5 * (x * x + y * y)"))
    p = weights.normalised_grid(g, ["one"], "log_posterior", _CELL)
    q = weights.normalised_grid(p.withColumnRenamed("p", "p1"), ["one"], "q_", _CELL)
    return rounded(weights.grid_kl(q, "p1", "p", _CELL, ["one"]).select("kl"), "kl")


# --- models, laws and Monte Carlo: no SQL --------------------------------------------------------------------------


def _orders(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rows.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey").select("o_orderkey", F.col("o_totalprice").alias("x0"), F.col("c_acctbal").alias("x1"), F.col("o_custkey").cast("double").alias("x2"))


_XS = ["x0", "x1", "x2"]


_ORDERS = "SELECT o_orderkey, o_totalprice AS x0, c_acctbal AS x1, CAST(o_custkey AS DOUBLE) AS x2 FROM orders JOIN customer ON o_custkey = c_custkey"
#: Kernel marginals in SQL: rows shared between two grid points each, kernels around these, a monotone cubic through the logs.
_MARGINALS = f"""l AS ({' UNION ALL '.join(f"SELECT o_orderkey, '{c}' AS coord, {c} AS x FROM o" for c in _XS)}),
s AS (SELECT coord, count(*) AS n, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, min(x) AS lo, max(x) AS hi FROM l GROUP BY coord),
w AS (SELECT *, 0.9 * (CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34) ELSE sd END) * power(n, -0.2) AS width FROM s),
g AS (SELECT *, lo - 4.0 * width AS g0, (hi - lo + 8.0 * width) / 1999.0 AS step, CAST(floor(8.0 * width / ((hi - lo + 8.0 * width) / 1999.0)) AS BIGINT) + 1 AS reach FROM w),
c AS (SELECT coord, CAST(floor((x - g0) / step) AS BIGINT) AS k, (x - g0) / step - floor((x - g0) / step) AS f FROM l JOIN g USING (coord)),
m AS (SELECT coord, k, sum(f) AS m FROM (SELECT coord, k, 1.0 - f AS f FROM c UNION ALL SELECT coord, k + 1, f FROM c) GROUP BY 1, 2),
d AS (SELECT coord, i.range AS i, step, ln(greatest(sum(m * exp(-0.5 * power((i.range - k) * step / width, 2))) / (width * {num(math.sqrt(2 * math.pi))} * n), 1.0e-300)) AS y FROM range(0, 2000) i, m JOIN g USING (coord) WHERE abs(i.range - k) <= reach GROUP BY coord, i.range, step, width, n),
e AS (SELECT *, y - lag(y) OVER v AS d0, lead(y) OVER v - y AS d1 FROM d WINDOW v AS (PARTITION BY coord ORDER BY i)),
p AS (SELECT coord, i, y, CASE WHEN d0 * d1 > 0 THEN 2.0 / (1.0 / d0 + 1.0 / d1) ELSE 0.0 END AS slope FROM e),
q AS (SELECT o_orderkey, coord, CAST(floor((x - g0) / step) AS BIGINT) AS i, (x - g0) / step - floor((x - g0) / step) AS t FROM l JOIN g USING (coord)),
f AS (SELECT o_orderkey, coord, a.y * (1 + 2 * t) * power(1 - t, 2) + a.slope * t * power(1 - t, 2) + b.y * t * t * (3 - 2 * t) + b.slope * t * t * (t - 1) AS log_pdf FROM q JOIN p a USING (coord, i) JOIN p b ON b.coord = q.coord AND b.i = q.i + 1)"""


@query(f"WITH o AS ({_ORDERS}), {_MARGINALS} SELECT o_orderkey, round(sum(log_pdf), 4) AS log_density FROM f GROUP BY o_orderkey")
def pom_log_density(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return rounded(models.ProductOfMarginals(_XS).fit(rows).evaluate(rows).select("o_orderkey", "log_density"), "log_density", digits=4)


def _cubic(t: str, h: str = "1.0") -> str:
    """The monotone cubic between knots a and b at share t of their distance h."""
    return f"a.y * (1 + 2 * {t}) * power(1 - {t}, 2) + {h} * a.slope * {t} * power(1 - {t}, 2) + b.y * {t} * {t} * (3 - 2 * {t}) + {h} * b.slope * {t} * {t} * ({t} - 1)"


def _scores(points: str, name: str) -> str:
    """Normal scores of points (key, coord, x) under the marginals, a row a key."""
    place = "SELECT key, coord, n, CAST(floor((x - g0) / step) AS BIGINT) AS i, (x - g0) / step - floor((x - g0) / step) AS t FROM " + points + " JOIN g USING (coord)"
    share = f"SELECT key, q.coord, greatest(0.5 / (n + 1), least(1 - 0.5 / (n + 1), {_cubic('t')})) AS p FROM ({place}) q JOIN hp a ON a.coord = q.coord AND a.i = q.i JOIN hp b ON b.coord = q.coord AND b.i = q.i + 1"
    wide = ", ".join(f"max(CASE WHEN coord = '{c}' THEN {P.ndtri_sql('p')} END) AS z{j}" for j, c in enumerate(_XS))
    return f"{name} AS (SELECT key, {wide} FROM ({share}) GROUP BY key)"


_ONE = num(1.000001)  # the correlation's diagonal
_DET = f"({_ONE} * {_ONE} * {_ONE} + 2 * r01 * r02 * r12 - {_ONE} * (r01 * r01 + r02 * r02 + r12 * r12))"
_INVERSE = {"00": f"({_ONE} * {_ONE} - r12 * r12)", "11": f"({_ONE} * {_ONE} - r02 * r02)", "22": f"({_ONE} * {_ONE} - r01 * r01)", "01": f"(r02 * r12 - {_ONE} * r01)", "02": f"(r01 * r12 - {_ONE} * r02)", "12": f"(r01 * r02 - {_ONE} * r12)"}
_SQUARE = " + ".join(f"{1 if i == j else 2} * ({_INVERSE[f'{i}{j}']} / {_DET} - {int(i == j)}) * z{i} * z{j}" for i in range(3) for j in range(i, 3))
_FACTOR = f"(-0.5 * ln({_DET}) - 0.5 * ({_SQUARE}))"
_COPULA = f"""h0 AS (SELECT coord, i, exp(y) AS d, coalesce((exp(y) + lag(exp(y)) OVER v) / 2 * step, 0.0) AS part FROM d WINDOW v AS (PARTITION BY coord ORDER BY i)),
h1 AS (SELECT coord, i, sum(part) OVER (PARTITION BY coord ORDER BY i ROWS UNBOUNDED PRECEDING) / sum(part) OVER (PARTITION BY coord) AS y FROM h0),
h2 AS (SELECT *, y - lag(y) OVER v AS d0, lead(y) OVER v - y AS d1 FROM h1 WINDOW v AS (PARTITION BY coord ORDER BY i)),
hp AS (SELECT coord, i, y, CASE WHEN d0 * d1 > 0 THEN 2.0 / (1.0 / d0 + 1.0 / d1) ELSE 0.0 END AS slope FROM h2),
k0 AS (SELECT coord, y AS x, g0 + i * step AS y FROM h2 JOIN g USING (coord) WHERE d0 IS NULL OR d0 > 0),
k1 AS (SELECT *, x - lag(x) OVER v AS s0, lead(x) OVER v - x AS s1, y - lag(y) OVER v AS e0, lead(y) OVER v - y AS e1, lead(x) OVER v AS nx FROM k0 WINDOW v AS (PARTITION BY coord ORDER BY x)),
k2 AS (SELECT coord, x, y, nx, CASE WHEN s0 IS NULL OR s1 IS NULL THEN 0.0 ELSE (3 * s0 + 3 * s1) / ((2 * s1 + s0) / (e0 / s0) + (s1 + 2 * s0) / (e1 / s1)) END AS slope FROM k1),
k AS (SELECT a.coord, a.x, a.nx, a.y, a.slope, b.y AS y2, b.slope AS slope2 FROM k2 a JOIN k2 b ON a.coord = b.coord AND a.nx = b.x),
u AS (SELECT range AS key, {', '.join(f"{sobol_sql('range', 1 << 14, 3, j, 0, 'xor({}, {})')} AS u{j}" for j in range(3))} FROM range(0, {1 << 14})),
v AS ({' UNION ALL '.join(f"SELECT key, '{c}' AS coord, u{j} AS u FROM u" for j, c in enumerate(_XS))}),
t AS (SELECT key, v.coord, k.y, k.slope, k.y2, k.slope2, k.nx - k.x AS h, (u - k.x) / (k.nx - k.x) AS t FROM v ASOF JOIN k ON v.coord = k.coord AND v.u >= k.x),
nodes AS (SELECT key, coord, y * (1 + 2 * t) * power(1 - t, 2) + h * slope * t * power(1 - t, 2) + y2 * t * t * (3 - 2 * t) + h * slope2 * t * t * (t - 1) AS x FROM t),
rows_ AS (SELECT o_orderkey AS key, coord, x FROM l), {_scores('rows_', 'zr')}, {_scores('nodes', 'zn')},
r AS (SELECT corr(z0, z1) AS r01, corr(z0, z2) AS r02, corr(z1, z2) AS r12 FROM zr),
mass AS (SELECT ln(avg(exp({_FACTOR}))) AS mass FROM zn, r)"""


@query(f"WITH o AS ({_ORDERS}), {_MARGINALS}, {_COPULA}, sums AS (SELECT o_orderkey AS key, sum(log_pdf) AS s FROM f GROUP BY 1) SELECT key AS o_orderkey, round(s + {_FACTOR} - mass, 4) AS log_density FROM sums JOIN zr USING (key), r, mass")
def gaussian_copula_log_density(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return rounded(models.GaussianCopula(_XS).fit(rows).evaluate(rows).select("o_orderkey", "log_density"), "log_density", digits=4)


_DISTRIBUTION = _COPULA[: _COPULA.index("k0 AS (")]


@query(f"""WITH o AS ({_ORDERS}), {_MARGINALS}, {_DISTRIBUTION} rows_ AS (SELECT o_orderkey AS key, coord, x FROM l), {_scores('rows_', 'zr')},
cv AS (SELECT count(*) AS n, {', '.join(f'covar_samp(z{i}, z{j}) * power(count(*), -2.0 / 7.0) AS c{i}{j}' for i in range(3) for j in range(i, 3))} FROM zr),
l1 AS (SELECT *, sqrt(c00) AS l00, c01 / sqrt(c00) AS l10, c02 / sqrt(c00) AS l20 FROM cv), l2 AS (SELECT *, sqrt(c11 - l10 * l10) AS l11 FROM l1),
l3 AS (SELECT *, (c12 - l20 * l10) / l11 AS l21 FROM l2), l4 AS (SELECT *, sqrt(c22 - l20 * l20 - l21 * l21) AS l22 FROM l3),
y0 AS (SELECT key, n, z0 / l00 AS y0, z1, z2, l10, l20, l11, l21, l22, ln(l00) + ln(l11) + ln(l22) AS ld, 0.5 * (z0 * z0 + z1 * z1 + z2 * z2) AS back FROM zr, l4),
y1 AS (SELECT *, (z1 - l10 * y0) / l11 AS y1 FROM y0), y2 AS (SELECT key, n, ld, back, y0, y1, (z2 - l20 * y0 - l21 * y1) / l22 AS y2 FROM y1),
ks AS (SELECT a.key, sum(exp(-0.5 * ((a.y0 - b.y0) * (a.y0 - b.y0) + (a.y1 - b.y1) * (a.y1 - b.y1) + (a.y2 - b.y2) * (a.y2 - b.y2)))) AS k FROM y2 a, y2 b GROUP BY a.key),
sums AS (SELECT o_orderkey AS key, sum(log_pdf) AS s FROM f GROUP BY 1)
SELECT key AS o_orderkey, round(ln(greatest(k, 1.0e-300)) - ln(n) - ld + s + back, 4) AS log_density FROM y2 JOIN ks USING (key) JOIN sums USING (key)""")
def kde_log_density(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return rounded(models.KernelDensity(_XS).fit(rows).evaluate(rows).select("o_orderkey", "log_density"), "log_density", digits=4)


@query()
def cas_log_density(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return models.ReducedDensity(_XS, r=2, inner_degree=4).fit(rows, "o_orderkey").evaluate(rows).select("o_orderkey", "log_density")


_ALONG = (0.6, 0.0, 0.8)
_SLOPE = num(math.sqrt(2))
_LINE = " + ".join(f"{num(v)} * z{j}" for j, v in enumerate(_ALONG))
_POTENTIAL = f"least(cap, t1 * u + t2 * {hermite_sql('u', 2)})"
_NODES = _COPULA[: _COPULA.index(",\nr AS (SELECT corr")]


@query(f"""WITH o AS ({_ORDERS}), {_MARGINALS}, {_NODES}, pr AS (SELECT key, {_LINE} AS u FROM zr),
st AS (SELECT avg({_SLOPE} * u) AS c, avg(2.0e0 * u * u) AS e, avg(u) AS p, avg({_SLOPE} * u * u - {_SLOPE}) AS q FROM pr),
th AS (SELECT (p * (e + 4.0e-2) - c * q) / (1.01e0 * (e + 4.0e-2) - c * c) AS t1, (q * 1.01e0 - c * p) / (1.01e0 * (e + 4.0e-2) - c * c) AS t2 FROM st),
cp AS (SELECT t1, t2, quantile_cont(t1 * u + t2 * {hermite_sql('u', 2)}, 0.999) AS cap FROM pr, th GROUP BY t1, t2),
n1 AS (SELECT {sobol_sql('range', 1 << 14, 1, 0, 0, 'xor({}, {})')} AS w FROM range(0, {1 << 14})), n2 AS (SELECT {P.ndtri_sql('w')} AS u FROM n1),
lz AS (SELECT ln(avg(exp({_POTENTIAL}))) AS lz FROM n2, cp), pn AS (SELECT {_LINE} AS u FROM zn),
ms AS (SELECT ln(avg(exp({_POTENTIAL} - lz))) AS mass FROM pn, cp, lz GROUP BY ALL), sums AS (SELECT o_orderkey AS key, sum(log_pdf) AS s FROM f GROUP BY 1)
SELECT key AS o_orderkey, round(s + {_POTENTIAL} - lz - mass, 4) AS log_density FROM pr JOIN sums USING (key), cp, lz, ms""")
def reduced_density_closed(spark, sf_dir):
    """The whole estimator along a given direction: ranks, a potential by ridge, its cap, both normalisers and the marginals."""
    rows = _orders(spark, sf_dir)
    model = models.ReducedDensity(_XS, r=1, inner_degree=2, scheme="ridge:strength=0.01").fit(rows, "o_orderkey", V=np.array(_ALONG)[:, None])
    return rounded(model.evaluate(rows).select("o_orderkey", "log_density"), "log_density", digits=4)


@query()
def constrained_fit(spark, sf_dir):
    model = models.ReducedDensity(_XS, r=2, inner_degree=4, constrained=True).fit(_orders(spark, sf_dir), "o_orderkey")
    return spark.createDataFrame([(k, float(t)) for k, t in enumerate(model.theta)], "k int, theta double")


@query()
def stage1_subspace(spark, sf_dir):
    V, info = models.fit_subspace(table(spark, sf_dir, "lineitem"), COLUMNS, 2, 3, 2)
    return spark.createDataFrame([(i, j, float(V[i, j]), float(info["eigenvalues"][j])) for i in range(4) for j in range(2)], "i int, j int, v double, eigenvalue double")


@query()
def heldout_select(spark, sf_dir):
    folds = scorematch.statistics(ranks.hash_halves(_orders(spark, sf_dir).selectExpr("o_orderkey", "(x0 - 2.5e5) / 1.4e5 AS x0", "(x1 - 4.5e3) / 3.2e3 AS x1"), "o_orderkey"), _SCALED, dictionary(2, 4, 2, linear=True), fold="fold")
    s = solvers.heldout_select((folds[0], folds[1]), dictionary(2, 4, 2, linear=True))
    return spark.createDataFrame([(k, float(t)) for k, t in enumerate(s.theta)], "k int, theta double")


@query()
def stage_selection(spark, sf_dir):
    risks = selection.heldout_risks(_orders(spark, sf_dir), _XS, "o_orderkey", [(2, 2, False), (3, 2, False), (4, 2, True)])
    return spark.createDataFrame([(str(c), float(v)) for c, vs in risks.items() for v in vs], "candidate string, risk double")


@query(f"""WITH o AS ({_ORDERS}), {_MARGINALS.rstrip().rstrip(',')}, mgf AS (SELECT coord, ln(avg((1 - f) * exp((g0 + k * step - lo) / (hi - lo)) + f * exp((g0 + (k + 1) * step - lo) / (hi - lo)))) + 0.5 * power(width / (hi - lo), 2) AS part FROM c JOIN g USING (coord) GROUP BY coord, width, hi, lo)
SELECT CAST(range AS INTEGER) AS seed, round(ln(2.5), 9) AS log_mass, (SELECT round(sum(part), 2) FROM mgf) AS tilted FROM range(0, 3)""")
def qmc_log_mass(spark, sf_dir):
    """The mass of a constant factor is that constant, whatever the marginals; that of an exponential tilt of every column is the
    product of the smoothed marginals' generating functions."""
    rows = _orders(spark, sf_dir)
    base = models.ProductOfMarginals(_XS).fit(rows)
    ends = rows.agg(*(f(c) for c in _XS for f in (F.min, F.max))).first()
    low, wide = np.array(ends[::2], float), np.array(ends[1::2], float) - np.array(ends[::2], float)
    constant = lambda x: np.full(len(x), math.log(2.5))
    tilt = lambda x: ((x - low) / wide).sum(1)
    found = [(s, models.log_mass(base.marginals, constant, 4096, s), models.log_mass(base.marginals, tilt, 1 << 14, s)) for s in range(3)]
    return rounded(rounded(spark.createDataFrame(found, "seed int, log_mass double, tilted double"), "log_mass", digits=9), "tilted", digits=2)


@query()
def law_samples(spark, sf_dir):
    out = None
    for name in sorted(laws.LAWS):
        part = laws.sample_law(spark, name, 2000, 7).select(F.lit(name).alias("law"), "row_id", "eta", "log_density")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def jhi_descent(spark, sf_dir):
    m, h, c = laws.conformal_square().moments(20000, 1)
    V, trail = subspace.descend(subspace.top_eigenvectors(c, 4)[1], m, h + 1e-3 * np.eye(len(h)), 30)
    return spark.createDataFrame([(k, float(t)) for k, t in enumerate(trail)], "round int, bound double")


@query()
def nested_mc_kl(spark, sf_dir):
    law = laws.cusp_bend()
    bases = {"exact": np.eye(20)[:, :4], "other": np.eye(20)[:, 4:8], "estimated": law.subspace(4, 4000)} | {f"random{k}": subspace.haar_basis(20, 4, k) for k in range(2)}
    return montecarlo.nested_kl_table(spark, "cusp_bend", bases, 40, 256, [0, 1])


@query()
def saturation_ladder(spark, sf_dir):
    ladder = diagnostics.saturation(_scaled(spark, sf_dir), _SCALED, [(2, 1), (2, 2), (3, 2), (4, 2)])
    return spark.createDataFrame([tuple(x.values()) for x in ladder], "degree int, order int, terms int, trace double")


@query()
def a_posteriori_bound(spark, sf_dir):
    got = diagnostics.a_posteriori_bound(_orders(spark, sf_dir), _XS, "o_orderkey", 2, 3, 2)
    return spark.createDataFrame([(k, float(v)) for k, v in got.items()], "part string, value double")


@query()
def conditional_kl(spark, sf_dir):
    """Divergences outside a subspace, a row a point, each by the first integrator that works there, with its status."""
    return montecarlo.conditional_kl_table(spark, "cusp_bend", np.eye(20)[:, [0, 2]], 24, methods=("laplace", "mixture"))


@query()
def ablation_tuned(spark, sf_dir):
    """Nine penalties, each tuned by a grid and a closer look around its best strength."""
    folds = scorematch.statistics(ranks.hash_halves(_orders(spark, sf_dir).selectExpr("o_orderkey", "(x0 - 2.5e5) / 1.4e5 AS x0", "(x1 - 4.5e3) / 3.2e3 AS x1"), "o_orderkey"), _SCALED, dictionary(2, 3, 2), fold="fold")
    return spark.createDataFrame([(x["penalty"], float(x["strength"]), float(x["risk"])) for x in diagnostics.ablation(folds[0], folds[1], dictionary(2, 3, 2))], "penalty string, strength double, risk double")
