"""Queries of samples, stored tables and joins: keyed draws, pools, caches, resumable cells, audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skerry.functions import normal as P
from skerry.functions.sqltext import num
from skerry.operators import ranks, samples, weights
from skerry.plans import diagnostics, storage
from skerry.plans.registry import query, rounded, table
from skerry.sources import tables


def _folder(spark, name: str) -> str:
    return f"{storage.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_U = samples.keyed_uniform_sql("event_id", 7)


@query(f"SELECT event_id, round({_U}, 9) AS u FROM events WHERE {_U} < exp(-value / 1.0e2)")
def rejection(spark, sf_dir):
    """Rows kept with probability exp(-value / 100)."""
    rows = samples.accept(table(spark, sf_dir, "events"), "event_id", "-value / 1.0e2", 7)
    return rounded(rows.select("event_id", samples.keyed_uniform("event_id", 7).alias("u")), "u", digits=9)


@query(f"SELECT c_custkey, c_acctbal FROM customer ORDER BY {samples.keyed_uniform_sql('c_custkey', 3)}, c_custkey LIMIT 1")
def one_observation(spark, sf_dir):
    return samples.draw_one(table(spark, sf_dir, "customer"), "c_custkey", 3).select("c_custkey", "c_acctbal")


@query("""SELECT user_id, event_id, round(avg(CASE WHEN value > 5.0e1 THEN 1.0e0 ELSE 0.0e0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS rate FROM events""")
def rolling_acceptance(spark, sf_dir):
    """The share of accepted moves over each chain's last 50."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 50).alias("ok"))
    return rounded(samples.rolling_share(rows, "user_id", "event_id", "ok").select("user_id", "event_id", "rate"), "rate", digits=9)


_GAUSS = P.log_gauss_sql(["(c_acctbal / 5.0e3)", "(c_nationkey / 1.0e1)"], [0.9, 1.2], [[0.4, 0.1], [0.1, 0.5]])


@query(f"""WITH d AS (SELECT c_custkey, c_acctbal / 5.0e3 - 0.9 AS a, c_nationkey / 1.0e1 - 1.2 AS b FROM customer)
SELECT c_custkey, round(-0.5 * (0.5 * a * a - 0.2 * a * b + 0.4 * b * b) / 0.19 - 0.5 * ln(0.19) - {num(P.LOG_2PI)}, 6) + 0.0 AS log_density FROM d""")
def gauss_log_density(spark, sf_dir):
    """A normal law with a full covariance; SQL writes the inverse of the 2 x 2 matrix out."""
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_GAUSS).alias("log_density")), "log_density")


@query(f"""WITH pool AS (SELECT o_totalprice AS x FROM orders WHERE o_orderstatus = 'F'), q AS (SELECT o_orderkey AS id, o_totalprice AS x FROM orders WHERE o_orderstatus <> 'F'),
u AS (SELECT x, 1 AS w, NULL AS id FROM pool UNION ALL SELECT x, 0, id FROM q), c AS (SELECT id, sum(w) OVER (ORDER BY x RANGE UNBOUNDED PRECEDING) AS below FROM u),
p AS (SELECT id, greatest(1, least((SELECT count(*) FROM pool), below)) / ((SELECT count(*) FROM pool) + 1.0e0) AS p FROM c WHERE id IS NOT NULL)
SELECT id AS o_orderkey, round({P.ndtri_sql('p')}, 6) + 0.0 AS o_totalprice_z FROM p""")
def pool_scores(spark, sf_dir):
    """Normal scores of new rows by their clipped ranks in a pool."""
    orders = table(spark, sf_dir, "orders")
    return rounded(diagnostics.transfer_ranks(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), ["o_totalprice"], "o_orderkey"), "o_totalprice_z")


@query("""WITH l AS (SELECT 'c_acctbal' AS coord, c_acctbal AS x FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer)
SELECT coord, count(*) AS n, CAST(0 AS BIGINT) AS drops, round(max(x) - min(x), 6) AS spread, true AS ok FROM l GROUP BY coord
UNION ALL SELECT 'by key', count(*), CAST(sum(CASE WHEN x < p THEN 1 ELSE 0 END) AS BIGINT), round(max(x) - min(x), 6), sum(CASE WHEN x < p THEN 1 ELSE 0 END) = 0 FROM (SELECT c_acctbal AS x, lag(c_acctbal) OVER (ORDER BY c_custkey) AS p FROM customer)
UNION ALL SELECT 'all alike', count(*), CAST(0 AS BIGINT), 0.0, false FROM customer
UNION ALL SELECT 'one short', count(*) - 1, CAST(0 AS BIGINT), round(max(CAST(c_custkey AS DOUBLE)) - min(c_custkey) - 1, 6), false FROM customer""")
def sorted_pool_check(spark, sf_dir):
    """Columns written as sorted range partitions, then read back and checked: rows, order and spread. Beside them, pools that are
    not in order, all alike and a row short."""
    rows = table(spark, sf_dir, "customer")
    pool = tables.sorted_pool(rows, ["c_acctbal", "c_nationkey"], _folder(spark, "pool"))
    planted = [("by key", "c_acctbal", "true"), ("all alike", "7.0D", "true"), ("one short", "CAST(c_custkey AS DOUBLE)", "c_custkey > (SELECT min(c_custkey) FROM {c})")]
    for name, x, kept in planted:
        pool = pool.unionByName(spark.sql(f"SELECT '{name}' AS coord, {x} AS x, c_custkey AS place FROM {{c}} WHERE {kept}", c=rows))
    return rounded(tables.check_pool(pool, rows.count()), "spread")


_CELLS = "SELECT event_type AS example, user_id AS seed, round(avg(value), 6) AS value FROM events GROUP BY 1, 2"


@query(f"WITH c AS ({_CELLS}) SELECT example, seed, value, seed % 3 = 0 AS first FROM c")
def resumed_cells(spark, sf_dir):
    """Result cells appended in two runs: the second one computes those that the first hasn't left, by an anti-join."""
    path = _folder(spark, "cells")
    cells = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("example"), F.col("user_id").alias("seed")).agg(F.round(F.avg("value"), 6).alias("value"))
    schema = "seed bigint, value double, first boolean, example string"
    if not tables.read_cells(spark, path, schema).isEmpty():
        raise RuntimeError("the folder of cells isn't new")
    tables.append_cells(cells.where("seed % 3 = 0").withColumn("first", F.lit(True)), path, ["example"])
    todo = weights.unfinished(cells, tables.read_cells(spark, path, schema), ["example", "seed"])
    tables.append_cells(storage.settle(todo.withColumn("first", F.lit(False))), path, ["example"])
    done = tables.read_cells(spark, path, schema)
    if not weights.all_done(cells, done, ["example", "seed"]):
        raise RuntimeError("cells are missing")
    return done.select("example", "seed", "value", "first")


@query("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, true AS again FROM customer")
def materialised_once(spark, sf_dir):
    """A table made at its first use and read at the second."""
    path, made = _folder(spark, "once"), []

    def make():
        made.append(1)
        return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")

    tables.materialise(make, spark, path)
    out = tables.materialise(make, spark, path)
    return rounded(out.agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total")).withColumn("again", F.lit(len(made) == 1)), "total", digits=2)


#: The last two differ from the first in one row: by a cent, and by rows that changed places.
_TWINS = {
    "a": "c_acctbal", "b": "c_nationkey", "c": "c_acctbal + 0.0", "d": "-c_acctbal", "e": "CAST(c_nationkey AS DOUBLE)",
    "f": "c_acctbal + CASE WHEN c_custkey = 3 THEN 0.01 ELSE 0.0 END", "g": "CASE WHEN c_custkey = 1 THEN other ELSE c_acctbal END",
}
_TWIN_ROWS = "SELECT *, (SELECT max(c_acctbal) FROM {c} WHERE c_custkey = 2) AS other FROM {c}"
_DIFFER = " UNION ALL ".join(f"SELECT '{y}' AS coord, '{x}' AS same_as, count(*) AS n FROM t WHERE {x} <> {y}" for i, y in enumerate(_TWINS) for x in list(_TWINS)[: i + 1])


@query(f"""WITH t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _TWINS.items())} FROM ({_TWIN_ROWS.format(c='customer')})), d AS ({_DIFFER})
SELECT coord, min(same_as) AS same_as FROM d WHERE n = 0 GROUP BY coord""")
def equal_columns(spark, sf_dir):
    """Columns with the same values in the same rows share one fit: found by sums of hashes, in SQL by comparing all rows."""
    rows = spark.sql(_TWIN_ROWS, c=table(spark, sf_dir, "customer")).selectExpr(*(f"{e} AS {n}" for n, e in _TWINS.items()))
    return spark.createDataFrame(list(samples.column_groups(rows, list(_TWINS)).items()), "coord string, same_as string")


@query("""WITH r AS (SELECT event_type AS name, avg(value) AS found FROM events GROUP BY 1), c AS (SELECT name, round(found + CASE WHEN name = 'click' THEN 1.0 ELSE 0.0 END, 2) AS claimed FROM r UNION ALL SELECT 'none', 1.0)
SELECT c.name, round(claimed, 2) AS claimed, round(found, 6) AS found, CASE WHEN found IS NULL THEN 'missing' WHEN name = 'click' THEN 'differs' ELSE 'ok' END AS status FROM c LEFT JOIN r USING (name)""")
def number_audit(spark, sf_dir):
    """Printed numbers against recomputed ones."""
    results = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("found"))
    claims = results.select("name", F.round(F.col("found") + F.when(F.col("name") == "click", 1.0).otherwise(0.0), 2).alias("claimed"), F.lit(2).alias("digits"))
    claims = claims.unionByName(spark.createDataFrame([("none", 1.0, 2)], "name string, claimed double, digits int"))
    return rounded(diagnostics.audit(claims, results, ["name"]), "found")


@query("""WITH l AS (SELECT l_returnflag AS s, l_linestatus AS g FROM lineitem GROUP BY 1, 2), m AS (SELECT l_returnflag AS s, l_linestatus AS g, round(avg(l_tax), 6) AS theta FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT s, g, coalesce(theta, 0.0) AS theta FROM l LEFT JOIN m USING (s, g)""")
def aligned_coefficients(spark, sf_dir):
    """A smaller dictionary's coefficients over a larger one, 0 where it has no term."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("s"), F.col("l_linestatus").alias("g"), "l_tax")
    small = rows.where("s <> 'N'").groupBy("s", "g").agg(F.round(F.avg("l_tax"), 6).alias("theta"))
    return diagnostics.align_coefficients(small, rows.select("s", "g").distinct(), ["s", "g"], "theta")


@query("SELECT l_returnflag AS flag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS q{k}" for k, q in enumerate((0.0, 0.25, 0.5, 0.999, 1.0))) + " FROM lineitem GROUP BY 1")
def group_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    names = {f"q{k}": q for k, q in enumerate((0.0, 0.25, 0.5, 0.999, 1.0))}
    return rounded(ranks.quantiles(rows, "l_extendedprice", names, ["flag"]), *names, digits=4)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 6")
def worst_violations(spark, sf_dir):
    """The n largest violations, ties by key."""
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(6)
