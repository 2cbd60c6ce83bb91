"""The jobs as registered queries: run twice over whole tables into a folder of their own, and the output read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import common, copula_scores, stream_fit
from skerry.functions import normal as P
from skerry.plans.registry import rounded
from skerry.plans.storage import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_copula_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, config = _folder(spark, "job1"), common.config(copula_scores.CONFIG)
    for _ in range(2):
        copula_scores.run(spark, f"{sf_dir}/documents.parquet", target, config)
    made = [*(f"{m}_z" for m in config["measures"]), "log_copula"]
    back = spark.read.schema(", ".join(["doc_id bigint", *(f"{c} double" for c in made), "lang string"])).parquet(f"{target}/scores")
    return rounded(back, *made)


def job2_stream_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = _folder(spark, "job2"), common.config(stream_fit.CONFIG)
    for _ in range(2):
        stream_fit.run(spark, f"{sf_dir}/lineitem*.parquet", f"{folder}/out", f"{folder}/checkpoint", config)
    back = spark.read.schema("term string, n bigint, theta double, l_returnflag string").parquet(f"{folder}/out/fit")
    return rounded(back, "theta")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_copula_scores, job2_stream_fit)}


def _scores_sql() -> str:
    """Three measures: average ranks by group as windows, the inverse of three correlations in closed form."""
    config = common.config(copula_scores.CONFIG)
    names = list(config["measures"])
    measures = ", ".join(f"CAST({e} AS DOUBLE) AS {m}" for m, e in config["measures"].items())
    rank = ", ".join(f"CASE WHEN {m} IS NOT NULL THEN (rank() OVER (PARTITION BY lang ORDER BY {m} NULLS LAST) + (count(*) OVER (PARTITION BY lang, {m}) - 1) / 2.0) / (count({m}) OVER (PARTITION BY lang) + 1) END AS p{k}" for k, m in enumerate(names))
    z = ", ".join(f"{P.ndtri_sql(f'p{k}')} AS z{k}" for k in range(3))
    r = ", ".join(f"coalesce(corr(z{i}, z{j}) FILTER (WHERE z0 + z1 + z2 IS NOT NULL), 0) AS {name}" for name, i, j in (("a", 0, 1), ("b", 0, 2), ("c", 1, 2)))
    det = "(1 + 2 * a * b * c - a * a - b * b - c * c)"
    form = f"((1 - c * c) / {det} - 1) * z0 * z0 + ((1 - b * b) / {det} - 1) * z1 * z1 + ((1 - a * a) / {det} - 1) * z2 * z2 + 2 * (b * c - a) / {det} * z0 * z1 + 2 * (a * c - b) / {det} * z0 * z2 + 2 * (a * b - c) / {det} * z1 * z2"
    shown = ", ".join(f"round(z{k}, 6) + 0.0 AS {m}_z" for k, m in enumerate(names))
    return f"""WITH f AS (SELECT doc_id, lang, {measures} FROM documents), p AS (SELECT doc_id, lang, {rank} FROM f), z AS (SELECT doc_id, lang, {z} FROM p), r AS (SELECT lang, {r} FROM z GROUP BY lang)
SELECT z.doc_id, z.lang, {shown}, round(-0.5 * ln({det}) - 0.5 * ({form}), 6) + 0.0 AS log_copula FROM z JOIN r ON z.lang IS NOT DISTINCT FROM r.lang"""


def _fit_sql() -> str:
    """Three terms, so the system is solved by Cramer's rule."""
    config = common.config(stream_fit.CONFIG)
    x, y = config["columns"].values()
    rows = [["a", "b", "0"], ["b", "c", "b"], ["0", "b", "d"]]

    def det(m: list[list[str]]) -> str:
        return " + ".join(f"{m[0][i]} * ({m[1][j]} * {m[2][k]} - {m[1][k]} * {m[2][j]})" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))

    def replaced(k: int) -> list[list[str]]:
        return [[f"g{i}" if j == k else v for j, v in enumerate(row)] for i, row in enumerate(rows)]

    parts = " UNION ALL ".join(f"SELECT l_returnflag, '{term}' AS term, n, round(({det(replaced(k))}) / ({det(rows)}), 6) + 0.0 AS theta FROM s" for k, term in enumerate(("0:2", "0:1+1:1", "1:2")))
    strength, root = config["strength"], "sqrt(2e0)"
    return f"""WITH x AS (SELECT l_returnflag, {x} AS x, {y} AS y FROM lineitem WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
s AS (SELECT l_returnflag, count(*) AS n, avg(2 * x * x) + {strength} AS a, avg({root} * x * y) AS b, avg(x * x + y * y) + {strength} AS c, avg(2 * y * y) + {strength} AS d,
avg({root} * (x * x - 1)) AS g0, avg(2 * x * y) AS g1, avg({root} * (y * y - 1)) AS g2 FROM x GROUP BY l_returnflag) {parts}"""


def oracle_sql() -> dict[str, str]:
    return {"job1_copula_scores": _scores_sql(), "job2_stream_fit": _fit_sql()}
