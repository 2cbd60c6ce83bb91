"""Integrals as joins: nested means over shared inner points, mixtures on grids, quasi-random normalisers.

The inner side of each is a table of points whose number is checked against MOST before it is sent to all tasks; the outer
side grows with the data and stays where it is.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.sobol import sobol_sql

#: Points of an inner table.
MOST = 100_000


def checked(inner: DataFrame, most: int = MOST) -> DataFrame:
    """inner for a broadcast, if it has so many rows at most; else ValueError."""
    if inner.limit(most + 1).count() > most:
        raise ValueError(f"the inner table has more than {most} rows")
    return F.broadcast(inner)


def nested_log_mean(outer: DataFrame, inner: DataFrame, key: str, log_term: str, weight: str | None = None) -> DataFrame:
    """key, log_mean, ess: for each outer row the log of the (weighted) mean of exp(log_term) over all inner rows, and the
    number of effective ones. Two passes over the pairs take the largest term out first; both combine on the map side.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = outer.crossJoin(checked(inner)).select(key, F.expr(log_term).alias("l_"), w.alias("w_"))
    top = pairs.groupBy(key).agg(F.max("l_").alias("top_"))
    e = F.col("w_") * F.exp(F.col("l_") - F.col("top_"))
    sums = outer.join(top, key).crossJoin(checked(inner)).select(key, "top_", F.expr(log_term).alias("l_"), w.alias("w_"))
    sums = sums.groupBy(key, "top_").agg(F.sum(e).alias("s_"), F.sum(e * e).alias("q_"), F.sum("w_").alias("n_"))
    return sums.select(key, (F.col("top_") + F.ln(F.col("s_") / F.col("n_"))).alias("log_mean"), (F.col("s_") * F.col("s_") / F.col("q_")).alias("ess"))


def tensor_nodes(spark: SparkSession, counts: list[int], prefix: str = "v") -> DataFrame:
    """A row a point of a tensor of Gauss-Hermite rules: v0, v1, .. and the weight w, for the standard normal. counts: nodes of
    each coordinate, more for those that matter more; their product is the number of rows."""
    if math.prod(counts) > MOST:
        raise ValueError(f"the rule has more than {MOST} points")
    out = None
    for j, n in enumerate(counts):
        x, w = np.polynomial.hermite_e.hermegauss(n)
        axis = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w / w.sum(), strict=True)], f"{prefix}{j} double, w_ double")
        out = axis.withColumnRenamed("w_", "w") if out is None else out.crossJoin(axis).withColumn("w", F.col("w") * F.col("w_")).drop("w_")  # counts are checked
    return out


def inner_divergence(outer: DataFrame, nodes: DataFrame, key: str, log_excess: str, weight: str) -> DataFrame:
    """key, kl: sum over quadrature nodes of weight * exp(l) * l, with l the excess of a joint log density over a reduced one."""
    pairs = outer.crossJoin(checked(nodes)).withColumn("l_", F.expr(log_excess))
    return pairs.groupBy(key).agg(F.sum(F.col(weight) * F.exp("l_") * F.col("l_")).alias("kl"))


def mixture_table(components: DataFrame, grid: DataFrame, mean: str, sd: float, cdf: Column) -> DataFrame:
    """g, density, cdf, score: a normal mixture with equal weights and one standard deviation at each grid point, with the
    derivative of its log density (NULL where no kernel reaches). cdf: the normal distribution function of column t_."""
    t = (F.col("g") - F.col("m_")) / sd
    counts = components.groupBy(F.col(mean).cast("double").alias("m_")).agg(F.count("*").alias("c_"))
    pairs = counts.crossJoin(checked(grid.select("g"))).withColumn("t_", t)
    k = F.exp(-0.5 * F.col("t_") * F.col("t_"))
    sums = pairs.groupBy("g").agg(F.sum("c_").alias("n"), F.sum(F.col("c_") * k).alias("k"), F.sum(F.col("c_") * cdf).alias("f"), F.sum(-F.col("c_") * k * F.col("t_") / sd).alias("d"))
    return sums.select("g", (F.col("k") / (F.col("n") * sd * math.sqrt(2 * math.pi))).alias("density"), (F.col("f") / F.col("n")).alias("cdf"), F.try_divide("d", "k").alias("score"))


def sobol_points(spark: SparkSession, n: int, d: int, seed: int, prefix: str = "u") -> DataFrame:
    """id and the coordinates of the first n shifted Sobol points, by built-in functions alone."""
    return spark.range(n).select("id", *(F.expr(sobol_sql("id", n, d, j, seed)).alias(f"{prefix}{j}") for j in range(d)))


def log_mass_table(spark: SparkSession, log_factor: str, d: int, budgets: list[int], seeds: list[int]) -> DataFrame:
    """budget, seed, log_mass: log of the mean of exp(log_factor), an expression in u0, u1, .., over each budget of points
    and each shift: how steady a normaliser is."""
    points = None
    for s in seeds:
        part = sobol_points(spark, max(budgets), d, s).withColumn("seed", F.lit(s))
        points = part if points is None else points.unionByName(part)
    values = points.select("seed", "id", F.expr(log_factor).alias("l_"))
    plans = spark.createDataFrame([(b,) for b in budgets], "budget bigint")
    within = values.join(F.broadcast(plans), F.col("id") < F.col("budget"))  # a row a budget
    top = within.groupBy("budget", "seed").agg(F.max("l_").alias("top_"))
    sums = within.join(top, ["budget", "seed"]).groupBy("budget", "seed", "top_").agg(F.avg(F.exp(F.col("l_") - F.col("top_"))).alias("m_"))
    return sums.select("budget", "seed", (F.col("top_") + F.ln("m_")).alias("log_mass"))
