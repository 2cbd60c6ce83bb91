"""Moments of a given density's score over the rows of a table, with normal scores of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.jets import Function, variables
from skerry.functions.sqltext import num


def score_texts(columns: list[str], log_density: Function, scores: Function | list[Function]) -> tuple[list[str], list[str]]:
    """SQL of the normal scores z_j and of t_j, the derivative along z_j of the log density that the rows have as scores.

    log_density: of the columns; a constant factor plays no part. scores: for each column its normal score, a rising function of
    that column alone, by its own marginal (one function for all, or one each). As x_j has the slope 1 / z_j' in z_j,
    t_j = (d_j log density - z_j'' / z_j') / z_j'.
    """
    x = variables(columns)
    made = [scores] * len(x) if callable(scores) else scores
    slope = log_density(x).first
    z, t = [], []
    for j, of in enumerate(made):
        s = of([x[j]])
        if s.first[j] is None or any(p is not None for k, p in enumerate(s.first) if k != j):
            raise ValueError("a score is a function of its own column")
        bent = f" - {s.second[j]} / {s.first[j]}" if s.second[j] else ""
        z.append(s.text)
        t.append(f"(({slope[j] or num(0.0)}{bent}) / {s.first[j]})")
    return z, t


def density_moments(df: DataFrame, columns: list[str], log_density: Function, scores: Function | list[Function]) -> DataFrame:
    """i, j, m, h, c for i <= j, all in one pass: M = E[z z'], H = E[t t'] and C = E[(t + z)(t + z)'], t being the derivatives of the
    log density of the scores and t + z those of its part beyond the normal. Rows where any of them is null or NaN are left out."""
    z, t = score_texts(columns, log_density, scores)
    d = len(columns)
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    rows = rows.select(*(F.expr(e).alias(f"z{j}") for j, e in enumerate(z)), *(F.expr(e).alias(f"t{j}") for j, e in enumerate(t)))
    for name in rows.columns:
        rows = rows.where(F.col(name).isNotNull() & ~F.isnan(name))
    cells = []
    for i in range(d):
        for j in range(i, d):
            zi, zj, ti, tj = (F.col(n) for n in (f"z{i}", f"z{j}", f"t{i}", f"t{j}"))
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.avg(zi * zj).alias("m"), F.avg(ti * tj).alias("h"), F.avg((ti + zi) * (tj + zj)).alias("c")))
    return rows.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
