"""Weighted and log-scale aggregates, and small-table joins of experiment cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_mean_exp(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """group, n, log_mean_exp: the maximum is taken out first. Two aggregations; nothing is collected."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    top = rows.groupBy(*group).agg(F.max(value).alias("top_"))
    joined = rows.join(top, group) if group else rows.crossJoin(F.broadcast(top))  # without groups one row
    sums = joined.groupBy(*group, "top_").agg(F.count("*").alias("n"), F.avg(F.exp(F.col(value) - F.col("top_"))).alias("mean_"))
    return sums.select(*group, "n", (F.col("top_") + F.ln("mean_")).alias("log_mean_exp"))


def effective_size(df: DataFrame, weight: str, group: list[str]) -> DataFrame:
    """group, n, ess = (sum w)^2 / sum w^2, rel_se of the mean weight."""
    s = df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(weight).alias("s_"), F.sum(F.col(weight) * F.col(weight)).alias("q_"))
    rel = F.sqrt(F.greatest(F.lit(0.0), F.col("n") * F.col("q_") / (F.col("s_") * F.col("s_")) - 1) / F.col("n"))
    return s.select(*group, "n", (F.col("s_") * F.col("s_") / F.col("q_")).alias("ess"), rel.alias("rel_se"))


def weighted_moments(df: DataFrame, weight: str, value: str, group: list[str]) -> DataFrame:
    """Self-normalised mean and variance of the mean: sum w~^2 (f - mean)^2."""
    w, f = F.col(weight), F.col(value)
    s = df.groupBy(*group).agg(F.sum(w).alias("s_"), F.sum(w * f).alias("m_"), F.sum(w * w).alias("q_"), F.sum(w * w * f).alias("qf_"), F.sum(w * w * f * f).alias("qff_"))
    mean = F.col("m_") / F.col("s_")
    spread = (F.col("qff_") - 2 * mean * F.col("qf_") + mean * mean * F.col("q_")) / (F.col("s_") * F.col("s_"))
    return s.select(*group, mean.alias("mean"), F.greatest(F.lit(0.0), spread).alias("variance"))


def cell_summary(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, sd_pop, se, median, least, most of the values that are not NaN; dropped counts those that are."""
    ok = F.when(~F.isnan(value), F.col(value))
    return cells.groupBy(*keys).agg(
        F.count(ok).alias("n"), F.sum(F.isnan(value).cast("int")).cast("bigint").alias("dropped"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("sd_pop"),
        (F.stddev_samp(ok) / F.sqrt(F.count(ok))).alias("se"), F.percentile(ok, F.lit(0.5)).alias("median"), F.min(ok).alias("least"), F.max(ok).alias("most"),
    )


def valid_cells(cells: DataFrame, keys: list[str], flag: str, share: float = 0.98) -> DataFrame:
    """Cells with enough valid rows: a share of them and more than one."""
    s = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("int")).cast("bigint").alias("n_valid"))
    return s.where((F.col("n_valid") > 1) & (F.col("n_valid") / F.col("n") >= share))


def unfinished(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the grid without a result."""
    return grid.join(done.select(*keys), keys, "left_anti")


def all_done(grid: DataFrame, done: DataFrame, keys: list[str]) -> bool:
    return unfinished(grid, done, keys).isEmpty()


def paired_differences(cells: DataFrame, keys: list[str], method: str, value: str, base: str) -> DataFrame:
    """keys, method, difference: each method's value less that of the base method in the same cell."""
    b = cells.where(F.col(method) == base).select(*keys, F.col(value).alias("base_"))
    return cells.where(F.col(method) != base).join(b, keys).select(*keys, method, (F.col(value) - F.col("base_")).alias("difference"))


def one_standard_error(risks: DataFrame, candidate: str, risk: str, size: str, place: str) -> DataFrame:
    """The candidate to take: within one standard error (population sd) of the least mean risk the smallest, then the first.
    risks: a row for each candidate and split."""
    s = risks.groupBy(candidate, size, place).agg(F.avg(risk).alias("mean"), (F.stddev_pop(risk) / F.sqrt(F.count("*"))).alias("se"))
    best = s.agg(F.min_by(F.struct("mean", "se"), F.struct("mean", place)).alias("b")).select((F.col("b.mean") + F.col("b.se")).alias("limit_"))
    return s.crossJoin(F.broadcast(best)).where(F.col("mean") <= F.col("limit_")).orderBy(size, place).limit(1).drop("limit_")  # one row


def normalised_grid(grid: DataFrame, group: list[str], log_weight: str, cell: float) -> DataFrame:
    """Adds p: exp(log_weight), scaled to integrate to 1 over cells of the given area. A group is one grid."""
    w = Window.partitionBy(*group)
    e = F.exp(F.col(log_weight) - F.max(log_weight).over(w))
    return grid.withColumn("e_", e).withColumn("p", F.col("e_") / (F.sum("e_").over(w) * cell)).drop("e_")


def grid_kl(grid: DataFrame, p: str, q: str, cell: float, group: list[str]) -> DataFrame:
    """sum p log(p / q) over cells with p > 1e-15; q is at least 1e-300."""
    term = F.when(F.col(p) > 1e-15, F.col(p) * F.ln(F.col(p) / F.greatest(F.col(q), F.lit(1e-300)))).otherwise(0.0)
    return grid.groupBy(*group).agg((F.sum(term) * cell).alias("kl"))


def accepted(df: DataFrame, ess_share: str = "ess_share", rel_se: str = "rel_se", least: float = 1e-3, most: float = 0.10) -> DataFrame:
    """Adds status: ok, low_ess or high_se."""
    return df.withColumn("status", F.when(F.col(ess_share) < least, "low_ess").when(F.col(rel_se) > most, "high_se").otherwise("ok"))
