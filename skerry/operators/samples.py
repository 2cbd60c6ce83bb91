"""Draws, filters and shares over samples, whose randomness is a hash of the row's key: reruns and engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_uniform(key: str, seed: int) -> Column:
    """A number in (0, 1) from the key's MD5, 52 bits of it."""
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def keyed_uniform_sql(key: str, seed: int) -> str:
    """The same for engines that read hexadecimal text as a number."""
    return f"((CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '/{seed}'), 1, 13) AS BIGINT) + 5.0e-1) / {float(1 << 52):.1f}e0)"


def accept(df: DataFrame, key: str, log_ratio: str, seed: int = 0) -> DataFrame:
    """Rejection: keeps a row with probability exp(log_ratio), which is 0 at most. log_ratio: an expression."""
    return df.where(keyed_uniform(key, seed) < F.exp(F.expr(log_ratio)))


def draw_one(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One row, each with equal probability. A top-1 by hash: every task keeps one row."""
    return df.withColumn("u_", keyed_uniform(key, seed)).orderBy("u_", key).limit(1).drop("u_")


def rolling_share(df: DataFrame, chain: str, step: str, flag: str, width: int = 50, name: str = "rate") -> DataFrame:
    """Adds the share of set flags over the last `width` steps of each chain (fewer at its start). A chain's steps are few."""
    last = Window.partitionBy(chain).orderBy(step).rowsBetween(1 - width, 0)
    return df.withColumn(name, F.avg(F.col(flag).cast("double")).over(last))


def status_counts(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """keys, status, n and its share of the cell."""
    counts = df.groupBy(*keys, status).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total_"))
    joined = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))  # without keys one row
    return joined.select(*keys, status, "n", (F.col("n") / F.col("total_")).alias("share"))


def joined_moments(z: DataFrame, t: DataFrame, key: str, z_columns: list[str], t_columns: list[str]) -> DataFrame:
    """i, j, m, h, c for i <= j from two tables with a row a key: M = E[z z'], H = E[t t'] and C = E[(t + z)(t + z)'].

    One join by key and one aggregation, whatever the number of cells. A key that one side lacks is left out.
    """
    joined = z.select(key, *(F.col(x).alias(f"z{i}") for i, x in enumerate(z_columns))).join(t.select(key, *(F.col(x).alias(f"t{i}") for i, x in enumerate(t_columns))), key)
    cells = []
    for i in range(len(z_columns)):
        for j in range(i, len(z_columns)):
            zi, zj, ti, tj = (F.col(x) for x in (f"z{i}", f"z{j}", f"t{i}", f"t{j}"))
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.avg(zi * zj).alias("m"), F.avg(ti * tj).alias("h"), F.avg((ti + zi) * (tj + zj)).alias("c")))
    return joined.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def column_groups(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """For each column the first one with the same values in the same rows, by sums of hashes from one aggregation.

    Work that depends on a column alone (a marginal's fit) is done once a group.
    """
    sums = [F.sum(F.xxhash64(F.lit(k), F.col(c).cast("double")).cast("decimal(38,0)")).alias(f"h{k}_{j}") for j, c in enumerate(columns) for k in range(2)]
    rows = df.withColumn("r_", F.lit(0)).agg(*sums).first()
    first: dict[tuple, str] = {}
    return {c: first.setdefault((rows[f"h0_{j}"], rows[f"h1_{j}"]), c) for j, c in enumerate(columns)}
