"""Scores every text of a table by how usual its measures are together, group by group.

    python -m jobs.copula_scores --input TABLE --output FOLDER [--config FILE]

The config names a key, a group (a column) and measures (SQL expressions of the table's columns). Within each group the
measures become normal scores of their average ranks; the Gaussian copula with the scores' correlations gives each row a log
density: 0 where the measures go together as if independent, low where they contradict what holds for the group.

Output, both as Parquet in a folder a group: scores (key, group, a score a measure, log_copula) and groups (rows, correlation
of each pair, mean log_copula). A rerun overwrites both with the same rows.

Defined results: rows where any measure is null or not finite have no log_copula, and are counted; null groups are one group.
A pair without a correlation (a constant measure) counts as uncorrelated. Where correlations make no positive definite matrix
(one measure follows from the others) the group has no log_copula. Repeated rows are rows of their own. Empty input: empty
tables.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from skerry.operators.ranks import rank_gaussianize
from skerry.plans.storage import join_null_safe, settle

CONFIG = Path(__file__).with_name("copula_scores.json")


def pair_correlations(scores: DataFrame, measures: list[str], group: str) -> DataFrame:
    """group, n, complete (rows with all scores) and r_a_b for each pair, over the complete rows."""
    z = [f"{m}_z" for m in measures]
    whole = F.lit(True)
    for c in z:
        whole = whole & F.col(c).isNotNull()
    x = [F.when(whole, F.col(c)) for c in z]
    cells = []
    for i, a in enumerate(measures):
        for j in range(i + 1, len(z)):
            r = F.try_divide(F.covar_pop(x[i], x[j]), F.stddev_pop(x[i]) * F.stddev_pop(x[j]))  # a constant score has none
            cells.append(r.alias(f"r_{a}_{measures[j]}"))
    return scores.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(whole, 1)).alias("complete"), *cells)


def precisions(groups: DataFrame, measures: list[str]) -> DataFrame:
    """Adds excess (inverse correlations less the identity, row by row) and log_det: small matrices, a row a group."""
    d = len(measures)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema.fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            r = np.tile(np.eye(d), (b.num_rows, 1, 1))
            for k, (i, j) in enumerate((i, j) for i in range(d) for j in range(i + 1, d)):
                r[:, i, j] = r[:, j, i] = np.nan_to_num(b.column(3 + k).to_numpy(zero_copy_only=False).astype(float))
            excess, dets = [], []
            for m in r:
                ok = np.linalg.eigvalsh(m)[0] > 1e-9
                excess.append((np.linalg.inv(m) - np.eye(d)).ravel() if ok else None)
                dets.append(float(np.linalg.slogdet(m)[1]) if ok else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(excess, pa.list_(pa.float64())), pa.array(dets, pa.float64())], [*b.schema.names, "excess", "log_det"])

    return groups.mapInArrow(run, f"{schema}, excess array<double>, log_det double")


def run(spark: SparkSession, source: str, target: str, config: dict) -> dict[str, int]:
    """Both tables, written; the rows of each."""
    key, group, measures = config["key"], config["group"], list(config["measures"])
    table = spark.read.parquet(source)
    narrow = settle(table.select(key, group, *(F.expr(e).cast("double").alias(m) for m, e in config["measures"].items())))  # texts are read once
    common.LOG.info("read %s: %d rows", source, narrow.count())
    scores = settle(rank_gaussianize(narrow, measures, group=[group]).drop(*measures))
    groups = settle(precisions(pair_correlations(scores, measures, group), measures))
    joined = join_null_safe(scores, groups.select(group, "excess", "log_det"), [group], "left")
    d = len(measures)
    form = sum((F.col(f"{measures[i]}_z") * F.col(f"{measures[j]}_z") * F.col("excess")[i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))
    scored = settle(joined.select(key, group, *(f"{m}_z" for m in measures), (-0.5 * F.col("log_det") - 0.5 * form).alias("log_copula")))
    means = scored.groupBy(group).agg(F.avg("log_copula").alias("mean_log_copula"))
    summary = join_null_safe(groups.drop("excess", "log_det"), means, [group], "left")
    with common.settings(spark, spark__sql__sources__partitionOverwriteMode="static"):
        return {"scores": common.write(scored.repartition(F.col(group), F.pmod(F.xxhash64(key), F.lit(_files(spark)))), f"{target}/scores", group), "groups": common.write(summary, f"{target}/groups", group)}


def _files(spark: SparkSession) -> int:
    """Files a group: a group of a third of all rows is written by several tasks."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="copula_scores", description=__doc__.splitlines()[0])
    parser.add_argument("--input", required=True, help="Parquet table")
    parser.add_argument("--output", required=True, help="folder of the tables")
    parser.add_argument("--config", default=str(CONFIG), help="JSON file")
    given = parser.parse_args(args)
    spark = common.session("copula_scores")
    try:
        run(spark, given.input, given.output, common.config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
