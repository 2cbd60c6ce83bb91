"""Keeps score-matching sums of a growing table and refits its density after every run.

    python -m jobs.stream_fit --input FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]

The input is a folder that gets new Parquet files, or a pattern of such folders and files, read as a file stream: each run takes the files that the checkpoint hasn't
seen, and ends. A micro-batch adds one row of sums a group: rows, and the cells of the gram A and of the right side b of a
Hermite dictionary over the config's standardised columns. Sums of disjoint rows add up, so no row is read twice, and a fit
costs as much as there are batches, not rows.

Output, as Parquet: sums (a folder a batch) and fit (a folder a group: the coefficients of the ridge fit, a row a term). A
batch that comes again after a failure has the same number and files, and overwrites its own folder and nothing else. A rerun
without new files leaves the sums and writes the same fit. Output and checkpoint belong together: a new checkpoint takes
all files again and needs a new output folder.

Defined results: rows where a column is null or not finite are left out, and counted; null groups are one group. Repeated rows
count as often as they are there. No input rows at all: no sums and no fit.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from jobs import common
from skerry.functions.hermite import Index, dictionary, gradient_sql

CONFIG = Path(__file__).with_name("stream_fit.json")


def cells(columns: list[str], terms: list[Index]) -> list[str]:
    """SQL of a row's part in each cell: of A by rows (second term from the first on), then of b."""
    made = []
    for i, p in enumerate(terms):
        for q in terms[i:]:
            shared = [k for k in range(len(columns)) if k in p[0] and k in q[0]]
            made.append(" + ".join(f"{gradient_sql(p, columns, k)} * {gradient_sql(q, columns, k)}" for k in shared) or "0.0D")
    for p in terms:
        parts = [f"{columns[i]} * {gradient_sql(p, columns, i)}" for i in p[0]]
        made.append(" + ".join([*parts, *(f"-({s})" for i in p[0] if (s := gradient_sql(p, columns, i, 2)))]))
    return made


def sums_of(rows: DataFrame, config: dict, terms: list[Index]) -> DataFrame:
    """group, n, skipped and sums (an array of cells): partial aggregates of built-in functions, a row a group."""
    columns = list(config["columns"])
    picked = rows.select(config["group"], *(F.expr(e).cast("double").alias(c) for c, e in config["columns"].items()))
    whole = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in columns)
    found = [F.expr(f"coalesce(sum(CASE WHEN {whole} THEN {text} END), 0.0D)") for text in cells(columns, terms)]
    return picked.groupBy(config["group"]).agg(F.count(F.expr(f"CASE WHEN {whole} THEN 1 END")).alias("n"), F.count(F.expr(f"CASE WHEN NOT ({whole}) THEN 1 END")).alias("skipped"), F.array(*found).alias("sums"))


def fit(sums: DataFrame, group: str, terms: list[Index], strength: float) -> DataFrame:
    """group, term, n, theta: (A + strength I) theta = b of the sums of all batches, a small system a group."""
    m = len(terms)
    one = sums.select(group, "n", F.posexplode("sums").alias("k", "x")).groupBy(group, "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    one = one.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("x"))  # a group's cells, as many as the terms ask for
    names = ["+".join(f"{j}:{d}" for j, d in zip(*t, strict=True)) for t in terms]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            theta = []
            for n, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                A, rest = np.zeros((m, m)), np.array(x) / max(n, 1)
                A[np.triu_indices(m)] = rest[: m * (m + 1) // 2]
                A += np.triu(A, 1).T
                theta.append(np.linalg.solve(A + strength * np.eye(m), rest[m * (m + 1) // 2 :]).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(theta, pa.list_(pa.float64()))], [group, "n", "theta"])

    kind = sums.schema[group].dataType.simpleString()
    solved = one.where("n > 0").select(group, "n", "x").mapInArrow(run, f"`{group}` {kind}, n bigint, theta array<double>")
    named = F.array(*map(F.lit, names))
    return solved.select(group, "n", F.posexplode("theta").alias("k", "theta")).select(group, named[F.col("k")].alias("term"), "n", "theta")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes what is new, then fits; the numbers of rows taken now and of the fit's rows."""
    terms = dictionary(len(config["columns"]), config["degree"], config["order"])
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    sums = f"{target}/sums"

    def add(batch: DataFrame, number: int) -> None:
        made = sums_of(batch, config, terms).withColumn("batch", F.lit(number))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sums)
        common.LOG.info("batch %d is in %s", number, sums)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    taken = sum(int(p["numInputRows"]) for p in query.recentProgress)
    common.LOG.info("read %s: %d new rows", source, taken)
    kind = schema[config["group"]].dataType.simpleString()
    try:
        every = spark.read.schema(f"`{config['group']}` {kind}, n bigint, skipped bigint, sums array<double>, batch bigint").parquet(sums)
    except AnalysisException:  # nothing has come yet
        return {"new_rows": taken, "fit": 0}
    with common.settings(spark, spark__sql__sources__partitionOverwriteMode="static"):
        return {"new_rows": taken, "fit": common.write(fit(every, config["group"], terms, config["strength"]), f"{target}/fit", config["group"])}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stream_fit", description=__doc__.splitlines()[0])
    parser.add_argument("--input", required=True, help="folder that Parquet files are added to, or a pattern with *")
    parser.add_argument("--output", required=True, help="folder of the tables")
    parser.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint")
    parser.add_argument("--config", default=str(CONFIG), help="JSON file")
    given = parser.parse_args(args)
    spark = common.session("stream_fit")
    try:
        run(spark, given.input, given.output, given.checkpoint, common.config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
