"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skerry.llm.exchange import Workspace

MOST_ROUNDS = 60


def components(edges: DataFrame, space: Workspace, label: str) -> DataFrame:
    """Columns node, root (bigint): root is the smallest node of the component. edges: a, b (bigint).

    Each round aggregates the smallest neighbour map-side and joins it back; a round's edges are written to the
    shared folder, so lineage stays short. Self-loops, repeated and reversed edges are allowed; nulls are dropped.
    An empty table gives an empty table. The rounds end when the edges stay as they are, which the write itself counts.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    now, mark = _marked(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), space, f"{label}0")
    before = None
    for k in range(1, MOST_ROUNDS):
        if mark == before or mark["n"] == 0:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, mark = _marked(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), space, f"{label}{k}")
        space.drop(f"{label}{k - 1}", sweep=False)
    else:
        raise RuntimeError("components did not settle")
    space.sweep()
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _marked(edges: DataFrame, space: Workspace, name: str) -> tuple[DataFrame, dict]:
    """The edges as a table, and their number and sum of hashes."""
    seen = Observation()
    table = space.settle(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name)
    return table, seen.get
