"""Written tables that cut lineage, and distributed running totals."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local master (tests) gets a folder of our own and others an error, as
    each machine of a cluster has a /tmp of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(root)
    return root


_BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, for rows that hold a whole block. The session keeps the bound, as results are
    computed after the operator has returned."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > _BATCH_BYTES:
        spark.conf.set(key, str(_BATCH_BYTES))


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back. The table goes when the application ends."""
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(name)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by equal keys where null equals null; the right side's keys are left out."""
    renamed = right.select(*(F.col(c).alias(f"right_{c}_") if c in keys else F.col(c) for c in right.columns))
    met = F.lit(True)
    for c in keys:
        met = met & F.col(c).eqNullSafe(F.col(f"right_{c}_"))
    return left.join(renamed, met, how).drop(*(f"right_{c}_" for c in keys))


def running_total(df: DataFrame, order: list[str], amount: str, name: str = "upto", group: list[str] | None = None) -> DataFrame:
    """Adds the running sum of `amount` in the given order, in each group if there are any, without a single-task window.

    Rows are range-partitioned; each partition's total (one row a partition and group) gives the next ones their start.
    """
    group = group or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(parts, *group, *order).withColumn("part_", F.spark_partition_id()))
    totals = ranged.groupBy("part_", *group).agg(F.sum(amount).alias("sum_"))
    before = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = totals.select("part_", *group, F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("start_"))
    inside = Window.partitionBy("part_", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_null_safe(ranged, F.broadcast(starts) if not group else starts, ["part_", *group])
    return joined.withColumn(name, F.col("start_") + F.sum(amount).over(inside)).drop("part_", "start_")
