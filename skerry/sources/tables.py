"""Result cells, sorted pools and cached tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from skerry.operators.ranks import not_sorted


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))


def materialise(make, spark: SparkSession, path: str) -> DataFrame:
    """The table at path, made first if it isn't there as a whole."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_cells(cells: DataFrame, path: str, partitions: list[str]) -> None:
    cells.write.mode("append").partitionBy(*partitions).parquet(path)


def read_cells(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Finished cells; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def sorted_pool(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    """coord, place, x: every column sorted, as range partitions of the long form."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("coord"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")).select("p.*")
    long.repartitionByRange(parts, "coord", "x").sortWithinPartitions("coord", "x").withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def check_pool(pool: DataFrame, rows: int) -> DataFrame:
    """coord, n, drops, spread and ok: all rows there, in order and not all alike."""
    return not_sorted(pool, "coord", "place", "x").withColumn("ok", (F.col("n") == rows) & (F.col("drops") == 0) & (F.col("spread") > 0))
