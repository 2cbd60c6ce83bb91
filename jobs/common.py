"""What the jobs share: config files, the log, and settings that are put back."""

from __future__ import annotations

import contextlib
import json
import logging
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("jobs")


def config(path: str | Path) -> dict:
    """A JSON file beside the command."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (two underscores for a dot) for a while."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(df: DataFrame, path: str, partition: str) -> int:
    """Overwrite the table at path, a folder by value of the partition column; the rows are counted by the write itself."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy(partition).parquet(path)
    rows = int(seen.get["rows"])
    LOG.info("wrote %s: %d rows, by %s", path, rows, partition)
    return rows


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
