"""Shared folder tables, partition counts and Arrow helpers of the operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import resource
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skerry.llm import hashing


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (tests) gets one
    of our own; others raise RuntimeError, as each machine has a /tmp of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(root)
    return root


class Workspace:
    """Tables in the shared folder that cut lineage; they survive lost executors. Results read some of them, so they last
    until the application ends, when Hadoop's file system deletes the folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        small_batches(spark)

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back, so that later steps start from the files."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEAN_UP)
        conf.set(_CLEAN_UP, "true")  # the write's shuffle files go with it; later steps start from the table
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.set(_CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def weighed(self, df: DataFrame, name: str, weight: Column | None = None) -> tuple[DataFrame, int]:
        """settle, and the bytes in payload or else the sum of a column, which the write itself adds up."""
        seen = Observation()
        table = self.settle(df.observe(seen, F.sum(F.length("payload") if weight is None else weight).alias("bytes")), name)
        return table, int(seen.get["bytes"] or 0)

    def drop(self, *names: str, sweep: bool = True) -> None:
        """Delete tables that no later step reads, and let Spark clean the shuffle files of finished steps."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
        if sweep:
            self.sweep()

    def sweep(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster's owner sets for its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tasks_for(size: int, most: int, each: int = 4 << 20) -> int:
    """How many tasks to deal the `most` shards of so many bytes out to: each gets as many whole shards as any other, or one less."""
    shards = max(1, most // max(1, -(-size // each)))
    return -(-most // shards)


_BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that go to Python; rows alone don't, where texts are long. The session keeps the
    bound, as results are computed after the operator has returned."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > _BATCH_BYTES:
        spark.conf.set(key, str(_BATCH_BYTES))


#: Bytes that an idle Python worker may keep beyond what it had before its first task.
_LITTLE = 48 << 20
_fresh: list[int] = []


def resident() -> int:
    """Bytes of this process in memory; where the system doesn't tell, more than any bound."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()
    except OSError:
        return 1 << 62


def fresh() -> None:
    """Notes what a worker has before its first task."""
    if not _fresh:
        _fresh.append(resident())


def release() -> None:
    """Gives memory back, unless the worker holds little: collecting garbage takes longer than many a small task."""
    hashing.POWERS.clear()
    if resident() >= (_fresh[0] if _fresh else 0) + _LITTLE:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
            ctypes.CDLL(None).malloc_trim(0)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow that gives memory back at its end: Python workers are reused and live on while idle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        try:
            yield from fn(it)
        finally:
            release()

    return run


def lean(fn: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """fn for arrow_udf that gives memory back after each batch, as there is no end to wait for."""

    @functools.wraps(fn)
    def run(*columns: pa.Array) -> pa.Array:
        fresh()
        try:
            return fn(*columns)
        finally:
            release()

    return run


def bounded_sample(rows: DataFrame, hashed: str, order: list[str], count: int, most: int) -> DataFrame:
    """The first `most` rows by hash. Of `count` rows those with larger hashes are left out before the ordering, so that
    tasks don't each send `most` rows to the driver."""
    share = min(1.0, 1.2 * most / max(count, 1) + 0.001)
    near = F.pmod(F.col(hashed), F.lit(1 << 30)) < int(share * (1 << 30))
    return rows.where(near).orderBy(F.pmod(F.col(hashed), F.lit(1 << 30)), *order).limit(most)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string or binary column as bytes; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.binary() if not pa.types.is_large_string(col.type) else pa.large_binary()).to_pylist()]


def batches(schema: pa.Schema, rows: Iterable[tuple], most_rows: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from tuples."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, bytes | str))
        if len(held) >= most_rows or weight >= most_bytes:
            yield _batch(schema, held)
            held, weight = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
