"""Score-matching statistics over a stream: each micro-batch adds to (n, A, b, C), which merge like partitions do."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skerry.functions.hermite import Index
from skerry.operators.scorematch import Stats, statistics


class Accumulator:
    """Statistics so far. They are saved beside the stream's checkpoint after each batch and loaded at the start, so a batch that
    comes again after a restart is not added twice, and none is lost."""

    def __init__(self, columns: list[str], indices: list[Index]):
        self.columns, self.indices = columns, indices
        self.stats: Stats | None = None
        self.seen = -1
        self.folder: str | None = None

    def add(self, batch: DataFrame, number: int) -> None:
        if number <= self.seen:
            return
        for part in statistics(batch, self.columns, self.indices).values():
            self.stats = part if self.stats is None else self.stats.merged(part)
        self.seen = number
        if self.folder:
            self.save(batch.sparkSession, self.folder)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        self.folder = f"{checkpoint}/sums"
        self.load(stream.sparkSession, self.folder)
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def save(self, spark: SparkSession, folder: str) -> None:
        """The sums of all batches up to the last, as a table of one row a matrix row."""
        if self.stats is None:
            return
        s = self.stats
        rows = [("A", k, [float(x) for x in r]) for k, r in enumerate(s.A)] + [("C", k, [float(x) for x in r]) for k, r in enumerate(s.C)] + [("b", 0, [float(x) for x in s.b]), ("n", 0, [float(s.n)])]
        spark.createDataFrame(rows, "part string, k int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{self.seen}")

    def load(self, spark: SparkSession, folder: str) -> None:
        """The sums of the last batch that was saved as a whole, if there is one."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return
        done = [int(f.getPath().getName()) for f in files.listStatus(path) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        if not done or max(done) <= self.seen:
            return
        self.seen = max(done)
        got: dict[str, dict[int, list[float]]] = {}
        for r in spark.read.parquet(f"{folder}/{self.seen}").collect():  # a row a matrix row
            got.setdefault(r.part, {})[r.k] = r.v
        matrix = lambda x: np.array([got[x][k] for k in sorted(got[x])])
        self.stats = Stats(int(got["n"][0][0]), matrix("A"), np.array(got["b"][0]), matrix("C"))


def windowed_moments(events: DataFrame, time: str, value: str, width: str, late: str) -> DataFrame:
    """window, n, mean, second moment of a value per tumbling window; rows later than the watermark are left out."""
    from pyspark.sql import functions as F

    v = F.col(value)
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.avg(v * v).alias("second"))
