"""A stopped and resumed stream of chains gives the rows of one window."""

import random

from pyspark.sql import functions as F

from skerry.operators import samples
from skerry.streaming import chains


def test_resumed_stream_equals_one_window(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "b", None]), k, rng.choice([True, False, None])) for k in range(400)]
    schema = "chain string, step int, ok boolean"
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        made = chains.rolling_share(stream, "chain", "step", "ok", 7)
        made.writeStream.format("parquet").option("checkpointLocation", marks).option("path", target).trigger(availableNow=True).start().awaitTermination()

    for low, high in ((0, 90), (90, 91), (91, 400)):  # runs with one to three new files
        for part in [rows[low:high]] if high - low < 100 else [rows[low : low + 100], rows[low + 100 : high]]:
            shuffled = rng.sample(part, len(part))
            spark.createDataFrame(shuffled, schema).coalesce(1).write.mode("append").parquet(source)
        run()
    run()  # nothing new
    got = sorted(map(tuple, spark.read.schema("chain string, step int, rate double").parquet(target).collect()), key=lambda r: r[1])
    whole = spark.createDataFrame(rows, schema).withColumn("ok", F.coalesce("ok", F.lit(False)))
    want = sorted(map(tuple, samples.rolling_share(whole, "chain", "step", "ok", 7).select("chain", "step", "rate").collect()), key=lambda r: r[1])
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want, strict=True))
