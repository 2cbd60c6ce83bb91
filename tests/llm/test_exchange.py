"""Shared folders, task counts and tables of a workspace."""

import pytest
from pyspark.sql import functions as F

from skerry.llm import exchange
from skerry.llm.packs import PACK_SCHEMA, by_shard, dump, load


def test_tasks_get_whole_shards_evenly():
    for size in (0, 1, 5 << 20, 90 << 20, 1 << 40):
        for shards in (1, 7, 51, 211):
            tasks = exchange.tasks_for(size, shards)
            held = [len(range(k, shards, tasks)) for k in range(tasks)]
            assert 1 <= tasks <= shards and max(held) - min(held) <= 1 and (tasks == shards or size / tasks <= 4 << 20)


def test_shared_folder_is_needed_on_clusters(spark):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, getCheckpointDir = "local-cluster[2,1,1024]", staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        exchange.shared_dir(Session)
    assert exchange.shared_dir(spark)


def test_settle_tells_the_bytes(spark):
    space = exchange.Workspace(spark, "test")
    table, size = space.weighed(spark.range(100).select(F.col("id"), F.lit(b"12345").alias("payload")), "t")
    assert size == 500 and table.count() == 100
    _, none = space.weighed(spark.createDataFrame([], "payload binary"), "empty")
    assert none == 0


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_shards_come_one_by_one(spark, tasks):
    import pyarrow as pa

    rows = [(s, k % 2, dump(bytes([s, k]))) for s in range(8) for k in range(5)]
    df = spark.createDataFrame(rows, PACK_SCHEMA).repartition(6)
    seen = lambda shard, got: iter([(shard, [k for k, _ in got], sum(load(p)[0][1] for _, p in got))])
    schema = pa.schema([("shard", pa.int32()), ("kinds", pa.list_(pa.int32())), ("total", pa.int64())])
    got = by_shard(df, tasks, seen, "shard int, kinds array<int>, total bigint", schema).collect()
    assert sorted((r.shard, r.kinds, r.total) for r in got) == [(s, [0, 0, 0, 1, 1], 10) for s in range(8)]
