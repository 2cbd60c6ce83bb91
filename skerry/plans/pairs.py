"""Sums and nearest values over pairs of points that are near each other: blocks of a k-d tree against blocks.

The tree's planes are medians of a bounded sample, so its leaves hold about as many distinct points each; the sample decides
how even they are, never what is found. Equal centres are one point with a weight, so a group of copies is one point, too.
Rows are packed into blocks by leaf. Which leaves a block must meet is told by the boxes around them, at most a parameter's
number: a list of pairs that Spark joins with both sides' blocks. What a block of queries gets from the blocks of centres
is merged by block. No task holds more than two blocks and the queries' values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.plans.storage import bounded_batches, settle

BLOCK = 1024
#: Most leaves of a tree, and most points of the sample that its planes come from.
LEAVES = 1 << 12
SAMPLE = 1 << 16
_CELLS = 1 << 20
_PACKED = pa.schema([("leaf", pa.int32()), ("block", pa.int64()), ("rows", pa.binary()), ("points", pa.binary()), ("weights", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
_PACKED_SQL = "leaf int, block bigint, rows binary, points binary, weights binary, low array<double>, high array<double>"

#: Rows of numbers for the queries, from queries, centres and the centres' weights.
Values = Callable[..., np.ndarray]
Merge = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@dataclass
class Tree:
    """A complete binary tree in heap order: node k's points above the cut of its axis go to 2 k + 2, others to 2 k + 1."""

    axis: np.ndarray
    cut: np.ndarray
    depth: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.axis[node]] > self.cut[node])
        return (node - (1 << self.depth) + 1).astype(np.int32)


def build(sample: np.ndarray, leaves: int) -> Tree:
    """Medians of the widest axis, level by level."""
    depth = max(0, int(leaves - 1).bit_length())
    axis, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    held = {0: sample}
    for node in range(len(axis)):
        x = held.pop(node)
        if len(x) > 1:
            axis[node] = np.argmax(x.max(0) - x.min(0))
            cut[node] = np.median(x[:, axis[node]])
        above = x[:, axis[node]] > cut[node]
        held[2 * node + 1], held[2 * node + 2] = x[~above], x[above]
    return Tree(axis, cut, depth)


def weighted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of the columns, as doubles, and how often each is there (w_). Rows that aren't finite are left out."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("w_"))


def _at(batch: pa.RecordBatch, places: list[int]) -> np.ndarray:
    return np.stack([batch.column(p).to_numpy(zero_copy_only=False) for p in places], 1).astype(float)


def tree_of(df: DataFrame, columns: list[str], points: Callable[[np.ndarray], np.ndarray], leaves: int = LEAVES, block: int = BLOCK) -> Tree:
    """df: distinct rows. A leaf for each block of rows, up to `leaves`; the sample is the first by hash of what a bounded share leaves."""
    n = df.count()
    share = min(1.0, 1.2 * SAMPLE / max(n, 1) + 0.001)
    near = df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(share * (1 << 30))).select(*columns).limit(SAMPLE).toArrow()
    x = points(np.stack([near.column(c).to_numpy() for c in columns], 1).astype(float))
    return build(x[np.isfinite(x).all(1)], min(leaves, max(1, -(-n // block))))


def pack(df: DataFrame, columns: list[str], points: Callable[[np.ndarray], np.ndarray], tree: Tree, weight: str | None = None, keep: bool = True, block: int = BLOCK) -> DataFrame:
    """df in blocks by leaf, as a written table: rows (an Arrow stream; empty without keep), points and weights (doubles) and the
    box. Without keep, rows whose point isn't finite are left out; with keep they count as far away from all."""
    bounded_batches(df.sparkSession)
    names = df.columns
    places = [names.index(c) for c in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def leaf_of(b: pa.RecordBatch) -> np.ndarray:
        x = points(_at(b, places))
        return tree.leaf(np.where(np.isfinite(x), x, np.inf))

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << tree.depth, np.int64)
        for b in it:
            total += np.bincount(leaf_of(b), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["leaf", "n"])

    salts = np.ones(1 << tree.depth, np.int64)  # a leaf of very many rows is dealt out by their hash
    if keep:
        for r in df.mapInArrow(counted, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # a row a leaf
            salts[r.leaf] = -(-r.n // (16 * block))

    def leaves(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            leaf = leaf_of(b)
            salt = b.column(len(names)).to_numpy() % salts[leaf]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(leaf), pa.array(salt)], [*names, "leaf_", "salt_"])

    def packed(number: int, leaf: int, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        at = points(_at(t, places))
        w = _at(t, [names.index(weight)])[:, 0] if weight else np.ones(len(at))
        good = np.isfinite(at).all(1)
        sink = pa.BufferOutputStream()
        if keep:
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_batch(t)
        else:
            at, w = at[good], w[good]
            if not len(at):
                return None
        box = at[np.isfinite(at).all(1)] if keep else at
        ends = (box.min(0), box.max(0)) if len(box) else (np.full(at.shape[1], np.inf),) * 2
        row = (leaf, number, sink.getvalue().to_pybytes(), np.ascontiguousarray(at).tobytes(), w.tobytes(), *ends)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PACKED, strict=True)], schema=_PACKED)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, now = TaskContext.get().partitionId() << 32, [], 0, None
        for b in it:
            leaf = b.column(len(names)).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            rows = b.select(names)
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if held and leaf[low] != now:
                    if (made := packed(number, now, held)) is not None:
                        yield made
                    number, held, n = number + 1, [], 0
                now = int(leaf[low])
                while low < high:
                    part = rows.slice(low, min(high - low, block - n))
                    held.append(part)
                    low, n = low + part.num_rows, n + part.num_rows
                    if n == block:
                        if (made := packed(number, now, held)) is not None:
                            yield made
                        number, held, n = number + 1, [], 0
        if held and (made := packed(number, now, held)) is not None:
            yield made

    parts = _partitions(df.sparkSession)
    sent = df.withColumn("hash_", F.xxhash64(*names)).mapInArrow(leaves, f"{schema}, leaf_ int, salt_ bigint")
    sent = sent.repartition(parts, "leaf_", "salt_").sortWithinPartitions("leaf_", "salt_")
    return settle(sent.mapInArrow(run, _PACKED_SQL))


def boxes(blocks: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """leaf, low and high of each leaf that has blocks: as many rows as a tree has leaves."""
    ends = blocks.groupBy("leaf").agg(*(F.min(F.col("low")[j]).alias(f"l{j}") for j in range(d)), *(F.max(F.col("high")[j]).alias(f"h{j}") for j in range(d))).toArrow()
    x = np.stack([ends.column(c).to_numpy() for c in ends.column_names[1:]], 1).astype(float) if ends.num_rows else np.zeros((0, 2 * d))
    return ends.column("leaf").to_numpy(), x[:, :d], x[:, d:]


def near_leaves(blocks: DataFrame, centres: DataFrame, d: int, reach: float) -> DataFrame:
    """block, other: for each block the leaves of centres whose boxes are no further from its own box than the reach. The boxes
    of the centres' leaves go to the tasks: at most LEAVES of them."""
    other, below, above = boxes(centres, d)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k, lo, hi in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                gap = np.maximum(np.maximum(below - np.array(hi), np.array(lo) - above), 0.0)
                yield _met(k, other[np.nan_to_num((gap**2).sum(1), nan=np.inf) <= reach * reach])

    return settle(blocks.select("block", "low", "high").mapInArrow(run, "block bigint, other int"))


def reached_leaves(blocks: DataFrame, far: DataFrame, centres: DataFrame, d: int) -> DataFrame:
    """block, other: for each block the leaves of centres, but its own, that a point's ball reaches. far: block and value, whose
    rows' largest numbers are the points' squared radii."""
    other, below, above = boxes(centres, d)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k, leaf, points, width, value in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                x, r = np.frombuffer(points).reshape(-1, d), np.frombuffer(value).reshape(-1, width).max(1)
                step, met = max(1, _CELLS // max(1, len(x) * d)), np.zeros(len(other), bool)
                for at in range(0, len(other), step):
                    gap = np.maximum(np.maximum(below[at : at + step] - x[:, None], x[:, None] - above[at : at + step]), 0.0)
                    met[at : at + step] = ((gap**2).sum(2) <= r[:, None] * (1 + 1e-12)).any(0)
                yield _met(k, other[met & (other != leaf)])

    return settle(blocks.select("block", "leaf", "points").join(far, "block").select("block", "leaf", "points", "width", "value").mapInArrow(run, "block bigint, other int"))


def _met(block: int, others: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(others), block), pa.int64()), pa.array(others, pa.int32())], ["block", "other"])


def over_pairs(queries: DataFrame, centres: DataFrame, near: DataFrame, d: int, values: Values, merge: Merge, known: DataFrame | None = None) -> DataFrame:
    """block, width, value: for each block of queries, values(queries, centres, weights) of the blocks of centres in the leaves that
    `near` has for it, merged. Values have a row of `width` numbers a query; they are asked for in slices, so that a slice times a block
    has about a million cells. A block without near centres has no row. known: values by block that are there already; `values` gets
    the queries' as a fourth argument."""
    spark = queries.sparkSession
    bounded_batches(spark)
    parts = _partitions(spark)

    def merged(pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for number, value in pairs:
            if number != now and total is not None:
                yield _value(now, total)
                total = None
            now, total = number, value if total is None else merge(total, value)
        if total is not None:
            yield _value(now, total)

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, np.ndarray]]:
            for b in it:
                for r, number in enumerate(b.column(0).to_pylist()):
                    x, y = (np.frombuffer(b.column(c)[r].as_buffer()).reshape(-1, d) for c in (1, 2))
                    w, more = np.frombuffer(b.column(3)[r].as_buffer()), [np.frombuffer(c[r].as_buffer()).reshape(len(x), -1) for c in b.columns[4:]]
                    step = max(1, _CELLS // max(1, len(y)))
                    yield number, np.concatenate([values(x[k : k + step], y, w, *(v[k : k + step] for v in more)) for k in range(0, max(1, len(x)), step)])

        yield from merged(found())

    def again(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, np.ndarray]]:
            for b in it:
                for number, shape, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    yield number, np.frombuffer(v.as_buffer()).reshape(-1, shape)

        yield from merged(found())

    asked = queries.select("block", "points") if known is None else queries.select("block", "points").join(known.select("block", F.col("value").alias("known")), "block")
    met = asked.join(near, "block").join(centres.select(F.col("leaf").alias("other"), F.col("points").alias("centres"), "weights"), "other")
    schema = "block bigint, width int, value binary"
    first = met.select("block", "points", "centres", "weights", *([] if known is None else ["known"])).mapInArrow(meet, schema)
    return first.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(again, schema)


def merge_values(one: DataFrame, other: DataFrame, merge: Merge) -> DataFrame:
    """The values of two such tables by block, merged where both have the block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for number, width, v, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                x = np.frombuffer(v.as_buffer()).reshape(-1, width)
                yield _value(number, merge(x, np.frombuffer(u.as_buffer()).reshape(-1, width)) if u.is_valid else x)

    return one.join(other.select("block", F.col("value").alias("more")), "block", "left").select("block", "width", "value", "more").mapInArrow(run, "block bigint, width int, value binary")


def _value(number: int, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([value.shape[1]], pa.int32()), pa.array([np.ascontiguousarray(value).tobytes()], pa.binary())], ["block", "width", "value"])


def unpack(value: pa.Scalar) -> list[pa.RecordBatch]:
    """The record batches of a block's rows."""
    return pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks().to_batches()
