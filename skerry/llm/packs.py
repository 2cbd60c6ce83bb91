"""Texts packed by shard, and look-ups of what other shards hold about their items.

A shard is a fixed share of the rows (a hash of the row's key). Each shard asks once for each distinct item it has, so
an item of every row still costs one request a shard, and no task ever holds all rows of an item.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.exchange import batches, tidy

PACK_SCHEMA = "shard int, kind int, payload binary"
_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_CHUNK = 8 << 20


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each in a worker: making them takes longer than a small message."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def dump(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed byte string."""
    heads, bodies = [len(arrays).to_bytes(2, "little")], []
    for a in arrays:
        kind = b"b   " if isinstance(a, bytes) else a.dtype.str.encode().ljust(4)
        body = a if isinstance(a, bytes) else a.tobytes()
        heads.append(kind + len(body).to_bytes(8, "little"))
        bodies.append(body)
    return _zstd()[0].compress(b"".join(heads + bodies))


def load(payload: bytes) -> list:
    raw = _zstd()[1].decompress(payload, max_output_size=1 << 31) if payload else b"\0\0"
    n, at = int.from_bytes(raw[:2], "little"), 2
    heads = [(raw[at + 12 * k : at + 12 * k + 4].strip().decode(), int.from_bytes(raw[at + 12 * k + 4 : at + 12 * k + 12], "little")) for k in range(n)]
    at += 12 * n
    out = []
    for kind, size in heads:
        out.append(raw[at : at + size] if kind == "b" else np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def pack(rows: DataFrame, longs: list[str], valid: Callable[[list[list[int]], list[bytes]], list[bool]] | None = None) -> DataFrame:
    """rows: shard, the named bigint columns, text. Returns PACK_SCHEMA rows of kind 0, many rows of a shard in each.

    valid: which rows of a batch to keep, from the columns and the texts.
    """

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            held: dict[int, list] = {}
            weight = 0
            for b in it:
                shards, texts, *columns = (b.column(k).to_pylist() for k in range(2 + len(longs)))
                texts = [x or b"" for x in texts]
                kept = valid(columns, texts) if valid else [True] * len(texts)
                for shard, text, keep, *values in zip(shards, texts, kept, *columns, strict=True):
                    if not keep:
                        continue
                    held.setdefault(shard, []).append((values, text))
                    weight += len(text) + 64
                    if weight >= _CHUNK:
                        yield from flush(held)
                        held, weight = {}, 0
            yield from flush(held)

        def flush(held: dict[int, list]) -> Iterator[tuple]:
            for shard, docs in held.items():
                columns = [np.array([d[0][k] for d in docs], np.int64) for k in range(len(longs))]
                yield shard, 0, dump(np.array([len(d[1]) for d in docs], np.int64), *columns, b"".join(d[1] for d in docs))

        yield from batches(_ARROW, out())

    return rows.select("shard", F.col("text").cast("binary").alias("text"), *longs).mapInArrow(tidy(packed), PACK_SCHEMA)


def unpack(payload: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    """The bigint columns and the texts of one pack."""
    lengths, *columns, blob = load(payload)
    ends = np.cumsum(lengths)
    return columns, [blob[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def by_shard(df: DataFrame, tasks: int, fn: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple]], schema: str, arrow: pa.Schema, key: str = "shard") -> DataFrame:
    """fn(shard, [(kind, payload), ...]) over each shard's rows. Shards are dealt out evenly to the tasks; a task takes its
    shards one after the other, so many shards of little data need not cost a task each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in it:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)

        for s, group in groupby(rows(), key=lambda row: row[0]):
            yield from batches(arrow, fn(s, sorted(((k, p) for _, k, p in group), key=lambda x: x[0])))

    dealt = df.select(key, "kind", "payload").repartitionById(tasks, (F.col(key) % tasks).cast("int"))
    return dealt.sortWithinPartitions(key).mapInArrow(tidy(run), schema)


def chunks(rows: list[tuple[int, bytes]], most: int = 1 << 20) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """The shard's documents, a bounded number of bytes at a time (one document at least)."""
    for kind, payload in rows:
        if kind:
            continue
        columns, texts = unpack(payload)
        at = 0
        while at < len(texts):
            end, weight = at, 0
            while end < len(texts) and (end == at or weight + len(texts[end]) <= most):
                weight += len(texts[end])
                end += 1
            yield [c[at:end] for c in columns], texts[at:end]
            at = end
