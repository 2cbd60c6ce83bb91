"""Best-fit packing: hierarchical residual packing of token pieces into sequences.

Each partition packs its pieces best-fit in decreasing length and emits bins that are nearly full. The others become items
of the next round, in fewer partitions, where they are packed again as wholes. The last round works on counts: bins of
equal fill are alike, so a plan over at most `capacity` fills says how many bins of which fills join, and row numbers
within a fill, dealt out by prefix sums over hash slices, tell each bin its place. So no task holds all bins.

Defined results: null text is empty and makes one piece of the end token. Null or repeated doc_id: every row is packed. Pieces
of equal length are taken in the order in which they come, and of bins with equal room the first that is found.
Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.exchange import Workspace, batches, partitions, tidy

#: How byte-level vocabularies split text before merging, and the bytes that stand for themselves in them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = (*range(33, 127), *range(161, 173), *range(174, 256))


def byte_ranks(vocabulary: dict[str, int], special: set[str]) -> dict[bytes, int]:
    """The vocabulary's byte strings with their ids, which are the merge order."""
    hidden = [b for b in range(256) if b not in PRINTED]
    byte_of = {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}


class Encoder:
    """Ids of a byte-level tokenizer file as little-endian unsigned 32-bit numbers.

    Merging runs over the file's ranks. Texts of other scripts, and texts with one of the file's special strings, go to
    the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.special = {t["content"] for t in held["added_tokens"]}
        self.merged = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=byte_ranks(held["model"]["vocab"], self.special), special_tokens={})

    def whole(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if (not text.isascii() and max(text) > "ɏ") or any(s in text for s in self.special):
            return self.whole(text)
        return self.merged.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """piece, start, length, crc32; the first piece is the shorter one."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    cuts = [0, *range(first, n + 1, capacity)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        yield k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("place", pa.int64()), ("fill", pa.int64())])
_PIECE_SQL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, place bigint, fill bigint"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items by bin: in decreasing length, each into the fullest bin that has room."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    free: list[int] = []  # rooms with a bin, ascending
    for k in order:
        n = lengths[k]
        at = bisect.bisect_left(free, n)
        if at == len(free):
            b, left = len(bins), capacity
            bins.append([])
        else:
            left = free[at]
            b = room[left].pop()
            if not room[left]:
                free.pop(at)
        bins[b].append(k)
        left -= n
        if left:
            if not room[left]:
                bisect.insort(free, left)
            room[left].append(b)
    return bins


def _first_round(docs: DataFrame, path: str, end: int, capacity: int, most: int = 20_000) -> DataFrame:
    """Pieces with a bin of their own partition, their place in it and the bin's fill."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, tail = Encoder(path), np.array([end], "<u4").tobytes()
        names = itertools.count(TaskContext.get().partitionId() << 40)

        def binned(held: list[tuple]) -> Iterator[tuple]:
            for members in best_fit([h[3] for h in held], capacity):
                name, at, fill = next(names), 0, sum(held[k][3] for k in members)
                for k in members:
                    yield *held[k], name, at, fill
                    at += held[k][3]

        def out() -> Iterator[tuple]:
            held: list[tuple] = []
            for b in it:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for piece in pieces_of(encode(text or "") + tail, capacity):
                        held.append((doc, *piece))
                if len(held) >= most:
                    yield from binned(held)
                    held = []
            yield from binned(held)

        yield from batches(_PIECE, out())

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), _PIECE_SQL)


_MOVE = pa.schema([("bin", pa.int64()), ("to", pa.int64()), ("shift", pa.int64()), ("fill", pa.int64())])
_MOVE_SQL = "bin bigint, to bigint, shift bigint, fill bigint"


def _next_round(bins: DataFrame, parts: int, capacity: int, most: int = 50_000) -> DataFrame:
    """bins: bin, fill. Each bin's place in a bin that best-fit packing of whole bins makes, and that bin's fill."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def moved(held: list[tuple[int, int]]) -> Iterator[tuple]:
            held.sort()
            for members in best_fit([h[1] for h in held], capacity):
                at, fill = 0, sum(held[k][1] for k in members)
                for k in members:
                    yield held[k][0], held[members[0]][0], at, fill
                    at += held[k][1]

        def out() -> Iterator[tuple]:
            held: list[tuple[int, int]] = []
            for b in it:
                held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                if len(held) >= most:
                    yield from moved(held)
                    held = []
            yield from moved(held)

        yield from batches(_MOVE, out())

    return bins.select("bin", "fill").repartition(parts, F.xxhash64("bin")).mapInArrow(tidy(run), _MOVE_SQL)


def plan_by_fill(count: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit packing of bins that are alike by fill: fills that share a sequence, and how many such sequences."""
    left = Counter({f: n for f, n in count.items() if n})
    plan: list[tuple[list[int], int]] = []
    fills = sorted(left)
    while fills:
        members, room = [], capacity
        trial = Counter()
        while True:
            at = bisect.bisect_right(fills, room) - 1
            while at >= 0 and left[fills[at]] <= trial[fills[at]]:
                at -= 1
            if at < 0:
                break
            f = fills[at]
            members.append(f)
            trial[f] += 1
            room -= f
        times = min(left[f] // k for f, k in trial.items())
        plan.append((members, times))
        for f, k in trial.items():
            left[f] -= k * times
        fills = [f for f in fills if left[f]]
    return plan


def _last_round(spark, bins: DataFrame, capacity: int, slices: int) -> DataFrame:
    """Moves of the plan over the fills: at most `capacity` of them, whatever the number of bins."""
    slice_ = F.pmod(F.xxhash64("bin"), F.lit(slices)).cast("int")
    counts = bins.groupBy("fill", slice_.alias("slice")).agg(F.count("*").alias("n"))
    total = {r.fill: r.n for r in counts.groupBy("fill").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    if not total:
        return spark.createDataFrame([], _MOVE_SQL)
    rows, used, sequence = [], Counter(), 0
    for members, times in plan_by_fill(total, capacity):
        at = 0
        for slot, f in enumerate(members):
            # The slot takes `times` bins of this fill: those numbered from used[f], one for each of the plan's sequences.
            rows.append((f, used[f], used[f] + times, sequence - used[f], at, sum(members)))
            used[f] += times
            at += f
        sequence += times
    plan = spark.createDataFrame(rows, "fill bigint, first bigint, last bigint, step bigint, shift bigint, total bigint")
    from pyspark.sql import Window

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("fill").orderBy("slice")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("fill", "slice").orderBy("bin")) - 1
    numbered = bins.withColumn("slice", slice_).withColumn("number", number).join(before, ["fill", "slice"]).withColumn("number", F.col("number") + F.col("before"))
    placed = numbered.join(F.broadcast(plan), "fill").where("number >= first and number < last")  # the plan: at most a few rows a fill
    return placed.select("bin", (-1 - F.col("number") - F.col("step")).alias("to"), "shift", F.col("total").alias("fill"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, slack: int = 8, fan_in: int = 8) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs(doc_id, text).

    tokenizer: path of a byte-level tokenizer file. end: id after each document. slack: free tokens up to which a bin is
    nearly full. fan_in: partitions of a round that feed one of the next.
    """
    spark = docs.sparkSession
    space, parts = Workspace(spark, "packing"), partitions(spark)
    pieces = space.settle(_first_round(docs, tokenizer, end, capacity), "pieces")
    bins = pieces.where(F.col("fill") < capacity - slack).select("bin", "fill").distinct()
    moves = None
    width = parts
    k = 0
    while width > 1:
        width = -(-width // fan_in)
        step = space.settle(_next_round(bins, width, capacity), f"round{k}")
        moves = step if moves is None else space.settle(_follow(moves, step), f"moves{k}")
        bins = step.where(F.col("fill") < capacity - slack).select(F.col("to").alias("bin"), "fill").distinct()
        k += 1
    last = space.settle(_last_round(spark, bins, capacity, 4 * parts), "last")
    moves = last if moves is None else _follow(moves, last)
    out = pieces.join(moves.select("bin", "to", "shift"), "bin", "left")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("to", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def _follow(moves: DataFrame, step: DataFrame) -> DataFrame:
    """Moves carried on by a later step."""
    onward = step.select(F.col("bin").alias("to"), F.col("to").alias("to_"), F.col("shift").alias("shift_"))
    carried = moves.join(onward, "to", "left")
    return carried.select("bin", F.coalesce("to_", "to").alias("to"), (F.col("shift") + F.coalesce("shift_", F.lit(0))).alias("shift"), "fill")
