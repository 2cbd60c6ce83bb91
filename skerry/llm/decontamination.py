"""Benchmark decontamination by Wu-Manber search for all windows of the benchmark's words.

Texts are brought into one form, lower-case words between single spaces, so that a window of words is found where its bytes
are. Windows are sorted into classes by length. A class has a table of shifts by the hash of a block of bytes: how far the end
of a candidate may move on before it can be the end of some pattern's first m bytes, m being the shortest length of the
class. Where the shift is 0, the hash of that last block and the first bytes select the few patterns that may stand here;
their lengths ask for one hash each, and the bytes themselves are compared. The texts of a batch are searched in many lanes
at once, each over a stretch of its own, by numpy.

The benchmark is read in blocks of bounded bytes, one where it is small. Each block's tables are broadcast and its patterns
searched in all documents; with more than one block, what they found is put together by row. So neither the broadcast nor a
task grows with the benchmark, and none of it depends on how often a window is hit.

Defined results: null text has no words and no hits; an item without words has no windows. An item of fewer words than the
window is one window. Items with equal ids are one item; a null id is searched, too, but has no name to list. Equal windows
of several items count for all of them. Null and repeated doc_id: each row is a row of its own. Empty documents: empty result;
empty benchmark: nothing is hit. Columns beside those named play no part; `carry` returns them as a struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.exchange import small_batches
from skerry.llm.fill_middle import texts_of
from skerry.llm.hashing import mix, prefix_sums, span_hashes
from skerry.plans.storage import running_total

_SPACE, _END = 0x20, 0x0A
#: Each byte as it stands in the form searched: word characters in lower case, all others as a space.
_FORM = np.full(256, _SPACE, np.uint8)
_FORM[0x30:0x3A], _FORM[0x61:0x7B], _FORM[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASSES = np.array([1, 8, 16, 32])  # classes of patterns begin at these lengths
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LANE = 512
_AT_ONCE = 1 << 20


@dataclass
class Words:
    """Texts, or a piece of one, as lower-case words between single spaces, with a line end after each text."""

    line: np.ndarray
    space: np.ndarray  # where the space before each word lies in line
    after: np.ndarray  # and the one after it
    upto: np.ndarray  # words up to each text's end
    texts: np.ndarray  # which texts of the batch these are
    base: int = 0  # words of the text before the first one here
    fresh: int = 0  # words at the beginning that an earlier piece had too

    def owner(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.upto, word, "right")


def words_of(data: np.ndarray, ends: np.ndarray, texts: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of the texts that end at the given places in data, and where each begins there (of a single text)."""
    raw = np.insert(_FORM[data], ends, _END)
    word, end = raw > _SPACE, raw == _END
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    at = np.cumsum(word + starts.view(np.int8) + 2 * end.view(np.int8), dtype=np.int64)  # each word and each end has a space before it
    line = np.full(int(at[-1]) if len(at) else 0, _SPACE, np.uint8)
    line[at[word] - 1] = raw[word]
    line[at[end] - 1] = _END
    begins, stops = np.flatnonzero(starts), np.flatnonzero(end)
    space, upto = at[begins] - 2, np.searchsorted(begins, stops)
    after = np.append(space[1:], 0)
    full = np.diff(upto, prepend=0) > 0
    after[upto[full] - 1] = at[stops[full]] - 2
    return Words(line, space, after, upto, texts), begins


def parts(data: np.ndarray, offsets: np.ndarray, overlap: int, most: int = _AT_ONCE) -> Iterator[Words]:
    """The texts' words, of so many bytes of texts at a time. A longer text comes in pieces that share `overlap` words."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        if offsets[end] - offsets[at] <= most:
            yield words_of(data[offsets[at] : offsets[end]], offsets[at + 1 : end + 1] - offsets[at], np.arange(at, end))[0]
        else:
            yield from _pieces(data[offsets[at] : offsets[end]], at, overlap, most)
        at = end


def _pieces(data: np.ndarray, text: int, overlap: int, most: int) -> Iterator[Words]:
    low = base = fresh = 0
    size = most
    while True:
        high = low + size
        while high < len(data) and _FORM[data[high]] != _SPACE:  # up to the end of a word
            high += int(np.argmax(np.append(_FORM[data[high : high + 4096]] == _SPACE, True)))
        high = min(high, len(data))
        found, begins = words_of(data[low:high], np.array([high - low]), np.array([text]))
        if high < len(data) and len(begins) <= overlap:  # very long words
            size *= 2
            continue
        found.base, found.fresh = base, fresh
        yield found
        if high == len(data):
            return
        size, fresh = most, overlap
        base += len(begins) - overlap
        low += int(begins[len(begins) - overlap]) if overlap else high - low


def blocks_at(line: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros after the end."""
    padded = np.concatenate((line, np.zeros(8, np.uint8)))
    return np.ndarray((len(line) + 1,), "<u8", padded, strides=(1,))


def low_bytes(count: int) -> np.uint64:
    return np.uint64((1 << 8 * count) - 1)


class Machine:
    """Wu-Manber tables for the patterns of a class of lengths."""

    def __init__(self, blob: np.ndarray, starts: np.ndarray, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray, shortest: int):
        self.m = shortest
        self.width = min(8, max(2, shortest // 3))  # bytes of a block
        self.order = np.argsort(hashes)
        self.hashes, self.ids = hashes[self.order], ids[self.order]
        self.counts = np.unique(counts).tolist()
        wide = blocks_at(blob)
        places = len(starts) * (self.m - self.width + 1)
        self.bits = np.uint64(64 - min(24, max(12, int(8 * places - 1).bit_length())))
        self.shift = np.full(1 << (64 - int(self.bits)), self.m - self.width + 1, np.uint16)
        for last in range(self.width - 1, self.m):  # later blocks of the first m bytes, with smaller shifts, win
            self.shift[self.slot(wide[starts + (last - self.width + 1)])] = self.m - 1 - last
        self.keys = np.unique(self.key(wide, starts))

    def slot(self, block: np.ndarray) -> np.ndarray:
        return ((block & low_bytes(self.width)) * _MUL) >> self.bits

    def key(self, wide: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Selects patterns by the last block of the first m bytes and by the first bytes."""
        return mix((wide[starts + (self.m - self.width)] & low_bytes(self.width)) * _MUL + mix(wide[starts] & low_bytes(min(8, self.m))))

    def candidates(self, wide: np.ndarray, size: int) -> np.ndarray:
        """Starts in the line where a pattern's last block and first bytes stand."""
        ends = np.arange(self.m - 1, size, _LANE)  # a lane's next end of the first m bytes
        limit = np.minimum(ends + _LANE, size)
        back, found = self.width - 1, []
        while len(ends):
            step = self.shift[self.slot(wide[ends - back])]
            found.append(ends[step == 0])
            ends = ends + np.maximum(step, 1)
            alive = ends < limit
            ends, limit = ends[alive], limit[alive]
        starts = np.concatenate(found) - (self.m - 1) if found else np.zeros(0, np.int64)
        return starts[_among(self.keys, self.key(wide, starts))[1]]


def _among(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted known values, and whether the asked ones are there."""
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    return at, known[at] == asked if len(known) else np.zeros(len(asked), bool)


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[at:at + length] and b[bt:bt + length] are equal, pair by pair."""
    out, low = np.ones(len(at), bool), 0
    upto = np.cumsum(lengths)
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + _AT_ONCE, "right")))
        n = lengths[low:high]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = a[np.repeat(at[low:high], n) + inside] == b[np.repeat(bt[low:high], n) + inside]
        out[low:high] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        low = high
    return out


class Patterns:
    """The distinct windows of a block of items, the items of each, and the machines that find them."""

    def __init__(self, names: list[str | None], texts: pa.Array, width: int):
        self.width = width
        self.names = sorted({n for n in names if n is not None})
        number = {name: k for k, name in enumerate(self.names)} | {None: -1}
        named = np.array([number[n] for n in names], np.int64)
        lines, columns, size = [], [], 0
        for part in parts(*texts_of(texts), width - 1):
            first, last = _windows(part, width)
            start, length = part.space[first], part.after[last] + 1 - part.space[first]
            owner = named[part.texts[part.owner(first)]]
            columns.append(np.stack((start + size, length, last + 1 - first, owner, span_hashes(prefix_sums(part.line), start, start + length).view(np.int64))))
            lines.append(part.line)
            size += len(part.line)
        self.blob = np.concatenate(lines) if lines else np.zeros(0, np.uint8)
        start, length, count, owner, hashes = np.concatenate(columns, 1) if columns else np.zeros((5, 0), np.int64)
        hashes = np.ascontiguousarray(hashes).view(np.uint64)
        _, one, ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.start, self.length = start[one], length[one]
        pairs = np.unique(np.stack((ids, owner), 1)[owner >= 0], axis=0).reshape(-1, 2)
        self.items, self.items_upto = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
        kind = np.searchsorted(_CLASSES, self.length, "right")
        self.machines = [Machine(self.blob, self.start[of], hashes[one][of], of, count[one][of], int(self.length[of].min())) for of in (np.flatnonzero(kind == k) for k in np.unique(kind))]

    def find(self, part: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words in the part, numbers of words, and patterns of all occurrences."""
        wide, sums, out = blocks_at(part.line), None, [np.zeros((3, 0), np.int64)]
        for machine in self.machines:
            starts = machine.candidates(wide, len(part.line))
            word, exact = _among(part.space, starts)
            word = word[exact]
            if not len(word):
                continue
            sums = prefix_sums(part.line) if sums is None else sums
            limit = part.upto[part.owner(word)]
            for count in machine.counts:
                first = word[word + count <= limit]
                begin, stop = part.space[first], part.after[first + (count - 1)] + 1
                at, known = _among(machine.hashes, span_hashes(sums, begin, stop))
                pattern, first, begin, stop = machine.ids[at[known]], first[known], begin[known], stop[known]
                fits = np.flatnonzero(self.length[pattern] == stop - begin)
                fits = fits[same_bytes(part.line, begin[fits], self.blob, self.start[pattern[fits]], (stop - begin)[fits])]
                out.append(np.stack((first[fits], np.full(len(fits), count), pattern[fits])))
        first, count, pattern = np.concatenate(out, 1)
        return first, count, pattern

    def search(self, texts: pa.Array) -> pa.Array:
        """For each text the number of words, the runs of hit words and the names of the items they are from."""
        n = len(texts)
        n_words, hits = np.zeros(n, np.int64), [np.zeros((4, 0), np.int64)]
        for part in parts(*texts_of(texts), self.width - 1):
            n_words[part.texts] += np.diff(part.upto, prepend=0) - part.fresh
            first, count, pattern = self.find(part)
            owner = part.owner(first)
            before = np.where(owner > 0, part.upto[owner - 1], 0) - part.base
            hits.append(np.stack((part.texts[owner], first - before, first - before + count, pattern)))
        text, first, last, pattern = np.concatenate(hits, 1)
        pairs = np.unique(np.stack((text, pattern), 1), axis=0).reshape(-1, 2)
        many = self.items_upto[pairs[:, 1] + 1] - self.items_upto[pairs[:, 1]]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        of, item = np.unique(np.stack((np.repeat(pairs[:, 0], many), self.items[np.repeat(self.items_upto[pairs[:, 1]], many) + inside]), 1), axis=0).reshape(-1, 2).T
        names = pa.array(self.names, pa.string()).take(pa.array(item, pa.int64()))
        listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), names)
        return pa.StructArray.from_arrays([pa.array(n_words), runs_of(n, text, first, last), listed], ["n_words", "runs", "items"])


def _windows(part: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the windows of the part's texts; a shorter text is one window."""
    before = np.concatenate(([0], part.upto[:-1]))
    words = part.upto - before
    least = 0 if part.fresh else 1  # a later piece has only windows that are whole
    many = np.where(words > 0, np.maximum(words - width + 1, least), 0)
    first = np.repeat(before, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return first, np.minimum(first + width, np.repeat(part.upto, many)) - 1


def runs_of(n: int, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """By text, the maximal runs that the stretches from first to last cover."""
    order = np.lexsort((first, text))
    text, first, last = text[order], first[order], last[order]
    far = np.maximum.accumulate((text << 40) + last)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] << 40) + first[1:] > far[:-1]
    begin = np.flatnonzero(new)
    ends = far[np.append(begin[1:], len(far)) - 1] - (text[begin] << 40) if len(begin) else far
    run = pa.StructArray.from_arrays([pa.array(first[begin]), pa.array(ends)], ["first", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[begin], np.arange(n + 1)), pa.int32()), run)


_RUNS = "array<struct<first:bigint,end:bigint>>"
_FOUND = f"struct<n_words:bigint,runs:{_RUNS},items:array<string>>"


def search_column(patterns: Broadcast) -> Column:
    @F.arrow_udf(_FOUND)
    def search(text: pa.Array) -> pa.Array:
        return patterns.value.search(text)

    return search(F.col("text_"))


def merged(runs: Column) -> Column:
    """Runs of several blocks put together."""

    @F.arrow_udf(_RUNS)
    def merge(runs: pa.Array) -> pa.Array:
        text = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        flat = runs.flatten()
        return runs_of(len(runs), text, flat.field("first").to_numpy(), flat.field("end").to_numpy())

    return merge(runs)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20, carry: bool = False) -> DataFrame:
    """key, n_words, n_hit (words in occurrences), runs of hit words (first, end), items (ids with occurrences, as strings in
    order) for every row; with carry also the input row as struct row_.

    block_bytes: bytes of benchmark texts searched at once; a block goes on while it has less, so it has one text more at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    listed = benchmark.select(F.col(item).cast("string").alias("name_"), F.coalesce(F.col(item_text), F.lit("")).alias("text_")).where("text_ <> ''")
    listed = listed.withColumn("bytes_", F.octet_length("text_").cast("bigint"))
    total = listed.agg(F.sum("bytes_")).first()[0] or 0
    if total <= block_bytes:
        blocks = [listed]
    else:
        upto = running_total(listed, ["name_", "text_"], "bytes_").withColumn("block_", F.floor((F.col("upto") - F.col("bytes_")) / block_bytes))
        blocks = [upto.where(F.col("block_") == k) for k in range(-(-total // block_bytes))]
    kept = [F.col(key), *([F.struct("*").alias("row_")] if carry else []), F.coalesce(F.col(text), F.lit("")).alias("text_")]
    rows = docs.select(*kept)

    def search(block: DataFrame) -> Column:
        table = block.select("name_", "text_").toArrow()
        return search_column(spark.sparkContext.broadcast(Patterns(table["name_"].to_pylist(), table["text_"].combine_chunks(), width)))

    if len(blocks) == 1:
        found = rows.withColumn("found_", search(blocks[0]))
        runs, items = F.col("found_.runs"), F.col("found_.items")
    else:
        rows = rows.withColumn("text_key_", F.md5(F.concat_ws("\n", F.coalesce(F.col(key).cast("string"), F.lit("")), "text_").cast("binary")))
        words = F.regexp_count("text_", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("bigint")
        parts_ = [rows.select("text_key_", F.lit(k).alias("block_"), search(b).alias("found_")).where("size(found_.runs) > 0") for k, b in enumerate(blocks)]
        every = parts_[0]
        for part in parts_[1:]:
            every = every.unionByName(part)
        every = every.groupBy("text_key_", "block_").agg(F.first("found_").alias("found_"))  # equal rows once, before they meet
        every = every.groupBy("text_key_").agg(F.flatten(F.collect_list("found_.runs")).alias("runs_"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found_.items")))).alias("items_"))
        found = rows.withColumn("words_", words).join(every.withColumn("runs_", merged(F.col("runs_"))), "text_key_", "left")
        found = found.withColumn("found_", F.struct(F.col("words_").alias("n_words")))
        runs, items = F.coalesce("runs_", F.array().cast(_RUNS)), F.coalesce("items_", F.array().cast("array<string>"))
    found = found.select(key, *(["row_"] if carry else []), F.col("found_.n_words").alias("n_words"), runs.alias("runs"), items.alias("items"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, run: n + run["end"] - run["first"])
    return found.select(key, *(["row_"] if carry else []), "n_words", n_hit.alias("n_hit"), "runs", "items")
