"""Suffix-array deduplication: strings of so many bytes, or of so many words, that start anywhere else too.

A difference-cover suffix sort finds the repeats. To sort only text that may repeat, every window of the given length
gets an anchor, the smallest of its short-gram hashes: equal windows have equal anchors at equal places, so the windows of
one anchor hash form an independent sub-problem. An anchor's windows span one segment of text. Segments equal in text and
anchor place repeat as a whole; those whose anchor hash has no other segment repeat nowhere. The others meet by anchor
hash, and each meeting sorts its segments' suffixes by the difference-cover algorithm modulo 3 (sampled triples sorted and
named, recursion on the names until every name spans the window length, the remaining suffixes merged in) and compares
adjacent prefixes. A meeting with too many different segments is cut into cells of fewer windows, which meet by anchor
hash, place and the text common to the cell's windows; in the last round a cell is one window and equality decides.

Equal segments of one chunk of texts travel as one row with a list of places, so a passage that a third of all documents
share costs a row a chunk, not a row a document. Equal texts are one text: with a copy elsewhere, a text of at least the
length repeats as a whole.

Symbols are bytes or words (runs of bytes that aren't white space). Words repeat whatever white space is between them, and
a repeated run of words goes from its first word's first byte to its last word's last byte.

Defined results: null text is empty. Rows shorter than the length lose nothing. Null or repeated doc_id: rows are kept
apart by their text, and each is returned. Empty table: empty result. Matches never cross rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import hashing
from skerry.llm.exchange import Workspace, batches, binary_column, partitions, tidy

#: Windows in a cell by round; the first round's cells are whole segments.
CELLS = (None, 16, 1)

_CHUNK = 8 << 20
#: Windows of a text that get their anchors at once: a very long text takes no more memory than this asks for.
_PIECE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """What counts as a repeat: length symbols; gram: symbols of an anchor."""

    length: int
    gram: int
    words: bool = False

    def least_bytes(self) -> int:
        """Bytes that a text needs to hold such a string: words are a byte long at least, with white space between."""
        return 2 * self.length - 1 if self.words else self.length


def symbols(text: bytes, words: bool) -> np.ndarray:
    """A text as symbols: its bytes, or the hashes of its words."""
    data = np.frombuffer(text, np.uint8)
    return hashing.word_hashes(data, *hashing.word_spans(data)) if words else data


def sums_of(values: np.ndarray) -> np.ndarray:
    """The sums that hash any run of symbols."""
    return hashing.prefix_sums(values) if values.dtype == np.uint8 else hashing.sums_of(values)


def byte_range(text: bytes, words: bool):
    """A function from the first and the last symbol and one (arrays or numbers) to bytes from and to."""
    if not words:
        return lambda a, b: (a, b)
    starts, ends = hashing.word_spans(np.frombuffer(text, np.uint8))
    return lambda a, b: (starts[a], ends[b - 1])


def difference_cover_order(text: np.ndarray, span: int) -> np.ndarray:
    """Suffix order of an integer text, right in the first span symbols at least. Symbols are 1 or more.

    Sampled suffixes (places not divisible by 3) are sorted by triple and named; equal names recurse while a name spans
    less than span; the other suffixes are sorted by symbol and the rank of what follows, and both are merged.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    padded = np.concatenate((text.astype(np.int64), [0, 0, 0]))
    wide = int(padded.max()) + 1
    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    triple = [padded[np.minimum(sample + k, n)] for k in range(3)]
    if wide**3 < 1 << 63:
        key = (triple[0] * wide + triple[1]) * wide + triple[2]
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(triple[::-1])
        new = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in triple])
    name = np.cumsum(np.concatenate(([True], new)))
    if name[-1] < len(sample) and span > 3:
        names = np.empty(len(sample), np.int64)
        names[order] = name
        order = difference_cover_order(names, -(-span // 3))
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rank[n:] = 0
    sampled = sample[order]
    return _merge(padded, rank, sampled[sampled < n], np.arange(0, n, 3))


def _merge(padded: np.ndarray, rank: np.ndarray, sampled: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Put the other suffixes among the sampled ones: against places 1 modulo 3 a symbol and a rank decide, against
    places 2 modulo 3 two symbols and a rank."""
    tall = int(rank.max()) + 1
    one = lambda i: padded[i] * tall + rank[i + 1]
    two = lambda i: (padded[i] * (int(padded.max()) + 1) + padded[i + 1]) * tall + rank[i + 2]
    rest = rest[np.argsort(one(rest))]
    before = np.zeros(len(rest), np.int64)
    for k, key in ((1, one), (2, two)):
        before += np.searchsorted(np.sort(key(sampled[sampled % 3 == k])), key(rest))
    before = np.maximum.accumulate(before)  # suffixes alike in the whole span may come in any order
    place = before + np.arange(len(rest))
    out = np.empty(len(sampled) + len(rest), np.int64)
    mark = np.zeros(len(out), bool)
    mark[place] = True
    out[mark], out[~mark] = rest, sampled
    return out


def repeated_starts(segments: list[bytes], rule: Rule) -> list[np.ndarray]:
    """For each segment the starts (in symbols) of windows of the length that also start elsewhere in the segments."""
    if rule.words:
        flat, first = hashing.words_of(segments, lower=False)
        sizes = np.diff(first)
    else:
        flat, sizes = np.frombuffer(b"".join(segments), np.uint8), np.array([len(x) for x in segments], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    inside = np.ones(sizes.sum() + len(sizes) - 1, bool)
    inside[begins[1:] - 1] = False
    text = np.ones(len(inside), np.int64)
    text[inside] = (np.unique(flat, return_inverse=True)[1] if rule.words else flat) + 2
    order = difference_cover_order(text, rule.length)
    which = np.searchsorted(begins, np.arange(len(text)), "right") - 1
    fits = np.arange(len(text)) + rule.length <= begins[which] + sizes[which]
    order = order[fits[order]]
    spread = np.zeros(len(inside), np.uint64)
    spread[inside] = flat if rule.words else hashing.byte_values(flat)
    window = hashing.span_hashes(hashing.sums_of(spread), order, order + rule.length)
    same = window[1:] == window[:-1]
    hit = np.zeros(len(text), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


def anchors(sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places and hashes, and the first and last start of each one's windows; every window has one anchor."""
    reach = length - gram + 1
    h = hashing.window_hashes(sums, gram)
    n = len(h)
    # The leftmost least of the hashes' upper 40 bits: places break ties.
    if n < 1 << 24:
        key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    else:
        order = np.argsort(h >> np.uint64(24), kind="stable")
        key = np.empty(n, np.uint64)
        key[order] = np.arange(n, dtype=np.uint64)
    # Minima of all windows of hashes: block-wise running minima from both sides.
    fill = -n % reach
    blocks = np.concatenate((key, np.full(fill, np.iinfo(np.uint64).max))).reshape(-1, reach)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[: n - reach + 1], left[reach - 1 : n])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:] - 1, len(least) - 1)
    at = (least[first] & np.uint64((1 << 24) - 1)).astype(np.int64) if n < 1 << 24 else order[least[first].astype(np.int64)]
    return at, h[at], first, last


#: Runs that one row holds.
_RUNS = 1 << 14


def runs_of(node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of node and lo, put together where they touch: the first of each run, and the run's end."""
    if not len(node):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = np.concatenate(([True], node[1:] != node[:-1]))
    group = np.cumsum(apart) << 32
    furthest = np.maximum.accumulate(group + hi)
    first = np.flatnonzero(apart | np.concatenate(([True], (group + lo)[1:] > furthest[:-1] + 1)))
    return first, furthest[np.append(first[1:], len(lo)) - 1] & 0xFFFFFFFF


#: A place of a segment: the first and the last window's start and the anchor's place, in symbols.
_PLACE = np.dtype([("node", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("at", "<i4")])
_CELL_SQL = "kind int, meet bigint, whole bigint, node bigint, lo int, hi int, at int"
_CELL = pa.schema([("kind", pa.int32()), ("meet", pa.int64()), ("whole", pa.int64()), ("node", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32())])
_MANY_SQL = f"{_CELL_SQL}, more binary"
_MANY = _CELL.append(pa.field("more", pa.binary()))
_TEXT_SQL = f"{_CELL_SQL}, text binary"
_TEXT = _CELL.append(pa.field("text", pa.binary()))
_SPAN_SQL = "kind int, node bigint, lo int, hi int"
_SPAN = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def cells_of(rules: list[Rule]):
    """For batches of node and text the segments of all anchors: anchor hash (meet), segment hash (whole) and a place, one row for equal
    segments of a chunk of texts. Places of segments that the chunk has several times are known to repeat: their runs come in
    rows of their own, packed (more; null in the others)."""

    def of_chunk(kind: int, texts: list[tuple[int, bytes]]) -> pa.RecordBatch | None:
        rule, found = rules[kind], []
        for node, text in texts:
            if len(text) < rule.least_bytes():
                continue
            values = symbols(text, rule.words)
            for start in range(0, len(values) - rule.length + 1, _PIECE):  # segments end where pieces do; sorting sees to the rest
                sums = sums_of(values[start : start + _PIECE + rule.length - 1])
                at, h, lo, hi = anchors(sums, rule.length, rule.gram)
                whole = hashing.fold([hashing.span_hashes(sums, lo, hi + rule.length), (at - lo).astype(np.uint64)])
                found.append((h, whole, np.full(len(at), node), lo + start, hi + start, at + start))
        if not found:
            return None
        meet, whole, *place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place[1], place[0], whole, meet))
        meet, whole, place = meet[order], whole[order], [x[order] for x in place]
        new = np.concatenate(([True], (meet[1:] != meet[:-1]) | (whole[1:] != whole[:-1])))
        again = np.concatenate(([False], ~new[1:] & (place[0][1:] == place[0][:-1]) & (place[1][1:] == place[1][:-1])))  # copies of one text
        lead = np.flatnonzero(new)
        several = np.add.reduceat(~again, lead) > 1  # segments that other places of the chunk have too: their windows repeat
        known = ~again & several[np.cumsum(new) - 1]
        node, lo, hi = (x[known] for x in place[:3])
        order = np.lexsort((lo, node))
        first, ends = runs_of(node[order], lo[order], hi[order])
        runs = np.zeros(len(first), _PLACE)
        runs["node"], runs["lo"], runs["hi"] = node[order][first], lo[order][first], ends
        packed = [runs[k : k + _RUNS].tobytes() for k in range(0, len(runs), _RUNS)]
        pad = np.zeros(len(packed), np.int64)
        columns = [np.concatenate((x[lead].view(np.int64), pad)) for x in (meet, whole, place[0])] + [np.concatenate((x[lead], pad)).astype(np.int32) for x in place[1:]]
        columns.insert(0, np.full(len(lead) + len(packed), kind, np.int32))
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([None] * len(lead) + packed, pa.binary())], schema=_MANY)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunked() -> Iterator[list[tuple[int, bytes]]]:
            held, weight = [], 0
            for b in it:
                for row in zip(b.column(0).to_pylist(), binary_column(b, "text"), strict=True):
                    held.append(row)
                    weight += len(row[1])
                    if weight >= _CHUNK:
                        yield held
                        held, weight = [], 0
            if held:
                yield held

        for texts in chunked():
            for kind in range(len(rules)):
                if out := of_chunk(kind, texts):
                    yield out

    return run


def _unpacked(runs: DataFrame) -> DataFrame:
    """The spans of packed runs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            more = b.column(1).to_pylist()
            spans = np.frombuffer(b"".join(more), _PLACE)
            kind = np.repeat(b.column(0).to_numpy(), [len(x) // _PLACE.itemsize for x in more])
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(spans[x].copy()) for x in ("node", "lo", "hi"))], schema=_SPAN)

    return runs.select("kind", "more").mapInArrow(tidy(run), _SPAN_SQL)


def _segments(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Cells with their text from rows of node, text and a list of the node's open cells."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in it:
                for text, node, opened in zip(binary_column(b, "text"), b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    ranges = {kind: byte_range(text, rules[kind].words) for kind in {x["kind"] for x in opened}}
                    for x in opened:
                        a, z = ranges[x["kind"]](x["lo"], x["hi"] + rules[x["kind"]].length)
                        yield x["kind"], x["meet"], x["whole"], node, x["lo"], x["hi"], x["at"], text[a:z]

        yield from batches(_TEXT, out())

    return texts.select("node", "text", "opened").mapInArrow(tidy(run), _TEXT_SQL)


def _finer(cells: DataFrame, most_windows: int, rules: list[Rule]) -> DataFrame:
    """Cells of most_windows windows (a length of them at most) from larger ones; they meet by anchor, place and the text that all their windows share.
    Cells of one window go without their text, as their hashes decide."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in it:
                for kind, meet, _, node, lo, _, at, text in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                    length = rules[kind].length
                    windows = min(most_windows, length)
                    values, range_ = symbols(text, rules[kind].words), byte_range(text, rules[kind].words)
                    sums = sums_of(values)
                    place = (at - lo - np.arange(len(values) - length + 1)) // windows
                    first = np.flatnonzero(np.diff(place, prepend=place[0] + 1))
                    last = np.append(first[1:] - 1, len(place) - 1)
                    begin = at - lo - (place[first] + 1) * windows + 1  # where the place's first window starts, in the segment or before
                    common = hashing.span_hashes(sums, begin + windows - 1, begin + length)
                    whole = hashing.fold([hashing.span_hashes(sums, first, last + length), (first - begin).astype(np.uint64)])
                    same = [np.full(len(first), meet, np.int64).view(np.uint64), place[first].astype(np.uint64), common]
                    common, whole = hashing.fold(same), hashing.fold([*same, whole])
                    for c, w, x, y in zip(common.view(np.int64).tolist(), whole.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
                        a, z = range_(x, y + length)
                        yield kind, c, w, node, lo + x, lo + y, at, text[a:z] if most_windows > 1 else b""

        yield from batches(_TEXT, out())

    return cells.mapInArrow(tidy(run), _TEXT_SQL)


def _sorted_out(cells: DataFrame, rules: list[Rule], parts: int, batch: int = 1 << 20) -> DataFrame:
    """Spans of windows that repeat, by a suffix sort of the cells of each meeting."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(kind: int, held: dict) -> Iterator[tuple]:
            if len(held) < 2:
                return
            for (node, lo), starts in zip(held, repeated_starts(list(held.values()), rules[kind]), strict=True):
                if len(starts):
                    cut = np.flatnonzero(np.diff(starts) != 1)
                    for a, b in zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True):
                        yield kind, node, lo + a, lo + b

        def out() -> Iterator[tuple]:
            held: dict[tuple, bytes] = {}
            weight, now = 0, (None, None)
            for b in it:
                for kind, meet, _, node, lo, _, _, text in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                    if (kind, meet) != now and (weight >= batch or kind != now[0]):
                        yield from solve(now[0], held)
                        held, weight = {}, 0
                    now = kind, meet
                    held[node, lo] = text
                    weight += len(text)
            yield from solve(now[0], held)

        yield from batches(_SPAN, out())

    return cells.repartition(parts, "meet").sortWithinPartitions("kind", "meet").mapInArrow(tidy(run), _SPAN_SQL)


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of windows that meet or overlap as one; those that lie in two batches may stay apart."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            kind, node, lo, hi = (b.column(k).to_numpy() for k in range(4))
            if not len(lo):
                continue
            apart = np.concatenate(([True], (node[1:] != node[:-1]) | (kind[1:] != kind[:-1])))
            # The furthest end so far within a node and kind: group numbers lift each group above the one before.
            group = np.cumsum(apart) << 32
            furthest = np.maximum.accumulate(group + hi)
            first = np.flatnonzero(apart | np.concatenate(([True], (group + lo)[1:] > furthest[:-1] + 1)))
            ends = (furthest[np.append(first[1:], len(lo)) - 1] & 0xFFFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind[first], node[first], lo[first], ends)], schema=_SPAN)

    return spans.repartition("node").sortWithinPartitions("node", "kind", "lo").mapInArrow(tidy(run), _SPAN_SQL)


def _met(cells: DataFrame) -> DataFrame:
    """The cells whose anchor hash another cell has too."""
    spot = F.xxhash64("node", "lo")
    meets = cells.groupBy("meet").agg(F.min(spot).alias("lead_"), F.max(spot).alias("last_"))
    return cells.join(meets.where("lead_ <> last_").select("meet"), "meet")


def _classes(cells: DataFrame) -> DataFrame:
    """The cells that repeat as a whole, or that meet other cells: with twin (equal cells elsewhere), others (different
    cells of the meeting) and lead (the one of the equal cells that stands for them)."""
    spot = F.xxhash64("node", "lo")
    classes = cells.groupBy("meet", "whole").agg(F.min(spot).alias("lead_"), F.max(spot).alias("last_"))
    meets = classes.groupBy("meet").agg(F.count("*").alias("others"))
    kept = classes.join(meets, "meet").where("lead_ <> last_ or others > 1")
    found = cells.join(kept, ["meet", "whole"])
    return found.withColumn("twin", F.expr("lead_ <> last_")).withColumn("lead", F.col("lead_") == spot).drop("lead_", "last_")


def suffix_dedup(docs: DataFrame, length: int = 400, gram: int = 128, most: int = 1000, words: int | None = None) -> DataFrame:
    """Remove each byte that a string of the length covers which also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes; null where nothing was removed)
    for each row of docs(doc_id, text). length: bytes of a repeated string. gram: bytes of an anchor. most: different cells
    of a meeting that one task sorts; larger meetings are cut into finer cells. words: also count passages of so many words
    that start elsewhere too, as n_passages (maximal runs) and passage_bytes (of these runs); they aren't removed.
    """
    rules = [Rule(length, gram)] + ([Rule(words, max(1, words * 2 // 5), True)] if words else [])
    base, changed = _changed(docs, rules, most, removing=1, characters=False)
    out = base.withColumnRenamed("node", "node_").join(changed, (F.col("node_") == F.col("node")) & (F.col("n_bytes") == F.col("b_")), "left")
    counts = ["n_passages", "passage_bytes"] if words else []
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        "kept",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
    )


def without_repeats(docs: DataFrame, length: int = 400, gram: int = 128, most: int = 1000, words: int | None = None) -> DataFrame:
    """docs with the remaining text in each row; n_chars follows the text where there is such a column. A character that
    loses a byte goes as a whole. words: passages of so many words that start elsewhere too go as well."""
    rules = [Rule(length, gram)] + ([Rule(words, max(1, words * 2 // 5), True)] if words else [])
    _, changed = _changed(docs, rules, most, removing=len(rules), characters=True)
    own = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"), F.xxhash64(own.cast("binary")).alias("k_"), F.octet_length(own).cast("bigint").alias("l_"))
    joined = keyed.join(changed.where("removed > 0").select("node", "b_", "kept").hint("merge"), (F.col("k_") == F.col("node")) & (F.col("l_") == F.col("b_")), "left")
    cut = F.col("node").isNotNull()
    text = F.when(cut, F.col("kept").cast("string")).otherwise(F.col("row_.text"))
    columns = {c: F.col(f"row_.`{c}`").alias(c) for c in docs.columns} | {"text": text.alias("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row_.n_chars")).alias("n_chars")
    return joined.select(*columns.values())


def _changed(docs: DataFrame, rules: list[Rule], most: int, removing: int, characters: bool) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, node, n_bytes, sha), and the texts that hold repeats (node, b_, removed, spans, kept_sha, kept,
    n_passages, passage_bytes). removing: how many of the rules remove, the first ones; the last one counts passages."""
    spark = docs.sparkSession
    space, parts = Workspace(spark, "suffix"), partitions(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("node"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    long_ = F.col("n_bytes") >= min(rule.least_bytes() for rule in rules)

    base = space.settle(rows.select("doc_id", "node", "n_bytes", F.sha2("text", 256).alias("sha")), "base")
    nodes = base.where(long_).groupBy("node", "n_bytes").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc"))
    nodes = space.settle(nodes, "nodes")
    cells = space.settle(rows.where(long_).select("node", "text").mapInArrow(tidy(cells_of(rules)), _MANY_SQL), "cells")
    met = space.settle(_met(cells.where("more is null").drop("more")), "met")
    found = space.settle(_classes(met), "found")
    space.drop("met")

    spans = [space.settle(found.where("twin").select(*_SPAN.names).unionByName(_unpacked(cells.where("more is not null"))), "places")]
    space.drop("cells")
    opened = found.where("lead and others > 1").groupBy("node").agg(F.collect_set(F.struct("kind", "meet", "whole", "lo", "hi", "at", "others")).alias("opened"))
    needed = spans[0].select("node").unionByName(nodes.where("copies > 1").select("node")).distinct()
    needed = needed.join(opened, "node", "full").join(nodes, "node")
    needed = needed.select(F.col("node").alias("n_"), F.col("n_bytes").alias("b_"), "doc", "copies", "opened")
    texts = rows.join(needed, (F.col("node") == F.col("n_")) & (F.col("n_bytes") == F.col("b_")) & F.col("doc_id").eqNullSafe(F.col("doc")))
    texts = space.settle(texts.select("node", "text", "opened", "copies"), "texts")
    space.sweep()

    few = texts.withColumn("opened", F.filter("opened", lambda x: x["others"] <= most)).where(F.size("opened") > 0)
    many = texts.withColumn("opened", F.filter("opened", lambda x: x["others"] > most)).where(F.size("opened") > 0)
    spans.append(_sorted_out(_segments(few, rules), rules, parts))
    if many.limit(1).count():
        finer = _segments(many, rules)
        for windows in CELLS[1:]:
            finer = _finer(finer, windows, rules).dropDuplicates(["kind", "node", "lo", "at"])
            finer = space.settle(finer, f"finer{windows}")
            found = space.settle(_classes(finer), f"found{windows}")
            spans.append(found.where("twin").select(*_SPAN.names))
            if windows > 1:
                spans.append(_sorted_out(found.where("lead and others > 1").where(F.col("others") <= most).select(*_TEXT.names), rules, parts))
                finer = found.where("lead and others > 1").where(F.col("others") > most).select(*_TEXT.names)
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    every = _merged(every).groupBy("node").agg(F.collect_list(F.struct("kind", "lo", "hi")).alias("spans"))
    repeats = texts.select("node", "text", "copies").join(every, "node", "left").where("copies > 1 or spans is not null")
    cut = space.settle(_cut(repeats, rules, removing, characters).dropDuplicates(["node"]), "cut")
    space.sweep()
    return base, cut


_CUT_SQL = "node bigint, b_ bigint, removed bigint, spans bigint, kept_sha string, kept binary, n_passages bigint, passage_bytes bigint"
_CUT = pa.schema([("node", pa.int64()), ("b_", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("kept_sha", pa.string()), ("kept", pa.binary()), ("n_passages", pa.int64()), ("passage_bytes", pa.int64())])


def _covered(text: bytes, rule: Rule, spans: list[dict], copied: bool) -> np.ndarray:
    """Which bytes the rule's spans of window starts cover; all windows of a copied text."""
    edge = np.zeros(len(text) + 1, np.int64)
    range_ = byte_range(text, rule.words)
    if copied and len(text) >= rule.least_bytes():
        count = len(hashing.word_spans(np.frombuffer(text, np.uint8))[0]) if rule.words else len(text)
        spans = [{"lo": 0, "hi": count - rule.length}] if count >= rule.length else []
    if spans:
        a, z = range_(np.array([x["lo"] for x in spans]), np.array([x["hi"] for x in spans]) + rule.length)
        np.add.at(edge, a, 1)
        np.add.at(edge, z, -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(mask: np.ndarray) -> int:
    return int(np.count_nonzero(np.diff(mask, prepend=False) & mask))


def _cut(rows: DataFrame, rules: list[Rule], removing: int, characters: bool) -> DataFrame:
    """What no span of the removing rules covers, from rows of node, text, copies and spans of window starts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in it:
                for node, text, copies, spans in zip(b.column(0).to_pylist(), binary_column(b, "text"), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    found = [_covered(text, rule, [x for x in spans or [] if x["kind"] == k], copies > 1) for k, rule in enumerate(rules)]
                    gone = np.logical_or.reduce(found[:removing])
                    data = np.frombuffer(text, np.uint8)
                    if characters and len(data):
                        first = np.flatnonzero(np.append(True, (data[1:] & 0xC0) != 0x80))
                        gone = np.repeat(np.logical_or.reduceat(gone, first), np.diff(np.append(first, len(data))))
                    removed, kept = int(gone.sum()), data[~gone].tobytes()
                    passages = (_runs(found[-1]), int(found[-1].sum())) if rules[-1].words else (0, 0)
                    yield node, len(text), removed, _runs(gone), hashlib.sha256(kept).hexdigest(), kept if removed else None, *passages

        yield from batches(_CUT, out())

    return rows.select("node", "text", "copies", "spans").mapInArrow(tidy(run), _CUT_SQL)
