"""Fill-in-middle transformation by overlapping chunks.

A text's units are runs of letters A-Z and a-z and single other characters, so a unit starts at every character that isn't
a letter after a letter. That needs a character and the one before it and nothing else: texts are cut into chunks of bytes
that overlap by one, each chunk counts its unit starts and its characters by itself, and prefix sums over the counts give
every chunk's first rank. A cut after k units is routed to the one chunk that holds rank k, and only that chunk is scanned
again for the place. No list of units is made, whatever the text's length; the cuts, two numbers a row, are all that comes
back from Python, and Spark puts the output together.

Defined results: null text is empty. An empty text, one that holds a mark and a share of the others stay plain: the output is
the text, and prefix_chars and middle_chars are null. The choices follow the row's id alone, so equal ids cut alike and reruns
agree; a null id counts as an empty one. Equal ranks make an empty middle. Repeated rows are rows of their own. Empty table:
empty result. Columns beside id and text play no part; `carry` returns them as a struct, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.exchange import small_batches

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
CHUNK = 4096
_AT_ONCE = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character in UTF-8


def marks_of(data: np.ndarray, low: int, high: int, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes from low to high: whether a unit starts there, and whether a character does. The byte before low is read
    too; at a head, which begins a text, a unit starts whatever lies before."""
    letter, first = _LETTER[data[low:high]], _FIRST[data[low:high]]
    after = np.empty_like(letter)
    after[0], after[1:] = low > 0 and _LETTER[data[low - 1]], letter[:-1]
    starts = first & ~(letter & after)
    starts[heads - low] = True
    return starts, first


class Chunks:
    """Texts that lie one after the other in one array of bytes, counted chunk by chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int = CHUNK):
        self.data, self.offsets = data, offsets
        lengths = np.diff(offsets)
        per_text = -(-lengths // size)
        self.first = np.concatenate(([0], np.cumsum(per_text)))  # each text's first chunk
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.low = np.repeat(offsets[:-1], per_text) + inside * size
        self.high = np.minimum(self.low + size, np.repeat(offsets[1:], per_text))
        self.head = inside == 0
        units, chars = np.zeros(len(self.low), np.int64), np.zeros(len(self.low), np.int64)
        step = max(1, _AT_ONCE // size)
        at = 0
        while at < len(self.low):
            end = at + step
            low, high = int(self.low[at]), int(self.high[min(end, len(self.low)) - 1])
            starts, first = marks_of(data, low, high, self.low[at:end][self.head[at:end]])
            units[at:end] = np.add.reduceat(starts, self.low[at:end] - low, dtype=np.int64)
            chars[at:end] = np.add.reduceat(first, self.low[at:end] - low, dtype=np.int64)
            at = end
        self.units = np.concatenate(([0], np.cumsum(units)))  # units and characters before each chunk
        self.chars = np.concatenate(([0], np.cumsum(chars)))

    def counts(self) -> np.ndarray:
        """Units by text."""
        return self.units[self.first[1:]] - self.units[self.first[:-1]]

    def places(self, ranks: np.ndarray) -> np.ndarray:
        """By text: the number of characters before the unit of the rank, or all of them if the rank is the number of units."""
        base = self.first[:-1]
        wanted = self.units[base] + ranks
        out = self.chars[self.first[1:]] - self.chars[base]
        for k in np.flatnonzero(ranks < self.counts()).tolist():
            chunk = int(np.searchsorted(self.units, wanted[k], "right")) - 1
            low = int(self.low[chunk])
            starts, first = marks_of(self.data, low, int(self.high[chunk]), self.low[chunk : chunk + 1][self.head[chunk : chunk + 1]])
            at = np.flatnonzero(starts)[wanted[k] - self.units[chunk]]
            out[k] = self.chars[chunk] - self.chars[base[k]] + np.count_nonzero(first[:at])
        return out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text begins and ends in them. Nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


_CUTS = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint>"


def cuts(text: Column, one: Column, other: Column, size: int = CHUNK) -> Column:
    """The number of units, and the characters of prefix and middle for the two draws, each modulo the number of units and one."""

    @F.arrow_udf(_CUTS)
    def cut(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        parts = Chunks(*texts_of(text), size)
        n = parts.counts()
        ranks = [x.to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for x in (one, other)]
        before, upto = parts.places(np.minimum(*ranks)), parts.places(np.maximum(*ranks))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, before, upto - before)], ["n", "prefix_chars", "middle_chars"])

    return cut(text, one, other)


def draws(key: Column, seed: str, count: int = 4) -> list[Column]:
    """Whole numbers below 2**32 from the key and the seed: the first groups of eight hex digits of a hash."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(count)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", fim_percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, chunk: int = CHUNK, carry: bool = False) -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output (the new text) for every row; with
    carry also the input row as struct row_.

    fim_percent: of the texts that can be cut, how many of a hundred are; spm_percent: how many of those put the suffix first.
    marks: of prefix, suffix and middle; they must be told apart wherever they stand, so one "<" first and one ">" last in each.
    """
    if len(set(marks)) < 3 or any(m[:1] + m[-1:] != "<>" or m.count("<") + m.count(">") != 2 for m in marks):
        raise ValueError("three different marks of the form <...> are needed")
    small_batches(docs.sparkSession)
    h1, h2, h3, h4 = draws(F.col(key), seed)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), whole.alias("text_"), *([F.struct("*").alias("row_")] if carry else []), h1.alias("h1_"), h2.alias("h2_"), h3.alias("h3_"), h4.alias("h4_"))
    rows = rows.withColumn("cut_", cuts(F.col("text_"), F.col("h1_"), F.col("h2_"), chunk))
    marked = F.contains("text_", F.lit(marks[0])) | F.contains("text_", F.lit(marks[1])) | F.contains("text_", F.lit(marks[2]))
    plain = (F.col("text_") == "") | marked | (F.col("h3_") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4_") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    before, inside = F.col("cut_.prefix_chars"), F.col("cut_.middle_chars")
    prefix = F.concat(F.lit(marks[0]), F.substr("text_", F.lit(1), before.cast("int")))
    middle = F.concat(F.lit(marks[2]), F.substr("text_", (before + 1).cast("int"), inside.cast("int")))
    suffix = F.concat(F.lit(marks[1]), F.substr("text_", (before + inside + 1).cast("int")))
    output = F.when(F.col("form") == "plain", F.col("text_")).when(F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.concat(prefix, suffix, middle))
    cut = F.col("form") != "plain"
    return rows.select(key, *(["row_"] if carry else []), F.col("cut_.n").alias("n"), "form", F.when(cut, before).alias("prefix_chars"), F.when(cut, inside).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from output and form alone. The text holds no mark, and no mark can arise where a part meets one."""
    first, second, third = marks
    head, middle = F.substring_index(output, third, 1), F.substring_index(output, third, -1)
    psm = F.concat(F.substr(F.substring_index(head, second, 1), F.lit(len(first) + 1)), middle, F.substring_index(head, second, -1))
    spm = F.concat(F.substring_index(head, first, -1), middle, F.substr(F.substring_index(head, first, 1), F.lit(len(second) + 1)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
