"""Counts of a text's words, lines and characters by numpy, many texts at once. White space is 0x20 and 0x09 to 0x0D; words are
what lies between; lines end at \\n, and those without a word don't count. Null text is empty.

Words and lines are compared by 64-bit hashes. A batch is worked on a bounded number of bytes at a time, or a text at a time
where one is longer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.llm.exchange import lean
from skerry.llm.fill_middle import texts_of
from skerry.llm.hashing import IS_SPACE, word_hashes, word_spans
from skerry.llm.textstats import CAPITALS, SYMBOLS

#: chars: code points that aren't white space. same: words equal to the one before. distinct: different words. dup_lines: lines
#: equal to an earlier one.
COUNTS = ("words", "same", "distinct", "chars", "symbols", "capitals", "marks", "lines", "dup_lines")
_AT_ONCE = 1 << 20
_NEWLINE = 10


def _among(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_KINDS = (~IS_SPACE & ((np.arange(256) & 0xC0) != 0x80), _among(SYMBOLS), _among(CAPITALS), _among("!?"))


def _repeats(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """By text, how many values are equal to another one that was counted."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    again = (value[1:] == value[:-1]) & (text[1:] == text[:-1])
    return np.bincount(text[1:][again], minlength=n)


def _line_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    long = end - start > _AT_ONCE  # the sums of the others are of bounded length
    out = np.empty(len(start), np.uint64)
    out[~long] = word_hashes(raw, start[~long], end[~long])
    for k in np.flatnonzero(long).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each text, a row a text."""
    out = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _AT_ONCE, "right")) - 1)
        part, ends, n = data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], to - at
        for k, kind in enumerate(_KINDS):
            upto = np.concatenate(([0], np.cumsum(kind[part], dtype=np.int64)))
            out[at:to, 3 + k] = np.diff(upto[np.concatenate(([0], ends))])
        raw = np.insert(part, ends, _NEWLINE)  # each text ends its last line
        stops = ends + np.arange(1, n + 1)
        start, end = word_spans(raw)
        words, text = word_hashes(raw, start, end), np.searchsorted(stops, start, "right")
        out[at:to, 0] = np.bincount(text, minlength=n)
        out[at:to, 1] = np.bincount(text[1:][(words[1:] == words[:-1]) & (text[1:] == text[:-1])], minlength=n)
        out[at:to, 2] = out[at:to, 0] - _repeats(text, words, n)
        line_end = np.flatnonzero(raw == _NEWLINE)
        line = np.concatenate(([0], line_end[:-1] + 1))
        full = np.searchsorted(start, line_end) > np.searchsorted(start, line)
        line, line_end = line[full], line_end[full]
        text = np.searchsorted(stops, line, "right")
        out[at:to, 7] = np.bincount(text, minlength=n)
        out[at:to, 8] = _repeats(text, _line_hashes(raw, line, line_end), n)
        at = to
    return out


def text_counts(text: Column) -> Column:
    """A struct of COUNTS."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    @lean
    def run(text: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in counts(*texts_of(text)).T], list(COUNTS))

    return run(text)
