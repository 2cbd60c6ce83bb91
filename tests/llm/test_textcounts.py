"""Counts by numpy against plain string operations."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import textcounts
from skerry.llm.fill_middle import texts_of
from skerry.llm.textcounts import COUNTS, counts, text_counts


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = "".join(words)
    return {
        "words": len(words), "same": sum(a == b for a, b in zip(words, words[1:], strict=False)), "distinct": len(set(words)), "chars": len(chars),
        "symbols": sum(c in "#*$%&|<>" for c in chars), "capitals": sum("A" <= c <= "Z" for c in chars), "marks": sum(c in "!?" for c in chars),
        "lines": len(lines), "dup_lines": len(lines) - len(set(lines)),
    }


TEXT = st.lists(st.sampled_from(["a", "Ab", "é", "日本", "😀", " ", " ", "\n", "\n", "\t", "\x0b", "#", "!?", " ", "same "]), max_size=50).map("".join)


@given(st.lists(TEXT | st.none(), max_size=6), st.integers(1, 60), st.integers(0, 2))
@settings(max_examples=300, deadline=None)
def test_counts(texts, most, skip):
    before, textcounts._AT_ONCE = textcounts._AT_ONCE, most
    try:
        column = pa.array(texts, pa.string())[skip:]
        got = counts(*texts_of(column))
    finally:
        textcounts._AT_ONCE = before
    assert got.tolist() == [[plain(t)[c] for c in COUNTS] for t in texts[skip:]]


def test_long_texts_and_rows(spark):
    long = "word line, of it all\n" * 60_000 + "x" * 1_500_000 + "\n" + "y " * 700_000 + "\n" + "x" * 1_500_000
    rows = [(1, long), (2, None), (3, ""), (4, "A! a A!"), (4, "A! a A!")]
    got = spark.createDataFrame(rows, "id int, text string").select("id", text_counts(F.col("text")).alias("n")).collect()
    assert sorted((r.id, *r.n) for r in got) == sorted((k, *(plain(t)[c] for c in COUNTS)) for k, t in rows)
    assert plain(long)["dup_lines"] == 60_000 and len(long) > textcounts._AT_ONCE and np.iinfo(np.int64).max > 0
