"""Cuts by chunks against lists of units, and the exact round trip."""

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm.fill_middle import Chunks, fill_in_middle, restored, texts_of
from skerry.llm.queries import FILL_IN_MIDDLE_SQL, cut_rows

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXT = st.lists(st.sampled_from(["a", "Zz", "é", " ", "\n", "日", "😀", "<", "<P", "P>", "7", "word", "@", "["]), max_size=50).map("".join)


@given(st.lists(TEXT | st.none(), max_size=8), st.integers(1, 20), st.integers(0, 2**32), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_places(texts, size, seed, skip):
    column = pa.array([*texts, *[""] * skip])[skip:]  # a slice, as batches may be
    texts = column.to_pylist()
    found = Chunks(*texts_of(column), size)
    units = [UNIT.findall(t or "") for t in texts]
    assert found.counts().tolist() == [len(u) for u in units]
    ranks = np.array([seed % (len(u) + 1) for u in units], np.int64)
    assert found.places(ranks).tolist() == [len("".join(u[:k])) for u, k in zip(units, ranks.tolist(), strict=True)]


SCHEMA = "doc_id bigint, text string, n string, form string, output string, text_ int"


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def rows():
    rng = np.random.default_rng(4)
    parts = ["a", "Word", "é", " ", "\n", "日本", "😀", "<", "P>", "42"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(120)]
    texts += ["x<M>y", "<P>", "<<S>", "", None, "a", "😀", "<P", "x" * 50_000, "Ab é" * 600_000]
    return [(k, t, "n", "f", "o", 1) for k, t in enumerate(texts)] + [(None, "null id", "", "", "", 1), (None, None, "", "", "", 1), (3, texts[3], "", "", "", 1), (3, texts[3], "", "", "", 1)]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_rows_and_round_trip(spark, chunk):
    data = [r for r in rows() if chunk > 3 or len(r[1] or "") < 10_000]
    got = fill_in_middle(spark.createDataFrame(data, SCHEMA), carry=True, chunk=chunk).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((tuple(r.row_), r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(((d, d[0], *plain(d[0], d[1])) for d in data), key=str)
    assert all(r.back == (r.row_[1] or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_same_as_sql(spark):
    got = cut_rows(spark.createDataFrame(rows(), SCHEMA))
    documents = spark.createDataFrame(rows(), SCHEMA).toArrow()  # noqa: F841  read by name below
    want = duckdb.sql(FILL_IN_MIDDLE_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_empty_table_and_bad_marks(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert not cut_rows(df).collect()
    with pytest.raises(ValueError):
        fill_in_middle(df, marks=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fill_in_middle(df, marks=("<P>", "<<>", "<M>"))
