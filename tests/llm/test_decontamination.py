"""Benchmark windows found by shift tables against a plain search of every window in every text."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import decontamination
from skerry.llm.decontamination import Patterns, contamination, parts
from skerry.llm.fill_middle import texts_of
from skerry.llm.queries import DECONTAMINATION_SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, items, width=10):
    """n_words, hit words and item names of each text."""
    words = lambda t: WORD.findall((t or "").translate(UPPER))
    windows = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(name)
    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    names |= found
        out.append((len(w), hit, sorted(str(n) for n in names if n is not None)))
    return out


def found(texts, items, width=10):
    got = Patterns([None if n is None else str(n) for n, _ in items], pa.array([t for _, t in items], pa.string()), width).search(pa.array(texts, pa.string()))
    return [(r["n_words"], {k for run in r["runs"] for k in range(run["first"], run["end"])}, r["items"]) for r in got.to_pylist()]


SMALL = st.lists(st.sampled_from(["a", "B", "b", "é", "7", "ab", "  ", ". ", "\n", "`", "{x}", "wordlongenough", "日本"]), max_size=60).map("".join)
SPACED = st.lists(st.sampled_from(["a", "B", "b", "é", "7a", "ab", "longerword", "longerwork", "x-y"]), max_size=60).map(" ".join)


@given(st.lists(SMALL | SPACED, max_size=5), st.lists(SMALL | SPACED, max_size=6), st.integers(1, 10))
@settings(max_examples=300, deadline=None)
def test_every_occurrence(texts, items, width):
    items = list(enumerate(items))
    assert found(texts, items, width) == plain(texts, items, width)


@given(SPACED | SMALL, st.integers(1, 40), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_pieces_of_a_long_text(text, most, overlap):
    data = pa.array([text, "x " + text])
    whole = [WORD.findall(t.translate(UPPER)) for t in data.to_pylist()]
    seen = [[], []]
    for part in parts(*texts_of(data), overlap, most):
        for k, t in enumerate(part.texts.tolist()):
            low, high = (part.upto[k - 1] if k else 0), part.upto[k]
            words = [bytes(part.line[a + 1 : b]).decode() for a, b in zip(part.space[low:high], part.after[low:high], strict=True)]
            assert len(seen[t]) == part.base + part.fresh and seen[t][part.base :] == words[: part.fresh]
            seen[t] += words[part.fresh :]
    assert seen == whole


def test_texts_longer_than_a_piece(monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary, 14))) for k in range(50)]
    long = [" ".join(rng.choice(vocabulary, 40) if k % 7 else [items[k % 50][1]]) if k else "y" * 3000 for k, _ in enumerate(range(200))]
    text = ".\n".join(map(str, (x if isinstance(x, str) else " ".join(x) for x in long)))
    want = plain([text, None], items)
    assert len(want[0][1]) > 200
    assert found([text, None], items) == want
    monkeypatch.setattr(parts, "__defaults__", (500,))
    assert found([text, None], items) == want
    big = (text + " ") * 45  # longer than the pieces of the library itself
    monkeypatch.undo()
    assert len(big) > decontamination._AT_ONCE
    assert found([big], items) == plain([big], items)


def test_hot_windows_share_their_beginning():
    """Patterns that differ in the last word only, one of every third item, and texts that are hit all over."""
    items = [(k, f"what is the name of the capital city of country{k % 400}") for k in range(1200)] + [(2000 + k, "one two") for k in range(600)]
    texts = ["What is the name of the capital city of country7? " * 200 + "one, two", "what is the name of the capital city of country", "one"]
    assert found(texts, items) == plain(texts, items)


SCHEMA = "doc_id bigint, text string, name_ string, items string, n_words int"


def corpus():
    rng = np.random.default_rng(5)
    vocabulary = ["the", "de", "é", "x1", "of", "THE", "many", "words", "beyond", "here", "日本", "a"]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate((12, 10, 25, 9, 3, 40, 11))]
    items += [(3, items[2][1]), (None, items[5][1]), (8, None), (9, ""), (10, "..."), (110, items[0][1].upper())]
    docs = []
    for k in range(60):
        text = " ".join(rng.choice(vocabulary, 30))
        if k % 3 == 0:
            text += ", " + items[k % 7][1].replace(" ", "\n- ", 3) + " " + text
        docs.append((k, text, "x", "y", 1))
    docs += [(None, items[0][1], "", "", 0), (None, None, "", "", 0), (7, docs[0][1], "", "", 0), docs[0], (61, "", None, None, None)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [16 << 20, 150])
def test_rows(spark, block_bytes):
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination(df, bench, block_bytes=block_bytes, carry=True).collect()
    want = plain([d[1] for d in docs], items)
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, [k for a, b in r.runs for k in range(a, b)], r["items"], tuple(r.row_)) for r in got), key=key) == sorted(((d[0], n, len(h), sorted(h), i, d) for d, (n, h, i) in zip(docs, want, strict=True)), key=key)
    assert any(h for _, h, _ in want) and any(not h for _, h, _ in want)


def test_empty_tables(spark):
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    assert not contamination(df.limit(0), bench).collect()
    got = contamination(df, bench.limit(0)).collect()
    assert len(got) == len(docs) and all(r.n_hit == 0 and r["items"] == [] for r in got)


def test_same_as_sql(spark):
    docs, items = corpus()
    from skerry.llm import queries

    documents, benchmark = spark.createDataFrame(docs, SCHEMA).where("doc_id is not null").dropDuplicates(["doc_id"]), spark.createDataFrame(items, "item_id bigint, text string")
    got = queries.contaminated_rows(documents, benchmark)
    documents, benchmark = documents.toArrow(), benchmark.toArrow()  # noqa: F841  read by name below
    want = duckdb.sql(DECONTAMINATION_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.agg(F.max("n_items")).first()[0] > 1
