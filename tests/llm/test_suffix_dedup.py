"""Removed bytes against a dictionary of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import skerry.llm.suffix_dedup as suffix_dedup_module
from skerry.llm.suffix_dedup import Rule, difference_cover_order, repeated_starts, suffix_dedup, symbols, without_repeats

SCHEMA = "doc_id bigint, text string, node string"


@given(st.lists(st.integers(1, 3), max_size=120))
@settings(max_examples=150, deadline=None)
def test_order_is_the_suffix_order(text):
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert difference_cover_order(np.array(text, np.int64), len(text) + 3).tolist() == want


@given(st.lists(st.sampled_from([[1], [2], [1, 2] * 9, [2] * 14, [1, 1, 2] * 7]), max_size=14), st.integers(1, 12))
@settings(max_examples=400, deadline=None)
def test_order_is_right_in_the_span(parts, span):
    text = [x for p in parts for x in p]
    order = difference_cover_order(np.array(text, np.int64), span).tolist()
    heads = [text[i : i + span] for i in order]
    assert sorted(order) == list(range(len(text))) and heads == sorted(heads)


@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6), st.integers(2, 9))
@settings(max_examples=150, deadline=None)
def test_repeated_starts(texts, length):
    texts = [t.encode() for t in texts]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in texts]
    assert [x.tolist() for x in repeated_starts(texts, Rule(length, 1))] == want


@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "ba"]), max_size=25), min_size=1, max_size=6), st.integers(2, 6))
@settings(max_examples=100, deadline=None)
def test_repeated_starts_of_words(texts, length):
    count = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    want = [[i for i in range(len(t) - length + 1) if count[tuple(t[i : i + length])] > 1] for t in texts]
    assert [x.tolist() for x in repeated_starts([" ".join(t).encode() for t in texts], Rule(length, 1, True))] == want


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, *_), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(length, n=120, seed=3):
    rng = random.Random(seed)
    fresh = lambda k: "".join(rng.choices("abcdefgh é\n", k=k))
    passages = [fresh(rng.randint(length - 3, 3 * length)) for _ in range(4)]
    rows = []
    for k in range(n):
        text = fresh(rng.randint(0, 4 * length))
        for p in rng.choices(passages, k=rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + p[rng.randint(0, 5) :] + text[at:]
        if rows and rng.random() < 0.2:
            base = rows[rng.randrange(len(rows))][1]
            text = base if rng.random() < 0.5 or not base else base[: len(base) // 2] + "#" + base[len(base) // 2 :]
        rows.append((k, text, "x"))
    return [*rows, rows[5], (None, passages[0], None), (7, passages[1] * 3, ""), (900, None, ""), (901, "", ""), (902, "z" * 9 * length, ""), (903, "ab" * 4 * length, "")]


@pytest.mark.parametrize(("length", "gram", "most"), [(40, 8, 1000), (40, 8, 3), (37, 12, 1)])
def test_matches_all_windows(spark, length, gram, most):
    rows = corpus(length, seed=length + most)
    out = suffix_dedup(spark.createDataFrame(rows, SCHEMA), length, gram, most).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(rows, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out if r.kept is not None)


def test_empty_table(spark):
    assert not suffix_dedup(spark.createDataFrame([], SCHEMA)).collect()


def covered_words(rows, length):
    """By row which bytes a repeated run of so many words covers."""
    texts = [(r[1] or "").encode() for r in rows]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    words = [[t[a:b] for a, b in s] for t, s in zip(texts, spans, strict=True)]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for t, s, w in zip(texts, spans, words, strict=True):
        gone = [False] * len(t)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[s[i][0] : s[i + length - 1][1]] = [True] * (s[i + length - 1][1] - s[i][0])
        out.append(gone)
    return out


def runs(gone):
    return sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def test_pieces_of_long_texts(spark, monkeypatch):
    """Texts are cut into pieces of windows; what lies across their edges is found all the same."""
    monkeypatch.setattr(suffix_dedup_module, "_PIECE", 23)
    rows = corpus(40, n=30, seed=9)
    texts = [(k, (r[1] or "").encode()) for k, r in enumerate(rows)]
    for rule in (Rule(40, 8), Rule(6, 2, True)):
        covered = {k: set() for k, _ in texts}
        batch = pa.RecordBatch.from_pydict({"node": [k for k, _ in texts], "text": [t for _, t in texts]})
        for b in suffix_dedup_module.cells_of([rule])(iter([batch])):
            for k, lo, hi in zip(*(b.column(x).to_pylist() for x in ("node", "lo", "hi")), strict=True):
                covered[k] |= set(range(lo, hi + 1))
            for more in b.column("more").to_pylist():
                for p in np.frombuffer(more or b"", suffix_dedup_module._PLACE):
                    covered[int(p["node"])] |= set(range(p["lo"], p["hi"] + 1))
        for k, t in texts:
            n = len(t.split()) if rule.words and not re.search(rb"[\x0e-\x1f\x85\xa0]", t) else len(symbols(t, rule.words))
            assert covered[k] == set(range(n - rule.length + 1))


@pytest.mark.parametrize("most", [1000, 2])
def test_passages_of_words(spark, most):
    rows = corpus(40, seed=most)
    out = suffix_dedup(spark.createDataFrame(rows, SCHEMA), 40, 8, most, words=6).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(rows, 40)
    want = [(r[0], len((r[1] or "").encode()), runs(g), sum(g)) for r, g in zip(rows, covered_words(rows, 6), strict=True)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_passages, r.passage_bytes) for r in out), key=str) == sorted(want, key=str)


def test_without_repeats(spark):
    """Both rules remove; characters go as a whole; U+FFFD, other columns and texts that lose nothing stay as they are."""
    rows = [(k, t, n, k) for k, t, n in [*corpus(40, seed=8), (910, "X\ufffd legit " + "é" * 60, "n"), (911, "é" * 61, "n"), (912, "a " + "é" * 60 + "b", "n")]]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, n_chars bigint")
    both = [[a or b for a, b in zip(x, y, strict=True)] for x, y in zip(covered_bytes(rows, 40), covered_words(rows, 6), strict=True)]
    want = []
    for r, gone in zip(rows, both, strict=True):
        kept, at = [], 0
        for c in r[1] or "":
            n = len(c.encode())
            kept += [] if any(gone[at : at + n]) else [c]
            at += n
        want.append((r[0], "".join(kept), r[2], len(kept)) if any(gone) else r)
    out = without_repeats(docs, 40, 8, 1000, words=6)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def covered_bytes(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out
