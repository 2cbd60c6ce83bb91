"""Hashed tokens against regular expressions, the lexicon against plain counts, and evidence that hasn't seen its text."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import toxicity
from skerry.llm.fill_middle import texts_of
from skerry.llm.toxicity import Lexicon, distinct_tokens, learn, tokens

WORD = re.compile(rb"[0-9A-Za-z'\x80-\xff]+")


def plain(text):
    """Lower-case words, and beginnings of longer ones, as bytes."""
    out = []
    for w in WORD.findall((text or "").encode()):
        w = w.lower()
        out.append((0, w))
        out += [(k, w[:k]) for k in toxicity.BEGINNINGS if len(w) > k]
    return out


TEXT = st.lists(st.sampled_from(["a", "Word", "réeux", "wordlonger", "'", " ", ". ", "\n", "é", "日本", "x1"]), max_size=40).map("".join)


@given(st.lists(TEXT | st.none(), max_size=6), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_tokens(texts, most):
    before = toxicity._AT_ONCE
    toxicity._AT_ONCE = most
    try:
        seen = [Counter() for _ in texts]
        for hashes, of, _ in tokens(*texts_of(pa.array(texts, pa.string()))):
            for h, k in zip(hashes.tolist(), of.tolist(), strict=True):
                seen[k][h] += 1
    finally:
        toxicity._AT_ONCE = before
    want = [Counter(plain(t)) for t in texts]
    names = {}
    for got, w in zip(seen, want, strict=True):
        assert sorted(got.values()) == sorted(w.values())
        for t in w:
            names.setdefault(t, None)
    every = set().union(*seen) if seen else set()
    assert len(every) == len(set().union(*want) if want else set())


def test_lexicon(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        words = [f"w{rng.randint(0, 60)}" for _ in range(30)]
        toxic = k % 5 == 0
        if toxic:
            words[::7] = [rng.choice(["vile", "grottingly", "grottingful", "grottinghood"]) for _ in words[::7]]
        rows.append((" ".join(words), int(toxic)))
    rows += [rows[0]] * 50 + [(None, 0), ("", 1)]
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    got = learn(df)
    texts = {(t or "", x) for t, x in rows}
    a, b = Counter(), Counter()
    for t, x in texts:
        (a if x else b).update(set(plain(t)))
    na, nb = sum(x for _, x in texts), sum(1 - x for _, x in texts)
    want = {}
    for token, n in a.items():
        m = b[token]
        odds = math.log((n + 0.5) / (na - n + 0.5)) - math.log((m + 0.5) / (nb - m + 0.5))
        if n >= 2 and odds >= 4 * math.sqrt(1 / (n + 0.5) + 1 / (na - n + 0.5) + 1 / (m + 0.5) + 1 / (nb - m + 0.5)):
            want[token] = odds
    assert np.allclose(sorted(got.odds[:, 0][got.odds[:, 0] > 0]), sorted(want.values())) and {(0, b"vile"), (5, b"grott"), (7, b"grottin")} <= want.keys()
    found = df.select(distinct_tokens(F.col("text")).alias("t")).collect()
    assert sum(len(r.t) for r in found) == sum(len(set(plain(t))) for t, _ in rows)
    assert len(learn(df.limit(0)).keys) == 0


def test_evidence_by_the_other_half():
    """A token's column by half: texts of half 0 are judged by half 1's lexicon and the other way round."""
    one = next(tokens(*texts_of(pa.array(["vile"]))))[0]
    lexicon = Lexicon(np.sort(one), np.array([[3.0, 1.0, 2.0]]))
    whole, other = lexicon.evidence(pa.array(["Vile, vile", "vile", "clean", None]), np.array([0, 1, 0, 1]))
    assert np.allclose(whole, [[math.log(2), 3, math.log(4), 10], [math.log(2), 3, math.log(4), 15], [0] * 4, [0] * 4])
    assert np.allclose(other[:, 1], [2, 1, 0, 0])
    none = Lexicon(np.zeros(0, np.uint64), np.zeros((0, 3))).evidence(pa.array(["x", None]), np.array([0, 1]))
    assert not none[0].any() and none[0].shape == (2, 4)


def test_toxic_rows_of_good_quality_go(spark):
    """Fitted on half of the labelled rows of the test tables: of the others few toxic rows of good quality stay, few good rows go."""
    from skerry.llm.quality_classifier import classify

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = classify(docs, labels.where("doc_id % 2 = 0"), F.col("source"), F.col("lang")).select("doc_id", "kept")
    held = labels.where("doc_id % 2 = 1 AND quality = 1").join(judged, "doc_id").collect()
    toxic, clean = [r.kept for r in held if r.toxic], [r.kept for r in held if not r.toxic]
    print("toxic kept", sum(toxic), len(toxic), "clean lost", len(clean) - sum(clean), len(clean))
    assert sum(toxic) <= 0.1 * len(toxic) and len(clean) - sum(clean) <= 0.02 * len(clean)
