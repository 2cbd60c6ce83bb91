"""Scores against counts made word by word."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skerry.llm.lm_scoring import CONTEXT_BUCKETS, _NEVER, _STEP, learn_weights, score_documents

SCHEMA = "doc_id bigint, text string, score string"


def brute(rows, order):
    docs = []
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        crc = zlib.crc32(b"" if doc is None else str(doc).encode())
        docs.append((doc, ["<s>"] * order + words + ["</s>"], crc % 10 == 0, crc % 10 != 0 and crc // 10 % 10 == 0))
    total, deleted = Counter(), Counter()
    for _, seq, held, cut in docs:
        for i in range(order - 1, len(seq)):
            for k in range(1, order + 1):
                if not held:
                    total[tuple(seq[i - k + 1 : i + 1])] += 1
                    deleted[tuple(seq[i - k + 1 : i + 1])] += cut
    unigrams = {g: c for g, c in total.items() if len(g) == 1 and g != ("<s>",) and c}
    n, v, gone = sum(unigrams.values()), len(unigrams), sum(c for g, c in deleted.items() if len(g) == 1 and g != ("<s>",))

    def estimates(seq, i, count, tokens):
        out, context = [1 / (v + 1)], tokens
        for k in range(1, order + 1):
            context = tokens if k == 1 else count(tuple(seq[i - k + 1 : i]))
            out.append(count(tuple(seq[i - k + 1 : i + 1])) / context if context else 0.0)
        return min(int(math.log2(context + 1)), CONTEXT_BUCKETS - 1), out

    grid = Counter()
    for _, seq, _held, cut in docs:
        for i in range(order, len(seq)) if cut else ():
            b, e = estimates(seq, i, lambda g: total[g] - deleted[g], n - gone)
            grid[(b, *(math.floor(math.log2(x / e[0]) / _STEP) if x > 0 else _NEVER for x in e[1:]))] += 1
    keys = list(grid)
    w = learn_weights(np.array([k[0] for k in keys]), np.array([k[1:] for k in keys]), np.array([grid[k] for k in keys]), order)
    out = []
    for doc, seq, held, _cut in docs:
        base = score = known = 0
        for i in range(order, len(seq)):
            c = total[(seq[i],)]
            known += c > 0
            base += math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            b, e = estimates(seq, i, total.__getitem__, n)
            score += math.log10(sum(x * y for x, y in zip(w[b], e, strict=True)))
        out.append((doc, held, len(seq) - order, known, n, base, score))
    return out


def corpus(n=400):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60))).title(), "x") for k in range(n)]
    return [*rows, rows[3], (None, "W1 w2", None), (9001, None, ""), (9002, " \t", ""), (9003, "w1\x0bW1 é " * 5000, "")]


@pytest.mark.parametrize("order", [2, 3])
def test_matches_counting(spark, order):
    rows = corpus()
    key = lambda r: (str(r[0]), *map(str, r[1:5]), round(r[5], 6))
    got = sorted(map(tuple, score_documents(spark.createDataFrame(rows, SCHEMA), order).collect()), key=key)
    want = sorted(brute(rows, order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_empty_and_untrained(spark):
    assert not score_documents(spark.createDataFrame([], SCHEMA)).collect()
    row = score_documents(spark.createDataFrame([(None, "a b", "")], SCHEMA)).first()
    assert row.held_out and row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0 and np.isfinite([row.score, row.base_score]).all()


def plain_em(rows, start, strength, rounds=60):
    """Mixture weights by the textbook: rows of component probabilities, each with a count; strength pseudo-counts of the start."""
    w = list(start)
    for _ in range(rounds):
        counts = [strength * s for s in start]
        for p, c in rows:
            whole = sum(a * b for a, b in zip(w, p, strict=True))
            for k in range(len(w)):
                counts[k] += c * w[k] * p[k] / whole
        w = [c / sum(counts) for c in counts]
    return w


def test_weights_against_plain_em():
    rng = np.random.default_rng(3)
    cells = np.stack([rng.integers(-4, 20, 60), rng.integers(2, 24, 60)], 1)
    cells[rng.random(60) < 0.3, 1] = _NEVER
    buckets, n = rng.integers(0, 3, 60), rng.integers(1, 50, 60)
    got = learn_weights(buckets, cells, n, 2)
    probability = lambda x: 0.0 if x == _NEVER else 2.0 ** ((x + 0.5) * _STEP)
    rows = [([1.0, *map(probability, c)], int(k)) for c, k in zip(cells.tolist(), n, strict=True)]
    overall = plain_em(rows, [1 / 3] * 3, 1.0)
    for b in range(4):
        want = plain_em([r for r, x in zip(rows, buckets, strict=True) if x == b], overall, 5.0)
        assert np.allclose(got[b], want, atol=1e-6)


def test_classes_lose_little():
    """Weights from exact estimates give nearly the same likelihood as those from classes of half a power of two."""
    rng = np.random.default_rng(4)
    ratios = np.exp(rng.normal([2.0, 4.0], [1.5, 2.5], (4000, 2)))
    ratios[rng.random(4000) < 0.4, 1] = 0.0
    fit, held = ratios[:2000], ratios[2000:]
    exact = plain_em([([1.0, *r], 1) for r in fit.tolist()], [1 / 3] * 3, 1.0)
    cells = np.where(fit > 0, np.floor(np.log2(np.maximum(fit, 1e-300)) / _STEP), _NEVER).astype(int)
    keys, n = np.unique(cells, axis=0, return_counts=True)
    classes = learn_weights(np.zeros(len(keys), int), keys, n, 2)[0]
    loss = lambda w: np.log10(w[0] + held @ np.asarray(w[1:])).mean()
    assert 0 <= abs(loss(exact) - loss(classes)) < 2e-3


def test_texts_beyond_a_megabyte(spark):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400_000)]
    rows = [*corpus(60), (9100, " ".join(words), ""), (9101, " ".join(words[::-1]), "")]
    assert len(rows[-1][1]) > 1 << 20
    got = {r.doc_id: tuple(r) for r in score_documents(spark.createDataFrame(rows, SCHEMA), 2).where("doc_id > 9000").collect()}
    want = {r[0]: r for r in brute(rows, 2) if r[0] is not None and r[0] > 9000}
    for k, r in got.items():
        assert r[:5] == want[k][:5] and np.allclose(r[5:], want[k][5:], rtol=1e-9)
