"""Evidence adds up by Bayes' rule; short texts lean on their host, long ones on themselves."""

import random

import numpy as np
from pyspark.sql import functions as F

from skerry.llm.language_id import GRAMS, GramTable, identify

SCHEMA = "kind string, id bigint, text string, declared string, suffix string, host string, lang string"
WORDS = {"aa": ["kata", "lopi", "mennu", "suva"], "bb": ["zrok", "wyth", "grumf", "plox"]}


def corpus():
    rng = random.Random(4)
    rows = []
    for k in range(400):
        lang = rng.choice(["aa", "bb"])
        host = f"{lang}.site{k % 3}.example" if k % 4 else "mixed.example"
        text = " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 40)))
        declared = lang if rng.random() < 0.8 else rng.choice(["aa", "bb", None])
        rows.append(("page", k, text, declared, lang if k % 2 else "com", host, lang))
    return rows


def test_long_and_short_texts(spark):
    rows = corpus()
    extra = [("page", 1000, None, "aa", "aa", "aa.site1.example", None), ("page", 1001, "", None, "com", "bb.site2.example", None), ("page", 1002, "kata lopi mennu suva kata", "bb", "bb", "new.example", None), ("page", None, None, None, None, None, None), rows[0]]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    labelled = df.where("id < 400").select("lang", "text")
    out = identify(df, labelled).collect()
    got = {r.id: r for r in out}
    assert len(out) == len(rows) + len(extra)
    assert all(got[r[1]].lang == r[6] for r in rows)
    assert got[1000].lang == "aa" and got[1001].lang == "bb" and got[1002].lang == "aa" and got[1002].text_lang == "aa"
    assert all(0.5 <= r.probability <= 1.0 for r in out)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    none = identify(df, df.select("lang", "text").limit(0)).collect()
    assert len(none) == 400 and all(r.lang is None for r in none)
    assert not identify(df.limit(0), df.select("lang", "text")).collect()


def test_every_labelled_language_can_be_the_answer(spark):
    """Rare ones beside 70 others, and the table's sums against a dense one."""
    rng = random.Random(7)
    rows = []
    for n in range(71):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)]
        rows += [("page", len(rows), " ".join(rng.choices(words, k=30)), None, "com", f"h{n}.example", f"l{n:02d}") for _ in range(1 if n >= 69 else 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.lang for r in identify(df, df.select("lang", "text")).collect()}
    assert all(got[r[1]] == r[6] for r in rows)
    counts = np.random.default_rng(0).poisson(0.2, (5, GRAMS))
    lang, gram = np.nonzero(counts)
    table = GramTable.of(lang, gram, counts[lang, gram], 5)
    dense = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * GRAMS))
    text = np.random.default_rng(1).poisson(0.1, GRAMS)
    assert np.allclose(table.logs(text), dense @ text, rtol=1e-12)


def test_long_texts_ties_and_clashing_columns(spark):
    """Other columns, whatever their names, change nothing; a tie goes to the first language by name; long texts are read whole."""
    rows = [(*r[:6], r[6]) for r in corpus()[:60]]
    rows += [("page", 900, "kata lopi " * 120_000, "bb", "bb", "bb.site1.example", None), ("page", 901, "7 7 7", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    labelled = df.where("id < 400").select("lang", "text")
    plain = {r.id: tuple(r) for r in identify(df, labelled).collect()}
    wide = df.select("*", *(F.lit(1).alias(c) for c in ("domain", "first", "others", "sums", "k_", "v_", "d_", "probability", "text_logs")))
    assert {r.id: tuple(r) for r in identify(wide, labelled).collect()} == plain and plain[900][2] == "aa"
    tie = spark.createDataFrame([("page", 1, "", None, None, None, None)], SCHEMA)
    same = spark.createDataFrame([("bb", "mmm"), ("aa", "mmm")], "lang string, text string")
    assert identify(tie, same).first().lang == "aa"
