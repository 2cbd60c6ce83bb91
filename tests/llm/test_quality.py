"""Statistics against plain counting, learned rules against planted ones, and the classifier's shrinkage."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skerry.llm.quality_classifier import classify, fit, fit_weight
from skerry.llm.quality_rules import judge, learn_rules, statistics

SCHEMA = "doc_id bigint, text string, n_words string, source string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k + j for k, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def corpus(n=300):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(50, 120))]
        bad = rng.random() < 0.3
        if bad:
            words = [w.upper() for w in words] if k % 2 else [w + "$$" for w in words]
        text = "".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in words)
        rows.append((k, text, "x", f"s{k % 5}", "en"))
        if k % 2 or k % 3:
            labels.append((k, int(not bad), 0))
    odd = ["", None, " \n\t", "a", "a b", "a b c a b c a b c", "é é é é", "same line\nsame line\n \nsame  line", "x " * 20000, "\x1c \x85 \xa0"]
    return [*rows, rows[2], *((1000 + k, t, None, None, None) for k, t in enumerate(odd)), (None, "a b a b a b", "", "s1", "en")], labels


def test_statistics(spark):
    rows, _ = corpus()
    got = statistics(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *plain(r[1])) for r in rows), key=str)


def test_rules_find_what_was_planted(spark):
    rows, labels = corpus()
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in judge(df, known).collect()}
    assert all(got[d].kept == bool(q) for d, q, _ in labels)
    assert got[1001].base_failed and not got[1001].kept and got[1008].base_failed
    assert judge(df, known).count() == len(rows)
    none = judge(df, known.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.rule == 0 for r in none)
    assert not judge(df.limit(0), known).collect()


def test_covering_is_ordered_and_pruned():
    rng = random.Random(3)
    rows = [{"a": rng.random(), "b": rng.random()} for _ in range(900)]
    for r in rows:
        r["bad"] = r["a"] > 0.8 or (r["b"] < 0.2 and r["a"] < 0.3)
    rules = learn_rules(rows, ["a", "b"])
    wrong = sum(any(rule.holds(r) for rule in rules) != r["bad"] for r in rows)
    assert 2 <= len(rules) <= 6 and wrong <= 15
    assert learn_rules(rows, ["a", "b"], most_conditions=1)[0].conditions[0].feature == "a"
    assert learn_rules([], ["a"]) == [] and learn_rules([{"a": 1.0, "bad": False}], ["a"]) == []


def test_classifier(spark):
    rows, labels = corpus()
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = classify(df, known, F.col("source"), F.col("lang"), carry=True)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[d].kept == bool(q) for d, q, _ in labels) and out.count() == len(rows)
    assert out.where("kept").select("row_.*").columns == df.columns
    assert all(r.kept for r in classify(df, known.limit(0), F.col("source"), F.col("lang")).collect())
    assert not classify(df.limit(0), known, F.col("source"), F.col("lang")).collect()


def test_small_sites_shrink_to_the_prior(spark):
    good = " ".join(f"w{k}" for k in range(60))
    bad = " ".join(f"W{k}$$" for k in range(60))
    rows = [(k, bad if k % 10 else good, "", "bad.example", "a") for k in range(400)]
    rows += [(k, good if k % 10 else bad, "", "good.example", "a") for k in range(400, 900)] + [(901, bad, "", "new.example", "a")]
    labels = [(k, int("$" not in t), 0) for k, t, *_ in rows[:880]]
    got = {r.doc_id: r for r in classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), F.col("source"), F.col("lang")).collect()}
    assert got[1].path_posterior < 0.2 and got[401].path_posterior > 0.8
    assert 0.3 < got[901].path_posterior < 0.8  # its own evidence is left out, so the prior speaks


def test_fit_without_both_kinds():
    assert fit(np.zeros((3, 8)), np.ones(3)).bias == 0.0


def test_toxic_documents_are_bad(spark):
    """Those of good quality go by their words, labelled or not; clean ones stay."""
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(50, 120))]
        toxic = k % 4 == 0
        if toxic:
            words[::9] = [rng.choice(["Vilesome", "grotting,", "smurked."]) for _ in words[::9]]
        rows.append((k, " ".join(words), "x", f"s{k % 5}", "en"))
        if k % 3:
            labels.append((k, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in classify(docs, known, F.col("source"), F.col("lang")).collect()}
    assert all(got[k] == (k % 4 != 0) for k in range(600))


def test_posteriors_against_plain_sums(spark):
    """Hosts, paths and posteriors again from the text evidence, by dictionaries."""
    rows, labels = corpus()
    rows = [(*r[:3], f"s{k % 7}" if k % 5 else None, f"p{k % 3}") for k, r in enumerate(rows)]
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = classify(df, known, F.col("source"), F.col("lang"), site_weight=0.7, carry=True).collect()
    share = lambda x: 1 / (1 + math.exp(-x))
    log_odds = lambda p: math.log(min(1 - 1e-4, max(1e-4, p)) / (1 - min(1 - 1e-4, max(1e-4, p))))
    hosts, paths = {}, {}
    for r in got:
        for table, key in ((hosts, r.row_.source), (paths, (r.row_.source, r.row_.lang))):
            table.setdefault(key, []).append(share(r.text_logit))
    prior = sum(map(sum, hosts.values())) / len(got)

    def strength(groups):
        """groups: values and the mean they shrink towards."""
        big = [(v, m) for v, m in groups if len(v) > 1]
        within = sum(len(v) * m * (1 - m) for v, m in big)
        excess = sum(len(v) * (sum(v) / len(v) - m) ** 2 - m * (1 - m) for v, m in big)
        return min(1e4, max(2.0, within / excess)) if big and excess > 0 else 1e4

    a = strength([(v, prior) for v in hosts.values()])
    host = {k: (sum(v) + a * prior) / (len(v) + a) for k, v in hosts.items()}
    b = strength([(v, host[k[0]]) for k, v in paths.items()])
    for r in got:
        own, key = share(r.text_logit), (r.row_.source, r.row_.lang)
        path = (sum(paths[key]) - own + b * host[key[0]]) / (len(paths[key]) - 1 + b)
        posterior = share(r.text_logit + 0.7 * (log_odds(path) - log_odds(prior)))
        assert math.isclose(r.host_posterior, host[key[0]], rel_tol=1e-9) and math.isclose(r.path_posterior, path, rel_tol=1e-9)
        assert math.isclose(r.posterior, posterior, rel_tol=1e-7, abs_tol=1e-12) and r.kept == (r.posterior >= 0.5)


def test_learned_site_weight():
    rng = np.random.default_rng(2)
    text, site = rng.normal(0, 2, 4000), rng.normal(0, 1.5, 4000)
    good = (rng.random(4000) < 1 / (1 + np.exp(-(text + 0.6 * site)))).astype(float)
    assert abs(fit_weight(np.stack((text, site, good), 1)) - 0.6) < 0.1
    assert fit_weight(np.stack((text, -site, good), 1)) == 0.0 and fit_weight(np.zeros((0, 3))) == 0.0 and fit_weight(np.ones((5, 3))) == 0.0


def test_held_out_error(spark):
    """Fitted on half of the labelled rows of the test tables; the other half tells the error."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = classify(docs, labels.where("doc_id % 2 = 0"), F.col("source"), F.col("lang")).select("doc_id", "kept")
    held = labels.where("doc_id % 2 = 1").withColumn("good", F.expr("quality = 1 and toxic = 0")).join(judged, "doc_id").collect()
    wrong = sum(r.good != r.kept for r in held)
    assert len(held) > 1500 and wrong <= 0.04 * len(held)


def test_equal_gains_take_the_first_feature():
    rows = [{"a": float(k % 50), "b": float(k % 50), "bad": k % 50 > 39} for k in range(300)]
    rules = learn_rules(rows, ["b", "a"])
    assert len(rules) == 1 and [(c.feature, c.above, c.threshold) for c in rules[0].conditions] == [("b", True, 39.5)]


def test_base_columns_of_a_text_beyond_a_megabyte(spark):
    long = "w1 w2 w3\n" * 90_000 + "x#" * 300_000 + "\nend"
    got = statistics(spark.createDataFrame([(1, long, "", "", "")], SCHEMA)).first()
    assert len(long) > 1 << 20 and (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == plain(long)
