"""Quality rules: decision lists learned by sequential covering. DataFrame functions only.

Statistics of each text are Spark expressions. Rules are learned on the driver from a bounded sample of labelled
statistics: each rule grows by the threshold that gains most, is pruned on a held-back third, and covers its rows; the
next rule sees what is left. The list becomes one ordered conditional expression, which judges every document.

Defined results: null text has no words and fails the base test. Null or repeated doc_id: every row is judged. Documents
without labels are judged too; labels without documents teach nothing. Without labels of both kinds there are no rules,
and the base test decides. Of equal gains the first feature, the lower threshold and the side below it are taken. Empty table:
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.exchange import Workspace, bounded_sample
from skerry.llm.textstats import CAPITALS, SYMBOLS, count_of, line_counts, ratio, repeat_words, with_words, without, SPACES

#: Features that rules may test, made from the statistics.
FEATURES = {
    "n_words": F.col,
    "mean_word": lambda _: ratio("word_chars", "n_words"),
    "symbol_share": lambda _: ratio("n_symbols", "word_chars"),
    "capital_share": lambda _: ratio("n_capitals", "word_chars"),
    "mark_share": lambda _: ratio("n_marks", "word_chars"),
    "repeat_share": lambda _: ratio("n_repeat_words", "n_words"),
    "dup_line_share": lambda _: ratio("n_dup_lines", "n_lines"),
    "distinct_share": lambda _: ratio("n_distinct", "n_words"),
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row of docs(doc_id, text)."""
    rows = line_counts(repeat_words(with_words(docs.select("doc_id", "text"), "text")))
    return rows.select(
        "doc_id",
        F.size("words_").cast("bigint").alias("n_words"),
        F.length(without(F.col("text_"), SPACES)).cast("bigint").alias("word_chars"),
        count_of(F.col("text_"), SYMBOLS).alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "n_lines",
        count_of(F.col("text_"), CAPITALS).alias("n_capitals"),
        count_of(F.col("text_"), "!?").alias("n_marks"),
        F.size(F.array_distinct("words_")).cast("bigint").alias("n_distinct"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    made = {name: make(name).cast("double").alias(f"f_{name}") for name, make in FEATURES.items()}
    return stats.select("*", *made.values())


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        value = F.col(f"f_{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; precision is smoothed, over the rows the rule saw."""

    conditions: tuple[Condition, ...]
    precision: float

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)


def learn_rules(rows: list[dict], features: list[str], most_rules: int = 12, most_conditions: int = 4, cuts: int = 32, least_precision: float = 0.7) -> list[Rule]:
    """Sequential covering over rows of features with the key bad (true: to be rejected). Rows in a fixed order."""
    grow, prune = [r for k, r in enumerate(rows) if k % 3], [r for k, r in enumerate(rows) if not k % 3]
    rules: list[Rule] = []
    while len(rules) < most_rules and any(r["bad"] for r in grow):
        conditions = _prune(_grow(grow, features, most_conditions, cuts), prune)
        if not conditions:
            break
        seen = [r["bad"] for r in grow + prune if all(c.holds(r) for c in conditions)]
        precision = (sum(seen) + 1) / (len(seen) + 2)
        if precision < least_precision:
            break
        rule = Rule(tuple(conditions), precision)
        rules.append(rule)
        grow, prune = [r for r in grow if not rule.holds(r)], [r for r in prune if not rule.holds(r)]
    return rules


def _grow(rows: list[dict], features: list[str], most: int, cuts: int) -> list[Condition]:
    conditions: list[Condition] = []
    covered = rows
    while len(conditions) < most:
        bad = sum(r["bad"] for r in covered)
        if bad in (0, len(covered)):
            break
        base, best, chosen = math.log2(bad / len(covered)), 1e-9, None
        for feature in features:
            ranked = sorted((r[feature], r["bad"]) for r in covered)
            upto = [0]
            for _, b in ranked:
                upto.append(upto[-1] + b)
            n = len(ranked)
            for at in sorted({round(n * k / cuts) for k in range(1, cuts)} | _edges(upto, n)):
                while 0 < at < n and ranked[at - 1][0] == ranked[at][0]:
                    at += 1
                if not 0 < at < n:
                    continue
                for above, b, size in ((False, upto[at], at), (True, bad - upto[at], n - at)):
                    if b and (gain := b * (math.log2(b / size) - base)) > best:
                        best, chosen = gain, Condition(feature, above, (ranked[at - 1][0] + ranked[at][0]) / 2)
        if chosen is None:
            break
        conditions.append(chosen)
        covered = [r for r in covered if chosen.holds(r)]
    return conditions


def _edges(upto: list[int], n: int) -> set[int]:
    """Where the pure runs at both ends of the order stop."""
    lead_bad = next((k for k in range(n) if upto[k + 1] == upto[k]), n)
    tail_bad = next((k for k in range(n, 0, -1) if upto[k] == upto[k - 1]), 0)
    return {lead_bad, tail_bad}


def _prune(conditions: list[Condition], rows: list[dict]) -> list[Condition]:
    def worth(kept: list[Condition]) -> float:
        seen = [r["bad"] for r in rows if all(c.holds(r) for c in kept)]
        return (2 * sum(seen) - len(seen)) / len(seen) if seen else -1.0

    best = conditions
    for k in range(len(conditions) - 1, 0, -1):
        if worth(conditions[:k]) >= worth(best):
            best = conditions[:k]
    return best


def rules_column(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        test = F.lit(True)
        for c in rules[k - 1].conditions:
            test = test & c.column()
        out = F.when(test, k).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and rule of each row of docs(doc_id, text); labels(doc_id, quality).

    most_labelled: labelled rows that rules are learned from, the first in the order of a hash.
    """
    space = Workspace(docs.sparkSession, "rules")
    stats = space.settle(with_features(statistics(docs)), "stats")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = stats.join(known, "doc_id").select(*(f"f_{x}" for x in FEATURES), (F.col("quality") == 0).alias("bad"), F.xxhash64("doc_id").alias("h"), "doc_id", "word_chars")
    rows = [r.asDict() for r in bounded_sample(sample, "h", ["doc_id", "word_chars"], known.count(), most_labelled).drop("h", "doc_id", "word_chars").collect()]  # bounded by most_labelled
    rules = learn_rules([{k.removeprefix("f_"): v for k, v in r.items()} for r in rows], list(FEATURES))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = stats.withColumn("base_failed", base).withColumn("rule", rules_column(rules))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
