"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic text classifier, fitted on a bounded sample of labelled rows, gives each document its evidence. Grouped sums of
that evidence give each host a posterior, shrunk towards the global prior, and each path of a host one shrunk towards its
host; how strongly is estimated from the spread between groups. A document's own evidence is taken out of its path's sums
before both are combined, so that nothing counts twice.

Toxic documents count as bad. A second classifier tells them by hashed words that the same sample ties to the label
(`toxicity.py`), with weights learned from evidence that hasn't seen the row. A text is good if it is of quality and not toxic,
so its evidence is the log-odds of the product of both.

How much a site counts beside the text is learned on the labelled rows too.

Sums are partial aggregates of one row a path; the path table joins back by its key, which Spark splits where a path is
large. Nothing is collected but the sample
and two numbers a level.

Defined results: null text is empty. Null host or path is a group of its own. Null or repeated doc_id: every row is
judged. Without labels of both kinds of either label, or for labels without documents, the text evidence is 0 and all rows are
kept; where one of the two labels has both kinds, it alone is the evidence.
Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.exchange import Workspace, bounded_sample
from skerry.llm.textcounts import COUNTS, text_counts
from skerry.llm.textstats import ratio
from skerry.llm.toxicity import EVIDENCE, evidence, learn

FEATURES = ("log_words", "symbol_share", "capital_share", "mark_share", "same_share", "distinct_share", "dup_line_share", "mean_word")
_FLOOR = 1e-4


def text_features(docs: DataFrame, text: str, keep: list[str], lexicon: Broadcast) -> DataFrame:
    """The kept columns, a column f_NAME for each feature, and toxic_ and toxic_other_, the evidence by the lexicon."""
    rows = docs.withColumn("text_", F.coalesce(F.col(text), F.lit("")))
    rows = rows.select(*keep, text_counts(F.col("text_")).alias("n_"), evidence(F.col("text_"), lexicon).alias("found_"))  # one pass of Python
    n = {c: F.col(f"n_.{c}") for c in COUNTS}
    made = {
        "log_words": F.log1p(n["words"].cast("double")),
        "symbol_share": F.sqrt(ratio(n["symbols"], n["chars"])),
        "capital_share": F.sqrt(ratio(n["capitals"], n["chars"])),
        "mark_share": F.sqrt(ratio(n["marks"], n["chars"])),
        "same_share": F.sqrt(ratio(n["same"], n["words"])),
        "distinct_share": ratio(n["distinct"], n["words"]),
        "dup_line_share": ratio(n["dup_lines"], n["lines"]),
        "mean_word": F.log1p(ratio(n["chars"], n["words"])),
    }
    return rows.select(*keep, *(made[name].alias(f"f_{name}") for name in FEATURES), F.col("found_.whole").alias("toxic_"), F.col("found_.other").alias("toxic_other_"))


@dataclass(frozen=True)
class TextModel:
    bias: float
    weights: tuple[float, ...]
    prior: float  # share of good rows in the sample
    bounds: tuple[tuple[float, float], ...] = ((0.0, 0.0),) * len(FEATURES)  # of the sample; values beyond count as these

    def logit(self, values: list[Column]) -> Column:
        out = F.lit(self.bias)
        for value, w, (lo, hi) in zip(values, self.weights, self.bounds, strict=True):
            out = out + F.greatest(F.lit(lo), F.least(F.lit(hi), value)) * w
        return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), out))

    def of(self, x: np.ndarray) -> np.ndarray:
        lo, hi = np.array(self.bounds).T
        return np.clip(self.bias + np.clip(x, lo, hi) @ np.array(self.weights), -20, 20)

    @property
    def void(self) -> bool:
        """Fitted on rows of one kind or none: it says nothing."""
        return not any(self.weights) and self.bias == 0.0


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> TextModel:
    """Ridge logistic regression by Newton's method on standardised features."""
    if len(y) == 0 or y.min() == y.max():
        return TextModel(0.0, (0.0,) * x.shape[1], 0.5, ((0.0, 0.0),) * x.shape[1])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], 1)
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-9, *([ridge] * (z.shape[1] - 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return TextModel(float(w[0] - weights @ mean), tuple(map(float, weights)), float(y.mean()), tuple(zip(x.min(0).tolist(), x.max(0).tolist(), strict=True)))


def good_log_odds(quality: np.ndarray, toxic: np.ndarray | None) -> np.ndarray:
    """Log-odds of being of quality and not toxic, from those of both; a model that is void has none."""
    if toxic is None:
        return quality
    p = 1 / (1 + np.exp(-quality)) / (1 + np.exp(toxic))
    return np.clip(np.log(np.maximum(p, 1e-300)) - np.log1p(-np.minimum(p, 1 - 1e-16)), -20, 20)


def crossed_logits(x: np.ndarray, y: np.ndarray, hints: np.ndarray, toxic: np.ndarray, margin: float) -> np.ndarray:
    """Text evidence for every other row from fits on the rows between, so that no row's label is in its own evidence."""
    out = np.zeros(len(x))
    for k in (0, 1):
        quality, other = fit(x[1 - k :: 2], y[1 - k :: 2]), fit(hints[1 - k :: 2], toxic[1 - k :: 2])
        if quality.void and not other.void:
            out[k::2] = margin - other.of(hints[k::2])
        else:
            out[k::2] = good_log_odds(quality.of(x[k::2]), None if other.void else other.of(hints[k::2]) - margin)
    return out


def fit_weight(rows: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> float:
    """What the second column counts beside the first as log-odds of the third, from 0 to 1: a ridge logistic fit of one number.
    Without rows of both kinds 0."""
    if not len(rows) or rows[:, 2].min() == rows[:, 2].max():
        return 0.0
    text, site, good = rows.T
    w = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(text + w * site, -30, 30)))
        w = min(1.0, max(0.0, w + (site @ (good - p) - ridge * w) / (site**2 @ (p * (1 - p)) + ridge)))
    return float(w)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(_FLOOR), F.least(F.lit(1 - _FLOOR), p))
    return F.ln(p / (1 - p))


def _strength(groups: DataFrame, prior: Column, least: float, most: float) -> float:
    """Pseudo-counts of a level's prior by moments: its mean's own spread over the spread that sampling doesn't explain."""
    mean = F.col("s") / F.col("n")
    within, excess = F.col("n") * prior * (1 - prior), F.col("n") * F.pow(mean - prior, 2) - prior * (1 - prior)
    row = groups.where("n > 1").agg(F.sum(within).alias("v"), F.sum(excess).alias("e"), F.sum("n").alias("n")).first()
    if not row.n or row.e is None or row.e <= 0:
        return most
    return float(min(most, max(least, row.v / row.e)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most_labelled: int = 20_000, site_weight: float | None = None, threshold: float = 0.5, toxic_margin: float = 0.85, carry: bool = False) -> DataFrame:
    """doc_id, text_logit, host_posterior, path_posterior, posterior and kept of each row of docs(doc_id, text, ...).

    labels: doc_id, quality (1 good, 0 bad), toxic (1 toxic, which makes a row bad; may be absent). host, path: expressions over docs. most_labelled: labelled rows that the text
    classifier is fitted on, the first in the order of a hash. site_weight: what a site's log-odds against the global prior
    count beside the text's; by default learned on the same labelled rows, with text evidence from fits that haven't seen the row. A posterior of just the threshold is kept. threshold: least posterior of kept rows. toxic_margin: log-odds that are taken
    off those of being toxic; by default it takes seven chances in ten to make a row bad, as clean rows are to stay. carry: also return the whole input row as struct row_.
    """
    space = Workspace(docs.sparkSession, "quality")
    more = ["row_"] if carry else []
    rows = docs.select("doc_id", "text", host.cast("string").alias("host_"), path.cast("string").alias("path_"), *(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(c) for c in more))
    bad = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(bad).cast("int").alias("toxic"))
    n_known = known.count()
    share = int(min(1.0, most_labelled / max(n_known, 1)) * (1 << 30))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share
    texts = space.settle(docs.where(chosen).select("doc_id", "text").join(known.where(chosen), "doc_id").select("text", "toxic"), "texts")
    lexicon = docs.sparkSession.sparkContext.broadcast(learn(texts))  # of a bounded sample
    rows = space.settle(text_features(rows, "text", ["doc_id", "host_", "path_", *more], lexicon), "features")
    names, hints = [f"f_{x}" for x in FEATURES], [F.col("toxic_other_")[k] for k in range(len(EVIDENCE))]
    labelled = space.settle(rows.join(known, "doc_id").drop("row_"), "labelled")

    def sampled(of: DataFrame, *further: str) -> np.ndarray:
        """Features, toxic evidence that hasn't seen the row, further columns, quality and toxic: bounded by most_labelled."""
        some = of.select(*names, *(h.alias(f"h_{k}") for k, h in enumerate(hints)), *further, "quality", "toxic", F.xxhash64("doc_id").alias("h"), "doc_id")
        some = bounded_sample(some, "h", ["doc_id", *names], n_known, most_labelled).drop("h", "doc_id")
        return np.array([[float(v) for v in r] for r in some.collect()]).reshape(-1, len(names) + len(hints) + len(further) + 2)

    got = sampled(labelled)
    quality, toxic = fit(got[:, : len(names)], got[:, -2]), fit(got[:, len(names) : -2], got[:, -1])
    text_logit = quality.logit([F.col(n) for n in names])
    if not toxic.void:
        tell = toxic.logit([F.col("toxic_")[k] for k in range(len(EVIDENCE))]) - toxic_margin
        both = 1 / (1 + F.exp(-text_logit)) / (1 + F.exp(tell))
        text_logit = -tell if quality.void else F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.ln(both) - F.ln(F.greatest(F.lit(1e-16), 1 - both))))

    rows = rows.select("doc_id", "host_", "path_", *more, text_logit.alias("text_logit"))
    rows = rows.withColumn("p", 1 / (1 + F.exp(-F.col("text_logit"))))
    paths = space.settle(rows.groupBy("host_", "path_").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host_").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = min(1 - _FLOOR, max(_FLOOR, (total.s / total.n) if total.n else quality.prior))
    host_strength = _strength(hosts, F.lit(prior), 2.0, 1e4)
    hosts = hosts.select(F.col("host_").alias("h_"), ((F.col("s") + host_strength * prior) / (F.col("n") + host_strength)).alias("host_posterior"))
    joined = paths.join(hosts, F.col("host_").eqNullSafe(F.col("h_"))).drop("h_")
    path_strength = _strength(joined, F.col("host_posterior"), 2.0, 1e4)
    plan = space.settle(joined.select(F.col("host_").alias("h_"), F.col("path_").alias("q_"), "n", "s", "host_posterior"), "sites")

    def with_site(of: DataFrame) -> DataFrame:
        """Adds path_posterior, without the row's own p, and its log-odds against the global prior."""
        others = (F.col("s") - F.col("p") + path_strength * F.col("host_posterior")) / (F.col("n") - 1 + path_strength)
        of = of.join(plan, F.col("host_").eqNullSafe(F.col("h_")) & F.col("path_").eqNullSafe(F.col("q_"))).withColumn("path_posterior", others)
        return of.withColumn("site_", _logit(F.col("path_posterior")) - _logit(F.lit(prior)))

    if site_weight is None:
        got = sampled(with_site(labelled.withColumn("p", 1 / (1 + F.exp(-text_logit)))), "site_")
        good = got[:, -2] * (got[:, -1] == 0)
        own = crossed_logits(got[:, : len(names)], got[:, -2], got[:, len(names) : -3], got[:, -1], toxic_margin)
        site_weight = fit_weight(np.column_stack((own, got[:, -3], good)))
    rows = with_site(rows)
    evidence = F.col("text_logit") + site_weight * F.col("site_")
    rows = rows.withColumn("posterior", 1 / (1 + F.exp(-evidence)))
    return rows.select("doc_id", "text_logit", "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= threshold).alias("kept"), *more)
