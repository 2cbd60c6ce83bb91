"""Evidence of toxic texts: hashed words and beginnings of words that the labelled sample ties to the label.

Tokens are hashes, so the lexicon is two arrays of numbers, as long as the sample's toxic texts have words that tell. It goes to
the tasks as one broadcast value and never into a plan. Each text is read once; its tokens are looked up by numpy, a bounded
number of bytes at a time. Words are runs of ASCII letters (capitals as small ones), digits, apostrophes and characters beyond
ASCII; beginnings are the first bytes of longer words, for words that are told by how they begin.

Two more lexicons, each from half of the sample's texts, give every labelled text evidence that hasn't seen it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.exchange import lean
from skerry.llm.fill_middle import texts_of
from skerry.llm.hashing import lower_ascii, mix, prefix_sums, span_hashes

BEGINNINGS = (5, 7)
#: Names of what a text's tokens say: how many tell, how much the strongest does, all of them, and all by the text's length.
EVIDENCE = ("telling", "strongest", "together", "per_word")
_PART = np.zeros(256, bool)
_PART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = True
_AT_ONCE = 1 << 20


def tokens(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of the texts, for a stretch of the data at a time: hashes, the text of each, and which are whole words."""
    low = 0
    while low < len(data):
        high = min(len(data), low + _AT_ONCE)
        while high < len(data) and _PART[data[high - 1]] and high not in offsets:  # not inside of a word
            high += 1
        piece = lower_ascii(data[low:high])
        inside = _PART[piece]
        before = np.concatenate(([False], inside[:-1]))
        heads = offsets[(offsets > low) & (offsets < high)] - low
        before[heads] = False  # a text begins
        start = np.flatnonzero(inside & ~before)
        last = np.concatenate((~inside[1:], [True]))
        last[heads - 1] = True
        end = np.flatnonzero(inside & last) + 1
        sums, text = prefix_sums(piece), np.searchsorted(offsets, start + low, "right") - 1
        found, of, whole = [span_hashes(sums, start, end)], [text], [np.ones(len(start), bool)]
        for k in BEGINNINGS:
            longer = end - start > k
            found.append(mix(span_hashes(sums, start[longer], start[longer] + k) ^ np.uint64(k)))
            of.append(text[longer])
            whole.append(np.zeros(int(longer.sum()), bool))
        yield np.concatenate(found), np.concatenate(of), np.concatenate(whole)
        low = high


def distinct_tokens(text: Column) -> Column:
    """The text's distinct tokens."""

    @F.arrow_udf("array<bigint>")
    @lean
    def run(text: pa.Array) -> pa.Array:
        data, offsets = texts_of(text)
        upto, found, at = [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)], 0
        while at < len(text):  # some texts at a time
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _AT_ONCE, "right")) - 1)
            of, some = _distinct(_distinct([(t, h)]) for h, t, _ in tokens(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
            upto.append(upto[-1][-1] + np.searchsorted(of, np.arange(1, to - at + 1)))
            found.append(some)
            at = to
        return pa.ListArray.from_arrays(pa.array(np.concatenate(upto), pa.int32()), pa.array(np.concatenate(found).view(np.int64)))

    return run(text)


def _distinct(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a text and a token, in order."""
    held = list(parts)
    if not held:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    text, token = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    del held
    order = np.lexsort((token, text))
    text, token = text[order], token[order]
    del order
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    return text[new].astype(np.int32), token[new]


@dataclass
class Lexicon:
    """Sorted tokens and their log-odds, in three columns: from all texts of the sample, and from those of half 0 and half 1.
    0 where a token tells nothing."""

    keys: np.ndarray
    odds: np.ndarray

    def evidence(self, text: pa.Array, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EVIDENCE of each text by all of the sample, and by the half that the text isn't in."""
        n, words = len(text), np.zeros(len(text))
        found = [np.zeros((0, 2), np.int64)]
        for hashes, of, whole in tokens(*texts_of(text)):
            words += np.bincount(of[whole], minlength=n)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
                known = self.keys[at] == hashes
                found.append(np.stack((of[known], at[known]), 1))
        of, at = np.unique(np.concatenate(found), axis=0).T
        out = []
        for odds in (self.odds[at, 0], self.odds[at, 2 - half[of]] if len(of) else np.zeros(0)):
            most, total = np.zeros(n), np.bincount(of, odds, n)
            np.maximum.at(most, of, odds)
            out.append(np.stack((np.log1p(np.bincount(of[odds > 0], minlength=n)), most, np.log1p(total), 10 * total / (1 + words)), 1))
        return out[0], out[1]


def half_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def learn(texts: DataFrame, least: int = 2, least_z: float = 4.0) -> Lexicon:
    """texts: text and toxic (0 or 1), a bounded sample; equal texts count once. A token tells if its texts are clearly more
    often toxic than others: least toxic texts with it, and standard errors between its log-odds among both kinds."""
    some = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["text", "toxic"])
    some = some.select("toxic", half_of(F.col("text")).alias("half"), F.concat(distinct_tokens(F.col("text")), F.array(F.lit(0).cast("bigint"))).alias("t"))  # 0 counts the texts
    kinds = [F.sum(F.when((F.col("toxic") == a) & (F.col("half") == h), 1).otherwise(0)).cast("double").alias(f"n{a}{h}") for a in (1, 0) for h in (0, 1)]
    counts = some.select("toxic", "half", F.explode("t").alias("token")).groupBy("token").agg(*kinds).where(f"token = 0 OR n10 + n11 >= {least}").toArrow()
    table = np.stack([counts.column(f"n{a}{h}").to_numpy() for a in (1, 0) for h in (0, 1)], 1) if counts.num_rows else np.zeros((0, 4))
    token = counts.column("token").to_numpy().view(np.uint64) if counts.num_rows else np.zeros(0, np.uint64)
    if not len(token) or not (token == 0).any():
        return Lexicon(np.zeros(0, np.uint64), np.zeros((0, 3)))
    every = table[token == 0][0]
    table, token = table[token != 0], token[token != 0]
    odds = np.zeros((len(token), 3))
    for k, parts in enumerate(([0, 1], [0], [1])):
        a, b = table[:, parts].sum(1), table[:, [2 + p for p in parts]].sum(1)
        na, nb = every[parts].sum(), every[[2 + p for p in parts]].sum()
        more = np.log((a + 0.5) / (na - a + 0.5)) - np.log((b + 0.5) / (nb - b + 0.5))
        error = np.sqrt(1 / (a + 0.5) + 1 / (na - a + 0.5) + 1 / (b + 0.5) + 1 / (nb - b + 0.5))
        odds[:, k] = np.where((a >= least) & (more >= least_z * error), more, 0.0)
    telling = odds.any(1)
    order = np.argsort(token[telling])
    return Lexicon(token[telling][order], odds[telling][order])


def evidence(text: Column, lexicon: Broadcast) -> Column:
    """A struct of two arrays of EVIDENCE: `whole` by the lexicon of all the sample's texts, `other` by the half without the text."""

    @F.arrow_udf("struct<whole:array<double>,other:array<double>>")
    @lean
    def run(text: pa.Array, half: pa.Array) -> pa.Array:
        both = lexicon.value.evidence(text, half.to_numpy())
        ends = pa.array(np.arange(len(text) + 1) * len(EVIDENCE), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in both], ["whole", "other"])

    return run(text, half_of(text))
