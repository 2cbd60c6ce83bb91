"""Language ID by Bayesian evidence fusion.

Byte-gram likelihoods, counted over all labelled texts, give each row a first posterior. Grouped sums of those posteriors
over all rows say how often each declared language and address suffix goes with each language, and give each host a prior
shrunk towards its domain's, which is shrunk towards the global one. The final posterior multiplies text, declaration,
suffix and prior; a row's own first posterior is taken out of its host's sums.

Tables that grow with the data (hosts, domains) are joined by key. The likelihood table has an entry for each
gram that a language has; it and the names of the languages are on the driver and in the workers, arrays of posteriors have a
number a language.

Defined results: null text is empty; then the other evidence decides. Equal posteriors go to the first language by name. Null, unknown or repeated declarations, suffixes,
hosts and keys are values like others; every row is returned. Without labelled texts the language is null. Empty table:
empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import hashing
from skerry.llm.exchange import Workspace, batches, binary_column, tidy

GRAMS = 1 << 14
_PIECE = 1 << 20
#: Languages that a task of the gram counts holds at a time; what it counted goes out before it takes more.
_HELD = 256


def gram_codes(text: bytes) -> np.ndarray:
    """Codes of the three-byte grams of a text in lower case, with a space around it; white space and digits count as one space."""
    data = hashing.lower_ascii(np.frombuffer(b" " + text + b" ", np.uint8)).astype(np.uint32)
    data[(data <= 32) | ((data >= 48) & (data <= 57))] = 32
    codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    return ((codes * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


_GRAM = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over labelled(lang, text); each partition adds up its rows first."""

    def rows(total: dict[str, np.ndarray]) -> Iterator[tuple]:
        return ((lang, g, int(c[g])) for lang, c in total.items() for g in np.flatnonzero(c).tolist())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in it:
            for lang, text in zip(b.column(0).to_pylist(), binary_column(b, "text"), strict=True):
                if lang not in total and len(total) >= _HELD:
                    yield from batches(_GRAM, rows(total))
                    total.clear()
                counts = total.setdefault(lang, np.zeros(GRAMS, np.int64))
                for k in range(0, len(text), _PIECE):
                    counts += np.bincount(gram_codes(text[k : k + _PIECE]), minlength=GRAMS)
        yield from batches(_GRAM, rows(total))

    return labelled.select("lang", "text").mapInArrow(tidy(run), "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class GramTable:
    """Log likelihoods of grams by language: one number a language for grams it hasn't, and by gram what the languages that
    have it add to that."""

    unseen: np.ndarray
    ends: np.ndarray  # of each gram's entries
    langs: np.ndarray
    gains: np.ndarray

    @classmethod
    def of(cls, langs: np.ndarray, grams: np.ndarray, counts: np.ndarray, n: int) -> GramTable:
        """From counts of pairs of a language's number and a gram; half a count more for each gram."""
        by = np.argsort(grams, kind="stable")
        totals = np.bincount(langs, weights=counts, minlength=n)
        return cls(np.log(0.5 / (totals + 0.5 * GRAMS)), np.cumsum(np.bincount(grams, minlength=GRAMS)), langs[by], np.log1p(2.0 * counts[by]))

    def logs(self, counts: np.ndarray) -> np.ndarray:
        """Of a text with so many of each gram."""
        grams = np.flatnonzero(counts)
        ends = self.ends[grams]
        sizes = ends - np.where(grams > 0, self.ends[grams - 1], 0)
        at = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        return self.unseen * counts.sum() + np.bincount(self.langs[at], weights=self.gains[at] * np.repeat(counts[grams], sizes), minlength=len(self.unseen))


_FIRST_SQL = "text_logs array<double>"


def text_logs(rows: DataFrame, keys: list[str], table: GramTable) -> DataFrame:
    """The key columns and the log likelihood of the text in each language, up to a constant."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = []
            for text in binary_column(b, "text"):
                logs = np.zeros(len(table.unseen))
                for k in range(0, len(text), _PIECE):
                    logs += table.logs(np.bincount(gram_codes(text[k : k + _PIECE]), minlength=GRAMS))
                found.append((logs - logs.max()).tolist() if len(logs) else [])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(found, pa.list_(pa.float64()))], [*keys, "text_logs"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return rows.select(*keys, "text").mapInArrow(tidy(run), f"{schema}, {_FIRST_SQL}")


def _posterior(logs: str, n: int) -> Column:
    """exp(log - max), normalised, of an array column."""
    top = f"array_max({logs})"
    return F.expr(f"transform({logs}, x -> exp(x - {top}) / aggregate({logs}, 0D, (a, y) -> a + exp(y - {top})))")


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*(F.sum(F.col("first")[k]) for k in range(n))).alias("sums"))


def identify(rows: DataFrame, labelled: DataFrame, strength: float = 8.0, smoothing: float = 0.5) -> DataFrame:
    """kind, id, lang, probability, text_lang, declared of each row of rows(kind, id, text, declared, suffix, host).

    labelled: lang, text. strength: pseudo-count of a host's domain and of a domain's global prior. smoothing: pseudo-count
    of declarations and suffixes.
    """
    spark = rows.sparkSession
    space = Workspace(spark, "language")
    labelled = labelled.where("lang is not null")
    names = sorted(r.lang for r in labelled.select("lang").distinct().collect())  # languages
    n = len(names)
    if not n:
        return rows.select("kind", F.col("id").cast("bigint").alias("id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared")
    number = {name: k for k, name in enumerate(names)}
    found = array("q")
    for r in gram_counts(labelled).toLocalIterator():  # grams of each language at most
        found.extend((number[r.lang], r.gram, r.n))
    table = GramTable.of(*np.array(found, np.int64).reshape(-1, 3).T, n)

    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    keyed = rows.select("kind", F.col("id").cast("bigint").alias("id"), "declared", "suffix", "host", "text").withColumn("domain", F.when(domain == "", F.col("host")).otherwise(domain))
    first = text_logs(keyed, ["kind", "id", "declared", "suffix", "host", "domain"], table)
    first = space.settle(first.withColumn("first", _posterior("text_logs", n)), "first")

    groups = space.settle(_sums(first, ["kind", "declared", "suffix", "host", "domain"], n), "groups").withColumnRenamed("sums", "first")
    everything = groups.agg(*(F.sum(F.col("first")[k]).alias(f"s{k}") for k in range(n))).first()
    total = np.array([everything[k] or 0.0 for k in range(n)]) + smoothing
    prior = F.array(*(F.lit(float(x)) for x in total / total.sum()))

    def likelihood(key: str) -> DataFrame:
        """log P(value | language), with a share for values never seen."""
        sums = _sums(groups, ["kind", key], n)
        whole = F.array(*(F.lit(float(x)) for x in total + 64 * smoothing))
        logs = F.zip_with("sums", whole, lambda s, w: F.ln((s + smoothing) / w))
        return sums.select(F.col("kind").alias("k_"), F.col(key).alias("v_"), logs.alias(f"{key}_logs"))

    def shrunk(sums: str, towards: Column | str) -> Column:
        towards = F.col(towards) if isinstance(towards, str) else towards
        whole = F.aggregate(sums, F.lit(strength), lambda a, x: a + x)
        return F.zip_with(sums, towards, lambda s, t: (s + strength * t) / whole)

    domains = _sums(groups, ["kind", "domain"], n).select(F.col("kind").alias("k_"), F.col("domain").alias("d_"), shrunk("sums", prior).alias("domain_prior"))
    hosts = _sums(groups, ["kind", "host", "domain"], n).withColumnRenamed("sums", "host_sums")
    hosts = hosts.join(domains, (F.col("kind") == F.col("k_")) & F.col("domain").eqNullSafe(F.col("d_"))).select(F.col("kind").alias("k_"), F.col("host").alias("v_"), F.col("domain").alias("d_"), "host_sums", "domain_prior")

    out = first
    for key in ("declared", "suffix"):
        known = space.settle(likelihood(key), key)
        out = out.join(known, (F.col("kind") == F.col("k_")) & F.col(key).eqNullSafe(F.col("v_")), "left").drop("k_", "v_")
    hosts = space.settle(hosts, "hosts")
    out = out.join(hosts, (F.col("kind") == F.col("k_")) & F.col("host").eqNullSafe(F.col("v_")) & F.col("domain").eqNullSafe(F.col("d_")), "left")
    others = out.withColumn("others", F.zip_with("host_sums", "first", lambda s, own: F.greatest(F.lit(0.0), s - own)))
    host_prior = shrunk("others", "domain_prior")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(add("text_logs", "declared_logs"), "suffix_logs"), F.transform("host_prior", F.ln))
    out = others.withColumn("host_prior", host_prior).withColumn("logs", logs).withColumn("posterior", _posterior("logs", n))
    lang = lambda p: F.element_at(F.array(*map(F.lit, names)), F.array_position(p, F.array_max(p)).cast("int"))
    return out.select("kind", "id", lang(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), lang(F.col("first")).alias("text_lang"), "declared")
