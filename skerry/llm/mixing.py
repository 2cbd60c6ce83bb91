"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Targets: each source's share of the budget by weight, at most `most` times its size, the excess shared out again by
weight (a water level, found by prefix sums over the sources in order of cap / weight). Whole epochs come first. The rest
is a sample without replacement: exponential keys divided by the document's quality weight, in order, up to the token
budget. Keys fall into slices; slice sums show the slice in which the budget ends, and only its rows are ordered. So a
source of any size costs one partial aggregation and the order of one slice.

Defined results: null text has size 0. Null sources are one source, the last. Null or not positive weights count as the
least weight. Null or repeated doc_id: every row is mixed, a null one by its text; ties in the key go by doc_id, size and text hash. A source
without words has target 0. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.exchange import Workspace
from skerry.llm.textstats import SYMBOLS, count_of, ratio, word_count

WEIGHTS = (3, 1, 2)
LEAST_WEIGHT = 0.05


def quality_weight(text: Column) -> Column:
    """From LEAST_WEIGHT to 1: less for texts with many symbols and exclamation marks."""
    text = F.coalesce(text, F.lit(""))
    return F.greatest(F.lit(LEAST_WEIGHT), 1.0 - 4.0 * ratio(count_of(text, SYMBOLS + "!"), F.length(text)))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: source, source_size, one row a source. Adds target."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source, not for each document
    listed = sizes.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    listed = listed.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    listed = listed.withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    listed = listed.withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)
    listed = listed.withColumn("target", F.least("cap", F.coalesce(level["level"] * F.col("weight"), F.col("cap"))))
    return listed.select("source", "source_size", F.round("target", 6).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weight: Column | None = None, seed: str = "mix-1-", slices: int = 1 << 12, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, epochs for each row of docs(doc_id, source, text).

    share: budget as a multiple of all words. most: cap of a source as a multiple of its words. weight: quality weight of
    a row (by default from its symbols). taken: words of the row in the mix, repeats counted. epochs: times it is in it. carry: also return the whole input row
    as struct row_.
    """
    more = ["row_"] if carry else []
    space = Workspace(docs.sparkSession, "mixing")
    quality = F.greatest(F.coalesce((quality_weight(F.col("text")) if weight is None else weight).cast("double"), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    known = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), (-F.ln(uniform(known, seed)) / quality).alias("key"), F.xxhash64("text").alias("tie"), *(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(c) for c in more))
    rows = space.settle(rows.withColumn("slice", F.floor((1.0 - F.exp(-F.col("key"))) * slices).cast("int")), "rows")

    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = plan.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    plan = plan.withColumn("rest", F.when(F.col("full") >= int(most), F.lit(0.0)).otherwise(F.col("rest")))
    here = F.col("source").eqNullSafe(F.col("source_"))
    running = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("slice")))  # at most `slices` rows a source
    plan = plan.withColumnRenamed("source", "source_")
    past = running.join(plan, here).where(F.col("upto") > F.col("rest"))
    cut = past.groupBy("source_").agg(F.min("slice").alias("cut"), F.min(F.col("upto") - F.col("words")).alias("before"))
    cut = cut.withColumnRenamed("source_", "source")
    plan = space.settle(plan.join(cut, here, "left").drop("source"), "plan")

    rows = rows.join(plan, here)  # Spark checks the plan's size in its files before it broadcasts it
    settled = rows.where("cut is null or slice <> cut").withColumn("extra", F.expr("cast(cut is null or slice < cut as bigint)"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ended = rows.where("slice = cut").withColumn("extra", F.when(upto - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0).cast("bigint"))
    both = settled.unionByName(ended).withColumn("epochs", F.col("full") + F.when(F.col("rest") > 0, F.col("extra")).otherwise(0))
    return both.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"), "source", "epochs", *more)


#: The same in SQL, for the default parameters.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix-1-' || coalesce(CAST(doc_id AS VARCHAR), '/' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / greatest(0.05, 1.0 - 4.0 * CASE WHEN length(text) > 0
        THEN CAST(length(text) - length(translate(text, '#*$%&|<>!', '')) AS DOUBLE) / length(text) ELSE 0 END) AS key
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM rows GROUP BY source
), caps AS (
  SELECT *, CAST([3, 1, 2][CAST(place % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, 2.0 * source_size AS cap FROM sizes
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM caps WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, source_size, CAST(round(least(cap, coalesce(arg_min(CASE WHEN level * weight <= cap THEN level END,
    CASE WHEN level * weight <= cap THEN cap / weight END) OVER () * weight, cap)), 6) AS DOUBLE) AS target FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan
), sampled AS (
  SELECT r.doc_id, r.source, r.size, p.source_size, p.target, p.whole,
    CASE WHEN p.whole >= 2 THEN 0.0 ELSE p.target - p.whole * p.source_size END AS rest,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
), taken AS (
  SELECT *, whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END AS epochs FROM sampled
)
SELECT doc_id, size, source_size, target, CAST(epochs * size AS BIGINT) AS taken, source, CAST(epochs AS BIGINT) AS epochs FROM taken
"""
