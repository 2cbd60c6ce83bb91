"""Text statistics as Spark expressions. White space is 0x20 and 0x09 to 0x0D; null text has no words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def count_of(text: Column, characters: str) -> Column:
    """How many of the text's code points are among the characters."""
    return (F.length(text) - F.length(without(text, characters))).cast("bigint")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def with_words(docs: DataFrame, text: str) -> DataFrame:
    """Adds text_ (null as empty) and words_ (array)."""
    docs = docs.withColumn("text_", F.coalesce(F.col(text), F.lit("")))
    blank = F.trim(F.translate("text_", SPACES[1:], " " * (len(SPACES) - 1)))
    return docs.withColumn("words_", F.when(blank == "", F.array().cast("array<string>")).otherwise(F.split(blank, " +")))


def repeat_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of three that are found twice or more. Needs words_.

    Window hashes are sorted with their places; neighbours of equal hash are the repeats. Each step is a column of its
    own, as the lambdas look the arrays up by index.
    """
    n = F.size("words_")
    hashes = F.expr("transform(sequence(0, size(words_) - 3), i -> xxhash64(words_[i], words_[i + 1], words_[i + 2]))")
    docs = docs.withColumn("hashes_", F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    placed = F.expr("sort_array(transform(hashes_, (h, i) -> struct(h AS h, i AS i)))")
    docs = docs.withColumn("placed_", F.when(F.size(F.array_distinct("hashes_")) < F.size("hashes_"), placed).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")))
    again = "filter(placed_, (x, k) -> coalesce(get(placed_, k - 1).h = x.h, false) or coalesce(get(placed_, k + 1).h = x.h, false))"
    docs = docs.withColumn("again_", F.expr(f"sort_array(transform({again}, x -> x.i))"))
    covered = "aggregate(again_, struct(0L AS n, -9 AS at), (a, i) -> struct(a.n + least(3, i - a.at) AS n, i AS at), a -> a.n)"
    return docs.withColumn("n_repeat_words", F.expr(covered)).drop("hashes_", "placed_", "again_")


def line_counts(docs: DataFrame) -> DataFrame:
    """Adds n_lines (\\n-split lines with a word) and n_dup_lines (those equal to an earlier one). Needs text_."""
    docs = docs.withColumn("lines_", F.filter(F.split("text_", "\n"), lambda x: F.translate(x, SPACES, "") != ""))
    docs = docs.withColumn("n_lines", F.size("lines_").cast("bigint"))
    return docs.withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("lines_"))).cast("bigint")).drop("lines_")


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, and 0 where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))
