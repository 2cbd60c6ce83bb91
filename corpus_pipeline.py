"""The corpus pipeline: quality classifier, n-gram Jaccard join, suffix-array dedup, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), calls one operator, and returns the rows that go on; all but the last return the
columns of documents, whatever others there are among them.

Defined results, for every stage: a null text counts as empty. Null and repeated doc_id: each row is a row of its own, and
rows are told apart by their text. An empty table gives an empty one with the same columns. Columns may have the names that
the operators use inside. Texts are read as a whole, whatever their length. Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.exchange import Workspace
from skerry.llm.jaccard_join import one_of_each
from skerry.llm.mixing import mix
from skerry.llm.packing import pack_documents
from skerry.llm.quality_classifier import classify
from skerry.llm.suffix_dedup import without_repeats


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. A posterior of just the threshold counts as kept; without labels of both
    kinds every document is kept, the empty ones too."""
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), host=F.col("source"), path=F.col("lang"), carry=True)
    return judged.where("kept").select("row_.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id and, among equal ids, text hash. Documents
    without words and those with a null id link nothing and stay."""
    return one_of_each(docs, width=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes and the passages of over 50 words that start elsewhere too. Every copy of them
    goes, and characters go as a whole; n_chars follows. Documents that lose their whole text stay as empty rows."""
    return without_repeats(docs, length=400, words=51)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once, twice or not at all. Null sources are one source. Documents without
    words are left out."""
    mixed = mix(docs, share=1.5, most=2.0, carry=True).where("taken > 0")
    return mixed.select("row_", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))).alias("epoch_")).select("row_.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a repeated document has its pieces as often. An empty text is
    one piece, the end token."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("suffix_array_dedup", remove_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: SQL can express neither the fitted classifier nor the tokenizer; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    space = Workspace(spark, "pipeline")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        rows = space.settle(stage(spark, rows, sf_dir), f"{k}-{name}")
        if k:
            space.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return rows
