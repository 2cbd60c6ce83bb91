"""Each stage of the pipeline against its operator's decisions, and the whole on a small corpus."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choices(words, k=150))
    rows = []
    for k in range(120):
        text = " ".join(rng.choices(words, k=rng.randint(60, 200)))
        if k % 10 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif k % 7 == 0:
            text += " " + passage
        elif k % 5 == 0 and rows:
            text = rows[-1][1] + " tail"
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
    rows += [rows[3], (500, None, None, None, None), (501, "", "en", "s1", 0), (502, "é" * 900, "fr", "s2", 900)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 10 != 0), 0) for k in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = pipeline.keep_good(spark, docs, folder)
    ids = {r.doc_id for r in good.collect()}
    assert good.schema == docs.schema and not ids & {k for k in range(0, 120, 10)} and {1, 2, 3, 4} <= ids
    single = pipeline.keep_one_of_each(spark, good, folder)
    got = single.collect()
    texts = [r.text for r in got if r.text]
    assert single.columns == docs.columns and len(set(texts)) == len(texts) and {500, 501, 502} <= {r.doc_id for r in got}
    assert not any(t.endswith(" tail") and t.removesuffix(" tail") in texts for t in texts)
    clean = pipeline.remove_repeats(spark, single, folder)
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and len(after) == len(got)
    before = {r.doc_id: r for r in got}
    shared = [k for k in before if before[k].text and k % 7 == 0 and k < 120]
    assert len(shared) > 3 and all(len(after[k].text) < len(before[k].text) - 400 and after[k].n_chars == len(after[k].text) for k in shared)
    assert after[502].text == "" and all(after[k].text == before[k].text for k in before if before[k].text and k % 7 and k < 120)
    mixed = pipeline.mix_sources(spark, clean, folder)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times.values()) <= {1, 2} and set(times) <= set(after)
    packed = pipeline.pack(spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times


def test_run(spark, folder):
    assert [name for name, _ in pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    assert pipeline.run(spark, folder).count() > 50


CLASHING = "node string, text_hash int, shard string, kind int, payload string, n int, size int, key int, host_ string, h int, p int, row_ int, epoch_ int, taken int, piece int, start int"


def test_odd_rows_and_clashing_columns(spark, folder):
    """Names that the operators use inside, repeated rows, null and empty texts, null ids, long words: no stage trips over them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (None, "x y z " * 30, "en", "s0", 180), (7, None, "", "", 1), (7, "z" * 30_000, "xx", "s1", 30_000), (8, "a b\n" * 4000, "en", "s2", 16_000)]
    docs = docs.unionByName(spark.createDataFrame(odd + odd, SCHEMA))
    names = [c.strip().rsplit(" ", 1) for c in CLASHING.split(",")]
    wide = docs.select("*", *(F.lit(str(k) if t == "string" else k).cast(t).alias(n) for k, (n, t) in enumerate(names)))
    rows = wide
    for name, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder)
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        assert rows.columns == wide.columns, name
        assert rows.where("size = 6 and node = '0' and start = 15").count() == rows.count() > 0, name
    packed = pipeline.pack(spark, rows, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed.columns) and packed.count() >= rows.count()


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for labels in (folder, str(tmp_path)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, labels)
            assert not out.collect(), name
            assert name == "best_fit_packing" or out.columns == docs.columns, name
