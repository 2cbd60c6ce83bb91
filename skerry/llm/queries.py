"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.decontamination import contamination
from skerry.llm.fill_middle import fill_in_middle, restored
from skerry.llm.html_extraction import extract, main_texts
from skerry.llm.jaccard_join import jaccard_join
from skerry.llm.language_id import identify
from skerry.llm.lm_scoring import score_documents
from skerry.llm.media import media_features, to_media
from skerry.llm.mixing import ORACLE_SQL as MIXING_SQL
from skerry.llm.mixing import mix
from skerry.llm.packing import pack_documents
from skerry.llm.quality_classifier import classify
from skerry.llm.quality_rules import judge
from skerry.llm.suffix_dedup import suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), width=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is the host; the language is the first part of the path, as in the addresses of pages."""
    docs = _table(spark, sf_dir, "documents")
    return classify(docs, _table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), order=2, folds=10)


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer(), capacity=1024, end=2)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), share=1.5, most=2.0)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return media_features(to_media(rows, "text", width=64).drop("text"), ["doc_id", "n_bytes"], tail=64)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (source as host, lang as declaration) and pages (main text, html lang, address suffix, host)."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    rows = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), none.alias("suffix"), F.col("source").alias("host"))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    suffix = F.concat_ws("/", F.regexp_extract(host, r"([^.]+)$", 1), F.lower(F.regexp_extract("url", r"://[^/?#]+/([a-zA-Z]{2})(?:/|$)", 1)))
    found = main_texts(pages.select("page_id", F.when(declared != "", declared).alias("declared"), suffix.alias("suffix"), F.when(host != "", host).alias("host"), "html"))
    rows = rows.unionByName(found.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "text", "declared", "suffix", "host"))
    out = identify(rows, docs.select("lang", "text"))
    return out.select(F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"), "lang", "probability", "text_lang", "declared")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also counts the passages of over 50 words that start elsewhere too."""
    return suffix_dedup(_table(spark, sf_dir, "documents"), length=400, words=51).drop("kept")


def contaminated_rows(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(documents, benchmark, width=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def cut_rows(documents: DataFrame) -> DataFrame:
    made = fill_in_middle(documents, fim_percent=90, spm_percent=20)
    made = made.withColumn("restored", restored(F.col("output"), F.col("form")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_rows(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All pairs of texts that share a shingle, then what each reaches by links.
JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * o >= 80 * (na + nb - o)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s"""


#: All windows of the items and, of each of their lengths in words, all windows of the documents.
DECONTAMINATION_SQL = f"""WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM ip),
ks AS (SELECT DISTINCT k FROM p),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw JOIN ks ON len(w) >= k),
d AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM di),
h AS (SELECT DISTINCT doc_id, item_id, k, i FROM d JOIN p USING (k, x)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, k, i FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
#: All units of each text as a list.
FILL_IN_MIDDLE_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM s"""


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": JACCARD_SQL, "op6_mixing": MIXING_SQL, "op11_decontamination": DECONTAMINATION_SQL, "op12_fill_in_middle": FILL_IN_MIDDLE_SQL}
