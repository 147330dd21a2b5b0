"""The queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import centroids, chat, classifier, codes, exact, licenses, mixing, packing, rules, sharding, simhash, suffixes, wrappers
from barloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


SQL["op1_license_scans"] = licenses.scan_sql()


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(table(spark, sf_dir, "documents"))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.format_chat(chat.with_own_parts(said.unionByName(planted))))


SQL["op5_chat_formatting"] = chat.DIGEST_SQL


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"))


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))

@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


SQL["op11_html_extraction"] = wrappers.SQL


@query
def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encoded(table(spark, sf_dir, "embeddings"))


SQL["op12_vector_code_compression"] = codes.encoded_sql()


@query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


SQL["op13_centroid_clustering"] = centroids.clustered_sql()


SQL["op3_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t"""

SQL["op7_quality_rules"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, string_split(x, chr(10)) AS lines FROM t),
line AS (SELECT doc_id, unnest(lines) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
gram AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER d AS b, lead(word, 2) OVER d AS c FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
many AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM gram WHERE c IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM many, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
m AS (SELECT w.doc_id, x, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(x, '!!')) AS shouts,
    len(regexp_extract_all(x, '[A-Z]')) AS capitals
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words
    OR (n_dup_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * shouts > 30 * n_words OR 2 * capitals > word_chars) AS kept FROM m"""
