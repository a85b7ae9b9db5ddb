"""Registered queries of the text operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vertexloom.llm import bm25, bpe, decontaminate, license_scan, minhash, pii, quality, suffix_dedup, toxicity, url_filter
from vertexloom.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file stands; callers of the operator pass their own path."""
    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii.report(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the five given rules; other urls get the verdict of the default block list."""
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.CONTRACT_RULES + url_filter.DEFAULT_RULES).select(
        "page_id", "host", "path", F.when(F.col("rank") == 1, F.col("rule")).alias("rule"), "verdict", F.when(F.col("rank") == 0, F.col("rule")).alias("pattern_rule")
    )


OP2_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
w(word) AS (VALUES %s),
s(segment) AS (VALUES %s),
m AS (
  SELECT page_id, '~' || word AS name FROM f, w WHERE rule IS NULL AND regexp_matches(host, '(^|[^a-z0-9])' || word || '($|[^a-z0-9])')
  UNION ALL
  SELECT page_id, '/' || segment || '/' FROM f, s WHERE rule IS NULL AND (contains(path, '/' || segment || '/') OR ends_with(path, '/' || segment))),
k AS (SELECT page_id, max(name) FILTER (WHERE length(name) = longest) AS pattern_rule FROM (
  SELECT page_id, name, max(length(name)) OVER (PARTITION BY page_id) AS longest FROM m) GROUP BY 1)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern_rule
FROM f LEFT JOIN k USING (page_id)""" % tuple(", ".join(f"('{w}')" for w in words) for words in (url_filter.BLOCKED_HOST_WORDS, url_filter.BLOCKED_SEGMENTS))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 80 per cent or more of a benchmark item's five-word shingles, with the items."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and every line of a document, that is entirely a known licence text."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored for quality by a model of the labels outside the held-out fold."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text covered by a 400-byte string that also starts elsewhere."""
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets are 85 per cent alike."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored for toxicity by a model of the labels outside the held-out fold."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the whole text of every document whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.top_k(docs, asked, 10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_url_filter": op2_url_filter,
        "op3_decontaminate": op3_decontaminate,
        "op4_license_scan": op4_license_scan,
        "op5_quality": op5_quality,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_bpe": op7_bpe,
        "op8_minhash_dedup": op8_minhash_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_bm25_topk": op10_bm25_topk,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op2_url_filter": OP2_SQL, "op4_license_scan": license_scan.oracle_sql()}
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
