"""The corpus pipeline: raw documents to token digests in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
Stages that reject documents keep every other row with all its columns; the
redaction rewrites ``text`` and ``n_chars``; the last stage returns token digests.

In every stage null texts count as empty and stay null, and empty texts are neither
toxic, copies, contaminated nor personal, so their rows stay to the end.  Rows
without an id are judged by their text where a stage can (toxicity, redaction,
encoding) and kept where it goes by ids (copies, contamination).  Of rows that
repeat an id one stays after the second stage.  Ties go to the smallest id, an
empty table gives an empty result, and further columns pass as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm import bpe, decontaminate, minhash, pii, toxicity
from vertexloom.llm.common import table
from vertexloom.plans.runtime import Scratch

#: The public vocabulary file that documents are encoded with.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Documents that score so high are toxic; similarity, in per cent, of near copies; share of an item's shingles that contaminates.
TOXIC, NEAR, HELD = 0.7, 80, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity limit, by a model of the labels outside the held-out fold."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    return minhash.deduplicate(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), HELD)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the names of their kinds."""
    return pii.redact(docs, "text", "n_chars" if "n_chars" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of its ids and of its decoded text."""
    return bpe.digests(docs, TOKENIZER, keep=[c for c in ("lang", "source") if c in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: Learnt models and iteration have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.put(docs)
            scratch.drop(before)
            before = docs
    return docs
