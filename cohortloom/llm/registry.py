"""The registered corpus queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (conversations, exact_dedup, jaccard_join, language_id, licenses, mixing, pieces,
               quality, simhash, sketches, token_files, url_filter, whitening)
from .common import prepare, read_table

#: Names of the public vocabulary files that the queries use.
WORD_MODEL, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> bytes:
    """Content of a public vocabulary file; tasks get the bytes, not the path."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(read_table(prepare(spark), sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    return quality.score_documents(docs, read_table(spark, sf_dir, "labels"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_fingerprints(read_table(prepare(spark), sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(prepare(spark), sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(prepare(spark), sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    return token_files.token_files(docs, vocabulary(WORD_MODEL))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    return pieces.encode_documents(docs, vocabulary(PIECE_MODEL))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(prepare(spark), sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(prepare(spark), sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(prepare(spark), sf_dir, "pages"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read_table(prepare(spark), sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(prepare(spark), sf_dir, "conversations")
    return conversations.repaired_conversations(rows)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read_table(prepare(spark), sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_quality_classifier, op3_document_fingerprints, op4_license_scan,
    op5_simhash_near_dedup, op6_token_files, op7_sentencepiece, op8_exact_dedup, op9_mixing,
    op10_url_filter, op11_jaccard_join, op12_conversation_repair,
    op13_embedding_whitening)}

ORACLES = {
    "op4_license_scan": licenses.oracle(),
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op12_conversation_repair": conversations.oracle(),
}
