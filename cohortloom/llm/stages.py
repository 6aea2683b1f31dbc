"""The stages of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, pieces, simhash
from . import quality as classifier
from .common import keep_rows, prepare, read_table
from .registry import PIECE_MODEL, vocabulary

#: Columns of the documents table, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, every one of its rows.

    Null and empty texts are judged like any other, very long ones whole; without labels of both
    classes everything stays. An empty table gives an empty one; further columns are dropped.
    """
    labels = read_table(prepare(spark), sf_dir, "labels")
    return classifier.score_documents(docs, labels, COLUMNS).filter("accepted").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the one with the largest doc_id.

    Null text counts as empty, null ids are smallest, of repeated rows one stays. An empty table
    gives an empty one; further columns are dropped.
    """
    prepare(spark)
    return keep_rows(docs.select(*COLUMNS), exact_dedup.exact_groups(docs).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: the one with the smallest doc_id, null last."""
    prepare(spark)
    return keep_rows(docs.select(*COLUMNS), simhash.component_heads(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in order of training position.

    Documents without words (null, empty or blank text) are taken no times; null sources are one
    source; repeated rows are mixed each by itself. An empty table gives an empty one; further
    columns are dropped.
    """
    prepare(spark)
    return mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row.

    Null text is empty and has no ids; very long texts are encoded whole; repeated rows, as the
    mix makes them, stay. An empty table gives an empty one; further columns are dropped.
    """
    return pieces.encode_documents(docs, vocabulary(PIECE_MODEL))
