"""From raw documents to token ids: filter, de-duplicate, mix and encode a corpus.

Each stage takes (spark, docs, sf_dir), reads what its predecessor kept and returns a frame;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import stages
from cohortloom.llm.common import prepare, read_table
from cohortloom.session import shared_dir

STAGES = [
    ("quality classifier", stages.quality),
    ("exact dedup", stages.exact),
    ("SimHash near-dedup", stages.near),
    ("mixing sources", stages.mix),
    ("SentencePiece encoding", stages.encode),
]

#: The classifier is trained by gradient descent, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    root = f"{shared_dir(prepare(spark))}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
