"""What the operators share: session settings, checkpoints, flat text from Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, tune

#: Rows of an Arrow batch handed to Python; with whole texts the default is too many.
BATCH_ROWS = 1000
#: Bytes of text that numpy code expands at a time.
BLOCK_BYTES = 2 << 20
#: White space that separates words (fixed): space, tab, line feed, VT, FF, CR.
WORD = rb"[^\x20\x09-\x0D]+"
WORD_SQL = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Adaptive execution on, small Arrow batches, a checkpoint folder all executors share.

    The folder is the one in ``spark.checkpoint.dir``; only a local session where that is
    unset gets a folder of its own.
    """
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    return df.checkpoint(eager=True)


def flat_text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array and its offsets (starting at 0); null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    array = array.cast(pa.large_binary())
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, 8 * array.offset)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    flat = np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0]))
    return flat, ends - ends[0]


def strings(array: pa.Array) -> list[str]:
    """Python strings of an array without nulls, converted at once."""
    return array.to_numpy(zero_copy_only=False).tolist()


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES
                ) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with at most ``limit`` bytes of text (or one row)."""
    _, offsets = flat_text(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = max(lo + 1, min(hi, n))
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_count(text) -> F.Column:
    """Number of words of a text column (null: 0), JVM side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def id_key(column: str = "doc_id") -> F.Column:
    """An id as a join key that also matches null with null."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("id_key")


def text_sha(column: str = "text") -> F.Column:
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is in ``kept`` (doc_id, text_sha256), once each.

    Both steps use one exchange on (id, digest); a repeated row comes back once.
    """
    from pyspark.sql import Window

    names = docs.columns
    keyed = docs.select("*", id_key(), text_sha().alias("sha_key"))
    one = Window.partitionBy("id_key", "sha_key").orderBy(F.lit(0))
    first = keyed.withColumn("row_in_key", F.row_number().over(one)).filter("row_in_key = 1")
    wanted = kept.select(id_key(), F.col("text_sha256").alias("sha_key"))
    return first.join(wanted, ["id_key", "sha_key"], "left_semi").select(*names)
