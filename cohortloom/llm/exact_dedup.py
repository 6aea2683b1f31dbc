"""Exact de-duplication by content-defined chunk recipes.

Texts are cut where a rolling hash of their own bytes says so; a text becomes the ordered
list of its chunk identifiers and equal lists are equal texts. Only chunks whose digest
occurs more than once move: they are grouped by digest and content, which proves that an
identifier stands for one content. Digests that turn out to stand for several contents get
a variant number per content, so a digest collision never merges different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_text, prepare, stored, text_blocks

#: Places of the set of repeated digests per digest in it, and its largest size (log 2 of bits:
#: 64 MB). Beyond that more chunks are moved than needed; the result stays the same.
PLACES, MOST_BITS = 16, 29


@dataclass(frozen=True)
class Chunking:
    """Cut points: window bytes hashed, one cut per 2**bits on average, size limits."""

    bits: int = 11
    least: int = 64
    most: int = 1 << 16
    digest_bits: int = 64


def _gear() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, bits: int) -> np.ndarray:
    """Positions after which a chunk may end: top bits of a 32-byte rolling hash are zero."""
    rolled = _gear()[data]
    for shift in (1, 2, 4, 8, 16):
        wider = rolled.copy()
        wider[shift:] += rolled[:-shift] << np.uint32(shift)
        rolled = wider
    return np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + 1


def chunk_bounds(data: np.ndarray, offsets: np.ndarray, how: Chunking) -> list[list[int]]:
    """For each text its chunk ends; the same text gives the same cuts wherever it stands."""
    cuts = cut_points(data, how.bits)
    firsts = np.searchsorted(cuts, offsets[:-1] + max(32, how.least))
    lasts = np.searchsorted(cuts, offsets[1:])
    out = []
    for start, end, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(),
                                firsts.tolist(), lasts.tolist(), strict=True):
        ends, last = [], start
        for cut in [*cuts[a:b].tolist(), end]:
            if cut != end and cut - last < how.least:
                continue
            while cut - last > how.most:
                last += how.most
                ends.append(last)
            if cut > last:
                ends.append(cut)
                last = cut
        out.append(ends)
    return out


def _chunks(batch: pa.RecordBatch, how: Chunking) -> Iterator[tuple[memoryview, list, list]]:
    """For each text of a block: its bytes, chunk (start, end) pairs and digests."""
    data, offsets = flat_text(batch.column("text"))
    view = memoryview(data)
    mask = (1 << how.digest_bits) - 1
    for start, end, ends in zip(offsets[:-1].tolist(), offsets[1:].tolist(),
                                chunk_bounds(data, offsets, how), strict=True):
        spans = list(zip([start, *ends[:-1]], ends, strict=True)) if ends else []
        digests = [(xxhash.xxh3_64_intdigest(view[a:b]) & mask) - (1 << 63) for a, b in spans]
        yield view[start:end], [view[a:b] for a, b in spans], digests


def _recipes(how: Chunking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, "text"):
                shas, recipes = [], []
                for text, _, digests in _chunks(batch, how):
                    shas.append(hashlib.sha256(text).hexdigest())
                    recipes.append(digests)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(shas, pa.string()),
                     pa.array(recipes, pa.list_(pa.int64()))],
                    ["doc_id", "text_sha256", "recipe"])

    return run


def _contents(how: Chunking, bitmap: np.ndarray, keyed: bool):
    """Chunks whose digest is in the bitmap, with their document's key if ``keyed``."""
    mask = bitmap.size * 8 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, "text"):
                rows: list[tuple] = []
                for doc_id, (text, parts, digests) in zip(
                        batch.column("doc_id").to_pylist(), _chunks(batch, how), strict=True):
                    sha = hashlib.sha256(text).hexdigest() if keyed else None
                    for place, (part, digest) in enumerate(zip(parts, digests, strict=True)):
                        bit = digest & mask
                        if bitmap[bit >> 3] >> (bit & 7) & 1:
                            rows.append((digest, bytes(part), doc_id, sha, place))
                columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                names = ["digest", "chunk", "doc_id", "text_sha256", "place"]
                n = 5 if keyed else 2
                yield pa.RecordBatch.from_arrays(arrays[:n], names[:n])

    return run


def bitmap_bits(count: int) -> int:
    """Size (log 2 of bits) of the set for ``count`` digests."""
    return min(MOST_BITS, max(15, (PLACES * count).bit_length()))


def _bitmap(digests: DataFrame) -> np.ndarray:
    """Bit set of stored digests modulo its size, which grows with their number."""
    bits = bitmap_bits(digests.count())
    parts = (digests.select(F.expr(f"(digest & {(1 << bits) - 1}) + 1").alias("place"))
             .groupBy(F.expr("bitmap_bucket_number(place)").alias("part"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("set")))
    out = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for row in parts.toLocalIterator():
        lo = (row.part - 1) * 4096  # part p holds the numbers from (p - 1) * 32768 + 1 on
        out[lo:lo + 4096] = np.frombuffer(row.set, np.uint8)
    return out


def chunk_recipes(docs: DataFrame, how: Chunking = Chunking()) -> DataFrame:
    """(doc_id, text_sha256, recipe, variants, row_no) of every row, checkpointed.

    ``recipe`` and ``variants`` together are the verified identifier list.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = stored(
        texts.mapInArrow(_recipes(how), "doc_id long, text_sha256 string, recipe array<long>")
        .withColumn("row_no", F.monotonically_increasing_id()))
    repeated = stored(rows.select(F.explode("recipe").alias("digest")).groupBy("digest")
                      .count().filter("count > 1").select("digest"))
    contents = (texts.mapInArrow(_contents(how, _bitmap(repeated), False),
                                 "digest long, chunk binary")
                .groupBy("digest", "chunk").agg(F.lit(1).alias("one")))
    shared = stored(contents.groupBy("digest").count().filter("count > 1").select("digest"))
    none = F.array().cast("array<int>")
    if shared.isEmpty():  # every identifier stands for one content
        return rows.withColumn("variants", none)
    again = texts.mapInArrow(
        _contents(how, _bitmap(shared), True),
        "digest long, chunk binary, doc_id long, text_sha256 string, place int")
    again = again.join(shared, "digest", "left_semi")
    order = Window.partitionBy("digest").orderBy("chunk")
    numbered = (again.select("digest", "chunk").distinct()
                .withColumn("variant", F.row_number().over(order)))
    variants = (again.join(numbered, ["digest", "chunk"])
                .groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"),
                         "text_sha256")
                .agg(F.sort_array(F.collect_set(F.struct("place", "variant"))).alias("found"))
                .select("id_key", "text_sha256", F.col("found.variant").alias("variants")))
    keyed = rows.withColumn("id_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return stored(keyed.join(variants, ["id_key", "text_sha256"], "left").drop("id_key")
                  .withColumn("variants", F.coalesce("variants", none)))


def exact_groups(docs: DataFrame, how: Chunking = Chunking()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty and empty texts are one group. Of equal texts the row with the
    largest doc_id stays (null ids are smallest); of repeated rows with that id exactly one
    is ``kept``. Very long texts are cut into chunks like any other and read whole. An empty
    table gives an empty result; further columns are ignored, whatever their names.
    """
    rows = chunk_recipes(docs, how)
    rows = rows.withColumn("key", F.xxhash64("recipe", "variants"))
    groups = rows.groupBy("key", "recipe", "variants").agg(
        F.max(F.struct("doc_id", "row_no")).alias("last"), F.count("*").alias("group_size"))
    return rows.join(groups, ["key", "recipe", "variants"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size",
        (F.col("row_no") == F.col("last.row_no")).alias("kept"), "text_sha256")
