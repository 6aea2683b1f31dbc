"""Bottom-k sketches of word shingles: mergeable document fingerprints.

A sketch is the ``k`` smallest distinct 63-bit hashes of a text's shingles, ascending. The
sketch of a union is the k smallest of the sketches' union, so parts can be merged in any
order. From two sketches come estimates of resemblance, containment and distinct counts;
while a text has no more than k distinct shingles they are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, flat_text, prepare
from .ordering import by_id_range

K = 128
SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread all 64 bits (xor-shift and multiply, two rounds)."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _POWERS[size] = (tables[0], tables[1])
    return _POWERS[size]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of texts laid end to end, and word offsets per text."""
    if not data.size:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(data.size, bool)
    edge[offsets[:-1][offsets[:-1] < data.size]] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge
    starts = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) & ~np.concatenate([edge[1:], [True]])
    ends = np.flatnonzero(solid & ~after) + 1
    powers, inverses = _powers(data.size)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:data.size], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * inverses[starts]), np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE
                   ) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all word shingles and their offsets per text.

    A text with fewer words has one shingle, its whole word sequence; without words none.
    """
    words, bounds = word_hashes(data, offsets)
    counts = np.diff(bounds)
    n = words.size
    hashes = np.zeros(max(n - shingle + 1, 0), np.uint64)
    factors = _mix(np.arange(1, shingle + 1, dtype=np.uint64)) | np.uint64(1)
    for j in range(shingle):
        hashes += words[j:j + hashes.size] * factors[j]
    out_counts = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)])
    out = np.zeros(out_bounds[-1], np.uint64)
    text = np.repeat(np.arange(counts.size), out_counts)
    place = np.arange(out.size) - out_bounds[text] + bounds[text]
    full = counts[text] >= shingle
    out[full] = hashes[place[full]]
    for i in np.flatnonzero((counts > 0) & (counts < shingle)):
        few = words[bounds[i]:bounds[i + 1]]
        out[out_bounds[i]] = (few * factors[:few.size]).sum() ^ np.uint64(few.size)
    return _mix(out) >> np.uint64(1), out_bounds


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if hashes.size > 16 * k:
        least = np.unique(np.partition(hashes, 4 * k)[:4 * k])
        if least.size >= k:
            return least[:k]
    return np.unique(hashes)[:k]


def sketches(texts: list[bytes], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes, bounds = shingle_hashes(data, offsets, shingle)
    return [bottom(hashes[a:b], k) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all; two texts without any are alike (1)."""
    both = merge(a, b, k)
    if not both.size:
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, common, assume_unique=True).sum() / both.size)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(a.size) if a.size < k else (k - 1) * 2.0**63 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too (1 if a has none)."""
    if not a.size:
        return 1.0
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, common / distinct_count(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def _sketch_rows(k: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            rows = [s.astype(np.int64) for s in sketches(texts, k, shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))],
                ["doc_id", "sketch"])

    return run


def sketch_documents(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sketch) of every row of ``docs``; null text is empty and has an empty sketch."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        _sketch_rows(k, shingle), "doc_id long, sketch array<long>")


def merge_sketches(parts: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Ranks are limited before the shuffle too, so a key with very many parts sends k hashes
    per task. Parts of a cut text should overlap by one word less than a shingle has.
    """
    order = Window.partitionBy(*keys).orderBy("hash")
    hashes = parts.select(*keys, F.explode("sketch").alias("hash")).distinct()
    least = hashes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    merged = least.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))
    return parts.select(*keys).distinct().join(merged, list(keys), "left").withColumn(
        "sketch", F.coalesce("sketch", F.array().cast("array<long>")))


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double, "
           "held_by_next double, n_shingles double")


def _edited_rows(k: int, shingle: int):
    """Sorted rows of id ranges to result rows; each row meets its successor in the stream."""

    def results(rows: list[tuple], prints: list[np.ndarray]) -> pa.RecordBatch:
        """Rows with the one after each; the last has no successor yet."""
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1]]
        edited = []
        for i in pairs:
            text, after = rows[i][3], rows[i + 1][3]
            half = len(text) // 2
            edited.append((text[:len(text) - half] + after[:half]).encode())
        edited_prints = sketches(edited, k, shingle)
        out = []
        for i, new, new_print in zip(pairs, edited, edited_prints, strict=True):
            own, after = prints[i], prints[i + 1]
            out.append((rows[i][2], len(rows[i][3]), hashlib.sha256(new).hexdigest(),
                        encode(own), encode(new_print), resemblance(own, new_print, k),
                        resemblance(own, after, k), containment(own, after, k),
                        distinct_count(own, k)))
        names = [part.split()[0] for part in _RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, prints, new, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, prints, new, size
            prints += sketches([r[3].encode() for r in new], k, shingle)
            rows += new
            out = results(rows, prints)
            rows, prints, new, size = rows[-1:], prints[-1:], [], 0
            return out

        for batch in batches:
            columns = [batch.column(c) for c in ("part", "late", "doc_id", "text")]
            _, offsets = flat_text(columns[3])
            for i in range(batch.num_rows):
                new.append(tuple(c[i].as_py() for c in columns))
                size += int(offsets[i + 1] - offsets[i])
                if size >= BLOCK_BYTES:
                    yield flush()
        if new:
            yield flush()

    return run


def edited_fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, one row per row of ``docs``.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document in ascending doc_id order; after the last
    document comes the first. Null text is empty, null ids come first, equal ids are ordered
    by text. Documents are dealt into id ranges once; each range ends with a copy of the row
    after it. Very long texts are read whole. An empty table gives an empty result; repeated
    rows stay, equal hashes count once; further columns are ignored.
    """
    prepare(docs.sparkSession)
    return by_id_range(docs, closing=True).mapInArrow(_edited_rows(k, shingle), _RESULT)
