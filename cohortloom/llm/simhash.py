"""SimHash near-duplicates: pigeonhole blocks, then exact Hamming distances.

A 64-bit fingerprint is cut into ``bits + 3`` blocks. Fingerprints that differ in at most
``bits`` positions agree on three whole blocks at least, so every choice of three blocks is
a key under which close pairs meet; all other members of a key are verified and refused.
Only distinct fingerprints take part, so copies cost nothing. Within a key a breadth-first
walk over the members emits a spanning forest of the links: a group of m members gives
fewer than m rows, not its pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, flat_text, prepare, stored, text_blocks
from .components import components

#: Members of a key that one task compares; a larger key is compared in pairs of parts.
MEMBERS = 100_000


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 majority bits over XXH64 (seed 42) of the word shingles, repeats included."""
    words = re.findall(WORD, text.lower())  # bytes.lower folds A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    totals, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        hashes = np.array([digest(joined[a:b - 1], 42) for a, b in
                           zip(starts[lo:hi], starts[lo + shingle:hi + shingle], strict=True)],
                          np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_blocks(whole, "text"):
                data, offsets = flat_text(batch.column("text"))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(),
                                                  strict=True)]
                prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(prints.view(np.int64)),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                    ["doc_id", "print", "text_sha256"])

    return run


def _masks(bits: int) -> list[int]:
    """Signed 64-bit masks: every choice of three among ``bits + 3`` blocks."""
    n = bits + 3
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(c) for c in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (child, parent) of the links among distinct fingerprints.

    Each member is compared with those not reached yet, so a dense group costs about as
    much as it has members.
    """
    left, child, parent = members, [], []
    while left.size > 1:
        front, left = [left[0]], left[1:]
        while front and left.size:
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found = left[near]
                child.append(found)
                parent.append(np.full(found.size, at))
                front.extend(found)
                left = left[~near]
    if not child:
        return members[:0], members[:0]
    return np.concatenate(child), np.concatenate(parent)


def _links(bits: int):
    """Rows sorted by (block, key, lo, hi) to links; a key may span Arrow batches."""

    def out(child: list, parent: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64))
             for x in (child, parent)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_keys, rest = None, None
        for batch in _then_none(batches):
            if batch is not None:
                keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                 for c in ("block", "key", "lo", "hi")], axis=1)
                prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
                if rest is not None:
                    keys, prints = np.concatenate([rest_keys, keys]), np.concatenate([rest, prints])
                new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
                starts = np.concatenate([[0], new])
                rest_keys, rest = keys[starts[-1]:], prints[starts[-1]:]
                prints = prints[:starts[-1]]
            elif rest is None:
                return
            else:
                starts, prints = np.array([0, rest.size]), rest
            sizes = np.diff(starts)
            twos = starts[:-1][sizes == 2]
            near = np.bitwise_count(prints[twos] ^ prints[twos + 1]) <= bits if twos.size else []
            child = [prints[twos + 1][near]] if twos.size else []
            parent = [prints[twos][near]] if twos.size else []
            for i in np.flatnonzero(sizes > 2):
                c, p = forest(prints[starts[i]:starts[i + 1]], bits)
                child.append(c)
                parent.append(p)
            yield out(child, parent)

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def links(prints: DataFrame, bits: int = 4, members: int = MEMBERS) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints (column ``print``) in reach.

    A key with more than ``members`` fingerprints is dealt into parts and every pair of
    parts is compared in a task of its own, so no task holds more than twice that many.
    """
    masks = _masks(bits)
    table = F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.col("print").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks)]))
    keyed = prints.select("print", table.alias("at")).select("print", "at.*")
    # counted with partial sums and joined back: a hot key's members spread like any skewed join
    sizes = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes, ["block", "key"])
    parts = F.ceil(F.col("n") / F.lit(members)).cast("int")
    part = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    dealt = (shared.withColumn("parts", parts).withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("block", "key", F.least("part", "other").alias("lo"),
                     F.greatest("part", "other").alias("hi"), "print"))
    keys = ["block", "key", "lo", "hi"]
    return (dealt.repartition(*keys).sortWithinPartitions(*keys, "print")
            .mapInArrow(_links(bits), "a long, b long").distinct())


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """One stored row per row of ``docs`` (doc_id, text): doc_id, print, text_sha256."""
    return stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_fingerprints(shingle), "doc_id long, print long, text_sha256 string"))


def rooted(rows: DataFrame, first: Column, bits: int = 4, members: int = MEMBERS) -> DataFrame:
    """One row per distinct fingerprint of ``rows``: print, root (first, print) of its component.

    ``first`` ranks the rows of a fingerprint. Fingerprints are numbered by their least
    ``first`` before the contraction, so the root is the one that holds the least of the whole
    component, and no component has to be gathered to find it.
    """
    distinct = stored(rows.groupBy("print").agg(F.min(first).alias("first")))
    node = distinct.select(F.struct("first", "print").alias("node"), "print")
    edges = links(distinct.select("print"), bits, members)
    for end in ("a", "b"):
        named = node.select(F.col("node").alias(f"{end}_node"), F.col("print").alias(end))
        edges = edges.join(named, end)
    roots = components(edges.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return node.join(roots.select(F.col("node.print").alias("print"), "root"), "print", "left").select(
        "print", F.coalesce("root", "node").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = 4, bits: int = 4,
                   members: int = MEMBERS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id, text_sha256.

    ``component_id`` is the smallest doc_id reachable over links of at most ``bits`` bits.
    Null and wordless texts have fingerprint zero, which links like any other. Null ids never
    are component ids unless a component has no other (then it is null). Components that share
    a smallest doc_id, or have none, share the component id; ``component_heads`` tells them
    apart. Repeated rows share a fingerprint; a bit set in exactly half the shingles is 0. Very
    long texts are read whole. An empty table gives an empty result; further columns are
    ignored.
    """
    prepare(docs.sparkSession)
    rows = fingerprints(docs, shingle)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")  # null last
    named = rooted(rows, first, bits, members).select(
        "print", F.col("root.first.doc_id").alias("component_id"))
    return rows.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        "component_id", "text_sha256")


def component_heads(docs: DataFrame, shingle: int = 4, bits: int = 4,
                    members: int = MEMBERS) -> DataFrame:
    """One row per component of ``docs`` (doc_id, text): doc_id, text_sha256 of its first row.

    The first row has the smallest doc_id, null last, then the smallest digest.
    """
    prepare(docs.sparkSession)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256")
    return (rooted(fingerprints(docs, shingle), first, bits, members)
            .filter(F.col("print") == F.col("root.print"))
            .select("root.first.doc_id", "root.first.text_sha256"))
