"""Documents dealt into ascending id ranges, one range per partition, sorted inside."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of a range, and the most ranges (the driver holds one bound of each).
RANGE_BYTES = 24 << 20
MOST_RANGES = 50_000
_NULL = -(2**63)


def _targets(bounds: np.ndarray, firsts: np.ndarray, last: int):
    """ids -> ranges they belong to; the first id of a range also closes the one before."""

    def targets(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(_NULL).to_numpy(zero_copy_only=False)
        own = np.searchsorted(bounds, values, "right")
        place = np.searchsorted(firsts[:, 0], values)
        place = np.minimum(place, len(firsts) - 1)
        closes = firsts[place, 0] == values
        before = np.where(place == 0, last, firsts[np.maximum(place, 1) - 1, 1])
        lists = [[2 * a, 2 * b + 1] if c else [2 * a] for a, b, c in
                 zip(own.tolist(), before.tolist(), closes.tolist(), strict=True)]
        return pa.array(lists, pa.list_(pa.int32()))

    return targets


def by_id_range(docs: DataFrame, closing: bool, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(part, late, doc_id, text): partition ``part`` holds one id range, sorted by id, text.

    Null text is empty and null ids sort first. Range bounds are quantiles of the ids. With
    ``closing`` each range ends with the row (late = 1) that follows it in the whole table,
    after the last range the first row of all; that row may come with repetitions.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    ranges = min(MOST_RANGES, max(1, math.ceil((size.b or 0) / range_bytes)))
    bounds = np.zeros(0, np.int64)
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * ranges))).first()[0]
        bounds = np.unique(np.array(cuts or [], np.int64))
    part = F.arrow_udf(lambda ids: pa.array(np.searchsorted(
        bounds, ids.fill_null(_NULL).to_numpy(zero_copy_only=False), "right").astype(np.int32)),
        "int")
    firsts = np.full((1, 2), _NULL + 1, np.int64)
    last = 0
    if closing and size.n:
        least = docs.groupBy(part("doc_id").alias("part")).agg(
            F.min(F.coalesce("doc_id", F.lit(_NULL))).alias("first")).orderBy("part").collect()
        firsts = np.array([(r.first, r.part) for r in least], np.int64)
        last = int(firsts[-1, 1])
    targets = F.arrow_udf(_targets(bounds, firsts, last), "array<int>")
    dealt = docs.select(F.explode(targets("doc_id")).alias("at"), "doc_id", "text").select(
        F.shiftright("at", 1).alias("part"), F.col("at").bitwiseAND(1).alias("late"),
        "doc_id", "text")
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(
        "part", "late", "doc_id", "text")
