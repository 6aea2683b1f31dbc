"""Mixing sources to target weights along a time-varying curriculum, JVM side only.

Every source has a target number of words and a schedule: a piecewise linear weight over
training time from 0 to 1. The integral of the schedule is the source's cumulative demand;
inverting it turns the words a source has given before a document into that document's
training position, and documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, prepare, stored, text_sha, word_count

WEIGHTS = (5, 2, 1)
#: Most often that a source is repeated.
REPEATS = 3
#: Weight over time of the sources of each class of WEIGHTS: heavy ones early, light ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.4, 0.8), (1.0, 1.5)))
#: Hash ranges that a source is split into, so that no task sees a whole source.
CELLS_LOG2 = 12


def source_key() -> Column:
    """A source as a join key; null has one too."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS,
                   repeats: int = REPEATS) -> DataFrame:
    """Adds ``target`` and ``class`` to one row per source (source, source_size).

    Sources by code point, null last, have the weights in turn. Targets share the sum of all
    sizes by weight; none exceeds ``repeats`` times its size, and what it leaves goes to the
    others by weight. That is a water level: in ascending order of limit over weight, a
    source is full if its limit is below the level that the sources after it would share.
    The window spans one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kind = F.pmod(place, F.lit(len(weights))).cast("int")
    rows = sizes.withColumn("class", kind).withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), F.col("class") + 1))
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(float(repeats)))
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("level", level).withColumn(
        "open", F.col("limit") / F.col("weight") > F.col("level"))
    shared = F.min(F.when(F.col("open"), F.struct(
        (F.col("limit") / F.col("weight")).alias("r"), F.col("level").alias("level")))
    ).over(everything)["level"]
    return rows.withColumn("shared", shared).select(
        "source", "source_size", "class",
        F.when(F.col("open"), F.least("limit", F.col("weight") * F.col("shared")))
        .otherwise(F.col("limit")).alias("target"))


def invert_demand(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """Time at which a source of class ``kind`` has given ``share`` of its words.

    Within a piece the demand is w t + s t^2 / 2; its root is taken in the form that stays
    exact for a flat piece.
    """
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        pieces, total = [], 0.0
        for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True):
            pieces.append((t0, t1, w0, (w1 - w0) / (t1 - t0), total))
            total += (t1 - t0) * (w0 + w1) / 2
        time = F.lit(0.0)
        for t0, t1, w0, slope, area in pieces:
            rest = share * F.lit(total) - F.lit(area)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * slope), F.lit(0.0)))
            local = F.lit(t0) + F.when(rest > 0, rest * 2 / (F.lit(w0) + root)).otherwise(F.lit(0.0))
            time = F.when(rest >= 0, F.least(local, F.lit(t1))).otherwise(time)
        out = F.when(kind == k, time).otherwise(out)
    return out


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS,
            schedules=SCHEDULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source) with what the mix takes of it.

    Columns doc_id, size (words; null text 0), source_size, target, copies, taken
    (copies x size), position (time of the first copy, null if none), positions,
    text_sha256, sorted by position. Within a source the order is a hash of id and text, so
    reruns agree and repeated rows are interchangeable. Every document is taken as often as
    the target holds whole rounds of its source, and once more while the last, partial round
    has not yet reached its middle; the source's sum misses the target by half a document at
    most. A source without words takes nothing; null sources are one source, the last. Very
    long texts count all their words. An empty table gives an empty result; further columns
    are ignored.
    """
    prepare(docs.sparkSession)
    digest = text_sha()
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), digest.alias("text_sha256"))
        .withColumn("key", source_key())
        .withColumn("draw", F.xxhash64("doc_id", "text_sha256"))
        .withColumn("cell", F.shiftrightunsigned("draw", 64 - CELLS_LOG2)))
    cells = stored(rows.groupBy("key", "cell").agg(
        F.first("source").alias("source"), F.sum("size").alias("cell_size")))
    sizes = cells.groupBy("key").agg(
        F.first("source").alias("source"), F.sum("cell_size").alias("source_size"))
    targets = source_targets(sizes, weights, repeats).withColumn("key", source_key()).drop("source")
    in_source = Window.partitionBy("key").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = cells.select("key", "cell", F.coalesce(
        F.sum("cell_size").over(in_source), F.lit(0)).alias("offset")).join(targets, "key")
    in_cell = Window.partitionBy("key", "cell").orderBy("draw", "doc_id", "text_sha256").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (rows.withColumn("within", F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
              .join(offsets, ["key", "cell"])
              .withColumn("start", F.col("offset") + F.col("within")))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
                    ).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumn("rounds", rounds)
    part = F.col("target") - F.col("rounds") * F.col("source_size")
    once_more = (F.col("start") + F.col("size") / 2 < part) & (F.col("rounds") < repeats)
    placed = placed.withColumn("copies", F.col("rounds") + once_more.cast("int"))
    given = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("copies"), F.lit(1)) - 1),
        lambda c: F.least(F.lit(1.0), (F.col("start") + c * F.col("source_size"))
                          / F.greatest(F.col("target"), F.lit(1.0))))
    shares = F.when(F.col("copies") > 0, given).otherwise(F.array().cast("array<double>"))
    placed = placed.withColumn("positions", F.transform(
        shares, lambda s: invert_demand(s, F.col("class"), schedules)))
    return placed.select(
        "doc_id", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, F.col("positions")[0]).alias("position"), "positions",
        "text_sha256").orderBy(F.col("position").asc_nulls_last(), "doc_id", "text_sha256")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by position."""
    same = Window.partitionBy("id_key", "sha_key").orderBy(F.lit(0))
    names = docs.columns
    taken = mixture(docs).filter("copies > 0").select(
        id_key(), F.col("text_sha256").alias("sha_key"), "positions")
    taken = taken.withColumn("taken_no", F.row_number().over(same))
    rows = docs.select("*", id_key(), text_sha().alias("sha_key")).withColumn(
        "row_no", F.row_number().over(same))
    return (rows.join(taken, ["id_key", "sha_key"]).filter("row_no = taken_no")
            .select(*names, F.explode("positions").alias("mix_position"))
            .orderBy("mix_position", "doc_id").select(*names))
