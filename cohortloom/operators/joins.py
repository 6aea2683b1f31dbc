"""Joins that enrich a keyed cohort without multiplying its rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import day_bucket, minus_days
from .ranks import union


#: Bytes that a broadcast key takes, with its share of the hash table.
KEY_BYTES = 32


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Existence test: rows of ``df`` whose key occurs in ``keys``."""
    return df.join(keys, on, "left_semi")


def broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = text.lower().rstrip("b")
    if digits[-1] in scale:
        return int(digits[:-1]) * scale[digits[-1]]
    return int(digits)


def extract_for_keys(texts: DataFrame, keys: DataFrame, on: str,
                     extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Extract narrow columns from wide text rows of the wanted keys.

    Wide text must never be shuffled. If the (unique) keys, counted, fit the broadcast
    limit, rows are dropped before the extraction; otherwise the extraction runs at the
    scan and only its narrow result takes part in the shuffled join.
    """
    most = broadcast_limit(keys) // KEY_BYTES
    if keys.select(on).limit(most + 1).count() <= most:
        return extract(texts.join(F.broadcast(keys), on, "left_semi"))
    return extract(texts).join(keys, on)


def bridge(events: DataFrame, link: DataFrame, on: str, key: str) -> DataFrame:
    """Distinct ``key`` values reached from events over a linking table."""
    hit = events.select(on).distinct()
    return link.select(on, key).dropna().join(hit, on, "left_semi").select(key).distinct()


def left_star(base: DataFrame, features: list[tuple[DataFrame, str | list[str]]]) -> DataFrame:
    """Left-join features that each hold at most one row per key.

    List features of one key next to each other: the base then stays partitioned by
    that key through all of them.
    """
    return reduce(lambda df, item: df.join(item[0], item[1], "left"), features, base)


def priority_coalesce(base: DataFrame, sources: list[tuple[DataFrame, str]], on: str,
                      value: str, label: str) -> DataFrame:
    """First non-missing value over ranked sources, with the source's name.

    The sources meet in one narrow frame first, so the base is joined once however many
    there are.
    """
    ranked = union([
        df.select(on, F.lit(i).alias("_rank"), F.col(value), F.lit(name).alias(label))
        for i, (df, name) in enumerate(sources)])
    best = (ranked.filter(F.col(value).isNotNull()).groupBy(on)
            .agg(F.min(F.struct("_rank", value, label)).alias("_best"))
            .select(on, f"_best.{value}", f"_best.{label}"))
    return base.join(best, on, "left")


def lookback_keys(index: DataFrame, history: DataFrame, person: str, event: str,
                  start: str, end: str, days: int) -> DataFrame:
    """Index events whose person has another event ending in [start - days, start).

    ``index`` has person, event, start; ``history`` the qualifying events with
    person, event, start, end. No pairs of events are formed: history shrinks to the
    first and last end per (person, ``days``-wide calendar bucket), and an index event
    looks into its own and the previous bucket, where that pair decides the test
    exactly. A record ending before it starts could see itself, so such records keep
    their event id beside the bucket and never answer for themselves.
    """
    odd = F.when(F.col(end) < F.col(start), F.col(event))
    buckets = (history
               .select(person, odd.alias("_self"), F.col(end).alias("_end"),
                       day_bucket(F.col(end), days).alias("_bucket"))
               .groupBy(person, "_bucket", "_self")
               .agg(F.min("_end").alias("_first"), F.max("_end").alias("_last")))
    own = day_bucket(F.col(start), days)
    probes = index.select(
        person, event, start, F.explode(F.array(own, own - 1)).alias("_bucket"))
    p, b = probes.alias("p"), buckets.alias("b")
    test: Column = (
        (F.col(f"p.{person}") == F.col(f"b.{person}"))
        & (F.col("p._bucket") == F.col("b._bucket"))
        & (F.col("b._first") < F.col(f"p.{start}"))
        & (F.col("b._last") >= minus_days(F.col(f"p.{start}"), days))
        & (F.col("b._self").isNull() | (F.col("b._self") != F.col(f"p.{event}"))))
    return p.join(b, test, "left_semi").select(F.col(event)).distinct()
