"""Per-key features: first values, flags, and sums in time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import plus_hours
from ..functions.numeric import flag


def first_values(df: DataFrame, key: str, order: list[str],
                 values: dict[str, Column]) -> DataFrame:
    """Earliest non-missing value per key, several values in one pass.

    ``order`` is completed by the value itself, so ties have one answer. The minimum
    of a struct combines on the map side: a key with very many rows sends one row per
    task, not its whole history.
    """
    aggregates = [
        F.min(F.when(v.isNotNull(), F.struct(*order, v.alias("_v"))))
        .getField("_v").alias(name)
        for name, v in values.items()]
    return df.groupBy(key).agg(*aggregates)


def first_row(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The whole first row per key; the remaining columns complete the order."""
    rest = [c for c in df.columns if c not in order and c != key]
    return (df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
            .select(key, "_r.*").select(*df.columns))


def key_flags(df: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """One 0/1 column per condition and key, all from one pass over the source."""
    return df.groupBy(key).agg(*[F.max(flag(c)).alias(n) for n, c in flags.items()])


def distinct_flag(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(key).dropna().distinct().withColumn(name, F.lit(1))


def within(time: Column, anchor: Column, hours: int, mode: str) -> Column:
    """Window test: 'half_open' is [t0, t0+h), 'up_to' is everything <= t0+h."""
    end = plus_hours(anchor, hours)
    if mode == "half_open":
        return (time >= anchor) & (time < end)
    if mode == "closed":
        return (time >= anchor) & (time <= end)
    if mode == "up_to":
        return time <= end
    raise ValueError(f"unknown window mode {mode!r}")


def windowed_sums(events: DataFrame, anchors: DataFrame, key: str, time: str,
                  anchor: str, amount: Column, horizons: dict[str, int], mode: str,
                  empty=None) -> DataFrame:
    """Sums of ``amount`` per key inside each horizon, all horizons in one pass.

    Keys need not be unique in ``anchors`` (duplicates are removed first, so a stay
    listed twice does not count its events twice). Events of a key outside every
    horizon leave the key with ``empty``.
    """
    starts = anchors.select(key, anchor).distinct()
    joined = events.join(starts, key)
    sums = [
        F.sum(F.when(within(F.col(time), F.col(anchor), h, mode), amount)
              .otherwise(F.lit(empty).cast("double"))).alias(name)
        for name, h in horizons.items()]
    return joined.groupBy(key).agg(*sums)


def item_factor(item: Column, factors: dict[int, float]) -> Column:
    """Unit conversion by item id."""
    out = None
    for key, factor in factors.items():
        out = (F.when(item == key, F.lit(factor)) if out is None
               else out.when(item == key, F.lit(factor)))
    return out.otherwise(F.lit(0.0))
