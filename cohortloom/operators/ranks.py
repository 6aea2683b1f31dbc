"""Ordered running totals, ranks and exact quantiles without a one-task window.

All order statistics here come from one helper, :func:`prefix_sums`, over a histogram
(rows already reduced to distinct values). A histogram is cut by value into cells whose
size does not depend on the data's distribution: the position of a double inside its power
of two gives a coarse and a fine key, totals are carried from coarse to fine to value, and
no window ever sees more than one cell. Only a caller who declares few distinct values
(a point score, a handful of labels) gets one window per group instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE_BITS, FINE_BITS = 12, 32


def value_key(value: Column, bits: int) -> Column:
    """Order-preserving integer key of a finite double, ``bits`` per power of two.

    Any two values compare the same way by key as by value, or share the key. That
    needs only a monotone exponent, so rounding inside the logarithm is harmless.
    """
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    # two steps keep the power of two finite for the smallest doubles
    half = F.floor(exponent / F.lit(2.0))
    scaled = size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), exponent - half)
    place = F.floor(scaled * F.lit(float(2 ** bits))).cast("bigint")
    key = (exponent + F.lit(1100)).cast("bigint") * F.lit(2 ** (bits + 2)) + place
    # never NULL in the planner's eyes: joins on the key then add no filter of their own,
    # and the branches of one histogram keep the same plan and share its exchange
    return F.coalesce(F.when(value > 0, key).when(value < 0, -key),
                      F.lit(0).cast("bigint"))


def _window(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def prefix_sums(hist: DataFrame, value: str, measures: list[str], by: list[str] = (),
                bounded: bool = False) -> DataFrame:
    """Adds, per measure m: m_below (over smaller values), m_at (same value), m_total.

    ``hist`` may hold several rows per (by, value) but must be reduced to distinct
    rows, not raw data. ``by`` columns and ``value`` must not be NULL. ``bounded``
    promises few distinct rows per group (a point score, a handful of labels).
    """
    by = list(by)
    if bounded:
        upto = _window(by).orderBy(value).rangeBetween(
            Window.unboundedPreceding, Window.currentRow)
        at = Window.partitionBy(*by, value)
        whole = _window(by)
        added = {}
        for m in measures:
            added[f"{m}_at"] = F.sum(m).over(at)
            added[f"{m}_below"] = F.sum(m).over(upto) - F.sum(m).over(at)
            added[f"{m}_total"] = F.sum(m).over(whole)
        return hist.withColumns(added)

    def strictly_before(keys: list[str], order: str):
        return _window(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def before(m: str, window) -> Column:
        return F.coalesce(F.sum(m).over(window), F.lit(0))

    keyed = hist.withColumns({
        "_k1": value_key(F.col(value).cast("double"), COARSE_BITS),
        "_k2": value_key(F.col(value).cast("double"), FINE_BITS)})
    fine = keyed.groupBy(*by, "_k1", "_k2").agg(*[F.sum(m).alias(m) for m in measures])
    coarse = fine.groupBy(*by, "_k1").agg(*[F.sum(m).alias(m) for m in measures])
    level1 = coarse.select(
        *by, "_k1",
        *[before(m, strictly_before(by, "_k1")).alias(f"_o1_{m}") for m in measures],
        *[F.sum(m).over(_window(by)).alias(f"{m}_total") for m in measures])
    within1 = strictly_before([*by, "_k1"], "_k2")
    level2 = fine.join(level1, [*by, "_k1"]).select(
        *by, "_k1", "_k2",
        *[(F.col(f"_o1_{m}") + before(m, within1)).alias(f"_o2_{m}") for m in measures],
        *[F.col(f"{m}_total") for m in measures])
    cell = Window.partitionBy(*by, "_k1", "_k2").orderBy(value).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    at = Window.partitionBy(*by, "_k1", "_k2", value)
    out = keyed.join(level2, [*by, "_k1", "_k2"])
    added = {}
    for m in measures:
        added[f"{m}_at"] = F.sum(m).over(at)
        added[f"{m}_below"] = F.col(f"_o2_{m}") + F.sum(m).over(cell) - F.sum(m).over(at)
    return out.withColumns(added).drop("_k1", "_k2", *[f"_o2_{m}" for m in measures])


def histogram(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Distinct rows with their count (or summed weight) ``n``; NULL rows dropped."""
    count = F.sum(weight) if weight else F.count("*")
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.filter(present).groupBy(*columns).agg(count.alias("n"))


def mean_rank() -> Column:
    """Tie-averaged rank from the prefix sums of ``n``."""
    return F.col("n_below").cast("double") + (F.col("n_at") + F.lit(1)) / F.lit(2.0)


def average_rank(df: DataFrame, value: str, by: list[str] = (), out: str = "rank",
                 bounded: bool = False) -> DataFrame:
    """Every row with its tie-averaged rank. Rows with a NULL value get NULL."""
    by = list(by)
    ranks = prefix_sums(histogram(df, [*by, value]), value, ["n"], by, bounded)
    return df.join(ranks.select(*by, value, mean_rank().alias(out)), [*by, value], "left")


def _named(quantiles: dict[str, float], pick) -> list[Column]:
    return [pick(q).alias(name) for name, q in quantiles.items()]


def quantile_aggregates(value: str, quantiles: dict[str, float]) -> list[Column]:
    """Aggregates over prefix-summed rows: linear interpolation of two order statistics."""
    reached = F.col("n_below") + F.col("n_at")
    last = (F.col("n_total") - 1).cast("double")

    def pick(q: float) -> Column:
        place = last * F.lit(float(q))
        low = F.min(F.when(reached > F.floor(place), F.col(value)))
        high = F.min(F.when(reached > F.ceil(place), F.col(value)))
        share = F.max(place - F.floor(place))
        return (low + (high - low) * share).cast("double")

    return _named(quantiles, pick)


def quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] = (),
              bounded: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group.

    ``bounded`` (few distinct values) uses the built-in percentile, whose state is one
    entry per distinct value; otherwise the state stays distributed.
    """
    by = list(by)
    if bounded:
        return df.groupBy(*by).agg(
            *_named(qs, lambda q: F.percentile(value, F.lit(float(q))).cast("double")))
    hist = histogram(df, [*by, value])
    return prefix_sums(hist, value, ["n"], by, bounded).groupBy(*by).agg(
        *quantile_aggregates(value, qs))


def quantile(df: DataFrame, value: str, q: float) -> Column:
    """One quantile of the whole frame as a scalar subquery."""
    return quantiles(df, value, {"q": q}).scalar()


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
