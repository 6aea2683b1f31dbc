"""Cut-off derivation on a score's histogram.

A candidate only regroups score levels, so every search works on one row per level:
the cohort is read and ranked once, never once per candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .association import chi_square_cells, kruskal_from_sums
from .rank_scan import level_sums
from .ranks import quantiles
from .roc import score_histogram


def candidate_grid(low: int, high: int) -> list[tuple[int, int]]:
    """Pairs (a, b): a from ``low``, b at least two above a and below ``high``."""
    return [(a, b) for a in range(low, high - 2) for b in range(a + 2, high)]


def with_candidates(levels: DataFrame, score: str, grid: list[tuple[int, int]]) -> DataFrame:
    """Each histogram level under each candidate pair, with its band 0, 1 or 2."""
    pairs = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"))
                      for a, b in grid])
    band = (F.when(F.col(score) <= F.col("low"), 0)
            .when(F.col(score) <= F.col("high"), 1).otherwise(2))
    return levels.select(*levels.columns, F.inline(pairs)).withColumn("band", band)


def best_candidate(stats: DataFrame, stat: str, digits: int = 9) -> DataFrame:
    """Row with the largest positive statistic; equal ones go to the smallest cuts.

    Rounded first, so that mathematically equal candidates tie instead of differing in
    the last bit of a sum.
    """
    rest = [c for c in stats.columns if c not in ("low", "high")]
    best = F.max(F.struct(F.round(stat, digits).alias("_s"), (-F.col("low")).alias("_l"),
                          (-F.col("high")).alias("_h"), *rest)).alias("_b")
    return (stats.filter(F.col(stat) > 0).agg(best).filter("_b is not null")
            .select((-F.col("_b._l")).alias("low"), (-F.col("_b._h")).alias("high"),
                    *[F.col(f"_b.{c}").alias(c) for c in rest]))


def chi2_candidates(df: DataFrame, score: str, event: str,
                    grid: list[tuple[int, int]]) -> DataFrame:
    """Independence statistic of the 3 x 2 table of every candidate that fills it."""
    hist = score_histogram(df, score, event)
    classes = F.array(F.struct(F.lit(1).alias("event"), F.col("p").alias("n")),
                      F.struct(F.lit(0).alias("event"), F.col("q").alias("n")))
    long = hist.select(F.col(score), F.inline(classes))
    cells = (with_candidates(long, score, grid).groupBy("low", "high", "band", "event")
             .agg(F.sum("n").alias("n")))
    tests = chi_square_cells(cells, "band", "event", ["low", "high"])
    return tests.filter(F.col("dof") == 2)


def kruskal_candidates(df: DataFrame, score: str, outcome: str,
                       grid: list[tuple[int, int]], min_group: int = 10) -> DataFrame:
    """Rank statistic of every candidate whose three groups exceed ``min_group``."""
    levels = level_sums(df, score, outcome)
    bands = with_candidates(levels, score, grid).groupBy("low", "high", "band").agg(
        F.sum("n").alias("n"), F.sum("d_sum").alias("d_sum"),
        F.sum("tie_term").alias("tie_term"))
    sizes = bands.groupBy("low", "high").agg(
        F.count("*").alias("_k"), F.min("n").alias("_least"))
    fit = sizes.filter((F.col("_k") == 3) & (F.col("_least") > min_group))
    return kruskal_from_sums(bands.join(fit.select("low", "high"), ["low", "high"]),
                             ["low", "high"])


def _gini(n: Column, p: Column) -> Column:
    """Node size times Gini impurity."""
    return 2.0 * p * (n - p) / n


def best_splits(hist: DataFrame, score: str, node: str, min_leaf: int) -> DataFrame:
    """Per node: the midpoint split with the least weighted impurity.

    ``hist`` is a score histogram (few levels) with p and q; pure nodes and nodes
    without a split leaving ``min_leaf`` rows on both sides give no row.
    """
    order = Window.partitionBy(node).orderBy(score)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(node)
    n = F.col("p") + F.col("q")
    marked = hist.select(
        node, F.col(score).cast("double").alias("_s"),
        F.lead(F.col(score).cast("double")).over(order).alias("_next"),
        F.sum(n).over(upto).cast("double").alias("_ln"),
        F.sum("p").over(upto).cast("double").alias("_lp"),
        F.sum(n).over(whole).cast("double").alias("_n"),
        F.sum("p").over(whole).cast("double").alias("_p"))
    rn, rp = F.col("_n") - F.col("_ln"), F.col("_p") - F.col("_lp")
    options = marked.filter(
        F.col("_next").isNotNull() & (F.col("_ln") >= min_leaf) & (rn >= min_leaf)
        & (F.col("_p") > 0) & (F.col("_p") < F.col("_n")))
    impurity = F.round(_gini(F.col("_ln"), F.col("_lp")) + _gini(rn, rp), 9)
    best = F.min(F.struct(
        impurity.alias("i"), ((F.col("_s") + F.col("_next")) / 2).alias("threshold")))
    return options.groupBy(node).agg(best.getField("threshold").alias("threshold"))


def tree_cutoffs(df: DataFrame, score: str, event: str, min_leaf: int = 50) -> DataFrame:
    """Thresholds of the depth-two tree on one score: node, threshold."""
    hist = score_histogram(df, score, event)
    root = best_splits(hist.withColumn("node", F.lit("root")), score, "node", min_leaf)
    # NULL (no root split) leaves every level without a side, hence without children
    cut = root.select("threshold").scalar()
    side = F.when(F.col(score) <= cut, "left").when(F.col(score) > cut, "right")
    halves = hist.withColumn("node", side).filter(F.col("node").isNotNull())
    return root.unionByName(best_splits(halves, score, "node", min_leaf))


def quantile_cutoffs(df: DataFrame, score: str) -> DataFrame:
    """Tertile and quartile boundaries of the score."""
    wide = quantiles(df, score, {"t1": 0.333, "t2": 0.667, "q1": 0.25, "q3": 0.75},
                     bounded=True)
    rows = F.array(
        F.struct(F.lit("tertiles").alias("method"), F.col("t1").alias("low"),
                 F.col("t2").alias("high")),
        F.struct(F.lit("quartiles").alias("method"), F.col("q1").alias("low"),
                 F.col("q3").alias("high")))
    return wide.select(F.inline(rows))
