"""Cut-off derivation and comparison of risk schemes over the final cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.numeric import risk_level
from ..operators.association import chi_square, kruskal_wallis
from ..operators.cutoffs import (best_candidate, candidate_grid, chi2_candidates,
                                 kruskal_candidates, quantile_cutoffs, tree_cutoffs)
from ..operators.describe import describe, rates
from ..operators.ranks import quantiles, union
from ..operators.roc import roc_curve, youden

GRID = candidate_grid(*config.CUTOFF_RANGE)


def efficiency_cohort(df: DataFrame, hours: int = 24) -> DataFrame:
    """Stays of the minimum length with a positive efficiency."""
    eff = F.col(f"diuretic_efficiency_{hours}h")
    return df.filter((F.col(f"icu_stay_ge_{hours}h") == 1) & (eff > 0))


LABELS = {"low_q20": 0.20, "low_q25": 0.25, "below_p99": 0.99}


def add_efficiency_labels(df: DataFrame) -> DataFrame:
    """Adds per horizon: efficiency at or below its own 20 %, 25 % and 99 % quantile.

    The labels are NULL outside the horizon's efficiency cohort. Each horizon's
    quantiles come as one struct from one scalar subquery.
    """
    added = {}
    for hours in (24, 72):
        eff = f"diuretic_efficiency_{hours}h"
        limits = quantiles(efficiency_cohort(df, hours), eff, LABELS)
        df = df.withColumn(f"_t{hours}", limits.select(F.struct(*LABELS)).scalar())
        inside = (F.col(f"icu_stay_ge_{hours}h") == 1) & (F.col(eff) > 0)
        for name in LABELS:
            low = F.col(eff) <= F.col(f"_t{hours}").getField(name)
            added[f"{name}_{hours}h"] = F.when(inside, low.cast("int"))
    return df.withColumns(added).drop("_t24", "_t72")


def labelled_efficiency(df: DataFrame, hours: int = 24) -> DataFrame:
    """Efficiency cohort with low_q20, low_q25 and below_p99.

    Uses stored labels if the table carries them, else derives them.
    """
    if f"low_q20_{hours}h" not in df.columns:
        df = add_efficiency_labels(df)
    return efficiency_cohort(df, hours).withColumnsRenamed(
        {f"{name}_{hours}h": name for name in LABELS})


def cutoff_summary(df: DataFrame) -> DataFrame:
    """One row per derivation method: low cut, high cut, outcome used.

    Low means 'at or below', high means 'at or above'.
    """
    cohort = labelled_efficiency(df)
    score, eff = "total_score", "diuretic_efficiency_24h"

    def row(frame: DataFrame, method: str, low, high, outcome: str) -> DataFrame:
        return frame.select(F.lit(method).alias("method"), low.cast("double").alias("low"),
                            high.cast("double").alias("high"), F.lit(outcome).alias("outcome"))

    nothing = F.lit(None)
    best_j = youden(roc_curve(cohort, score, "low_q20", bounded=True))
    chi2 = best_candidate(chi2_candidates(cohort, score, "low_q20", GRID), "chi2")
    rank = best_candidate(kruskal_candidates(cohort, score, eff, GRID), "h")
    tree = tree_cutoffs(cohort, score, "low_q20", config.TREE_MIN_LEAF)
    ends = F.sort_array(F.collect_list("threshold"))
    tree = tree.agg(ends.alias("t")).select(
        F.get("t", F.lit(0)).alias("low"), F.get("t", F.lit(1)).alias("high"))
    spread = quantile_cutoffs(df, score)
    return union([
        row(best_j, "youden", nothing, F.col("threshold"), "lowest fifth"),
        row(tree, "tree", F.col("low"), F.col("high"), "lowest fifth"),
        row(chi2, "chi_square", F.col("low"), F.col("high") + 1, "lowest fifth"),
        row(rank, "kruskal_wallis", F.col("low"), F.col("high") + 1, "continuous"),
        spread.select("method", "low", "high", F.lit("distribution").alias("outcome")),
    ])


def mortality_cutoffs(df: DataFrame) -> DataFrame:
    """The candidate pair with the largest independence statistic for deaths, full cohort."""
    return best_candidate(
        chi2_candidates(df, "total_score", "hospital_expire_flag", GRID), "chi2")


def cutoff_derivation(df: DataFrame) -> DataFrame:
    """All derived cuts, and for each risk scheme its cuts with its test statistics."""
    none = F.lit(None).cast("double")
    derived = cutoff_summary(df).unionByName(mortality_cutoffs(df).select(
        F.lit("chi_square").alias("method"), F.col("low").cast("double").alias("low"),
        (F.col("high") + 1).cast("double").alias("high"), F.lit("mortality").alias("outcome")))
    derived = derived.withColumns({"statistic": none, "p": none})
    tested = framework_efficiency(df).select("framework", F.lit("continuous").alias("outcome"),
                                             F.col("h").alias("statistic"), "p").distinct()
    tested = tested.unionByName(framework_mortality(df).select(
        "framework", F.lit("mortality").alias("outcome"), F.col("chi2").alias("statistic"),
        "p").distinct())
    cuts = F.create_map(*[x for name, (low, high) in config.RISK_FRAMEWORKS.items() for x in
                          (F.lit(name), F.struct(F.lit(float(low)).alias("low"),
                                                 F.lit(float(high + 1)).alias("high")))])
    tested = tested.withColumn("_c", cuts[F.col("framework")]).select(
        F.concat(F.lit("scheme "), F.col("framework")).alias("method"), "_c.low", "_c.high",
        "outcome", "statistic", "p")
    return derived.unionByName(tested)


def with_frameworks(df: DataFrame) -> DataFrame:
    """Every row once per risk scheme, with that scheme's level."""
    options = F.array(*[
        F.struct(F.lit(name).alias("framework"),
                 risk_level(F.col("total_score"), low, high).alias("level"))
        for name, (low, high) in config.RISK_FRAMEWORKS.items()])
    return df.select(*df.columns, F.inline(options))


def framework_efficiency(df: DataFrame, hours: int = 24) -> DataFrame:
    """Per scheme and level: n, median efficiency, and the scheme's rank statistic."""
    eff = f"diuretic_efficiency_{hours}h"
    long = with_frameworks(
        efficiency_cohort(df, hours).select("total_score", eff))
    medians = describe(long, eff, ["framework", "level"]).select(
        "framework", "level", "n", "median")
    tests = kruskal_wallis(long, "level", eff, ["framework"]).select("framework", "h", "p")
    return medians.join(tests, "framework").withColumn("timepoint", F.lit(f"{hours}h"))


def framework_mortality(df: DataFrame) -> DataFrame:
    """Per scheme and level: n, share, deaths, rate, and the scheme's chi-square."""
    long = with_frameworks(df.select("total_score", "hospital_expire_flag"))
    table = rates(long, "hospital_expire_flag", ["framework", "level"])
    tests = chi_square(long, "level", "hospital_expire_flag", ["framework"])
    return table.join(tests.select("framework", "chi2", "p"), "framework")


def score_step_profile(df: DataFrame, scores: list[int] | None = None) -> DataFrame:
    """n and median efficiency at each exact score."""
    cohort = efficiency_cohort(df)
    if scores:
        cohort = cohort.filter(F.col("total_score").isin(scores))
    return describe(cohort, "diuretic_efficiency_24h", ["total_score"]).select(
        "total_score", "n", "median")
