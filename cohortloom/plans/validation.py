"""Validation panels over the final cohort: subgroups, scenarios, outcomes, tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.numeric import (clip_upper, coerce_flag, level_order, percent_change,
                                 recode, strength)
from ..operators import association as assoc
from ..operators import bootstrap as boot
from ..operators import roc
from ..operators.describe import bin_counts, describe, effect_ratios, rates
from ..operators.filters import unpivot
from ..operators.ranks import quantiles, union
from .cutoffs import efficiency_cohort, labelled_efficiency

ID, SCORE, RISK = "stay_id", "total_score", "risk_category"
EFF24, EFF72 = "diuretic_efficiency_24h", "diuretic_efficiency_72h"
B, SEED = config.BOOTSTRAP_RESAMPLES, config.BOOTSTRAP_SEED


# --- sub-cohorts -----------------------------------------------------------------

def subcohort_tests() -> dict[str, Column]:
    def efficient(hours: int) -> Column:
        return ((F.col(f"icu_stay_ge_{hours}h") == 1)
                & (F.col(f"diuretic_efficiency_{hours}h") > 0))

    return {
        "all": F.lit(True),
        "icu_ge_24h": F.col("icu_stay_ge_24h") == 1,
        "efficiency_24h": efficient(24),
        "icu_ge_72h": F.col("icu_stay_ge_72h") == 1,
        "efficiency_72h": efficient(72),
        "shock": F.col("cardiogenic_shock") == 1,
        "no_shock": F.col("cardiogenic_shock") == 0,
        "known_ef": F.col("lvef").isNotNull(),
        "no_advanced_ckd": F.col("chronic_advanced_ckd") == 0,
    }

# the point score has few levels
spearman = partial(assoc.spearman, bounded_x=True)
discrimination = partial(roc.discrimination, bounded=True)
roc_curve = partial(roc.roc_curve, bounded=True)


def subcohorts(df: DataFrame) -> dict[str, DataFrame]:
    return {name: df.filter(test) for name, test in subcohort_tests().items()}


def with_membership(df: DataFrame, tests: dict[str, Column], name: str) -> DataFrame:
    """Every row once per named subset it belongs to, so all subsets run as one job."""
    member = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return df.withColumn(name, F.explode(member))


def subcohort_summary(df: DataFrame) -> DataFrame:
    """Rows, deaths and risk split of every sub-cohort in one pass."""
    long = with_membership(df, subcohort_tests(), "cohort")
    return long.groupBy("cohort").agg(
        F.count("*").alias("n"), F.sum("hospital_expire_flag").cast("bigint").alias("deaths"),
        *[F.sum((F.col(RISK) == level).cast("int")).alias(f"n_{level.lower()}")
          for level in config.RISK_LEVELS])


# --- one metric with its interval -------------------------------------------------

AREAS = ["auroc", "auprc", "auroc_ci_low", "auroc_ci_high", "auprc_ci_low", "auprc_ci_high"]


def spearman_with_ci(df: DataFrame, outcome: str, by: list[str], resamples: int = B) -> DataFrame:
    """n, rho, p and interval per group, the sample being one more replicate."""
    reps = boot.rank_replicates(df, ID, SCORE, outcome, resamples, SEED, by, sample=True)
    found = boot.estimates(reps, {"rho": "spearman"}, by)
    return found.withColumn("p", assoc.correlation_p(F.col("rho"), F.col("n")))


def areas_with_ci(df: DataFrame, event: str, by: list[str], resamples: int = B) -> DataFrame:
    """n, events and both areas with intervals per group."""
    reps = boot.discrimination_replicates(df, SCORE, event, resamples, SEED, by, sample=True)
    return boot.estimates(reps, {"auroc": "auroc", "auprc": "auprc"}, by, ["n", "events"])


class Metrics:
    """Estimates with intervals that the panels ask for by name, each worked out on its own."""

    def __init__(self, resamples: int = B):
        self.resamples = resamples

    def rho(self, panel: str, rows: DataFrame, outcome: str, by: list[str]) -> DataFrame:
        """n, rho, p and interval per group."""
        return spearman_with_ci(rows, outcome, by, self.resamples)

    def areas(self, panel: str, rows: DataFrame, event: str, by: list[str]) -> DataFrame:
        """n, events, AUROC and AUPRC with intervals per group."""
        return areas_with_ci(rows, event, by, self.resamples)


DIRECT = Metrics()


def only_if(test: Column, columns: list[str]) -> dict[str, Column]:
    return {c: F.when(test, F.col(c)) for c in columns}


def efficiency_rows(df: DataFrame, hours: list[int]) -> DataFrame:
    """Labelled efficiency rows of several horizons as one long frame."""
    return union([
        labelled_efficiency(df, h).select(
            ID, SCORE, RISK, "low_q20", "low_q25",
            F.col(f"diuretic_efficiency_{h}h").alias("y"), F.lit(f"{h}h").alias("cohort"))
        for h in hours])


def primary_metrics(df: DataFrame, hours: list[int] = (24,), resamples: int = B) -> DataFrame:
    """cohort, metric, n, estimate, ci_low, ci_high, p of the efficiency outcomes.

    All horizons run together; the sample is one more replicate of each metric.
    """
    rows, by = efficiency_rows(df, list(hours)), ["cohort"]
    keys, none = [*by, "metric"], F.lit(None).cast("double")
    events = unpivot(rows, [ID, SCORE, "cohort"], ["low_q20", "low_q25"], "int",
                     "metric", "event")
    events = events.withColumn("metric", F.concat(F.lit("auroc_"), F.substring("metric", 5, 3)))

    def long(frame: DataFrame, name: Column, **values: Column) -> DataFrame:
        """The estimates of a frame as rows; ``values`` are the p-values by column."""
        # SQL functions cannot stand in a generator: the p-values come first
        known = frame.withColumns({f"_p_{c}": p for c, p in values.items()})
        return known.select("cohort", F.inline(F.array(*[
            F.struct(F.coalesce(name, F.lit(c)).alias("metric"), F.col("n"),
                     F.col(c).alias("estimate"), F.col(f"{c}_ci_low").alias("ci_low"),
                     F.col(f"{c}_ci_high").alias("ci_high"), F.col(f"_p_{c}").alias("p"))
            for c in values])))

    ranks = boot.estimates(
        boot.rank_replicates(rows, ID, SCORE, "y", resamples, SEED, by, True, True),
        {"spearman": "spearman", "c_index": "c_index"}, by)
    linear = boot.estimates(
        boot.pearson_replicates(rows, ID, SCORE, "y", resamples, SEED, by, True),
        {"pearson": "pearson"}, by)
    areas = boot.estimates(
        boot.discrimination_replicates(events, SCORE, "event", resamples, SEED, keys, sample=True),
        {"auroc": "auroc"}, keys)
    same = F.lit(None).cast("string")
    return union([
        long(ranks, same, spearman=assoc.correlation_p(F.col("spearman"), F.col("n")), c_index=none),
        long(linear, same, pearson=assoc.correlation_p(F.col("pearson"), F.col("n"))),
        long(areas, F.col("metric"), auroc=none)])


# --- subgroups ---------------------------------------------------------------------

def subgroup_rows(df: DataFrame) -> DataFrame:
    """Labelled efficiency rows, once per subgroup variable, with the level's name."""
    cohort = labelled_efficiency(df)
    columns = [v for v, _ in config.SUBGROUPS.values()]
    entries = []
    for name, (column, levels) in config.SUBGROUPS.items():
        label = F.lit(None).cast("string")
        for code, text in levels.items():
            label = F.when(F.col(column).cast("string") == code, F.lit(text)).otherwise(label)
        entries.append(F.struct(F.lit(name).alias("subgroup"), label.alias("level")))
    return (cohort.select(ID, SCORE, EFF24, "low_q20", *columns)
            .select(ID, SCORE, EFF24, "low_q20", F.inline(F.array(*entries)))
            .filter(F.col("level").isNotNull()))


def level_metrics(panel: str, rows: DataFrame, by: list[str], metrics: Metrics,
                  min_n: int = 30) -> DataFrame:
    """rho and AUROC with intervals per level; small levels are left out.

    AUROC needs more than five events and five non-events.
    """
    rho = metrics.rho(panel, rows, EFF24, by).filter(F.col("n") >= min_n)
    auc = metrics.areas(panel, rows, "low_q20", by)
    enough = (F.col("events") > 5) & (F.col("events") < F.col("n") - 5)
    area = only_if(enough, ["auroc", "auroc_ci_low", "auroc_ci_high"])
    return rho.join(auc.select(*by, "events", *[c.alias(n) for n, c in area.items()]), by)


def subgroup_analysis(df: DataFrame, metrics: Metrics = DIRECT) -> DataFrame:
    return level_metrics("subgroups", subgroup_rows(df), ["subgroup", "level"], metrics)


def interaction_tests(df: DataFrame, min_n: int = 30) -> DataFrame:
    """Difference of the two levels' correlations per subgroup variable."""
    points = spearman(subgroup_rows(df), SCORE, EFF24, ["subgroup", "level"])
    points = points.filter(F.col("n") >= min_n)
    firsts = [next(iter(levels.values())) for _, levels in config.SUBGROUPS.values()]
    is_first = F.col("level").isin(firsts)

    def side(column: str, test: Column) -> Column:
        return F.max(F.when(test, F.col(column)))

    pairs = points.groupBy("subgroup").agg(
        side("rho", is_first).alias("rho_1"), side("n", is_first).alias("n_1"),
        side("rho", ~is_first).alias("rho_2"), side("n", ~is_first).alias("n_2"))
    z, p = assoc.fisher_z(F.col("rho_1"), F.col("n_1"), F.col("rho_2"), F.col("n_2"))
    return pairs.dropna(subset=["rho_1", "rho_2"]).select(
        "subgroup", "rho_1", "n_1", "rho_2", "n_2",
        (F.col("rho_1") - F.col("rho_2")).alias("delta"), z.alias("z"), p.alias("p"))


def phenotype_rows(df: DataFrame) -> DataFrame:
    cohort = labelled_efficiency(df)
    return (cohort.filter(F.col("hf_phenotype").isin(config.PHENOTYPES))
            .select(ID, SCORE, EFF24, "low_q20", F.col("hf_phenotype").alias("level")))


def phenotype_subgroups(df: DataFrame, metrics: Metrics = DIRECT) -> DataFrame:
    return level_metrics("phenotypes", phenotype_rows(df), ["level"], metrics)


def forest_rows(df: DataFrame) -> DataFrame:
    """All forest levels as one long frame: overall, subgroup levels, phenotypes."""
    keep = [ID, SCORE, EFF24]
    overall = efficiency_cohort(df).select(*keep, F.lit("Overall").alias("level"))
    return union([overall, subgroup_rows(df).select(*keep, "level"),
                  phenotype_rows(df).select(*keep, "level")])


def forest_order(level: Column) -> Column:
    names = ["Overall"]
    for _, levels in config.SUBGROUPS.values():
        names += levels.values()
    return level_order(level, names + config.PHENOTYPES)


def forest_table(df: DataFrame, min_n: int = 30, metrics: Metrics = DIRECT) -> DataFrame:
    """Overall first, then every level in its given order: n, rho, interval."""
    table = metrics.rho("forest", forest_rows(df), EFF24, ["level"])
    return (table.filter(F.col("n") >= min_n)
            .select(forest_order(F.col("level")).cast("int").alias("position"), "level", "n",
                    "rho", "rho_ci_low", "rho_ci_high")
            .orderBy("position"))


def rank_by_strength(df: DataFrame, min_n: int = 30) -> DataFrame:
    """Subgroup levels by falling strength of the correlation."""
    points = spearman(subgroup_rows(df), SCORE, EFF24, ["subgroup", "level"])
    points = points.filter(F.col("n") >= min_n)
    return points.select("subgroup", "level", "n", "rho",
                         strength("correlation", F.col("rho")).alias("strength")).orderBy(
        F.round(F.abs("rho"), 9).desc(), "subgroup", "level")


# --- sensitivity -------------------------------------------------------------------

def scenario_rows(df: DataFrame) -> DataFrame:
    """Efficiency rows once per alternative cohort, labelled by the primary threshold."""
    cohort = labelled_efficiency(df)
    tests = {
        "primary": F.lit(True),
        "exclude_ckd": F.col("chronic_advanced_ckd") == 0,
        "exclude_outliers": F.col("below_p99") == 1,
        "exclude_shock": F.col("cardiogenic_shock") == 0,
        "complete_ef": F.col("lvef").isNotNull(),
    }
    return with_membership(cohort, tests, "scenario").select(
        ID, SCORE, EFF24, "low_q20", "low_q25", "scenario")


def sensitivity_runs(df: DataFrame, min_n: int = 50, metrics: Metrics = DIRECT) -> DataFrame:
    """rho and AUROC per alternative cohort and their change from the primary one."""
    rows, by = scenario_rows(df), ["scenario"]
    area = ["events", "auroc", "auroc_ci_low", "auroc_ci_high"]
    runs = metrics.rho("scenarios", rows, EFF24, by).join(
        metrics.areas("scenarios", rows, "low_q20", by).select(*by, *area), by)
    return with_deltas(runs.withColumns(only_if(
        F.col("n") >= min_n, ["rho", "p", "rho_ci_low", "rho_ci_high", *area])))


def sensitivity_quarter(df: DataFrame, min_n: int = 50, metrics: Metrics = DIRECT) -> DataFrame:
    """Events, AUROC and interval for the lowest quarter per alternative cohort."""
    columns = ["events", "auroc", "auroc_ci_low", "auroc_ci_high"]
    out = metrics.areas("scenarios_quarter", scenario_rows(df), "low_q25", ["scenario"])
    return out.select("scenario", "n", *columns).withColumns(
        only_if(F.col("n") >= min_n, columns))


def with_deltas(metrics: DataFrame) -> DataFrame:
    """Adds the change of rho and AUROC from the primary scenario (a few rows)."""
    primary = metrics.filter(F.col("scenario") == "primary")
    return metrics.withColumns({
        "delta_rho": F.col("rho") - primary.select("rho").scalar(),
        "delta_auroc": F.col("auroc") - primary.select("auroc").scalar()})


def efficiency_thresholds(df: DataFrame) -> DataFrame:
    """Efficiency rows once per quantile threshold, with that threshold's label."""
    cohort = efficiency_cohort(df).select(ID, SCORE, EFF24)
    names = {f"q{int(round(q * 100))}": q for q in config.EFFICIENCY_QUANTILES}
    limits = quantiles(cohort, EFF24, names)
    # one struct holds all thresholds: a single scalar subquery
    packed = limits.select(F.struct(*names).alias("t")).scalar()
    options = F.array(*[
        F.struct(F.lit(q).alias("quantile"), F.col(f"_t.{n}").alias("threshold"),
                 F.when(F.col(EFF24) <= F.col(f"_t.{n}"), 1).otherwise(0).alias("event"))
        for n, q in names.items()])
    return cohort.withColumn("_t", packed).select(ID, SCORE, F.inline(options))


def threshold_rows(df: DataFrame) -> DataFrame:
    """Rows once per efficiency quantile and per output limit: kind, setting, threshold, event."""
    eff = efficiency_thresholds(df).select(
        ID, SCORE, F.lit("efficiency").alias("kind"), "threshold",
        F.col("quantile").alias("setting"), "event")
    volume = F.col("urine_output_24h_ml")
    options = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(t)).alias("setting"),
                 F.when(volume <= t, 1).otherwise(0).alias("event"))
        for t in config.OUTPUT_LIMITS_ML])
    low = (df.filter(F.col("icu_stay_ge_24h") == 1)
           .select(ID, SCORE, F.lit("output").alias("kind"), F.inline(options)))
    return union([eff, low])


def threshold_sweep(df: DataFrame, metrics: Metrics = DIRECT) -> DataFrame:
    """Events, prevalence and AUROC at each efficiency quantile and output limit."""
    rows, by = threshold_rows(df), ["kind", "setting"]
    area = metrics.areas("thresholds", rows, "event", by).select(
        *by, "n", "events", "auroc", "auroc_ci_low", "auroc_ci_high")
    limits = rows.groupBy(*by).agg(F.max("threshold").alias("threshold"))
    return area.join(limits, by).withColumn(
        "prevalence", F.col("events") * 100 / F.col("n").cast("double"))


def robustness_spread(df: DataFrame) -> DataFrame:
    """Largest minus smallest point estimate over scenarios and over thresholds.

    The kidney-disease scenario stays out: it narrows the score's own range.
    """
    rows = scenario_rows(df).filter(
        F.col("scenario").isin("exclude_outliers", "exclude_shock", "complete_ef"))
    rho = spearman(rows, SCORE, EFF24, ["scenario"]).select(F.col("rho").alias("v"))
    auc = discrimination(rows, SCORE, "low_q20", ["scenario"])
    sweep = discrimination(efficiency_thresholds(df), SCORE, "event", ["quantile"])

    def spread(frame: DataFrame, value: str, name: str) -> DataFrame:
        return frame.agg((F.max(value) - F.min(value)).alias("spread")).select(
            F.lit(name).alias("measure"), "spread")

    return union([spread(rho, "v", "rho"), spread(auc, "auroc", "auroc"),
                  spread(sweep, "auroc", "auroc_thresholds")])


# --- outcome panels ----------------------------------------------------------------

def binary_rows(df: DataFrame, outcomes: list[str] = config.BINARY_OUTCOMES) -> DataFrame:
    long = unpivot(df.dropna(subset=[SCORE, RISK]), [ID, SCORE, RISK], outcomes, "string",
                   "outcome", "event")
    return long.withColumn("event", coerce_flag(F.col("event"))).dropna(subset=["event"])


def binary_outcome_panel(df: DataFrame, metrics: Metrics = DIRECT) -> DataFrame:
    """Per outcome: n, events, prevalence, AUROC, rate per risk level, test, ratio."""
    rows, by = binary_rows(df), ["outcome"]
    auc = metrics.areas("binary", rows, "event", by).drop("auprc", "auprc_ci_low", "auprc_ci_high")
    enough = ((F.col("n") >= 50) & (F.col("events") > 10)
              & (F.col("events") < F.col("n") - 10))
    auc = auc.withColumns(only_if(enough, ["auroc", "auroc_ci_low", "auroc_ci_high"]))
    wide = rates(rows, "event", ["outcome", RISK]).groupBy("outcome").agg(*[
        F.max(F.when(F.col(RISK) == level, F.col("rate"))).alias(f"rate_{level.lower()}")
        for level in config.RISK_LEVELS])
    tests = assoc.chi_square(rows, RISK, "event", by).select("outcome", "chi2", "p")
    return auc.join(wide, by).join(tests, by).withColumns({
        "prevalence": F.col("events") * 100 / F.col("n").cast("double"),
        "ratio_high_low": F.when(F.col("rate_low") > 0,
                                 F.col("rate_high") / F.col("rate_low"))})


def stay_rows(df: DataFrame) -> DataFrame:
    """One row per stay and length measure: outcome, days."""
    return unpivot(df.dropna(subset=[SCORE, RISK]), [ID, SCORE, RISK],
                   config.STAY_LENGTHS, "double", "outcome", "days").dropna(subset=["days"])


def continuous_outcome_panel(df: DataFrame, metrics: Metrics = DIRECT) -> DataFrame:
    """Stay lengths: rho with interval, rank test, summary per risk level."""
    rows, by = stay_rows(df), ["outcome"]
    rho = metrics.rho("stays", rows, "days", by).withColumnRenamed("n", "n_all")
    test = assoc.kruskal_wallis(rows, RISK, "days", by).select(
        "outcome", "h", F.col("p").alias("p_kruskal"))
    levels = describe(rows, "days", ["outcome", RISK]).select(
        "outcome", RISK, "n", "median", "q1", "q3", "mean", "sd")
    return levels.join(rho, by).join(test, by)


def mortality_rows(df: DataFrame) -> DataFrame:
    """All stays, and those with and without shock, as cohorts of the death outcome."""
    tests = {"all": F.lit(True), "shock": F.col("cardiogenic_shock") == 1,
             "no_shock": F.col("cardiogenic_shock") == 0}
    return with_membership(df, tests, "cohort").select(ID, SCORE, "hospital_expire_flag", "cohort")


def mortality_panel(df: DataFrame, metrics: Metrics = DIRECT) -> DataFrame:
    """AUROC and AUPRC overall and by shock, with the threshold statistics.

    Shock groups need more than ten deaths and both outcomes.
    """
    out = event_panel("mortality", mortality_rows(df), "hospital_expire_flag", ["cohort"], metrics)
    enough = (F.col("cohort") == "all") | (
        (F.col("events") > 10) & (F.col("events") < F.col("n")))
    return out.withColumns(only_if(enough, AREAS))


def event_panel(panel: str, rows: DataFrame, event: str, by: list[str], metrics: Metrics) -> DataFrame:
    """AUROC and AUPRC with intervals, best threshold, and the stated cut, per group."""
    best = roc.youden(roc_curve(rows, SCORE, event, by), by)
    stated = roc.operating_point(rows, SCORE, event, config.HIGH_RISK_CUT, by).select(
        *by, F.col("sensitivity").alias("sensitivity_13"),
        F.col("specificity").alias("specificity_13"))
    return metrics.areas(panel, rows, event, by).join(best, by, "left").join(stated, by)


def resistance_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("icu_stay_ge_24h") == 1).withColumn("cohort", F.lit("stay_24h"))


def resistance_panel(df: DataFrame, metrics: Metrics = DIRECT) -> DataFrame:
    """The low-output outcome on stays of a full day: discrimination, cuts, high against low."""
    event, rows = "diuretic_resistance", resistance_rows(df)
    panel = event_panel("resistance", rows.select(ID, SCORE, event, "cohort"), event, ["cohort"],
                        metrics)
    ratio = rates_with_effects(rows, event).select(
        F.lit("stay_24h").alias("cohort"), "rate_low", "rate_high",
        F.col("ratio_high_low").alias("risk_ratio"), "chi2", "p")
    return panel.join(ratio, "cohort")


def rates_with_effects(df: DataFrame, event: str) -> DataFrame:
    """Event rate per risk level side by side, high against low, chi-square."""
    long = df.dropna(subset=[event, RISK]).select(RISK, F.col(event).alias("event"))
    by_risk = rates(long, "event", [RISK])
    wide = by_risk.agg(
        F.sum("n").alias("n"), F.sum("events").alias("events"),
        *[F.max(F.when(F.col(RISK) == level, F.col("rate"))).alias(f"rate_{level.lower()}")
          for level in config.RISK_LEVELS])
    test = assoc.chi_square(long, RISK, "event").select(F.struct("chi2", "p").alias("t"))
    wide = wide.withColumns(effect_ratios(F.col("rate_low"), F.col("rate_high")))
    return (wide.withColumn("_t", test.scalar())
            .select(F.lit(event).alias("outcome"), "*", "_t.chi2", "_t.p").drop("_t"))


def component_roc(df: DataFrame) -> DataFrame:
    """AUROC of the score and of its raw laboratory components for the lowest fifth."""
    cohort = labelled_efficiency(df)
    rows = unpivot(cohort, [ID, "low_q20"], [SCORE, "creatinine", "bun", "ntprobnp"],
                   "double", "predictor", "value")
    out = roc.discrimination(rows, "value", "low_q20", ["predictor"])
    return out.filter(F.col("n") >= 10).select("predictor", "n", "events", "auroc")


def scatter_fit(df: DataFrame, cap: float = 200.0) -> DataFrame:
    cohort = efficiency_cohort(df).select(
        SCORE, clip_upper(F.col(EFF24), cap).alias("capped"))
    return assoc.linear_fit(cohort, SCORE, "capped")


# --- tables ------------------------------------------------------------------------

def summary_by_risk(df: DataFrame) -> DataFrame:
    """n, median, quartiles, mean and SD of efficiency per horizon and risk level."""
    both = union([
        efficiency_cohort(df, h).select(
            F.lit(f"{h}h").alias("timepoint"), RISK,
            F.col(f"diuretic_efficiency_{h}h").alias("value"))
        for h in (24, 72)])
    return describe(both, "value", ["timepoint", RISK]).select(
        "timepoint", RISK, "n", "median", "q1", "q3", "mean", "sd")


def table_rows(df: DataFrame, group: Column) -> DataFrame:
    male = recode(F.col("gender"), {"M": 1, "MALE": 1, "MAN": 1}, 0)
    return df.withColumn("male_sex", male).withColumn("group", group)


def with_overall(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Counts per ``keys`` (one of them the group), and those of all groups together."""
    both = union([counts, counts.withColumn("group", F.lit("Overall"))])
    return both.groupBy(*keys).agg(F.sum(n).alias(n))


def baseline_continuous(df: DataFrame, group: Column) -> DataFrame:
    """Per numeric variable and group (and overall): all summary statistics.

    The rows are counted once, per group; the whole cohort is the sum of its groups.
    """
    variables, by = config.BASELINE_MEAN + config.BASELINE_MEDIAN, ["variable", "group"]
    long = unpivot(table_rows(df, group), ["group"], variables, "double")
    sizes = with_overall(long.groupBy(*by).agg(
        F.sum(F.col("value").isNull().cast("int")).alias("n_missing")), by, "n_missing")
    cells = long.filter(F.col("value").isNotNull()).groupBy(*by, "value").agg(
        F.count("*").alias("n"))
    stats = describe(with_overall(cells, [*by, "value"], "n"), "value", by, weight="n").select(
        "variable", "group", "n", "mean", "sd", "median", "q1", "q3")
    return sizes.join(stats, by, "left")


def baseline_tests(df: DataFrame, group: Column, first: str, groups: int) -> DataFrame:
    """p per variable: means by t test or F test, medians by rank test, counts by chi-square."""
    rows = table_rows(df, group)
    means = unpivot(rows, ["group"], config.BASELINE_MEAN, "double").dropna()
    medians = unpivot(rows, ["group"], config.BASELINE_MEDIAN, "double").dropna()
    counts = unpivot(rows, ["group"], config.BASELINE_CATEGORICAL, "string").dropna()
    by = ["variable"]
    if groups == 2:
        mean = assoc.t_test(means, "group", "value", first, by).select(
            "variable", F.lit("t").alias("test"), "p")
        rank = assoc.mann_whitney(medians, "group", "value", first, by).select(
            "variable", F.lit("mann_whitney").alias("test"), "p")
    else:
        mean = assoc.anova_f(means, "group", "value", by).select(
            "variable", F.lit("anova").alias("test"), "p")
        rank = assoc.kruskal_wallis(medians, "group", "value", by).select(
            "variable", F.lit("kruskal_wallis").alias("test"), "p")
    chi = assoc.chi_square(counts, "group", "value", by).select(
        "variable", F.lit("chi_square").alias("test"), "p")
    return union([mean, rank, chi])


def baseline_categorical(df: DataFrame, group: Column) -> DataFrame:
    """Per categorical variable, level and group (and overall): n and percent."""
    rows = table_rows(df, group)
    long = unpivot(rows, ["group"], config.BASELINE_CATEGORICAL, "string").dropna()
    keys = ["variable", "group", "value"]
    counts = with_overall(long.groupBy(*keys).agg(F.count("*").alias("n")), keys, "n")
    totals = counts.groupBy("variable", "group").agg(F.sum("n").alias("_t"))
    return counts.join(totals, ["variable", "group"]).select(
        "variable", "group", F.col("value").alias("level"), "n",
        (F.col("n") * 100 / F.col("_t").cast("double")).alias("percent"))


MORTALITY_GROUP = ("Survivors", "Non-survivors")


def mortality_group() -> Column:
    return F.when(F.col("hospital_expire_flag") == 1, MORTALITY_GROUP[1]).otherwise(
        MORTALITY_GROUP[0])


def baseline_table(df: DataFrame, by: str = "mortality") -> DataFrame:
    """The whole baseline table in long form, by survival or by risk level.

    Columns: variable, group, level (categories only), n, missing, mean, sd, median,
    q1, q3, percent, test, p.
    """
    if by == "mortality":
        group, first, groups = mortality_group(), MORTALITY_GROUP[0], 2
    else:
        group, first, groups = F.col(RISK), config.RISK_LEVELS[0], 3
    none = F.lit(None)
    numbers = baseline_continuous(df, group).withColumns({
        "level": none.cast("string"), "percent": none.cast("double")})
    counts = baseline_categorical(df, group).withColumns({
        "n_missing": none.cast("bigint"),
        **{c: none.cast("double") for c in ("mean", "sd", "median", "q1", "q3")}})
    body = numbers.unionByName(counts)
    return body.join(baseline_tests(df, group, first, groups), "variable", "left")


def section_rows(df: DataFrame) -> DataFrame:
    """Both binary outcomes as one long frame; resistance needs a full first day."""
    resistant = F.when(F.col("icu_stay_ge_24h") == 1, F.col("diuretic_resistance"))
    return unpivot(
        df.select(ID, SCORE, RISK, resistant.alias("resistance"),
                  F.col("hospital_expire_flag").alias("mortality")),
        [ID, SCORE, RISK], ["resistance", "mortality"], "int", "section", "event").dropna()


def outcomes_table(df: DataFrame, metrics: Metrics = DIRECT) -> DataFrame:
    """Long outcome table: section, metric, level, value, interval, p; all computed."""
    columns = ["section", "metric", "level", "value", "ci_low", "ci_high", "p"]
    none = F.lit(None).cast("double")

    def shaped(frame: DataFrame, **fields: Column) -> DataFrame:
        defaults = {"level": F.lit(None).cast("string"), "ci_low": none, "ci_high": none,
                    "p": none}
        return frame.select(*[{**defaults, **fields}[c].alias(c) for c in columns])

    name = F.concat(F.lit("efficiency_"), F.col("cohort"))
    parts = [
        shaped(primary_metrics(df, [24, 72], metrics.resamples), section=name,
               metric=F.col("metric"), value=F.col("estimate"), ci_low=F.col("ci_low"),
               ci_high=F.col("ci_high"), p=F.col("p")),
        shaped(assoc.kruskal_wallis(efficiency_rows(df, [24, 72]), RISK, "y", ["cohort"]),
               section=name, metric=F.lit("kruskal_h"), value=F.col("h"), p=F.col("p"))]
    summary = summary_by_risk(df)
    parts.append(shaped(
        summary, section=F.concat(F.lit("efficiency_"), F.col("timepoint")),
        metric=F.lit("median"), level=F.col(RISK), value=F.col("median"),
        ci_low=F.col("q1"), ci_high=F.col("q3")))
    long, section, by = section_rows(df), F.col("section"), ["section"]
    parts += [
        shaped(metrics.areas("sections", long, "event", by), section=section,
               metric=F.lit("auroc"), value=F.col("auroc"), ci_low=F.col("auroc_ci_low"),
               ci_high=F.col("auroc_ci_high")),
        shaped(assoc.chi_square(long, RISK, "event", by), section=section,
               metric=F.lit("chi_square"), value=F.col("chi2"), p=F.col("p")),
        shaped(rates(long, "event", ["section", RISK]), section=section,
               metric=F.lit("rate"), level=F.col(RISK), value=F.col("rate"))]
    return union(parts)


# --- comparators and plot feeds ----------------------------------------------------

def reference_values(spark) -> DataFrame:
    return spark.createDataFrame(
        config.COMPARATORS,
        "population string, n bigint, pearson_r double, auroc_q20 double, "
        "auroc_q25 double, auroc_dr double")


def cohort_comparators(df: DataFrame) -> DataFrame:
    """metric, here: this cohort's value of every published metric."""
    cohort = labelled_efficiency(df)
    stays = df.filter(F.col("icu_stay_ge_24h") == 1)

    def one(frame: DataFrame, column: str, metric: str) -> DataFrame:
        return frame.select(F.lit(metric).alias("metric"), F.col(column).alias("here"))

    return union([
        one(assoc.pearson(cohort, SCORE, EFF24), "r", "pearson_r"),
        one(discrimination(cohort, SCORE, "low_q20"), "auroc", "auroc_q20"),
        one(discrimination(cohort, SCORE, "low_q25"), "auroc", "auroc_q25"),
        one(discrimination(stays, SCORE, "diuretic_resistance"), "auroc", "auroc_dr")])


def literature_delta(df: DataFrame) -> DataFrame:
    """Published values against this cohort's, difference in percent of magnitude."""
    here = cohort_comparators(df)
    published = unpivot(reference_values(df.sparkSession), ["population"],
                        ["pearson_r", "auroc_q20", "auroc_q25", "auroc_dr"], "double",
                        "metric", "published").dropna()
    return published.join(here, "metric").withColumn(
        "percent_difference", percent_change(F.col("here"), F.col("published")))


# the tidy frame behind every figure, built on demand
PLOT_FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "efficiency_raw": lambda df: df.select(
        "hadm_id", SCORE, RISK, EFF24, EFF72, "icu_stay_ge_24h", "icu_stay_ge_72h"),
    "efficiency_summary": summary_by_risk,
    "outcomes_by_risk": lambda df: outcomes_by_risk(df),
    "forest": forest_table,
    "interactions": interaction_tests,
    "subgroups": subgroup_analysis,
    "roc_q20": lambda df: roc_curve(
        labelled_efficiency(df), SCORE, "low_q20").select("threshold", "fpr", "tpr"),
    "score_distribution": lambda df: df.select(SCORE, RISK, "hospital_expire_flag"),
    "score_histogram": lambda df: bin_counts(df, SCORE, 1.0, [RISK]),
    "scatter": lambda df: efficiency_cohort(df).select(SCORE, EFF24, RISK),
    "comparators": literature_delta,
}


def outcomes_by_risk(df: DataFrame) -> DataFrame:
    """One row per risk level: efficiency quartiles of both horizons and event rates."""
    summary = summary_by_risk(df)
    wide = summary.groupBy(RISK).agg(*[
        F.max(F.when(F.col("timepoint") == t, F.col(c))).alias(f"eff_{t}_{c}")
        for t in ("24h", "72h") for c in ("median", "q1", "q3")])
    resistant = rates(df.filter(F.col("icu_stay_ge_24h") == 1), "diuretic_resistance",
                      [RISK]).select(RISK, F.col("rate").alias("resistance_rate"))
    deaths = rates(df, "hospital_expire_flag", [RISK]).select(
        RISK, F.col("rate").alias("mortality_rate"))
    return wide.join(resistant, RISK, "left").join(deaths, RISK, "left").withColumn(
        "position", level_order(F.col(RISK), config.RISK_LEVELS).cast("int"))


def resistance_agreement(df: DataFrame) -> DataFrame:
    """Share of rows whose stored resistance flag matches its definition."""
    stated = F.coalesce(F.col("urine_output_24h_ml") <= config.LOW_OUTPUT_ML, F.lit(False))
    return df.agg((F.avg((stated.cast("int") == F.col("diuretic_resistance")).cast("int"))
                   * 100).alias("match_percent"), F.count("*").alias("n"))

