"""Queries that put whole panels together, with twins made of the panels' own twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import bootstrap as boot
from ..plans import cutoffs as cutoff_plan
from ..plans import report
from ..plans import validation as val
from . import stats
from . import stats_sql as s
from .base import ORACLES, Data, query, r6

STAY = "SELECT *, 'stay_24h' AS cohort FROM final WHERE icu_stay_ge_24h = 1"
EVENT = "diuretic_resistance"
R = s.rounded_select


@query("sensitivity_quarter", "SELECT scenario, n, CASE WHEN n >= 50 THEN events END AS events, "
       + ", ".join(r6(f"CASE WHEN n >= 50 THEN {c} END", c)
                   for c in ("auroc", "auroc_ci_low", "auroc_ci_high"))
       + " FROM (" + stats._metrics_sql(
           stats.SCENARIO.replace("low_q20,", "low_q20, low_q25,"), "scenario", "low_q25", "y")[1] + ")")
def sensitivity_quarter(d: Data) -> DataFrame:
    return val.sensitivity_quarter(d.analysis)


_reps = s.boot_auroc(STAY, "total_score", EVENT, "cohort")
_rate = " ".join(f"avg({EVENT}) FILTER (WHERE risk_category = '{level}') * 100 AS rate_{level.lower()},"
                 for level in ("Low", "High"))


@query("resistance_panel", "SELECT cohort, a.n, a.events, "
       + ", ".join(r6(c, c) for c in ("auroc", "auprc", "auroc_ci_low", "auroc_ci_high",
                                      "auprc_ci_low", "auprc_ci_high", "rate_low", "rate_high"))
       + ", " + ", ".join(r6(f"y.{c}", c) for c in ("threshold", "sensitivity", "specificity", "youden_j"))
       + f", {r6('o.sensitivity', 'sensitivity_13')}, {r6('o.specificity', 'specificity_13')}, "
       f"{r6('CASE WHEN rate_low > 0 THEN rate_high / rate_low END', 'risk_ratio')}, "
       f"{r6('x.chi2', 'chi2')}, {r6('x.p', 'p')} FROM "
       f"({s.auroc(STAY, 'total_score', EVENT, 'cohort')}) a "
       f"JOIN ({s.auprc(STAY, 'total_score', EVENT, 'cohort')}) USING (cohort) "
       f"JOIN ({s.interval(_reps, 'auroc', 'cohort', 'auroc_ci_low', 'auroc_ci_high')}) USING (cohort) "
       f"JOIN ({s.interval(_reps, 'auprc', 'cohort', 'auprc_ci_low', 'auprc_ci_high')}) USING (cohort) "
       f"JOIN ({s.youden(STAY, 'total_score', EVENT, 'cohort')}) y USING (cohort) "
       f"JOIN ({s.operating_point(STAY, 'total_score', EVENT, 13, 'cohort')}) o USING (cohort) "
       f"JOIN ({s.chi_square(STAY, 'risk_category', EVENT, 'cohort')}) x USING (cohort) "
       f"JOIN (SELECT {_rate} 'stay_24h' AS cohort FROM ({STAY})) USING (cohort)")
def resistance_panel(d: Data) -> DataFrame:
    return val.resistance_panel(d.analysis)


_ALL_BANDS = stats._BANDED.replace("FROM lab24", "FROM final")
_MORTALITY = ("SELECT * FROM (" + s.chi_square(
    _ALL_BANDS.format(cols="hospital_expire_flag"), "band", "hospital_expire_flag", "low, high")
    + ") WHERE dof = 2")


@query("cutoff_chi2_mortality", R(stats._best(_MORTALITY, "chi2"), ["low", "high", "n", "dof"],
                                  ["chi2", "p"]))
def cutoff_chi2_mortality(d: Data) -> DataFrame:
    return cutoff_plan.mortality_cutoffs(d.analysis)


_CUTS = ", ".join(f"('{name}', {float(low)}::DOUBLE, {float(high + 1)}::DOUBLE)"
                  for name, (low, high) in config.RISK_FRAMEWORKS.items())
_TESTED = " UNION ALL ".join(
    f"SELECT DISTINCT 'scheme ' || framework, low, high, '{outcome}', {stat}, p "
    f"FROM ({ORACLES[key]}) JOIN (VALUES {_CUTS}) AS v(framework, low, high) USING (framework) {where}"
    for key, outcome, stat, where in (
        ("framework_comparison", "continuous", "h", "WHERE timepoint = '24h'"),
        ("framework_mortality", "mortality", "chi2", "")))


@query("cutoff_derivation", f"SELECT method, {r6('low', 'low')}, {r6('high', 'high')}, outcome, "
       f"CAST(NULL AS DOUBLE) AS statistic, CAST(NULL AS DOUBLE) AS p FROM ({stats._SUMMARY_CUTS}) UNION ALL "
       f"SELECT 'chi_square', low, high + 1, 'mortality', NULL, NULL FROM ({stats._best(_MORTALITY, 'chi2')}) "
       f"UNION ALL {_TESTED}")
def cutoff_derivation(d: Data) -> DataFrame:
    return cutoff_plan.cutoff_derivation(d.analysis)


#: The death rate as a metric of a caller's own: weighted deaths over weights.
DEATH_RATE = boot.Metric(
    ("hospital_expire_flag",), 2,
    lambda columns, w: np.stack([columns["hospital_expire_flag"] @ w, w.sum(axis=0)]),
    lambda cells, states: {"value": np.divide(
        states[0, 0], states[0, 1], out=np.full(states.shape[2], np.nan), where=states[0, 1] > 0)})


_RATE = ("SELECT risk_category, b, sum(hospital_expire_flag * w) / CAST(nullif(sum(w), 0) AS DOUBLE) AS value FROM ("
         + s.replicates("SELECT * FROM final WHERE hospital_expire_flag IS NOT NULL AND risk_category IS NOT NULL",
                        "risk_category, hospital_expire_flag") + ") GROUP BY 1, 2")


@query("metric_callback", R(s.interval(_RATE, "value", "risk_category"), ["risk_category", "n_valid"],
                            ["ci_low", "ci_high"]))
def metric_callback(d: Data) -> DataFrame:
    """The bootstrap with a metric handed in: the death rate per risk level."""
    return boot.bootstrap(d.analysis, DEATH_RATE, val.ID, config.BOOTSTRAP_RESAMPLES,
                          config.BOOTSTRAP_SEED, [val.RISK])


_REFERENCE = " UNION ALL ".join(
    f"SELECT '{name}' AS population, {n} AS n, " + ", ".join(
        f"{'NULL' if v is None else v}::DOUBLE AS {c}" for c, v in
        zip(("pearson_r", "auroc_q20", "auroc_q25", "auroc_dr"), values, strict=True))
    for name, n, *values in config.COMPARATORS)


_METRICS = ("pearson_r", "auroc_q20", "auroc_q25", "auroc_dr")
_HERE_WIDE = ", ".join(f"max(here) FILTER (WHERE metric = '{m}') AS {m}_here" for m in _METRICS)


@query("reference_values", f"SELECT r.*, m.n AS n_here, {', '.join(r6(f'{m}_here', f'{m}_here') for m in _METRICS)} "
       f"FROM ({_REFERENCE}) r CROSS JOIN (SELECT count(*) AS n FROM final) m "
       f"CROSS JOIN (SELECT {_HERE_WIDE} FROM ({stats._HERE})) h")
def reference_values(d: Data) -> DataFrame:
    """Published comparators beside the size and the metrics of this cohort."""
    here = d.analysis.agg(F.count("*").alias("n"))
    metrics = val.cohort_comparators(d.analysis).agg(*[
        F.max(F.when(F.col("metric") == m, F.col("here"))).alias(f"{m}_here") for m in _METRICS])
    packed = metrics.select(F.struct("*").alias("m")).scalar()
    return val.reference_values(d.spark).withColumn("n_here", here.scalar()).withColumn(
        "_m", packed).select("*", "_m.*").drop("_m")


@query("plot_feed_distribution", "SELECT total_score, risk_category, hospital_expire_flag FROM final")
def plot_feed_distribution(d: Data) -> DataFrame:
    return val.PLOT_FEEDS["score_distribution"](d.analysis)


def _part(key: str, section: str, level: str, where: str = "", **metrics: tuple) -> str:
    """A panel's twin as long rows, each metric as (value, low, high, p)."""
    parts = []
    for metric, columns in metrics.items():
        value, low, high, p = (*columns, *["NULL"] * (4 - len(columns)))
        parts.append(
            f"SELECT '{section}' AS section, '{metric}' AS metric, {level} AS level, "
            f"CAST({value} AS DOUBLE) AS value, CAST({low} AS DOUBLE) AS ci_low, "
            f"CAST({high} AS DOUBLE) AS ci_high, CAST({p} AS DOUBLE) AS p FROM panel")
    return (f"SELECT * FROM (WITH panel AS MATERIALIZED ({ORACLES[key]}) "
            f"{' UNION ALL '.join(parts)}) {where}")


_SUB, _RISK = "subgroup || ': ' || level", "outcome || ': ' || risk_category"
_RHO, _AUROC = ("rho", "rho_ci_low", "rho_ci_high"), ("auroc", "auroc_ci_low", "auroc_ci_high")
_CUT = {c: (c,) for c in ("threshold", "sensitivity_13", "specificity_13")}
_REPORT = " UNION ALL ".join([
    f"SELECT section, metric, level, value, ci_low, ci_high, p FROM ({ORACLES['outcomes_table']})",
    _part("baseline_table", "baseline", "concat_ws(': ', variable, \"group\", level)",
          "WHERE value IS NOT NULL", mean=("mean", "NULL", "NULL", "p"), sd=("sd",),
          median=("median", "q1", "q3"), percent=("percent", "NULL", "NULL", "p"), n=("n",),
          n_missing=("n_missing",)),
    _part("subgroup_analysis", "subgroups", _SUB, rho=(*_RHO, "p"), auroc=_AUROC),
    _part("interaction_tests", "interaction", "subgroup", delta=("delta", "NULL", "NULL", "p")),
    _part("phenotype_subgroups", "phenotypes", "level", rho=(*_RHO, "p"), auroc=_AUROC),
    _part("forest_table", "forest", "level", rho=_RHO, position=("position",)),
    _part("sensitivity_runs", "sensitivity", "scenario", rho=(*_RHO, "p"), auroc=_AUROC,
          delta_rho=("delta_rho",), delta_auroc=("delta_auroc",)),
    _part("sensitivity_quarter", "sensitivity", "scenario", auroc_q25=_AUROC),
    _part("threshold_sweep", "thresholds", "kind || ': ' || setting", auroc=_AUROC,
          threshold=("threshold",), prevalence=("prevalence",)),
    _part("robustness_spread", "sensitivity", "measure", spread=("spread",)),
    _part("mortality_panel", "mortality", "cohort", auroc=_AUROC,
          auprc=("auprc", "auprc_ci_low", "auprc_ci_high"), **_CUT),
    _part("resistance_panel", "resistance", "cohort", auroc=_AUROC,
          risk_ratio=("risk_ratio", "NULL", "NULL", "p"), **_CUT),
    _part("binary_outcome_panel", "binary outcomes", "outcome", auroc=(*_AUROC, "p"),
          prevalence=("prevalence",), ratio=("ratio_high_low",)),
    _part("continuous_outcome_panel", "stay lengths", _RISK, median=("median", "q1", "q3"),
          mean=("mean",), rho=(*_RHO, "p"), h=("h", "NULL", "NULL", "p_kruskal")),
    _part("component_roc", "components", "predictor", auroc=("auroc",)),
    _part("linear_fit", "scatter", "CAST(NULL AS VARCHAR)", slope=("slope",), intercept=("intercept",)),
    _part("literature_delta", "literature", "population || ': ' || metric",
          percent_difference=("percent_difference",)),
])


@query("validation_report", _REPORT)
def validation_report(d: Data) -> DataFrame:
    return report.validation_report(d.analysis, d.store)
