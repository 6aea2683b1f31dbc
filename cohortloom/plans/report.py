"""The validation report: every panel's numbers as one long table.

All correlations and areas of all panels come from two stored tables, the areas and the rank
correlations, each with the panel and its groups as grouping columns. So the thousandfold work of the intervals runs once for the whole report, however
many panels a stay belongs to, and every panel is planned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators.ranks import union
from ..session import TableStore
from . import validation as val

COLUMNS = ["section", "metric", "level", "value", "ci_low", "ci_high", "p"]
#: Grouping columns of the stored tables: panel, outer group (or none), group.
KEYS = ["panel", "outer_group", "inner_group"]
#: Panels whose levels make up the forest table.
FOREST = ["overall", "subgroups", "phenotypes"]


def keyed(panel: str, rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rows of a panel in the shape all panels share: keys, id, score, value."""
    outer = F.col(by[0]).cast("string") if len(by) > 1 else F.lit("")
    return rows.select(F.lit(panel).alias("panel"), outer.alias("outer_group"),
                       F.col(by[-1]).cast("string").alias("inner_group"),
                       val.ID, val.SCORE, F.col(value).cast("double").alias("value"))


def rank_rows(df: DataFrame) -> DataFrame:
    """Score and continuous outcome of every panel that correlates them."""
    overall = val.efficiency_cohort(df).withColumn("level", F.lit("Overall"))
    return union([
        keyed("overall", overall, val.EFF24, ["level"]),
        keyed("subgroups", val.subgroup_rows(df), val.EFF24, ["subgroup", "level"]),
        keyed("phenotypes", val.phenotype_rows(df), val.EFF24, ["level"]),
        keyed("scenarios", val.scenario_rows(df), val.EFF24, ["scenario"]),
        keyed("stays", val.stay_rows(df), "days", ["outcome"])])


def event_rows(df: DataFrame) -> DataFrame:
    """Score and binary outcome of every panel that discriminates it."""
    scenarios = val.scenario_rows(df)
    return union([
        keyed("subgroups", val.subgroup_rows(df), "low_q20", ["subgroup", "level"]),
        keyed("phenotypes", val.phenotype_rows(df), "low_q20", ["level"]),
        keyed("scenarios", scenarios, "low_q20", ["scenario"]),
        keyed("scenarios_quarter", scenarios, "low_q25", ["scenario"]),
        keyed("thresholds", val.threshold_rows(df), "event", ["kind", "setting"]),
        keyed("binary", val.binary_rows(df), "event", ["outcome"]),
        keyed("mortality", val.mortality_rows(df), "hospital_expire_flag", ["cohort"]),
        keyed("resistance", val.resistance_rows(df), "diuretic_resistance", ["cohort"]),
        keyed("sections", val.section_rows(df), "event", ["section"])]).withColumn(
        "value", F.col("value").cast("int"))


class StoredMetrics(val.Metrics):
    """Estimates of all panels from the stored tables, by panel and group."""

    def __init__(self, df: DataFrame, store: TableStore, resamples: int):
        super().__init__(resamples)
        self.area_table = store.save(
            val.areas_with_ci(event_rows(df), "value", KEYS, resamples), "report_areas")
        self.rank_table = store.save(
            val.spearman_with_ci(rank_rows(df), "value", KEYS, resamples), "report_ranks")

    @staticmethod
    def _of(table: DataFrame, panels: list[str], rows: DataFrame, by: list[str]) -> DataFrame:
        types = dict(rows.dtypes)
        names = dict(zip(["outer_group", "inner_group"][-len(by):], by, strict=True))
        return table.filter(F.col("panel").isin(panels)).select(
            *[F.col(c).cast(types[n]).alias(n) for c, n in names.items()],
            *[c for c in table.columns if c not in KEYS])

    def rho(self, panel: str, rows: DataFrame, outcome: str, by: list[str]) -> DataFrame:
        return self._of(self.rank_table, FOREST if panel == "forest" else [panel], rows, by)

    def areas(self, panel: str, rows: DataFrame, event: str, by: list[str]) -> DataFrame:
        return self._of(self.area_table, [panel], rows, by)


def number(name: str | None) -> Column:
    return F.col(name).cast("double") if name else F.lit(None).cast("double")


def shaped(frame: DataFrame, section: str, level: Column, **metrics: tuple) -> DataFrame:
    """A panel as long rows: its frame is read once, each metric is (value, low, high, p)."""
    rows = []
    for metric, columns in metrics.items():
        value, low, high, p = (*columns, *[None] * (4 - len(columns)))
        rows.append(F.struct(
            F.lit(section).alias("section"), F.lit(metric).alias("metric"),
            level.cast("string").alias("level"), number(value).alias("value"),
            number(low).alias("ci_low"), number(high).alias("ci_high"), number(p).alias("p")))
    return frame.select(F.inline(F.array(*rows)))


def validation_report(df: DataFrame, store: TableStore,
                      resamples: int = config.BOOTSTRAP_RESAMPLES) -> DataFrame:
    """section, metric, level, value, interval, p of all panels; no number is fixed."""
    found = StoredMetrics(df, store, resamples)
    rho, auroc = ("rho", "rho_ci_low", "rho_ci_high"), ("auroc", "auroc_ci_low", "auroc_ci_high")
    cohort, level = F.col("cohort"), F.concat_ws(": ", "subgroup", "level")
    risk = F.concat_ws(": ", "outcome", val.RISK)
    cuts = {"threshold": ("threshold",), "sensitivity_13": ("sensitivity_13",),
            "specificity_13": ("specificity_13",)}
    runs = val.sensitivity_runs(df, metrics=found)
    stays = val.continuous_outcome_panel(df, found)
    baseline = val.baseline_table(df)
    parts = [
        val.outcomes_table(df, found),
        shaped(baseline, "baseline", F.concat_ws(": ", "variable", "group", "level"),
               mean=("mean", None, None, "p"), sd=("sd",), median=("median", "q1", "q3"),
               percent=("percent", None, None, "p"), n=("n",), n_missing=("n_missing",))
        .filter(F.col("value").isNotNull()),
        shaped(val.subgroup_analysis(df, found), "subgroups", level, rho=(*rho, "p"), auroc=auroc),
        shaped(val.interaction_tests(df), "interaction", F.col("subgroup"),
               delta=("delta", None, None, "p")),
        shaped(val.phenotype_subgroups(df, found), "phenotypes", F.col("level"), rho=(*rho, "p"),
               auroc=auroc),
        shaped(val.forest_table(df, metrics=found), "forest", F.col("level"), rho=rho,
               position=("position",)),
        shaped(runs, "sensitivity", F.col("scenario"), rho=(*rho, "p"), auroc=auroc,
               delta_rho=("delta_rho",), delta_auroc=("delta_auroc",)),
        shaped(val.sensitivity_quarter(df, metrics=found), "sensitivity", F.col("scenario"),
               auroc_q25=auroc),
        shaped(val.threshold_sweep(df, found), "thresholds", F.concat_ws(": ", "kind", "setting"),
               auroc=auroc, threshold=("threshold",), prevalence=("prevalence",)),
        shaped(val.robustness_spread(df), "sensitivity", F.col("measure"), spread=("spread",)),
        shaped(val.mortality_panel(df, found), "mortality", cohort, auroc=auroc,
               auprc=("auprc", "auprc_ci_low", "auprc_ci_high"), **cuts),
        shaped(val.resistance_panel(df, found), "resistance", cohort, auroc=auroc,
               risk_ratio=("risk_ratio", None, None, "p"), **cuts),
        shaped(val.binary_outcome_panel(df, found), "binary outcomes", F.col("outcome"),
               auroc=(*auroc, "p"), prevalence=("prevalence",), ratio=("ratio_high_low",)),
        shaped(stays, "stay lengths", risk, median=("median", "q1", "q3"), mean=("mean",),
               rho=(*rho, "p"), h=("h", None, None, "p_kruskal")),
        shaped(val.component_roc(df), "components", F.col("predictor"), auroc=("auroc",)),
        shaped(val.scatter_fit(df), "scatter", F.lit(None), slope=("slope",),
               intercept=("intercept",)),
        shaped(val.literature_delta(df), "literature", F.concat_ws(": ", "population", "metric"),
               percent_difference=("percent_difference",)),
    ]
    return union([p.select(*COLUMNS) for p in parts])
