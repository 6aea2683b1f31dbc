"""Statistical operators, cut-off derivation and validation panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import tails
from ..functions.numeric import strength
from ..operators import association as assoc
from ..operators import cutoffs as cut
from ..operators import roc
from ..operators.ranks import union
from ..plans import cutoffs as cutoff_plan
from ..plans import validation as val
from . import stats_sql as s
from .base import Data, query, r6

SCORE, EFF24, EFF72, RISK = val.SCORE, val.EFF24, val.EFF72, val.RISK
R = s.rounded_select

# long helper sources in SQL
E24 = "SELECT *, '24h' AS cohort FROM lab24"
E72 = "SELECT *, '72h' AS cohort FROM lab72"
EBOTH = ("SELECT stay_id, total_score, risk_category, y, low_q20, low_q25, '24h' AS cohort FROM lab24 "
         "UNION ALL SELECT stay_id, total_score, risk_category, y, low_q20, low_q25, '72h' FROM lab72")
ALL = "SELECT *, 'all' AS cohort FROM final"
SUBGROUP = " UNION ALL ".join(
    f"SELECT stay_id, total_score, y, low_q20, '{name}' AS subgroup, '{text}' AS level "
    f"FROM lab24 WHERE CAST({column} AS VARCHAR) = '{code}'"
    for name, (column, levels) in config.SUBGROUPS.items() for code, text in levels.items())
PHENOTYPE = ("SELECT stay_id, total_score, y, low_q20, hf_phenotype AS level FROM lab24 "
             "WHERE hf_phenotype IN ('HFrEF', 'HFmrEF', 'HFpEF')")
SCENARIO = " UNION ALL ".join(
    f"SELECT stay_id, total_score, y, low_q20, '{name}' AS scenario FROM lab24 WHERE {test}"
    for name, test in {
        "primary": "TRUE", "exclude_ckd": "chronic_advanced_ckd = 0",
        "exclude_outliers": "y <= (SELECT quantile_cont(y, 0.99) FROM lab24)",
        "exclude_shock": "cardiogenic_shock = 0",
        "complete_ef": "lvef IS NOT NULL"}.items())
EFF_SWEEP = " UNION ALL ".join(
    f"SELECT stay_id, total_score, 'efficiency' AS kind, {q}::DOUBLE AS setting, "
    f"(SELECT quantile_cont(y, {q}) FROM lab24) AS threshold, "
    f"CASE WHEN y <= (SELECT quantile_cont(y, {q}) FROM lab24) THEN 1 ELSE 0 END AS event FROM lab24"
    for q in config.EFFICIENCY_QUANTILES)
OUT_SWEEP = " UNION ALL ".join(
    f"SELECT stay_id, total_score, 'output' AS kind, {t}::DOUBLE AS setting, {t}::DOUBLE AS threshold, "
    f"CASE WHEN urine_output_24h_ml <= {t} THEN 1 ELSE 0 END AS event FROM final WHERE icu_stay_ge_24h = 1"
    for t in config.OUTPUT_LIMITS_ML)
BINARY = " UNION ALL ".join(
    f"SELECT stay_id, total_score, risk_category, '{o}' AS outcome, {o} AS event FROM final"
    for o in config.BINARY_OUTCOMES)
STAYS = " UNION ALL ".join(
    f"SELECT stay_id, total_score, risk_category, '{o}' AS outcome, {o} AS days FROM final"
    for o in config.STAY_LENGTHS)
SHOCK = ("SELECT *, 'all' AS cohort FROM final UNION ALL SELECT *, 'shock' FROM final WHERE cardiogenic_shock = 1 "
         "UNION ALL SELECT *, 'no_shock' FROM final WHERE cardiogenic_shock = 0")
FRAMES = " UNION ALL ".join(
    f"SELECT *, '{name}' AS framework, CASE WHEN total_score <= {low} THEN 'Low' "
    f"WHEN total_score <= {high} THEN 'Moderate' ELSE 'High' END AS level FROM {{src}}"
    for name, (low, high) in config.RISK_FRAMEWORKS.items())


def _eff(d: Data, hours: int = 24) -> DataFrame:
    return cutoff_plan.labelled_efficiency(d.analysis, hours)


def _both(d: Data) -> DataFrame:
    """24 h and 72 h efficiency rows in one long frame."""
    return val.efficiency_rows(d.analysis, [24, 72])


# --- association -------------------------------------------------------------------

@query("spearman", R(s.spearman(EBOTH, "total_score", "y", "cohort"), ["cohort", "n"], ["rho", "p"]))
def spearman(d: Data) -> DataFrame:
    return val.spearman(_both(d), SCORE, "y", ["cohort"])


@query("spearman_events", R(s.spearman(
    "SELECT itemid, CAST(hour(charttime) AS INTEGER) AS hr, value FROM outputevents",
    "hr", "value", "itemid"), ["itemid", "n"], ["rho", "p"]))
def spearman_events(d: Data) -> DataFrame:
    events = d.table("outputevents").withColumn("hr", F.hour("charttime"))
    return assoc.spearman(events, "hr", "value", ["itemid"])


@query("pearson", R(s.pearson(EBOTH, "total_score", "y", "cohort"), ["cohort", "n"], ["r", "p"]))
def pearson(d: Data) -> DataFrame:
    return assoc.pearson(_both(d), SCORE, "y", ["cohort"])


@query("c_index", R(s.c_index(EBOTH, "total_score", "y", "cohort"), ["cohort", "n"],
                    ["permissible", "c_index"]))
def c_index(d: Data) -> DataFrame:
    return assoc.c_index(_both(d), SCORE, "y", config.SCORE_BITS, ["cohort"])


# --- discrimination ----------------------------------------------------------------

@query("auroc", R(s.auroc(EBOTH, "total_score", "low_q20", "cohort"), ["cohort", "n", "events"],
                  ["auroc"]))
def auroc(d: Data) -> DataFrame:
    return val.discrimination(_both(d), SCORE, "low_q20", ["cohort"]).drop("auprc")


@query("auroc_continuous", R(s.auroc(
    "SELECT hospital_expire_flag, a.hadm_id, bun, first_careunit FROM chemistry c JOIN admissions a ON a.hadm_id = c.hadm_id "
    "JOIN icustays i ON i.hadm_id = a.hadm_id", "bun", "hospital_expire_flag", "first_careunit"),
    ["first_careunit", "n", "events"], ["auroc"]))
def auroc_continuous(d: Data) -> DataFrame:
    from ..plans.funnel import stays_with_admission

    labs = d.table("chemistry", "hadm_id", "bun").join(
        stays_with_admission(d.src).select("hadm_id", "first_careunit", "hospital_expire_flag"),
        "hadm_id")
    return roc.discrimination(labs, "bun", "hospital_expire_flag", ["first_careunit"]).drop("auprc")


@query("auprc", R(s.auprc(ALL, "total_score", "hospital_expire_flag", "cohort"), ["cohort"], ["auprc"]))
def auprc(d: Data) -> DataFrame:
    rows = d.analysis.withColumn("cohort", F.lit("all"))
    return val.discrimination(rows, SCORE, "hospital_expire_flag", ["cohort"]).select(
        "cohort", "auprc")


@query("roc_curve", R(s.roc_points(E24, "total_score", "low_q20", "cohort"),
                      ["cohort", "tp", "fp", "p_total", "q_total"], ["threshold", "tpr", "fpr"]))
def roc_curve(d: Data) -> DataFrame:
    rows = _eff(d).withColumn("cohort", F.lit("24h"))
    return val.roc_curve(rows, SCORE, "low_q20", ["cohort"], min_rows=10)


@query("plot_feed_roc", R(s.roc_points(E24, "total_score", "low_q20", "cohort"), [],
                          ["threshold", "tpr", "fpr"]))
def plot_feed_roc(d: Data) -> DataFrame:
    return val.PLOT_FEEDS["roc_q20"](d.analysis)


@query("youden", R(s.youden(EBOTH, "total_score", "low_q20", "cohort"), ["cohort"],
                   ["threshold", "sensitivity", "specificity", "youden_j"]))
def youden(d: Data) -> DataFrame:
    return roc.youden(val.roc_curve(_both(d), SCORE, "low_q20", ["cohort"]), ["cohort"])


@query("argmax_row", R(s.youden(ALL, "total_score", "hospital_expire_flag", "cohort"), [],
                       ["threshold", "sensitivity", "specificity", "youden_j"]))
def argmax_row(d: Data) -> DataFrame:
    return roc.youden(val.roc_curve(d.analysis, SCORE, "hospital_expire_flag"))


@query("operating_point", R(s.operating_point(SHOCK, "total_score", "hospital_expire_flag", 13, "cohort"),
                            ["cohort", "13.0::DOUBLE AS cut"], ["sensitivity", "specificity"]))
def operating_point(d: Data) -> DataFrame:
    tests = {"all": F.lit(True), "shock": F.col("cardiogenic_shock") == 1,
             "no_shock": F.col("cardiogenic_shock") == 0}
    rows = val.with_membership(d.analysis, tests, "cohort")
    return roc.operating_point(rows, SCORE, "hospital_expire_flag", 13, ["cohort"])


# --- tests -------------------------------------------------------------------------

@query("kruskal_wallis", R(s.kruskal(EBOTH, "risk_category", "y", "cohort"), ["cohort", "n", "groups"],
                           ["h", "p"]))
def kruskal_wallis(d: Data) -> DataFrame:
    return assoc.kruskal_wallis(_both(d), RISK, "y", ["cohort"])


@query("chi_square", R(s.chi_square(BINARY, "risk_category", "event", "outcome"),
                       ["outcome", "n", "dof"], ["chi2", "p"]))
def chi_square(d: Data) -> DataFrame:
    return assoc.chi_square(val.binary_rows(d.analysis), RISK, "event", ["outcome"])


@query("chi_square_yates", R(s.chi_square(BINARY.replace("risk_category", "gender AS risk_category"),
                                          "risk_category", "event", "outcome"),
                             ["outcome", "n", "dof"], ["chi2", "p"]))
def chi_square_yates(d: Data) -> DataFrame:
    rows = val.binary_rows(d.analysis.withColumn(RISK, F.col("gender")))
    return assoc.chi_square(rows, RISK, "event", ["outcome"])


_PAIRS = (f"SELECT subgroup, max(CASE WHEN first_ THEN rho END) AS rho_1, max(CASE WHEN first_ THEN n END) AS n_1, "
          "max(CASE WHEN NOT first_ THEN rho END) AS rho_2, max(CASE WHEN NOT first_ THEN n END) AS n_2 FROM "
          "(SELECT *, level IN ("
          + ", ".join("'" + next(iter(v.values())) + "'" for _, v in config.SUBGROUPS.values())
          + f") AS first_ FROM ({s.spearman(SUBGROUP, 'total_score', 'y', 'subgroup, level')}) WHERE n >= 30) GROUP BY subgroup")
_INTERACTION = (f"SELECT *, rho_1 - rho_2 AS delta, (atanh(rho_1) - atanh(rho_2)) / sqrt(1.0 / (n_1 - 3) + 1.0 / (n_2 - 3)) AS z "
                f"FROM ({_PAIRS}) WHERE rho_1 IS NOT NULL AND rho_2 IS NOT NULL")
_INTERACTION = f"SELECT *, {s.normal_p('z')} AS p FROM ({_INTERACTION})"


@query("interaction_tests", R(_INTERACTION, ["subgroup", "n_1", "n_2"], ["rho_1", "rho_2", "delta", "z", "p"]))
def interaction_tests(d: Data) -> DataFrame:
    return val.interaction_tests(d.analysis)


@query("fisher_z", R(_INTERACTION, ["subgroup"], ["z", "p"]))
def fisher_z(d: Data) -> DataFrame:
    return val.interaction_tests(d.analysis).select("subgroup", "z", "p")


GROUPED = ("SELECT *, CASE WHEN hospital_expire_flag = 1 THEN 'Non-survivors' ELSE 'Survivors' END AS grp, "
           "CASE WHEN gender = 'M' THEN 1 ELSE 0 END AS male_sex FROM final")


def _long(variables: list[str], group: str, kind: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {group} AS grp, CAST({v} AS {kind}) AS v FROM ({GROUPED})"
        for v in variables)


def _numbers(d: Data, group, variables: list[str]) -> DataFrame:
    from ..operators.filters import unpivot

    return unpivot(val.table_rows(d.analysis, group), ["group"], variables, "double")


@query("mean_rank_tests",
       R(s.t_test(_long(config.BASELINE_MEAN, "grp", "DOUBLE"), "grp", "v", "Survivors", "variable"),
         ["variable", "'t' AS test", "n"], ["t", "p"]).replace(" AS t,", " AS stat,")
       + " UNION ALL "
       + R(s.mann_whitney(_long(config.BASELINE_MEDIAN, "grp", "DOUBLE"), "grp", "v", "Survivors", "variable"),
           ["variable", "'mann_whitney' AS test", "n"], ["z", "p"]).replace(" AS z,", " AS stat,"))
def mean_rank_tests(d: Data) -> DataFrame:
    group, first = val.mortality_group(), val.MORTALITY_GROUP[0]
    t = assoc.t_test(_numbers(d, group, config.BASELINE_MEAN), "group", "value", first, ["variable"])
    u = assoc.mann_whitney(_numbers(d, group, config.BASELINE_MEDIAN), "group", "value", first,
                           ["variable"])
    return union([t.select("variable", F.lit("t").alias("test"), "n", F.col("t").alias("stat"), "p"),
                  u.select("variable", F.lit("mann_whitney").alias("test"), "n",
                           F.col("z").alias("stat"), "p")])


@query("anova_f", R(s.anova(_long(config.BASELINE_MEAN, "risk_category", "DOUBLE"), "grp", "v", "variable"),
                    ["variable", "n", "groups"], ["f", "p"]))
def anova_f(d: Data) -> DataFrame:
    return assoc.anova_f(_numbers(d, F.col(RISK), config.BASELINE_MEAN), "group", "value",
                         ["variable"])


_TAILS = "SELECT total_score, count(*) AS n, 1 + total_score / 4.0::DOUBLE AS stat FROM final GROUP BY total_score"


@query("p_value_functions", f"""SELECT total_score, n, {r6('stat', 'stat')}, {r6(s.normal_p('stat'), 'normal')},
 {r6(s.chi2_p('stat', '1'), 'chi2_1')}, {r6('exp(-stat / 2)', 'chi2_2')}, {r6(s.chi2_p('stat', '3'), 'chi2_3')},
 {r6(s.t_p('stat', '100'), 't_100')}, {r6('power(1 + 2 * stat / 60, -30.0)', 'f_2_60')} FROM ({_TAILS})""")
def p_value_functions(d: Data) -> DataFrame:
    stat = F.col("stat")
    rows = d.analysis.groupBy(SCORE).agg(F.count("*").alias("n")).withColumn(
        "stat", 1 + F.col(SCORE) / 4.0)
    return rows.select(
        SCORE, "n", "stat", tails.normal_two_sided(stat).alias("normal"),
        *[tails.chi2_tail(stat, F.lit(k)).alias(f"chi2_{k}") for k in (1, 2, 3)],
        tails.t_two_sided(stat, F.lit(100)).alias("t_100"),
        tails.f_tail(stat, F.lit(2), F.lit(60)).alias("f_2_60"))


# --- bootstrap ---------------------------------------------------------------------

def _primary_sql(src: str) -> str:
    by = "cohort"
    none = "CAST(NULL AS DOUBLE)"

    def part(point: str, value: str, name: str, reps: str, metric: str, p: str) -> str:
        return (f"SELECT a.cohort, '{name}' AS metric, a.n, {r6('a.' + value, 'estimate')}, "
                f"{r6('c.ci_low', 'ci_low')}, {r6('c.ci_high', 'ci_high')}, {r6(p, 'p')} FROM ({point}) a "
                f"JOIN ({s.interval(reps, metric, by)}) c ON c.cohort = a.cohort")

    x, y = "total_score", "y"
    parts = [
        part(s.spearman(src, x, y, by), "rho", "spearman", s.boot_spearman(src, x, y, by), "spearman", "a.p"),
        part(s.pearson(src, x, y, by), "r", "pearson", s.boot_pearson(src, x, y, by), "pearson", "a.p"),
        part(s.c_index(src, x, y, by), "c_index", "c_index", s.boot_c_index(src, x, y, by), "c_index", none)]
    for label in ("low_q20", "low_q25"):
        parts.append(part(s.auroc(src, x, label, by), "auroc", f"auroc_{label[4:]}",
                          s.boot_auroc(src, x, label, by), "auroc", none))
    return " UNION ALL ".join(parts)


@query("bootstrap_ci", _primary_sql(E24))
def bootstrap_ci(d: Data) -> DataFrame:
    return val.primary_metrics(d.analysis)


def _metrics_sql(src: str, by: str, event: str, y: str) -> tuple[str, str]:
    """Points with intervals: rho frame and auroc frame."""
    keys = by
    rho = (f"SELECT {by}, a.n, a.rho, a.p, rho_ci_low, rho_ci_high FROM ({s.spearman(src, 'total_score', y, by)}) a "
           f"JOIN ({s.interval(s.boot_spearman(src, 'total_score', y, by), 'spearman', by, 'rho_ci_low', 'rho_ci_high')}) c USING ({keys})")
    auc = (f"SELECT {by}, a.n, a.events, a.auroc, auroc_ci_low, auroc_ci_high FROM ({s.auroc(src, 'total_score', event, by)}) a "
           f"JOIN ({s.interval(s.boot_auroc(src, 'total_score', event, by), 'auroc', by, 'auroc_ci_low', 'auroc_ci_high')}) c USING ({keys})")
    return rho, auc


def _levels_sql(src: str, by: str) -> str:
    rho, auc = _metrics_sql(src, by, "low_q20", "y")
    ok = "u.events > 5 AND u.events < u.n - 5"
    doubles = ["rho", "p", "rho_ci_low", "rho_ci_high"]
    areas = ["auroc", "auroc_ci_low", "auroc_ci_high"]
    return (f"SELECT {by}, r.n, u.events, {', '.join(r6('r.' + c, c) for c in doubles)}, "
            + ", ".join(r6(f"CASE WHEN {ok} THEN u.{c} END", c) for c in areas)
            + f" FROM ({rho}) r JOIN ({auc}) u USING ({by}) WHERE r.n >= 30")


SUBGROUP_SQL = _levels_sql(SUBGROUP, "subgroup, level")


@query("subgroup_analysis", SUBGROUP_SQL)
def subgroup_analysis(d: Data) -> DataFrame:
    return val.subgroup_analysis(d.analysis)


@query("phenotype_subgroups", _levels_sql(PHENOTYPE, "level"))
def phenotype_subgroups(d: Data) -> DataFrame:
    return val.phenotype_subgroups(d.analysis)


_FOREST = ("SELECT stay_id, total_score, y, 'Overall' AS level FROM lab24 UNION ALL "
           f"SELECT stay_id, total_score, y, level FROM ({SUBGROUP}) UNION ALL "
           f"SELECT stay_id, total_score, y, level FROM ({PHENOTYPE})")
_LEVELS = ["Overall", *[t for _, v in config.SUBGROUPS.values() for t in v.values()], *config.PHENOTYPES]
_POSITION = "CASE level " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(_LEVELS, 1)) + " END"
FOREST_SQL = (
    f"SELECT {_POSITION} AS position, level, a.n, {r6('a.rho', 'rho')}, {r6('rho_ci_low', 'rho_ci_low')}, "
    f"{r6('rho_ci_high', 'rho_ci_high')} FROM ({s.spearman(_FOREST, 'total_score', 'y', 'level')}) a JOIN "
    f"({s.interval(s.boot_spearman(_FOREST, 'total_score', 'y', 'level'), 'spearman', 'level', 'rho_ci_low', 'rho_ci_high')}) c "
    "USING (level) WHERE a.n >= 30")


@query("forest_table", FOREST_SQL)
def forest_table(d: Data) -> DataFrame:
    return val.forest_table(d.analysis)


@query("pin_row_first", f"SELECT {_POSITION} AS position, level, n, {r6('rho', 'rho')} FROM "
       f"({s.spearman(_FOREST, 'total_score', 'y', 'level')})")
def pin_row_first(d: Data) -> DataFrame:
    points = val.spearman(val.forest_rows(d.analysis), SCORE, EFF24, ["level"])
    return points.select(val.forest_order(F.col("level")).cast("int").alias("position"),
                         "level", "n", "rho").orderBy("position")


_STRENGTH = "CASE WHEN abs({v}) > 0.5 THEN 'strong' WHEN abs({v}) > 0.3 THEN 'moderate' ELSE 'weak' END"
_RANKED = s.spearman(SUBGROUP, "total_score", "y", "subgroup, level")


@query("rank_by_strength", f"SELECT subgroup, level, n, {r6('rho', 'rho')}, {_STRENGTH.format(v='rho')} AS strength "
       f"FROM ({_RANKED}) WHERE n >= 30")
def rank_by_strength(d: Data) -> DataFrame:
    return val.rank_by_strength(d.analysis)


_BAND = "CASE WHEN auroc >= 0.7 THEN 'good' WHEN auroc >= 0.6 THEN 'moderate' ELSE 'poor' END"


@query("strength_band", f"SELECT outcome, {r6('auroc', 'auroc')}, {_BAND} AS strength FROM "
       f"({s.auroc(BINARY, 'total_score', 'event', 'outcome')}) WHERE auroc IS NOT NULL")
def strength_band(d: Data) -> DataFrame:
    out = val.discrimination(val.binary_rows(d.analysis), SCORE, "event", ["outcome"])
    return out.filter(F.col("auroc").isNotNull()).select(
        "outcome", "auroc", strength("area", F.col("auroc")).alias("strength"))


_rho, _auc = _metrics_sql(SCENARIO, "scenario", "low_q20", "y")
_SENS = f"SELECT r.*, u.events, u.auroc, u.auroc_ci_low, u.auroc_ci_high FROM ({_rho}) r JOIN ({_auc}) u USING (scenario)"
_SENS_COLS = ["rho", "p", "rho_ci_low", "rho_ci_high", "auroc", "auroc_ci_low", "auroc_ci_high"]


@query("sensitivity_runs", f"SELECT scenario, n, CASE WHEN n >= 50 THEN events END AS events, "
       + ", ".join(r6(f"CASE WHEN n >= 50 THEN {c} END", c) for c in _SENS_COLS) + ", "
       + ", ".join(r6(f"CASE WHEN n >= 50 THEN {c} END - (SELECT {c} FROM sens WHERE scenario = 'primary' AND n >= 50)", f"delta_{c}")
                   for c in ("rho", "auroc")) + " FROM sens", sens=_SENS)
def sensitivity_runs(d: Data) -> DataFrame:
    return val.sensitivity_runs(d.analysis)


_SWEEP = f"{EFF_SWEEP} UNION ALL {OUT_SWEEP}"
_sweep_rho, _sweep_auc = _metrics_sql(_SWEEP, "kind, setting", "event", "threshold")


@query("threshold_sweep", f"SELECT kind, setting, a.n, events, {r6('auroc', 'auroc')}, {r6('auroc_ci_low', 'auroc_ci_low')}, "
       f"{r6('auroc_ci_high', 'auroc_ci_high')}, {r6('threshold', 'threshold')}, {r6('events * 100 / CAST(a.n AS DOUBLE)', 'prevalence')} "
       f"FROM ({_sweep_auc}) a JOIN (SELECT kind, setting, max(threshold) AS threshold FROM ({_SWEEP}) GROUP BY kind, setting) USING (kind, setting)")
def threshold_sweep(d: Data) -> DataFrame:
    return val.threshold_sweep(d.analysis)


_ROBUST = f"SELECT * FROM ({SCENARIO}) WHERE scenario IN ('exclude_outliers', 'exclude_shock', 'complete_ef')"


@query("robustness_spread", f"""SELECT 'rho' AS measure, {r6('max(rho) - min(rho)', 'spread')} FROM ({s.spearman(_ROBUST, 'total_score', 'y', 'scenario')})
 UNION ALL SELECT 'auroc', {r6('max(auroc) - min(auroc)', 'spread')} FROM ({s.auroc(_ROBUST, 'total_score', 'low_q20', 'scenario')})
 UNION ALL SELECT 'auroc_thresholds', {r6('max(auroc) - min(auroc)', 'spread')} FROM ({s.auroc(EFF_SWEEP, 'total_score', 'event', 'setting')})""")
def robustness_spread(d: Data) -> DataFrame:
    return val.robustness_spread(d.analysis)


# --- outcome panels ----------------------------------------------------------------

def _wide_rates(src: str, by: str, event: str) -> str:
    return f"SELECT {by}, " + ", ".join(
        f"avg({event}) FILTER (WHERE risk_category = '{v}') * 100 AS rate_{v.lower()}"
        for v in config.RISK_LEVELS) + f" FROM ({src}) GROUP BY {by}"


_bin_auc = _metrics_sql(BINARY, "outcome", "event", "event")[1]
_ENOUGH = "a.n >= 50 AND a.events > 10 AND a.events < a.n - 10"


@query("binary_outcome_panel", "SELECT outcome, a.n, a.events, "
       + ", ".join(r6(f"CASE WHEN {_ENOUGH} THEN {c} END", c) for c in ("auroc", "auroc_ci_low", "auroc_ci_high"))
       + ", " + ", ".join(r6(f"rate_{v.lower()}", f"rate_{v.lower()}") for v in config.RISK_LEVELS)
       + f", {r6('x.chi2', 'chi2')}, {r6('x.p', 'p')}, {r6('a.events * 100 / CAST(a.n AS DOUBLE)', 'prevalence')}, "
       + r6("CASE WHEN rate_low > 0 THEN rate_high / rate_low END", "ratio_high_low")
       + f" FROM ({_bin_auc}) a JOIN ({_wide_rates(BINARY, 'outcome', 'event')}) USING (outcome) "
       f"JOIN ({s.chi_square(BINARY, 'risk_category', 'event', 'outcome')}) x USING (outcome)")
def binary_outcome_panel(d: Data) -> DataFrame:
    return val.binary_outcome_panel(d.analysis)


_stay_rho = _metrics_sql(STAYS, "outcome", "days", "days")[0]


@query("continuous_outcome_panel", f"""SELECT outcome, risk_category, l.n, {r6('l.median', 'median')}, {r6('l.q1', 'q1')}, {r6('l.q3', 'q3')},
 {r6('l.mean', 'mean')}, {r6('l.sd', 'sd')}, r.n AS n_all, {r6('r.rho', 'rho')}, {r6('r.p', 'p')}, {r6('r.rho_ci_low', 'rho_ci_low')},
 {r6('r.rho_ci_high', 'rho_ci_high')}, {r6('k.h', 'h')}, {r6('k.p', 'p_kruskal')} FROM
 (SELECT outcome, risk_category, count(*) AS n, median(days) AS median, quantile_cont(days, 0.25) AS q1, quantile_cont(days, 0.75) AS q3,
 avg(days) AS mean, stddev_samp(days) AS sd FROM ({STAYS}) GROUP BY 1, 2) l
 JOIN ({_stay_rho}) r USING (outcome) JOIN ({s.kruskal(STAYS, 'risk_category', 'days', 'outcome')}) k USING (outcome)""")
def continuous_outcome_panel(d: Data) -> DataFrame:
    return val.continuous_outcome_panel(d.analysis)


_M = "hospital_expire_flag"
_mort_reps = s.boot_auroc(SHOCK, "total_score", _M, "cohort")
_M_OK = "cohort = 'all' OR (a.events > 10 AND a.events < a.n)"


@query("mortality_panel", "SELECT cohort, a.n, a.events, "
       + ", ".join(r6(f"CASE WHEN {_M_OK} THEN {c} END", c) for c in (
           "auroc", "auprc", "auroc_ci_low", "auroc_ci_high", "auprc_ci_low", "auprc_ci_high"))
       + ", " + ", ".join(r6(f"y.{c}", c) for c in ("threshold", "sensitivity", "specificity", "youden_j"))
       + f", {r6('o.sensitivity', 'sensitivity_13')}, {r6('o.specificity', 'specificity_13')} FROM "
       f"({s.auroc(SHOCK, 'total_score', _M, 'cohort')}) a JOIN ({s.auprc(SHOCK, 'total_score', _M, 'cohort')}) USING (cohort) "
       f"JOIN ({s.interval(_mort_reps, 'auroc', 'cohort', 'auroc_ci_low', 'auroc_ci_high')}) USING (cohort) "
       f"JOIN ({s.interval(_mort_reps, 'auprc', 'cohort', 'auprc_ci_low', 'auprc_ci_high')}) USING (cohort) "
       f"JOIN ({s.youden(SHOCK, 'total_score', _M, 'cohort')}) y USING (cohort) "
       f"JOIN ({s.operating_point(SHOCK, 'total_score', _M, 13, 'cohort')}) o USING (cohort)")
def mortality_panel(d: Data) -> DataFrame:
    return val.mortality_panel(d.analysis)


@query("effect_ratios", f"""SELECT 'hospital_expire_flag' AS outcome, c.n, CAST(c.events AS BIGINT) AS events,
 {r6('rate_low', 'rate_low')}, {r6('rate_moderate', 'rate_moderate')}, {r6('rate_high', 'rate_high')},
 {r6('CASE WHEN rate_low > 0 THEN rate_high / rate_low END', 'ratio_high_low')}, {r6('rate_high - rate_low', 'difference')},
 {r6('CASE WHEN rate_high <> 0 THEN rate_low / rate_high END', 'fold_low_high')},
 {r6('CASE WHEN rate_low <> 0 THEN (rate_low - rate_high) / rate_low * 100 END', 'percent_reduction')},
 {r6('x.chi2', 'chi2')}, {r6('x.p', 'p')} FROM ({_wide_rates(ALL, 'cohort', _M)}) w
 JOIN (SELECT 'all' AS cohort, count(*) AS n, sum({_M}) AS events FROM final) c USING (cohort)
 JOIN ({s.chi_square(ALL, 'risk_category', _M, 'cohort')}) x USING (cohort)""")
def effect_ratios(d: Data) -> DataFrame:
    return val.rates_with_effects(d.analysis, "hospital_expire_flag")


_COMPONENTS = " UNION ALL ".join(
    f"SELECT '{c}' AS predictor, low_q20, CAST({c} AS DOUBLE) AS v FROM lab24"
    for c in ("total_score", "creatinine", "bun", "ntprobnp"))


@query("component_roc", R(s.auroc(_COMPONENTS, "v", "low_q20", "predictor"),
                          ["predictor", "n", "events"], ["auroc"]))
def component_roc(d: Data) -> DataFrame:
    return val.component_roc(d.analysis)


@query("linear_fit", f"""SELECT {r6('regr_slope(least(y, 200), total_score)', 'slope')},
 {r6('regr_intercept(least(y, 200), total_score)', 'intercept')} FROM lab24""")
def linear_fit(d: Data) -> DataFrame:
    return val.scatter_fit(d.analysis)


# --- tables ------------------------------------------------------------------------

def _summary(src: str, value: str, by: str) -> str:
    return (f"SELECT {by}, count(*) AS n, {r6(f'median({value})', 'median')}, {r6(f'quantile_cont({value}, 0.25)', 'q1')}, "
            f"{r6(f'quantile_cont({value}, 0.75)', 'q3')}, {r6(f'avg({value})', 'mean')}, {r6(f'stddev_samp({value})', 'sd')} "
            f"FROM ({src}) GROUP BY {by}")


_SUMMARY = _summary(EBOTH.replace("cohort", "timepoint"), "y", "timepoint, risk_category")


@query("summary_by_group", _SUMMARY)
def summary_by_group(d: Data) -> DataFrame:
    return val.summary_by_risk(d.analysis)


def _baseline_sql(group: str, groups: int) -> str:
    numbers = config.BASELINE_MEAN + config.BASELINE_MEDIAN
    both = (f"SELECT * FROM ({_long(numbers, group, 'DOUBLE')}) UNION ALL "
            f"SELECT variable, 'Overall', v FROM ({_long(numbers, group, 'DOUBLE')})")
    num = (f"SELECT variable, grp, CAST(NULL AS VARCHAR) AS level, count(v) AS n, count(*) - count(v) AS n_missing, "
           "avg(v) AS mean, stddev_samp(v) AS sd, median(v) AS median, quantile_cont(v, 0.25) AS q1, "
           f"quantile_cont(v, 0.75) AS q3, CAST(NULL AS DOUBLE) AS percent FROM ({both}) GROUP BY 1, 2")
    cats = _long(config.BASELINE_CATEGORICAL, group, "VARCHAR")
    both = (f"SELECT * FROM ({cats}) WHERE v IS NOT NULL UNION ALL "
            f"SELECT variable, 'Overall', v FROM ({cats}) WHERE v IS NOT NULL")
    cat = ("SELECT variable, grp, v AS level, count(*) AS n, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
           "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
           "count(*) * 100 / CAST(sum(count(*)) OVER (PARTITION BY variable, grp) AS DOUBLE) "
           f"FROM ({both}) GROUP BY variable, grp, v")
    means, medians = _long(config.BASELINE_MEAN, group, "DOUBLE"), _long(config.BASELINE_MEDIAN, group, "DOUBLE")
    if groups == 2:
        tests = [("t", s.t_test(means, "grp", "v", "Survivors", "variable")),
                 ("mann_whitney", s.mann_whitney(medians, "grp", "v", "Survivors", "variable"))]
    else:
        tests = [("anova", s.anova(means, "grp", "v", "variable")),
                 ("kruskal_wallis", s.kruskal(medians, "grp", "v", "variable"))]
    tests.append(("chi_square", s.chi_square(cats, "grp", "v", "variable")))
    test = " UNION ALL ".join(f"SELECT variable, '{n}' AS test, p FROM ({t})" for n, t in tests)
    doubles = ["mean", "sd", "median", "q1", "q3", "percent", "p"]
    return (f'SELECT variable, grp AS "group", level, n, n_missing, test, '
            f"{', '.join(r6(c, c) for c in doubles)} FROM ({num} UNION ALL {cat}) LEFT JOIN ({test}) USING (variable)")


@query("baseline_table", _baseline_sql("grp", 2))
def baseline_table(d: Data) -> DataFrame:
    return val.baseline_table(d.analysis, "mortality")


@query("baseline_table_by_risk", _baseline_sql("risk_category", 3))
def baseline_table_by_risk(d: Data) -> DataFrame:
    return val.baseline_table(d.analysis, "risk")


def _outcomes_sql() -> str:
    null = "CAST(NULL AS DOUBLE)"
    text = "CAST(NULL AS VARCHAR)"
    cols = "section, metric, level, value, ci_low, ci_high, p"
    parts = [f"SELECT 'efficiency_' || cohort AS section, metric, {text} AS level, estimate AS value, ci_low, ci_high, p "
             f"FROM ({_primary_sql(EBOTH)})",
             f"SELECT 'efficiency_' || cohort, 'kruskal_h', {text}, h, {null}, {null}, p FROM "
             f"({s.kruskal(EBOTH, 'risk_category', 'y', 'cohort')})",
             f"SELECT 'efficiency_' || timepoint, 'median', risk_category, median, q1, q3, {null} FROM ({_SUMMARY})"]
    for section, where, event in (("resistance", "icu_stay_ge_24h = 1", "diuretic_resistance"),
                                  ("mortality", "TRUE", _M)):
        src = f"SELECT *, '{section}' AS cohort FROM final WHERE {where}"
        auc = _metrics_sql(src, "cohort", event, event)[1]
        parts += [
            f"SELECT cohort, 'auroc', {text}, auroc, auroc_ci_low, auroc_ci_high, {null} FROM ({auc})",
            f"SELECT cohort, 'chi_square', {text}, chi2, {null}, {null}, p FROM "
            f"({s.chi_square(src, 'risk_category', event, 'cohort')})",
            f"SELECT '{section}', 'rate', risk_category, avg({event}) * 100, {null}, {null}, {null} FROM ({src}) GROUP BY risk_category"]
    inner = " UNION ALL ".join(parts)
    return (f"SELECT section, metric, level, {r6('value', 'value')}, {r6('ci_low', 'ci_low')}, {r6('ci_high', 'ci_high')}, "
            f"{r6('p', 'p')} FROM (SELECT * FROM ({inner}) AS t({cols}))")


@query("outcomes_table", _outcomes_sql())
def outcomes_table(d: Data) -> DataFrame:
    return val.outcomes_table(d.analysis)


_BY_RISK = f"""SELECT risk_category, {', '.join(r6(f"max({c}) FILTER (WHERE timepoint = '{t}')", f'eff_{t}_{c}') for t in ('24h', '72h') for c in ('median', 'q1', 'q3'))},
 {r6('max(resistance_rate)', 'resistance_rate')}, {r6('max(mortality_rate)', 'mortality_rate')},
 CASE risk_category WHEN 'Low' THEN 1 WHEN 'Moderate' THEN 2 ELSE 3 END AS position FROM ({_SUMMARY})
 JOIN (SELECT risk_category, avg(diuretic_resistance) * 100 AS resistance_rate FROM final WHERE icu_stay_ge_24h = 1 GROUP BY 1) USING (risk_category)
 JOIN (SELECT risk_category, avg({_M}) * 100 AS mortality_rate FROM final GROUP BY 1) USING (risk_category) GROUP BY risk_category"""


@query("outcomes_by_risk", _BY_RISK)
def outcomes_by_risk(d: Data) -> DataFrame:
    return val.outcomes_by_risk(d.analysis)


_PUBLISHED = " UNION ALL ".join(
    f"SELECT '{pop}' AS population, '{metric}' AS metric, {value}::DOUBLE AS published"
    for pop, _, *values in config.COMPARATORS
    for metric, value in zip(("pearson_r", "auroc_q20", "auroc_q25", "auroc_dr"), values)
    if value is not None)
_HERE = (f"SELECT 'pearson_r' AS metric, r AS here FROM ({s.pearson(E24, 'total_score', 'y', 'cohort')}) "
         f"UNION ALL SELECT 'auroc_q20', auroc FROM ({s.auroc(E24, 'total_score', 'low_q20', 'cohort')}) "
         f"UNION ALL SELECT 'auroc_q25', auroc FROM ({s.auroc(E24, 'total_score', 'low_q25', 'cohort')}) "
         f"UNION ALL SELECT 'auroc_dr', auroc FROM ({s.auroc('SELECT *, 1 AS one FROM final WHERE icu_stay_ge_24h = 1', 'total_score', 'diuretic_resistance', 'one')})")


@query("literature_delta", f"""SELECT metric, population, {r6('published', 'published')}, {r6('here', 'here')},
 {r6('(abs(here) - abs(published)) / abs(published) * 100', 'percent_difference')} FROM ({_PUBLISHED}) JOIN ({_HERE}) USING (metric)""")
def literature_delta(d: Data) -> DataFrame:
    return val.literature_delta(d.analysis)


@query("resistance_agreement", f"""SELECT {r6('avg(CASE WHEN (urine_output_24h_ml <= 3000) = (diuretic_resistance = 1) THEN 1 ELSE 0 END) * 100', 'match_percent')},
 count(*) AS n FROM final""")
def resistance_agreement(d: Data) -> DataFrame:
    return val.resistance_agreement(d.analysis)


# --- cut-offs ----------------------------------------------------------------------

_BANDED = ("SELECT l.low, h.high, CASE WHEN total_score <= l.low THEN 0 WHEN total_score <= h.high THEN 1 ELSE 2 END AS band, "
           "{cols} FROM lab24 JOIN (SELECT CAST(unnest(range(4, 18)) AS INTEGER) AS low) l ON TRUE "
           "JOIN (SELECT CAST(unnest(range(6, 20)) AS INTEGER) AS high) h ON h.high >= l.low + 2")
_CHI_ALL = f"SELECT * FROM ({s.chi_square(_BANDED.format(cols='low_q20'), 'band', 'low_q20', 'low, high')}) WHERE dof = 2"
_KW_ALL = (f"SELECT * FROM ({s.kruskal(_BANDED.format(cols='y'), 'band', 'y', 'low, high')}) JOIN (SELECT low, high FROM "
           f"(SELECT low, high, band, count(*) AS c FROM ({_BANDED.format(cols='y')}) GROUP BY 1, 2, 3) GROUP BY 1, 2 "
           "HAVING count(*) = 3 AND min(c) > 10) USING (low, high)")


def _best(sql: str, stat: str) -> str:
    return (f"SELECT * FROM ({sql}) WHERE {stat} > 0 "
            f"QUALIFY row_number() OVER (ORDER BY round({stat}, 9) DESC, low, high) = 1")


@query("cutoff_chi2_search", R(_best(_CHI_ALL, "chi2"), ["low", "high", "n", "dof"], ["chi2", "p"]))
def cutoff_chi2_search(d: Data) -> DataFrame:
    return cut.best_candidate(
        cut.chi2_candidates(_eff(d), SCORE, "low_q20", cutoff_plan.GRID), "chi2")


@query("cutoff_kw_search", R(_best(_KW_ALL, "h"), ["low", "high", "n", "groups"], ["h", "p"]))
def cutoff_kw_search(d: Data) -> DataFrame:
    return cut.best_candidate(
        cut.kruskal_candidates(_eff(d), SCORE, EFF24, cutoff_plan.GRID), "h")


@query("cutoff_kw_candidates", R(_KW_ALL, ["low", "high", "n", "groups"], ["h", "p"]))
def cutoff_kw_candidates(d: Data) -> DataFrame:
    return cut.kruskal_candidates(_eff(d), SCORE, EFF24, cutoff_plan.GRID)


def _split(source: str, node: str) -> str:
    """All midpoints tried on the rows themselves."""
    levels = (f"SELECT total_score AS s, lead(total_score) OVER (ORDER BY total_score) AS nxt FROM "
              f"(SELECT DISTINCT total_score FROM ({source}))")
    tried = (f"SELECT (l.s + l.nxt) / 2.0::DOUBLE AS threshold, "
             "count(*) FILTER (WHERE total_score <= l.s) AS ln, sum(low_q20) FILTER (WHERE total_score <= l.s) AS lp, "
             "count(*) FILTER (WHERE total_score > l.s) AS rn, sum(low_q20) FILTER (WHERE total_score > l.s) AS rp "
             f"FROM ({source}) JOIN ({levels}) l ON l.nxt IS NOT NULL GROUP BY 1")
    gini = "2.0::DOUBLE * lp * (ln - lp) / ln + 2.0::DOUBLE * rp * (rn - rp) / rn"
    return (f"SELECT '{node}' AS node, threshold FROM ({tried}) WHERE ln >= 50 AND rn >= 50 AND lp + rp > 0 "
            f"AND lp + rp < ln + rn QUALIFY row_number() OVER (ORDER BY round({gini}, 9), threshold) = 1")


_ROOT = _split("SELECT * FROM lab24", "root")
_TREE = " UNION ALL ".join([
    f"SELECT * FROM ({_ROOT})",
    "SELECT * FROM (" + _split(f"SELECT * FROM lab24 WHERE total_score <= (SELECT threshold FROM ({_ROOT}))", "left") + ")",
    "SELECT * FROM (" + _split(f"SELECT * FROM lab24 WHERE total_score > (SELECT threshold FROM ({_ROOT}))", "right") + ")"])


@query("tree_cutoffs", R(_TREE, ["node"], ["threshold"]))
def tree_cutoffs(d: Data) -> DataFrame:
    return cut.tree_cutoffs(_eff(d), SCORE, "low_q20", config.TREE_MIN_LEAF)


_QUANT = " UNION ALL ".join(
    f"SELECT '{n}' AS method, {r6(f'quantile_cont(total_score, {a})', 'low')}, {r6(f'quantile_cont(total_score, {b})', 'high')} FROM final"
    for n, a, b in (("tertiles", 0.333, 0.667), ("quartiles", 0.25, 0.75)))


@query("quantile_cutoffs", _QUANT)
def quantile_cutoffs(d: Data) -> DataFrame:
    return cut.quantile_cutoffs(d.analysis, SCORE)


_SUMMARY_CUTS = (
    f"SELECT 'youden' AS method, CAST(NULL AS DOUBLE) AS low, threshold AS high, 'lowest fifth' AS outcome FROM "
    f"({s.youden(E24, 'total_score', 'low_q20', 'cohort')}) UNION ALL "
    f"SELECT 'tree', list_sort(list(threshold))[1], list_sort(list(threshold))[2], 'lowest fifth' FROM ({_TREE}) UNION ALL "
    f"SELECT 'chi_square', low, high + 1, 'lowest fifth' FROM ({_best(_CHI_ALL, 'chi2')}) UNION ALL "
    f"SELECT 'kruskal_wallis', low, high + 1, 'continuous' FROM ({_best(_KW_ALL, 'h')}) UNION ALL "
    f"SELECT method, low, high, 'distribution' FROM ({_QUANT})")


@query("cutoff_summary", R(_SUMMARY_CUTS, ["method", "outcome"], ["low", "high"]))
def cutoff_summary(d: Data) -> DataFrame:
    return cutoff_plan.cutoff_summary(d.analysis)


def _framework_sql(table: str, timepoint: str) -> str:
    src = FRAMES.format(src=table)
    return (f"SELECT framework, level, m.n, {r6('m.median', 'median')}, {r6('k.h', 'h')}, {r6('k.p', 'p')}, '{timepoint}' AS timepoint "
            f"FROM (SELECT framework, level, count(*) AS n, median(y) AS median FROM ({src}) GROUP BY 1, 2) m "
            f"JOIN ({s.kruskal(src, 'level', 'y', 'framework')}) k USING (framework)")


@query("framework_comparison", f"{_framework_sql('lab24', '24h')} UNION ALL {_framework_sql('lab72', '72h')}")
def framework_comparison(d: Data) -> DataFrame:
    return union([cutoff_plan.framework_efficiency(d.analysis, h) for h in (24, 72)])


_FRAME_M = FRAMES.format(src="final")


@query("framework_mortality", f"""SELECT framework, level, m.n, CAST(events AS BIGINT) AS events, {r6('rate', 'rate')}, {r6('x.chi2', 'chi2')}, {r6('x.p', 'p')} FROM
 (SELECT framework, level, count(*) AS n, sum({_M}) AS events, avg({_M}) * 100 AS rate FROM ({_FRAME_M}) GROUP BY 1, 2) m
 JOIN ({s.chi_square(_FRAME_M, 'level', _M, 'framework')}) x USING (framework)""")
def framework_mortality(d: Data) -> DataFrame:
    return cutoff_plan.framework_mortality(d.analysis)


@query("score_step_profile", f"SELECT total_score, count(*) AS n, {r6('median(y)', 'median')} FROM lab24 GROUP BY 1")
def score_step_profile(d: Data) -> DataFrame:
    return cutoff_plan.score_step_profile(d.analysis)
