"""Correlation, concordance and rank tests on histograms of distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi2_tail, f_tail, normal_two_sided, t_two_sided
from .rank_scan import concordance, level_sums
from .ranks import histogram, mean_rank, prefix_sums


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by the t distribution with n - 2 degrees."""
    dof = n.cast("double") - 2
    t = r * F.sqrt(dof / F.nullif(1 - r * r, F.lit(0.0)))
    return F.when((n > 2) & (F.abs(r) < 1), t_two_sided(t, dof)).when(
        (n > 2) & r.isNotNull(), F.lit(0.0))


def rank_sums(df: DataFrame, group: str, value: str, by: list[str] = (),
              weight: str | None = None) -> DataFrame:
    """Per (by, group): n, centred rank sum and its square sum, and tie terms.

    Ranks are those of ``value`` within ``by``, ties averaged, measured from their
    mean. One row per group level is all any rank statistic below needs.
    """
    by = list(by)
    cells = histogram(df, [*by, group, value], weight)
    ranked = prefix_sums(cells, value, ["n"], by).withColumn(
        "_d", mean_rank() - (F.col("n_total") + 1) / F.lit(2.0))
    n, d = F.col("n").cast("double"), F.col("_d")
    at = F.col("n_at").cast("double")
    return ranked.groupBy(*by, group).agg(
        F.sum("n").alias("n"),
        F.sum(n * d).alias("d_sum"),
        F.sum(n * d * d).alias("d_square"),
        F.sum(n * (at * at - 1)).alias("tie_term"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = (),
             weight: str | None = None, bounded_x: bool = False,
             p_value: bool = True) -> DataFrame:
    """Tie-averaged rank correlation per group: n, rho, p.

    ``x`` is the side with fewer distinct values; ``bounded_x`` declares it a score of few
    levels.
    """
    by = list(by)
    levels = (level_sums if bounded_x else rank_sums)(df, x, y, by, weight)
    ranked = prefix_sums(levels, x, ["n"], by, bounded_x).withColumn(
        "_x", mean_rank() - (F.col("n_total") + 1) / F.lit(2.0))
    rho = _centred_correlation()
    out = ranked.groupBy(*by).agg(F.sum("n").alias("n"), rho.alias("rho"))
    return out.withColumn("p", correlation_p(F.col("rho"), F.col("n"))) if p_value else out


def _centred_correlation() -> Column:
    n, x = F.col("n").cast("double"), F.col("_x")
    spread = F.sum(n * x * x) * F.sum("d_square")
    return F.when(spread > 0, F.sum(x * F.col("d_sum")) / F.sqrt(spread))


def pearson(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Linear correlation per group: n, r, p."""
    both = df.dropna(subset=[x, y])
    out = both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))
    return out.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def linear_fit(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(F.regr_slope(ys, xs).alias("slope"),
                               F.regr_intercept(ys, xs).alias("intercept"))


def c_index(df: DataFrame, score: str, outcome: str, bits: int, by: list[str] = (),
            weight: str | None = None) -> DataFrame:
    """P(higher score goes with lower outcome): n, permissible, c_index.

    Pairs with equal outcome do not count; pairs with equal score count one half. The
    score must be an integer in [0, 2**bits), so it has few levels; give other scores a dense
    index first (:func:`dense_index`).
    """
    inside = (F.col(score) >= 0) & (F.col(score) < 2 ** bits) & (
        F.floor(F.col(score)) == F.col(score))
    outside = F.raise_error(F.lit(f"index is not an integer in [0, 2**{bits})")).cast("int")
    index = F.when(inside | F.col(score).isNull(), F.col(score).cast("int")).otherwise(outside)
    return concordance(df.withColumn(score, index), score, outcome, by, weight)


def dense_index(df: DataFrame, value: str, out: str, by: list[str] = ()) -> DataFrame:
    """Adds the 0-based rank of each value among its group's distinct values."""
    by = list(by)
    levels = histogram(df, [*by, value]).withColumn("n", F.lit(1))
    index = prefix_sums(levels, value, ["n"], by).select(
        *by, value, F.col("n_below").cast("bigint").alias(out))
    return df.join(index, [*by, value])


def kruskal_wallis(df: DataFrame, group: str, value: str, by: list[str] = ()) -> DataFrame:
    """Tie-corrected rank test over groups: n, groups, h, p."""
    return kruskal_from_sums(level_sums(df, group, value, by), by)


def kruskal_from_sums(sums: DataFrame, by: list[str] = ()) -> DataFrame:
    """The rank test from per-group n, centred rank sum and tie term."""
    n = F.sum("n").cast("double")
    between = F.sum(F.col("d_sum") * F.col("d_sum") / F.col("n"))
    ties = F.when(n > 1, 1 - F.sum("tie_term") / (n * n * n - n))
    out = sums.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count("*").alias("groups"),
        F.when(ties > 0, 12 / (n * (n + 1)) * between / ties).alias("h"))
    return out.withColumn("p", F.when(
        F.col("groups") > 1, chi2_tail(F.col("h"), F.col("groups") - 1)))


def mann_whitney(df: DataFrame, group: str, value: str, first, by: list[str] = ()) -> DataFrame:
    """Two-group rank test: u of the ``first`` group, z with tie correction, p."""
    sums = level_sums(df, group, value, by)
    n = F.sum("n").cast("double")
    n1 = F.sum(F.when(F.col(group) == first, F.col("n")).otherwise(0)).cast("double")
    d1 = F.sum(F.when(F.col(group) == first, F.col("d_sum")).otherwise(0.0))
    n2 = n - n1
    ties = F.when(n > 1, 1 - F.sum("tie_term") / (n * n * n - n))
    sd = F.sqrt(n1 * n2 * (n + 1) / 12 * ties)
    out = sums.groupBy(*by).agg(
        F.sum("n").alias("n"), (d1 + n1 * n2 / 2).alias("u"),
        F.when(sd > 0, F.greatest(F.abs(d1) - 0.5, F.lit(0.0)) / sd).alias("z"))
    return out.withColumn("p", normal_two_sided(F.col("z")))


def group_moments(df: DataFrame, group: str, value: str, by: list[str] = ()) -> DataFrame:
    v = F.col(value).cast("double")
    return df.dropna(subset=[*by, group, value]).groupBy(*by, group).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def t_test(df: DataFrame, group: str, value: str, first, by: list[str] = (),
           equal_var: bool = True) -> DataFrame:
    """Two-group mean test: t of the ``first`` group against the rest, dof, p."""
    m = group_moments(df, group, value, by)
    is_first = F.col(group) == first

    def side(column: str, test: Column) -> Column:
        return F.max(F.when(test, F.col(column))).cast("double")

    n1, n2 = side("n", is_first), side("n", ~is_first)
    gap = side("mean", is_first) - side("mean", ~is_first)
    v1, v2 = side("var", is_first), side("var", ~is_first)
    if equal_var:
        dof = n1 + n2 - 2
        pooled = F.when(dof > 0, ((n1 - 1) * v1 + (n2 - 1) * v2) / dof)
        se = F.sqrt(pooled * (1 / n1 + 1 / n2))
    else:
        a, b = v1 / n1, v2 / n2
        dof = F.when((a + b > 0) & (n1 > 1) & (n2 > 1),
                     (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))
        se = F.sqrt(a + b)
    out = m.groupBy(*by).agg(F.sum("n").alias("n"), dof.alias("dof"),
                             F.when(se > 0, gap / se).alias("t"))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("dof")))


def anova_f(df: DataFrame, group: str, value: str, by: list[str] = ()) -> DataFrame:
    """One-way comparison of means: n, groups, f, p."""
    # one row per group level from here on; squares are taken about the grand mean
    m = group_moments(df, group, value, by)
    n, total = F.col("n").cast("double"), F.sum("n").cast("double")
    level = Window.partitionBy(*by)
    m = m.withColumn("_g", F.sum(n * F.col("mean")).over(level) / F.sum("n").over(level))
    gap = F.col("mean") - F.col("_g")
    between = F.sum(n * gap * gap)
    within = F.sum((n - 1) * F.coalesce(F.col("var"), F.lit(0.0)))
    groups = F.count("*").cast("double")
    stat = (between / (groups - 1)) / (within / (total - groups))
    usable = (groups > 1) & (total > groups) & (within > 0)
    out = m.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count("*").alias("groups"),
        F.when(usable, stat).alias("f"))
    return out.withColumn("p", f_tail(
        F.col("f"), F.col("groups") - 1, F.col("n") - F.col("groups")))


def contingency(df: DataFrame, row: str, column: str, by: list[str] = (),
                weight: str | None = None) -> DataFrame:
    """Long cross table: by, row, column, n."""
    return histogram(df, [*by, row, column], weight)


def expected_counts(cells: DataFrame, row: str, column: str, by: list[str] = ()) -> DataFrame:
    """Adds row_n, column_n, total_n and the expected count to a long cross table."""
    by = list(by)

    def margin(keys: list[str], name: str) -> DataFrame:
        return cells.groupBy(*keys).agg(F.sum("n").alias(name))

    rows, columns = margin([*by, row], "row_n"), margin([*by, column], "column_n")
    out = cells.join(rows, [*by, row]).join(columns, [*by, column])
    if by:
        out = out.join(margin(by, "total_n"), by)
    else:
        out = out.withColumn("total_n", margin([], "total_n").scalar())
    return out.withColumn(
        "expected", F.col("row_n").cast("double") * F.col("column_n") / F.col("total_n"))


def chi_square(df: DataFrame, row: str, column: str, by: list[str] = (),
               weight: str | None = None) -> DataFrame:
    """Independence test of a cross table: n, dof, chi2, p.

    The continuity correction applies to one degree of freedom only. A table with
    fewer than two rows or columns has NULL results.
    """
    return chi_square_cells(contingency(df, row, column, by, weight), row, column, by)


def chi_square_cells(cells: DataFrame, row: str, column: str,
                     by: list[str] = ()) -> DataFrame:
    full = expected_counts(cells.filter(F.col("n") > 0), row, column, by)
    n, e = F.col("n").cast("double"), F.col("expected")
    r, c = F.col("row_n").cast("double"), F.col("column_n").cast("double")
    total = F.col("total_n").cast("double")
    # empty cells enter through the identity sum(o^2/e) - n
    plain = F.sum(n * n / e) - F.max(total)
    gap = F.greatest(F.max(F.abs(n - e)) - 0.5, F.lit(0.0))
    others = r * (total - r) * c * (total - c)
    inverse = F.max(F.when(others > 0, total * total * total / others))
    out = full.groupBy(*by).agg(
        F.max("total_n").alias("n"),
        ((F.count_distinct(F.col(row)) - 1) * (F.count_distinct(F.col(column)) - 1))
        .alias("dof"),
        F.greatest(plain, F.lit(0.0)).alias("_plain"),
        (gap * gap * inverse).alias("_corrected"))
    stat = F.when(F.col("dof") == 1, F.col("_corrected")).when(F.col("dof") > 1, F.col("_plain"))
    out = out.withColumn("chi2", stat)
    return out.select(*by, "n", "dof", "chi2", F.when(
        F.col("dof") > 0, chi2_tail(F.col("chi2"), F.col("dof"))).alias("p"))


def fisher_z(r1: Column, n1: Column, r2: Column, n2: Column) -> tuple[Column, Column]:
    """z and two-sided p for the difference of two independent correlations."""

    def transform(r: Column) -> Column:
        return 0.5 * F.log((1 + r) / (1 - r))

    se = F.sqrt(1 / (n1.cast("double") - 3) + 1 / (n2.cast("double") - 3))
    usable = (n1 > 3) & (n2 > 3) & (F.abs(r1) < 1) & (F.abs(r2) < 1)
    z = F.when(usable, (transform(r1) - transform(r2)) / se)
    return z, normal_two_sided(z)
