"""Descriptive summaries: moments, quantiles, rates, tables, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import histogram, prefix_sums, quantile, quantile_aggregates, quantiles

GRID_STEP = 1 << 16


def describe(df: DataFrame, value: str, by: list[str] = (), bounded: bool = False,
             qs: dict[str, float] | None = None, weight: str | None = None) -> DataFrame:
    """n, mean, sd, median, q1, q3, min, max (and adjusted skew) per group, exactly.

    One histogram serves everything; the mean is carried through the same prefix sums,
    so the spread is taken about the exact mean in a single further aggregation. ``weight``
    is a column that says how many rows a row stands for.
    """
    by = list(by)
    qs = qs or {"q1": 0.25, "median": 0.5, "q3": 0.75}
    hist = histogram(df, [*by, value], weight).withColumn(
        "s", F.col("n") * F.col(value).cast("double"))
    summed = prefix_sums(hist, value, ["n", "s"], by, bounded)
    n, v = F.col("n").cast("double"), F.col(value).cast("double")
    d = v - F.col("s_total") / F.col("n_total")
    count = F.max("n_total").cast("double")
    m2, m3 = F.sum(n * d * d), F.sum(n * d * d * d)
    g1 = (m3 / count) / F.pow(m2 / count, F.lit(1.5))
    return summed.groupBy(*by).agg(
        F.max("n_total").alias("n"),
        (F.max("s_total") / count).alias("mean"),
        F.when(count > 1, F.sqrt(m2 / (count - 1))).alias("sd"),
        F.when((count > 2) & (m2 > 0), g1 * F.sqrt(count * (count - 1)) / (count - 2))
        .alias("skew"),
        *quantile_aggregates(value, qs),
        F.min(v).alias("min"), F.max(v).alias("max"))


def percentiles(df: DataFrame, value: str, points: list[float], by: list[str] = (),
                bounded: bool = False) -> DataFrame:
    """Long form: by, percentile (0-100), value."""
    names = {f"_q{i}": p / 100 for i, p in enumerate(points)}
    wide = quantiles(df, value, names, by, bounded)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.col(c).alias("value"))
                     for p, c in zip(points, names)])
    return wide.select(*by, F.inline(rows))


def rates(df: DataFrame, event: str, by: list[str]) -> DataFrame:
    """n, events and percentage per group (rows with a NULL event do not count)."""
    e = F.col(event)
    return df.dropna(subset=[event]).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(e).cast("bigint").alias("events"),
        (F.avg(e) * 100).alias("rate"))


def cohort_overview(df: DataFrame, subject: str, event: str, value: str) -> DataFrame:
    """Rows, subjects, events, event rate, and the value's mean and median.

    The median is a scalar subquery over the value's histogram; a distinct count and
    the sums share the other pass.
    """
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(F.col(subject)).alias("subjects"),
        F.sum(event).cast("bigint").alias("events"),
        (F.avg(event) * 100).alias("event_rate"),
        F.avg(value).alias("mean_value"),
    ).withColumn("median_value", quantiles(df, value, {"m": 0.5}, bounded=True).scalar())


def frequency_table(df: DataFrame, value: str) -> DataFrame:
    """Count, percent and cumulative percent for every integer between min and max.

    Built on the value's histogram: values that do not occur are filled in with 0, in
    runs of ``GRID_STEP`` that are dealt over the tasks.
    """
    hist = histogram(df, [value])
    span = hist.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = F.lit(GRID_STEP).cast("bigint")
    starts = span.select(F.explode(F.sequence(
        F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), step)).alias("_from"), "hi")
    ends = F.least(F.col("_from") + step - 1, F.col("hi").cast("bigint"))
    grid = (starts.withColumn("_to", ends).repartition("_from")
            .select(F.explode(F.sequence("_from", "_to")).alias("_v"))
            .select(F.col("_v").cast(hist.schema[value].dataType).alias(value)))
    filled = grid.join(hist, value, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.col("n_total").cast("double")
    return prefix_sums(filled, value, ["n"]).select(
        value, F.col("n").cast("bigint").alias("n"), (F.col("n") * 100 / total).alias("percent"),
        ((F.col("n_below") + F.col("n_at")) * 100 / total).alias("cumulative_percent"))


def bin_counts(df: DataFrame, value: str, width: float = 1.0, by: list[str] = ()) -> DataFrame:
    """Left-closed bins of equal width: lower edge, n and density within the group."""
    by = list(by)
    edge = (F.floor(F.col(value).cast("double") / width) * width).cast("double")
    counts = (df.dropna(subset=[*by, value]).groupBy(*by, edge.alias("bin"))
              .agg(F.count("*").alias("n")))
    if by:
        out = counts.join(counts.groupBy(*by).agg(F.sum("n").alias("_t")), by)
    else:
        out = counts.withColumn("_t", counts.agg(F.sum("n")).scalar())
    return out.select(*by, "bin", "n", (F.col("n") / (F.col("_t") * width)).alias("density"))


def at_or_below(df: DataFrame, value: str, q: float, out: str) -> DataFrame:
    """Adds a 0/1 label: value at or below its own q-quantile."""
    return label_below(df, value, quantile(df, value, q), out)


def label_below(df: DataFrame, value: str, limit: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.when(F.col(value) <= limit, 1).otherwise(0))


def trim_above(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """Rows at or below the q-quantile."""
    return df.filter(F.col(value) <= quantile(df, value, q))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form: variable, non-missing count and percent, from one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_present"),
                 (F.col(c) * 100 / F.col("_n").cast("double")).alias("percent_present"))
        for c in columns])
    return counts.select(F.inline(rows))


def validate_schema(df: DataFrame, required: list[str], parts: list[str], total: str) -> DataFrame:
    """Per required column: present, non-null count, min, max; plus the total check.

    ``sum_matches_percent`` is the share of rows whose parts add up to the total.
    """
    have = [c for c in required if c in df.columns]
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in
               ("byte", "short", "integer", "long", "float", "double", "decimal")}
    measures = []
    for c in have:
        measures.append(F.count(c).alias(f"{c}|n"))
        if c in numeric:
            measures += [F.min(c).cast("double").alias(f"{c}|lo"),
                         F.max(c).cast("double").alias(f"{c}|hi")]
    added = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    measures.append((F.avg((added == F.col(total)).cast("int")) * 100).alias("|match"))
    wide = df.agg(*measures)
    nothing = F.lit(None).cast("double")
    rows = []
    for c in required:
        seen, ranged = c in have, c in have and c in numeric
        rows.append(F.struct(
            F.lit(c).alias("variable"), F.lit(int(seen)).alias("present"),
            (F.col(f"`{c}|n`") if seen else F.lit(0).cast("bigint")).alias("n_present"),
            (F.col(f"`{c}|lo`") if ranged else nothing).alias("min"),
            (F.col(f"`{c}|hi`") if ranged else nothing).alias("max"),
            F.col("`|match`").alias("sum_matches_percent")))
    return wide.select(F.inline(F.array(*rows)))


def effect_ratios(low: Column, high: Column) -> dict[str, Column]:
    """Ratio, difference, fold and percent reduction of a low against a high group."""
    return {
        "ratio_high_low": F.when(low > 0, high / low),
        "difference": high - low,
        "fold_low_high": F.when(high != 0, low / high),
        "percent_reduction": F.when(low != 0, (low - high) / low * 100)}
