"""Registration, data access per scale folder, and result normalisation."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.admission_features import admission_table
from ..plans.cutoffs import add_efficiency_labels
from ..plans.funnel import Funnel, cohort_funnel
from ..plans.outcomes import add_risk_category, enrich_outcomes
from ..session import TableStore, tune
from ..sources.overlay import (BASE_TABLES, VIEWS, admission_buckets, overlay_sources,
                               with_clause)
from ..sources.tables import Sources
from .oracle_views import COHORT_VIEWS

DIGITS = 6
#: P-values: below the first, three decimals of the leading digits; below the second, zero.
SMALL_P, LEAST_P, P_DIGITS = 1e-3, 1e-250, 3
P_COLUMNS = {"p", "normal", "chi2_1", "chi2_2", "chi2_3", "t_100", "f_2_60"}


class Data:
    """Lazy access to the source tables and the stored study tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, key: str = "0"):
        self.spark, self.sf_dir, self.key = tune(spark), sf_dir, key
        self.src = overlay_sources(spark, sf_dir)

    def table(self, name: str, *columns: str) -> DataFrame:
        return self.src.table(name, *columns)

    @cached_property
    def store(self) -> TableStore:
        return TableStore(self.spark, buckets=admission_buckets(self.spark, self.sf_dir))

    @cached_property
    def _dealt(self) -> Sources:
        return self.src.by_admission(self.store.save)

    @cached_property
    def _steps(self) -> Funnel:
        return cohort_funnel(self.dealt, self.store.save)

    @cached_property
    def _near(self) -> Sources:
        return self.dealt.of_admissions(self.steps["step7"], self.store.save)

    @cached_property
    def _wide(self) -> DataFrame:
        return self.store.save(admission_table(
            self.dealt, self.steps["step7"], self.steps.notes, self.near), "admission")

    @cached_property
    def _final(self) -> DataFrame:
        enriched = add_risk_category(enrich_outcomes(self.near, self.wide))
        return self.store.save(enriched, "final")

    @cached_property
    def _analysis(self) -> DataFrame:
        return self.store.save(add_efficiency_labels(self.final), "analysis")

    def _written(self, name: str) -> bool:
        try:
            self.spark.read.parquet(self.store.path(name))
        except AnalysisException:
            return False
        return True

    def _stored(self, attribute: str, name: str):
        """A stored table; written again if its files have gone."""
        value = getattr(self, attribute)
        if not self._written(name):
            del self.__dict__[attribute]
            value = getattr(self, attribute)
        return value

    @property
    def dealt(self) -> Sources:
        """The sources whole, their large tables dealt by admission once for every view."""
        return self._stored("_dealt", "lineitem_dealt")

    @property
    def steps(self) -> Funnel:
        return self._stored("_steps", "step7")

    @property
    def near(self) -> Sources:
        """The sources, cut down to the admissions of the final cohort."""
        return self._stored("_near", "lineitem_kept")

    @property
    def wide(self) -> DataFrame:
        return self._stored("_wide", "admission")

    @property
    def final(self) -> DataFrame:
        return self._stored("_final", "final")

    @property
    def analysis(self) -> DataFrame:
        """The final cohort with the efficiency labels every analysis shares."""
        return self._stored("_analysis", "analysis")


_DATA: dict[tuple[str, str], Data] = {}


def sources_key(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the source files' names, sizes and times; their content is not read."""
    paths = [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in BASE_TABLES]
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
             .select(F.xxhash64("path", "length", "modificationTime").alias("h")))
    row = files.agg(F.count("h").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}_{int(row.s or 0) % 2**64:016x}"


def data_for(spark: SparkSession, sf_dir: str) -> Data:
    """The data of a folder. Stored study tables are kept while its source files stay the same;
    files that have changed give new tables, and those of before expire."""
    place, key = (spark.sparkContext.applicationId, sf_dir), sources_key(spark, sf_dir)
    if place not in _DATA or _DATA[place].key != key:
        _DATA[place] = Data(spark, sf_dir, key)
    return _DATA[place]


def is_probability(name: str) -> bool:
    """Columns that hold p-values, by name; they keep their size through the logarithm."""
    return name in P_COLUMNS or name.startswith("p_")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of digits, so sums in another order compare equal.

    P-values below ``SMALL_P`` come with so many decimals that their leading digits show.
    """
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}

    def value(c: str):
        v = F.col(f"`{c}`")
        if not is_probability(c):
            # adding 0.0 turns a negative zero into zero
            return F.round(v, DIGITS) + F.lit(0.0)
        power = F.floor(F.log10(v))
        head = F.round(v / F.pow(F.lit(10.0), power), P_DIGITS)
        # as text: the double of a rounded number depends on how it is put together
        return F.when(v >= SMALL_P, F.round(v, DIGITS) + F.lit(0.0)).when(v > LEAST_P, F.concat(
            head.cast("decimal(10,3)").cast("string"), F.lit("e"),
            power.cast("string")).cast("double")).when(v.isNotNull(), F.lit(0.0))

    return df.select(*[value(c).alias(c) if c in doubles else F.col(f"`{c}`")
                       for c in df.columns])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **views: str):
    """Register ``fn(Data) -> DataFrame`` under a key, with its SQL twin.

    ``views`` names further subqueries the SQL text uses.
    """

    def register(fn: Callable[[Data], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(data_for(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_clause(sql, {**VIEWS, **COHORT_VIEWS, **views})
        return fn

    return register


def r6(expression: str, alias: str) -> str:
    """SQL: a double rounded like :func:`rounded`, named."""
    if is_probability(alias):
        v = f"CAST({expression} AS DOUBLE)"
        power = f"CAST(floor(log10({v})) AS INT)"
        return (f"CASE WHEN {v} >= {SMALL_P} THEN round({v}, {DIGITS}) + 0.0 WHEN {v} > {LEAST_P} THEN "
                f"CAST(CAST(CAST(round({v} / power(10.0, {power}), {P_DIGITS}) AS DECIMAL(10,3)) AS VARCHAR) "
                f"|| 'e' || CAST({power} AS VARCHAR) AS DOUBLE) WHEN {v} IS NOT NULL THEN 0.0 END AS {alias}")
    return f"round(CAST({expression} AS DOUBLE), {DIGITS}) + 0.0 AS {alias}"
