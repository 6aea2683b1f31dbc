"""Row predicates over code sets, allow-lists and plausible ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of

CodeSet = list[tuple[str, int | None, str]]


def code_match(code: Column, version: Column, codes: CodeSet) -> Column:
    """True where (code, version) is in the set; reaches the scan as In/StartsWith."""
    exact: dict[int | None, list[str]] = {}
    tests: list[Column] = []
    for value, ver, how in codes:
        if how == "exact":
            exact.setdefault(ver, []).append(value)
        else:
            test = code.startswith(value)
            tests.append(test if ver is None else test & (version == ver))
    for ver, values in exact.items():
        test = code.isin(values)
        tests.append(test if ver is None else test & (version == ver))
    return any_of(tests)


def codeset_filter(df: DataFrame, code: str, version: str, codes: CodeSet) -> DataFrame:
    return df.filter(code_match(F.col(code), F.col(version), codes))


def category_allowlist(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.filter(F.col(column).isin(allowed))


def require_not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def plausible_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def unpivot(df: DataFrame, keep: list[str], columns: list[str], as_type: str,
            name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long, one row per (input row, column), values cast to one type."""
    entries = F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast(as_type).alias(value))
        for c in columns])
    return df.select(*keep, F.inline(entries))
