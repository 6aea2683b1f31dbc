"""Free-text extraction built from native regex expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def mentions(text: Column, needles: list[str]) -> Column:
    """Case-insensitive containment of any needle (given in lower case)."""
    lowered = F.lower(text)
    return any_of([lowered.contains(n) for n in needles])


def regex_first(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; NULL without a match, '' for an empty group.

    The text is searched once; the group is then read from the matched part alone.
    """
    return F.regexp_extract(F.regexp_substr(text, F.lit(pattern)), pattern, group)


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """Result of the first pattern in the list that matches at all."""
    return F.coalesce(*[regex_first(text, p) for p in patterns])


def section(text: Column, patterns: list[str], end_marker: str) -> Column:
    """Section body after the first header pattern, cut at the next header."""
    return F.split_part(first_pattern(text, patterns), F.lit(end_marker), F.lit(1))


def daily_dose(text: Column, drug: str, number: str, as_type: str, space: str,
               twice: str) -> Column:
    """First stated dose in mg, doubled if any mention is dosed twice a day."""
    amount = regex_first(text, rf"{drug}{space}*({number}){space}*mg").try_cast(as_type)
    doubled = text.rlike(rf"{drug}{space}*{number}{space}*mg{twice}")
    return amount * F.when(doubled, 2).otherwise(1)


def unnegated_mention(text: Column, mention: str, negated: str) -> Column:
    """1 if mentioned and nowhere negated, else 0 (text matched in lower case)."""
    lowered = F.lower(text)
    return F.when(lowered.rlike(mention) & ~lowered.rlike(negated), 1).otherwise(0)
