"""Tail probabilities as SQL functions of the session.

They act on one-row-per-test frames, so the iterations (a higher-order ``aggregate`` over a
short sequence) cost nothing that matters, and no Python worker is needed. The functions are
registered once per session; a tail is then one call, however large its formula, which keeps
plans with many tests quick to put together. Their arguments are bound before use.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7, n = 9) of the log gamma function
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
]
TINY = "1e-300D"
# from this size on, gamma quotients come from Stirling's series
STIRLING_FROM = 50.0


def _steps(size: str) -> str:
    """Iterations: convergence takes on the order of the square root of the size."""
    return f"sequence(1, cast(ceil(60 + 6 * sqrt(greatest(nanvl({size}, 0D), 0D))) AS INT))"


def _guard(x: str) -> str:
    return f"if(abs({x}) < {TINY}, {TINY}, {x})"


def _positive(x: str) -> str:
    """``x``, or NULL where it is no size: arguments are worked out even where a caller's
    condition then takes another branch, and must not fail there."""
    return f"if({x} > 0, {x}, NULL)"


def _bind(body: str, name: str, **values: str) -> str:
    """``body`` of ``name``'s fields, each evaluated once (a one-element transform)."""
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"transform(array(named_struct({fields})), {name} -> {body})[0]"


def _lentz(start: str, size: str, a: str, b: str) -> str:
    """Modified Lentz evaluation; ``a`` and ``b`` are numerator and denominator of step k."""
    last = _bind("named_struct('h', q.h * q.c * q.d, 'c', q.c, 'd', q.d)", "q", h="p.h",
                 c=_guard("p.b + p.a / p.c"), d=f"1D / {_guard('p.b + p.a * p.d')}")
    step = _bind(last, "p", h="s.h", c="s.c", d="s.d", a=a, b=b)
    return (f"aggregate({_steps(size)}, named_struct('h', {start}, 'c', {start}, 'd', 0D), "
            f"(s, k) -> {step}).h")


def _stirling(z: str) -> str:
    return f"(1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) + 1 / (1260 * pow({z}, 5)))"


_SERIES = " + ".join([f"{LANCZOS[0]!r}D", *[f"{c!r}D / (x + {i - 1})" for i, c in
                                           enumerate(LANCZOS) if i]])
_M = "floor(k / 2)"
_EVEN = f"{_M} * (q - {_M}) * u / ((p + 2 * {_M} - 1) * (p + 2 * {_M}))"
_ODD = f"-(p + {_M}) * (p + q + {_M}) * u / ((p + 2 * {_M}) * (p + 2 * {_M} + 1))"

#: name: (arguments, body); a later one may call those before it.
FUNCTIONS = {
    # log gamma for x >= 0.5
    "loom_log_gamma": ("x", f"{0.5 * math.log(2 * math.pi)!r}D + (x - 0.5D) * ln(x + 6.5D) - (x + 6.5D) "
                            f"+ ln({_SERIES})"),
    # log(gamma(a + b) / (gamma(a) gamma(b))) without cancellation where one side is large
    "loom_sorted_quotient": (
        "large, small",
        f"if(large >= {STIRLING_FROM}D, (large - 0.5D) * log1p(small / large) + small * ln(large + small) "
        f"- small + {_stirling('(large + small)')} - {_stirling('large')}, "
        "loom_log_gamma(large + small) - loom_log_gamma(large)) - loom_log_gamma(small)"),
    "loom_gamma_quotient": ("a, b", f"loom_sorted_quotient({_positive('greatest(a, b)')}, "
                                    f"{_positive('least(a, b)')})"),
    # regularized upper incomplete gamma: a series for small x, a continued fraction for large
    "loom_gamma_part": (
        "a, x, front",
        f"CASE WHEN x <= 0 THEN 1D WHEN x < a + 1 THEN 1 - front * aggregate({_steps('a')}, "
        "named_struct('s', 1 / a, 't', 1 / a), (s, k) -> named_struct("
        "'s', s.s + s.t * x / (a + k), 't', s.t * x / (a + k))).s "
        f"ELSE front / {_lentz(_guard('(x + 1 - a)'), 'a', '-k * (k - a)', 'x + 2 * k + 1 - a')} END"),
    "loom_upper_gamma": ("a, x", "loom_gamma_part(a, x, exp(a * ln(x) - x "
                                 f"- loom_log_gamma({_positive('a')})))"),
    "loom_beta_part": ("front, p, q, u", "front / p / " + _lentz(
        "1D", "greatest(p, q)", f"if(k % 2 = 0, {_EVEN}, {_ODD})", "1D")),
    # regularized incomplete beta; y is 1 - x, exact where x is near 1. The fraction converges
    # on one side of the mean; the other side is mirrored.
    "loom_beta_sides": (
        "a, b, x, y, front, direct",
        "CASE WHEN x <= 0 THEN 0D WHEN y <= 0 THEN 1D WHEN direct > 0 THEN loom_beta_part(front, a, b, x) "
        "ELSE 1 - loom_beta_part(front, b, a, y) END"),
    "loom_lower_beta": (
        "a, b, x, y",
        "loom_beta_sides(a, b, x, y, exp(loom_gamma_quotient(a, b) + a * if(x > 0.5D, log1p(-y), ln(x)) "
        "+ b * if(y > 0.5D, log1p(-x), ln(y))), if(x < (a + 1) / (a + b + 2), 1D, 0D))"),
    "loom_chi2_tail": ("stat, df", "loom_upper_gamma(df / 2, stat / 2)"),
    "loom_normal_two_sided": ("z", "if(z IS NOT NULL, loom_upper_gamma(0.5D, z * z / 2), NULL)"),
    "loom_t_two_sided": (
        "t, df", "if(t IS NOT NULL AND df IS NOT NULL, loom_lower_beta(df / 2, 0.5D, df / nullif(df + t * t, 0D), "
                 "t * t / nullif(df + t * t, 0D)), NULL)"),
    "loom_f_tail": (
        "stat, df1, df2",
        "if(stat IS NOT NULL, loom_lower_beta(df2 / 2, df1 / 2, df2 / nullif(df2 + df1 * stat, 0D), "
        "df1 * stat / nullif(df2 + df1 * stat, 0D)), NULL)"),
}
_MARK = "cohortloom.tails"


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, once."""
    if spark.conf.get(_MARK, None) == "1":
        return
    for name, (arguments, body) in FUNCTIONS.items():
        typed = ", ".join(f"{a.strip()} DOUBLE" for a in arguments.split(","))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({typed}) RETURNS DOUBLE RETURN {body}")
    spark.conf.set(_MARK, "1")


def _call(name: str, *arguments: Column) -> Column:
    register(SparkSession.active())
    return F.call_function(name, *[a.cast("double") for a in arguments])


def chi2_tail(stat: Column, df: Column) -> Column:
    """P(chi-square with df degrees of freedom > stat)."""
    return _call("loom_chi2_tail", stat, df)


def normal_two_sided(z: Column) -> Column:
    """2 * P(N(0,1) > |z|), from the chi-square with one degree of freedom."""
    return _call("loom_normal_two_sided", z)


def t_two_sided(t: Column, df: Column) -> Column:
    """2 * P(T > |t|)."""
    return _call("loom_t_two_sided", t, df)


def f_tail(stat: Column, df1: Column, df2: Column) -> Column:
    """P(F > stat)."""
    return _call("loom_f_tail", stat, df1, df2)
