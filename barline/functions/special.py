"""Special functions as column expressions: log gamma, the regularised incomplete beta function, Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Lanczos' approximation with g = 7 and nine terms, good to about 15 digits.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Steps of the continued fraction; it settles after about the root of the larger parameter.
STEPS = 500


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 0.5."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (x - 1 + i)
    t = x - 0.5 + LANCZOS_G
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.ln(t) - t + F.ln(series)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz' method from the front."""
    one = F.lit(1.0)

    def fed(state: Column, term: Column) -> Column:
        d = one / (one + term * state["d"])
        c = one + term / state["c"]
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # A one-element array binds the state between the two terms.
        half = F.transform(F.array(fed(state, even)), lambda s: fed(s, odd))
        return F.get(half, F.lit(0))

    first = one / (one - (a + b) * x / (a + 1))
    start = F.struct(one.alias("c"), first.alias("d"), first.alias("h"))
    ms = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double"))
    return F.aggregate(ms, start, step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column, y: Column | None = None) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b >= 0.5; null outside 0 <= x <= 1.

    y: 1 - x, for callers who know it better than the difference does.
    """
    y = 1 - x if y is None else y
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(y))
    inside = F.when(x < (a + 1) / (a + b + 2), front * _fraction(x, a, b) / a).otherwise(1 - front * _fraction(y, b, a) / b)
    return F.when(x == 0, F.lit(0.0)).when(y == 0, F.lit(1.0)).when((x > 0) & (y > 0), inside)


def t_two_sided(t: Column, df: Column) -> Column:
    """The chance of a t statistic at least as far from 0 with ``df`` >= 1 degrees of freedom; null without one."""
    df = df.cast("double")
    return F.when(df >= 1, incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5), t * t / (df + t * t)))
