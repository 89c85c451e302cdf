import math

import pytest
from pyspark.sql import functions as F

from barline.functions import special


def p_value(t, df):
    """The finite series for whole degrees of freedom."""
    th = math.atan(abs(t) / math.sqrt(df))
    term, total = 1.0, 0.0
    for k in range((df - 1) // 2 if df % 2 else df // 2):
        if k:
            term *= (2 * k / (2 * k + 1) if df % 2 else (2 * k - 1) / (2 * k)) * math.cos(th) ** 2
        total += term
    if df % 2:
        return 1 - 2 / math.pi * (th + (math.sin(th) * math.cos(th) * total if df > 1 else 0))
    return 1 - math.sin(th) * total


def test_p_values(spark):
    cases = [(t, df) for t in (-30.0, -2.5, -0.1, 0.0, 1e-9, 0.7, 1.96, 3.3, 8.0) for df in (1, 2, 3, 4, 9, 30, 101, 2000, 40_000)]
    d = spark.createDataFrame(cases + [(1.0, 0), (None, 5)], "t double, df long")
    got = d.select("t", "df", special.t_two_sided(F.col("t"), F.col("df")).alias("p"), special.log_gamma(F.col("df") / 2 + 0.5).alias("g")).collect()
    for r in got:
        if r.t is None or r.df < 1:
            assert r.p is None
        else:
            assert r.p == pytest.approx(p_value(r.t, r.df), abs=1e-10), (r.t, r.df)
            assert r.g == pytest.approx(math.lgamma(r.df / 2 + 0.5), rel=1e-12, abs=1e-12)
