"""Hand-computed series for the rolling columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions import windows as w
from barline.operators import aggregates as agg
from barline.operators.ordered import BARS


@pytest.fixture
def series(spark):
    def make(values, name="close"):
        rows = [("A", i, None if v is None else float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, f"symbol string, ts long, {name} double")

    return make


def values(df, col):
    return [r[col] for r in df.orderBy("ts").select(col).collect()]


def test_ramp_means(series):
    d = series(range(1, 11))
    assert values(d.withColumn("x", w.sma("close", 3)), "x")[:4] == [None, None, 2.0, 3.0]
    assert values(d.withColumn("x", w.sma_partial("close", 3)), "x")[:3] == [1.0, 1.5, 2.0]
    assert values(d.withColumn("x", w.sma_zero("close", 3)), "x")[:3] == [0.0, 0.0, 2.0]
    assert values(d.withColumn("x", w.wma("close", 3)), "x")[2] == pytest.approx((1 + 4 + 9) / 6)


def test_drawdown(series):
    d = series([100, 110, 90, 95, 100]).withColumn("peak", F.max("close").over(BARS.upto()))
    out = values(d.withColumn("x", (F.col("close") - F.col("peak")) / F.col("peak")), "x")
    assert min(out) == pytest.approx(-20 / 110) and max(out) == 0


def test_fills_and_interpolation(series):
    d = series([1, None, 3, None, 5, None])
    assert values(d.withColumn("x", w.fill_forward("close")), "x") == [1, 1, 3, 3, 5, 5]
    assert values(w.with_interpolation(d, "close", "x"), "x") == [1, 2, 3, 4, 5, 5]
    head = series([None, 2, None, 4])
    assert values(w.with_interpolation(head, "close", "x"), "x") == [None, 2, 3, 4]
    assert values(head.withColumn("x", w.fill_both("close", default=0.0)), "x") == [2, 2, 2, 4]
    empty = series([None, None])
    assert values(empty.withColumn("x", w.fill_both("close", default=0.0)), "x") == [0, 0]


def test_rsi_edges(series):
    flat, up = series([5.0] * 20), series(range(20))
    assert values(w.with_rsi(flat, "strict"), "rsi")[-1] is None
    assert values(w.with_rsi(flat, "null_loss"), "rsi")[-1] is None
    assert values(w.with_rsi(flat, "last14"), "rsi")[-1] == 100.0
    strict = values(w.with_rsi(up, "strict"), "rsi")
    assert strict[:13] == [None] * 13 and strict[13] == 100.0
    assert values(w.with_rsi(up, "last14"), "rsi")[13:15] == [50.0, 100.0]
    with pytest.raises(ValueError):
        w.with_rsi(up, "other")


def test_zero_base_gives_null(series):
    assert values(series([0, 5, 10]).withColumn("x", w.change("close")), "x") == [None, None, 1.0]


def test_rolling_against_pandas(bars, pbars):
    d = bars.withColumn("r", w.change("close")).withColumns({"v": w.volatility("r", 20), "c": w.rolling_corr("close", "volume", 24)})
    got = w.with_stochastic(w.with_atr(d)).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    g = pbars.groupby("symbol")
    ret = g.close.pct_change(fill_method=None)
    np.testing.assert_allclose(got.v.astype(float), ret.groupby(pbars.symbol).transform(lambda x: x.rolling(20).std()), rtol=1e-8)
    want = pd.concat([x.close.rolling(24).corr(x.volume) for _, x in g])
    np.testing.assert_allclose(got.c.astype(float), want.to_numpy(), rtol=1e-6, atol=1e-9)


def test_matrix_beta_sharpe(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(0, 0.01, 100)
    a = 1.5 * m + rng.normal(0, 0.001, 100)
    d = spark.createDataFrame(pd.DataFrame({"a": a, "m": m}))
    row = d.agg(agg.beta("a", "m").alias("b"), agg.sharpe_samp("a").alias("s")).first()
    assert row.b == pytest.approx(np.cov(a, m)[0, 1] / m.var(ddof=1))
    assert row.s == pytest.approx((a.mean() - 0.02 / 252) * 252 / (a.std(ddof=1) * 252**0.5))
    corr = {(r.c1, r.c2): r.corr for r in agg.correlation_matrix(d, ["a", "m"]).collect()}
    assert corr["a", "a"] == 1.0 and corr["a", "m"] == corr["m", "a"] == pytest.approx(np.corrcoef(a, m)[0, 1])
    assert d.limit(1).agg(agg.beta("a", "m").alias("b")).first().b == 1.0


def test_resample_is_associative(bars):
    from barline.operators.resample import resample

    def rows(df):
        return [tuple(r) for r in df.orderBy("symbol", "ts").collect()]

    assert rows(resample(resample(bars, "4h"), "1d")) == rows(resample(bars, "1d"))
