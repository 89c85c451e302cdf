"""Chunked series give the same numbers as whole-symbol windows and as pandas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import windows as w
from barline.operators import ordered, recurrence as rec


def collect(df, *cols):
    return df.select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"], ignore_index=True)


def test_numbering_matches_row_number(bars):
    a = collect(ordered.numbered(bars), "_pos")
    b = collect(ordered.numbered(bars, bounded=True), "_pos")
    assert a._pos.tolist() == b._pos.tolist()


@pytest.mark.parametrize("rows", [7, 64])
def test_rolling_chunks(bars, rows):
    build = lambda d, s: w.with_rsi(d.withColumn("sma", w.sma("close", 20, s)), "strict", s=s)
    a = collect(ordered.rolling(bars, build, halo=21, rows=rows), "sma", "rsi")
    b = collect(build(bars, ordered.BARS), "sma", "rsi")
    np.testing.assert_allclose(a[["sma", "rsi"]], b[["sma", "rsi"]], rtol=1e-12)


def test_running_chunks(bars, pbars):
    spiky = F.when(F.col("volume") > 40, F.col("close"))
    aggs = {
        "total": ordered.Running("sum", F.col("volume")),
        "peak": ordered.Running("max", F.col("close")),
        "low_": ordered.Running("min", F.col("close")),
        "seen": ordered.Running("last", spiky),
    }
    a = collect(ordered.running(bars, aggs, rows=16), *aggs)
    b = collect(ordered.running(bars, aggs, bounded=True), *aggs)
    np.testing.assert_allclose(a[list(aggs)].astype(float), b[list(aggs)].astype(float), rtol=1e-12)
    g = pbars.groupby("symbol")
    np.testing.assert_allclose(a.total, g.volume.cumsum())
    np.testing.assert_allclose(a.seen.astype(float), pbars.close.where(pbars.volume > 40).groupby(pbars.symbol).ffill())


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("span", [2, 12, 26, 200])
def test_ema_matches_pandas(bars, pbars, span, adjust):
    got = collect(rec.ema(bars, "close", {"e": span}, adjust, bounded=True), "e")
    want = pbars.groupby("symbol").close.transform(lambda x: x.ewm(span=span, adjust=adjust).mean())
    np.testing.assert_allclose(got.e, want, rtol=1e-11)


def test_ema_without_bound(bars, pbars):
    got = collect(rec.ema(bars, "close", {"e": 12, "f": 26}, False), "e", "f")
    np.testing.assert_allclose(got.f, pbars.groupby("symbol").close.transform(lambda x: x.ewm(span=26, adjust=False).mean()), rtol=1e-11)


def test_long_series_uses_many_blocks(spark):
    import pandas as pd

    x = spark.range(20_000).select(F.lit("A").alias("symbol"), F.col("id").alias("ts"), (F.col("id") % 97 + F.col("id") % 13).cast("double").alias("close"))
    got = rec.macd(x, adjust=False, bounded=False).toPandas().sort_values("ts")
    c = pd.Series([float(i % 97 + i % 13) for i in range(20_000)])
    m = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got.macd, m, atol=1e-9)
    np.testing.assert_allclose(got.macd_signal, m.ewm(span=9, adjust=False).mean(), atol=1e-9)


def test_wilder_forms(bars, pbars):
    got = collect(rec.wilder_rsi(bars, bounded=True), "rsi_wilder")
    for symbol, g in pbars.groupby("symbol"):
        d = np.diff(g.close.to_numpy())
        out = np.zeros(len(g))
        if len(d) >= 14:
            up, down = np.maximum(d, 0), np.maximum(-d, 0)
            a, b = up[:14].mean(), down[:14].mean()
            out[14] = 100 - 100 / (1 + a / (b + 1e-10))
            for i in range(14, len(d)):
                a, b = (a * 13 + up[i]) / 14, (b * 13 + down[i]) / 14
                out[i + 1] = 100 - 100 / (1 + a / (b + 1e-10))
        np.testing.assert_allclose(got.rsi_wilder[got.symbol == symbol], out, rtol=1e-10)


def test_scratch_folder_comes_from_the_session(spark):
    from barline.session import scratch_path

    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
