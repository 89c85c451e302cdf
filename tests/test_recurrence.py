import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import recurrence as rec


def frame(spark, values):
    rows = [("A", i, v) for i, v in enumerate(values)] + [("B", i, float(i)) for i in range(3)]
    d = spark.createDataFrame(rows, "symbol string, sec long, close double")
    return d.select("symbol", F.timestamp_seconds("sec").alias("ts"), "close")


def sequential(values, span):
    a, out = rec.ema_decay(span), []
    for v in values:
        out.append(v if not out else a * out[-1] + (1 - a) * v)
    return np.array(out)


def solved(spark, values, spans, adjust, bounded):
    got = rec.ema(frame(spark, values), "close", spans, adjust, bounded=bounded).filter("symbol = 'A'").orderBy("ts").toPandas()
    assert len(got) == len(values)
    return got


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("reach", [4, 240])
def test_spans_of_9_and_5000_together(spark, monkeypatch, bounded, reach):
    monkeypatch.setattr(rec, "RANGE", reach)
    rng = np.random.default_rng(3)
    values = 100 + np.cumsum(rng.normal(size=6000))
    values[700] = 1e20
    got = solved(spark, values.tolist(), {"fast": 9, "slow": 5000}, False, bounded)
    np.testing.assert_allclose(got.fast, sequential(values, 9), rtol=1e-9)
    np.testing.assert_allclose(got.slow, sequential(values, 5000), rtol=1e-9)
    got = solved(spark, values.tolist(), {"slow": 5000}, True, bounded)
    np.testing.assert_allclose(got.slow, pd.Series(values).ewm(span=5000, adjust=True).mean(), rtol=1e-9)


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("odd", [math.nan, math.inf, -math.inf])
def test_what_is_no_number_stays(spark, monkeypatch, bounded, odd):
    monkeypatch.setattr(rec, "RANGE", 4)
    values = [1.0] * 100 + [odd] + [2.0] * 500 + [-math.inf] + [3.0] * 100
    got = solved(spark, values, {"e": 9}, False, bounded)
    np.testing.assert_array_equal(got.e[100:], sequential(values, 9)[100:])
    np.testing.assert_allclose(got.e[:100], 1.0)


def test_no_row_is_repeated(spark):
    plan = rec.macd(frame(spark, [1.0, 2.0]))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan
