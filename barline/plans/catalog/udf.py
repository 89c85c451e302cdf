"""UDF: strategies, per-series functions and custom rolling functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barline import udf
from barline.functions import signals as sg, windows as w
from barline.plans.catalog import BARS, W, query, rows
from barline.plans.catalog.windows import MOVES, RSI
from barline.sources.tables import Tables


class RsiStrategy:
    name = "rsi"

    def transform(self, bars: DataFrame) -> DataFrame:
        return sg.rsi_events(bars).withColumn("params", F.create_map(F.lit("period"), F.lit("14")))


class MoveStrategy:
    name = "move"

    def transform(self, bars: DataFrame) -> DataFrame:
        d = bars.withColumn("side", sg.threshold_move("close", 0.02)).filter("side <> 0")
        return d.withColumns({"direction": F.when(F.col("side") > 0, "long").otherwise("short"), "strength": F.lit(1.0),
                              "params": F.create_map(F.lit("threshold"), F.lit("0.02"))})


RSI_SQL = f"""{MOVES.removesuffix('SELECT symbol, ts, ').rstrip()}, r AS (SELECT *, {RSI['strict_eps8']} AS rsi FROM a),
  e AS (SELECT 'rsi' AS strategy, symbol, ts, CASE WHEN rsi < 30 THEN 'long' ELSE 'short' END AS direction, CASE WHEN rsi < 30 THEN (30 - rsi) / 30 ELSE (rsi - 70) / 30 END AS strength FROM r WHERE rn > 14 AND (rsi < 30 OR rsi > 70)),
  v AS (SELECT symbol, ts, close / nullif(lag(close) OVER {W}, 0) - 1 AS d FROM bars), mo AS (SELECT 'move' AS strategy, symbol, ts, CASE WHEN d > 0.02 THEN 'long' ELSE 'short' END AS direction, 1.0 AS strength FROM v WHERE abs(d) > 0.02)"""


@query("udf01_strategy", f"{RSI_SQL} SELECT * FROM e", "strategy, symbol, ts, direction", "strength")
def _(t: Tables) -> DataFrame:
    return udf.run_strategy(RsiStrategy(), t.hourly())


def _spread(rows: pd.DataFrame) -> float:
    if rows["symbol"].iloc[0] == "error":
        raise ValueError("refused")
    return float(rows["close"].max() - rows["close"].min())


@query("udf02_per_series",
       f"WITH {BARS} SELECT symbol, symbol <> 'error' AS success, CASE WHEN symbol = 'error' THEN 'ValueError: refused' END AS error, count(*) AS data_size, CASE WHEN symbol <> 'error' THEN max(close) - min(close) END AS spread FROM bars GROUP BY 1",
       "symbol, success, error, data_size", "spread")
def _(t: Tables) -> DataFrame:
    return udf.apply_per_series(t.hourly(), _spread, "spread")


def _longest_rise(state: tuple, rows: pd.DataFrame) -> tuple:
    """(last price, length of the run at the end, longest run): rows pass in pieces, a run may cross them."""
    if (rows["symbol"] == "error").any():
        raise ValueError("refused")
    last, run, longest = state
    for price in rows["price"]:
        run = run + 1 if last is not None and price > last else 0
        last, longest = price, max(longest, run)
    return last, run, longest


@query("udf02_folded_series",
       """WITH d AS (SELECT event_type AS symbol, ts, event_id, value > lag(value) OVER w AS up FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
       g AS (SELECT symbol, up, count(*) FILTER (up IS NOT TRUE) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS g FROM d), r AS (SELECT symbol, g, count(*) FILTER (up) AS n, count(*) AS c FROM g GROUP BY 1, 2)
       SELECT symbol, symbol <> 'error' AS success, CASE WHEN symbol = 'error' THEN 'ValueError: refused' END AS error, sum(c)::BIGINT AS data_size, CASE WHEN symbol <> 'error' THEN max(n) END AS longest_rise FROM r GROUP BY 1""",
       "symbol, success, error, data_size", "longest_rise")
def _(t: Tables) -> DataFrame:
    return udf.reduce_series(t.ticks(), lambda: (None, 0, 0), _longest_rise, lambda s: s[2], ["symbol"], ["ts", "event_id"], "longest_rise")


@query("udf03_rolling_function",
       f"WITH {BARS} SELECT symbol, ts, CASE WHEN count(close) OVER {rows(10)} >= 10 THEN max(close) OVER {rows(10)} - avg(close) OVER {rows(10)} END AS above_mean FROM bars", "symbol, ts", "above_mean")
def _(t: Tables) -> DataFrame:
    def fold(a):
        return F.array_max(a) - F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    return t.hourly().withColumn("above_mean", w.rolling_apply("close", 10, fold))


@query("udf04_strategies", f"{RSI_SQL}, u AS (SELECT * FROM e UNION ALL SELECT * FROM mo) SELECT strategy, symbol, count(*) AS n, sum(strength) AS total FROM u GROUP BY 1, 2", "strategy, symbol, n", "total")
def _(t: Tables) -> DataFrame:
    out = udf.run_strategies([RsiStrategy(), MoveStrategy()], t.hourly_stored())
    return out.groupBy("strategy", "symbol").agg(F.count("*").alias("n"), F.sum("strength").alias("total"))
