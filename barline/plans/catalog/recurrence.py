"""REC: linear recurrences, running sums and products."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import windows as w
from barline.operators import ordered, recurrence as rec
from barline.operators.ordered import BARS as S
from barline.plans.catalog import BARS, W, query, rows
from barline.sources.tables import Tables

NUMBERED = f"n AS (SELECT *, row_number() OVER {W} AS rn FROM bars)"


def ewm(x: str, span: float, out: str, adjust: bool, source: str) -> str:
    """Recursive CTEs for one exponential mean of ``source`` (symbol, ts, rn, x)."""
    a = f"(1 - 2.0::DOUBLE / ({span} + 1))"
    if adjust:
        return f"""{out}(symbol, ts, rn, num, den) AS (SELECT symbol, ts, rn, {x}::DOUBLE, 1.0::DOUBLE FROM {source} WHERE rn = 1
          UNION ALL SELECT s.symbol, s.ts, s.rn, s.{x} + {a} * p.num, 1.0 + {a} * p.den FROM {out} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""
    return f"""{out}(symbol, ts, rn, num, den) AS (SELECT symbol, ts, rn, {x}::DOUBLE, 1.0::DOUBLE FROM {source} WHERE rn = 1
      UNION ALL SELECT s.symbol, s.ts, s.rn, (1 - {a}) * s.{x} + {a} * p.num, 1.0::DOUBLE FROM {out} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


for _adjust, _name in ((True, "rec01_ema_adjusted"), (False, "rec02_ema_recursive")):

    def _register(adjust: bool, name: str) -> None:
        @query(name,
               f"WITH RECURSIVE {BARS}, {NUMBERED}, {ewm('close', 12, 'a', adjust, 'n')}, {ewm('close', 26, 'b', adjust, 'n')} "
               "SELECT a.symbol, a.ts, a.num / a.den AS ema12, b.num / b.den AS ema26 FROM a JOIN b USING (symbol, rn)",
               "symbol, ts", "ema12, ema26")
        def _(t: Tables) -> DataFrame:
            return rec.ema(t.hourly(), "close", {"ema12": 12, "ema26": 26}, adjust, bounded=True)

    _register(_adjust, _name)


@query("rec02_ema_ticks",
       f"WITH RECURSIVE n AS (SELECT event_type AS symbol, event_id AS ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events), "
       f"{ewm('value', 12, 'a', False, 'n')} SELECT a.ts AS event_id, a.num AS ema12 FROM a", "event_id", "ema12")
def _(t: Tables) -> DataFrame:
    return rec.ema(t.ticks(), "price", {"ema12": 12}, adjust=False)


for _adjust, _name in ((True, "rec03_macd_adjusted"), (False, "rec03_macd_recursive")):

    def _register_macd(adjust: bool, name: str) -> None:
        @query(name,
               f"""WITH RECURSIVE {BARS}, {NUMBERED}, {ewm('close', 12, 'a', adjust, 'n')}, {ewm('close', 26, 'b', adjust, 'n')},
               m AS (SELECT a.symbol, a.ts, a.rn, a.num / a.den - b.num / b.den AS macd FROM a JOIN b USING (symbol, rn)), {ewm('macd', 9, 'g', adjust, 'm')}
               SELECT m.symbol, m.ts, macd, num / den AS macd_signal, macd - num / den AS macd_hist FROM m JOIN g USING (symbol, rn)""",
               "symbol, ts", "macd, macd_signal, macd_hist")
        def _(t: Tables) -> DataFrame:
            return rec.macd(t.hourly(), adjust=adjust, bounded=True)

    _register_macd(_adjust, _name)


@query("rec04_wilder_rsi",
       f"""WITH RECURSIVE {BARS}, {NUMBERED}, d AS (SELECT *, greatest(coalesce(close - lag(close) OVER {W}, 0), 0) AS gain,
         greatest(coalesce(lag(close) OVER {W} - close, 0), 0) AS loss FROM n),
       s AS (SELECT symbol, avg(gain) AS g, avg(loss) AS l FROM d WHERE rn BETWEEN 2 AND 15 GROUP BY 1),
       y(symbol, ts, rn, g, l) AS (SELECT d.symbol, d.ts, d.rn, s.g, s.l FROM d JOIN s USING (symbol) WHERE rn = 15
         UNION ALL SELECT d.symbol, d.ts, d.rn, (y.g * 13 + d.gain) / 14, (y.l * 13 + d.loss) / 14 FROM y JOIN d ON d.symbol = y.symbol AND d.rn = y.rn + 1)
       SELECT n.symbol, n.ts, CASE WHEN y.rn IS NULL THEN 0.0 ELSE 100 - 100 / (1 + y.g / (y.l + 1e-10)) END AS rsi_wilder
       FROM n LEFT JOIN y USING (symbol, rn)""",
       "symbol, ts", "rsi_wilder")
def _(t: Tables) -> DataFrame:
    return rec.wilder_rsi(t.hourly(), bounded=True)


@query("rec05_equity",
       f"WITH {BARS}, r AS (SELECT *, 1 + 0.01 * (close - open) / (close + open + 1) AS g FROM bars) "
       "SELECT symbol, ts, exp(sum(ln(g)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS total_return FROM r",
       "symbol, ts", "total_return")
def _(t: Tables) -> DataFrame:
    step = 0.01 * (F.col("close") - F.col("open")) / (F.col("close") + F.col("open") + 1)
    grown = ordered.running(t.hourly(), {"_log": ordered.Running("sum", F.log1p(step))}, bounded=True)
    return grown.withColumn("total_return", F.exp("_log") - 1)


TRN = f"t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM n)"


@query("rec06_wilder_atr",
       f"""WITH RECURSIVE {BARS}, {NUMBERED}, {TRN}, s AS (SELECT symbol, avg(tr) AS seed FROM t WHERE rn <= 14 GROUP BY 1),
       y(symbol, rn, v) AS (SELECT t.symbol, t.rn, s.seed FROM t JOIN s USING (symbol) WHERE rn = 14
         UNION ALL SELECT t.symbol, t.rn, (y.v * 13 + t.tr) / 14 FROM y JOIN t ON t.symbol = y.symbol AND t.rn = y.rn + 1)
       SELECT n.symbol, n.ts, coalesce(v, 0.0) AS atr_wilder FROM n LEFT JOIN y USING (symbol, rn)""",
       "symbol, ts", "atr_wilder")
def _(t: Tables) -> DataFrame:
    return rec.atr_smoothed(t.hourly(), how="wilder", bounded=True)


@query("rec07_ewm_atr",
       f"WITH RECURSIVE {BARS}, {NUMBERED}, {TRN}, {ewm('tr', 14, 'y', False, 't')} SELECT symbol, ts, num AS atr_ewm FROM y",
       "symbol, ts", "atr_ewm")
def _(t: Tables) -> DataFrame:
    return rec.atr_smoothed(t.hourly(), how="ewm", bounded=True)


@query("rec08_obv",
       f"""WITH {BARS}, d AS (SELECT *, sign(close - lag(close) OVER {W}) * volume AS step, first_value(volume) OVER {W} AS v0 FROM bars),
       o AS (SELECT *, v0 + sum(coalesce(step, 0)) OVER {W} AS obv, sum(step) OVER {W} AS obv0 FROM d)
       SELECT symbol, ts, obv, obv0, CASE WHEN count(obv0) OVER {rows(20)} >= 20 THEN (obv0 - avg(obv0) OVER {rows(20)}) / (stddev_samp(obv0) OVER {rows(20)} + 1e-10) END AS obv_z FROM o""",
       "symbol, ts", "obv, obv0, obv_z")
def _(t: Tables) -> DataFrame:
    step = F.signum(F.col("close") - F.lag("close").over(S.spec())) * F.col("volume")
    df = t.hourly().withColumn("_step", step)
    start = F.first("volume").over(S.upto())
    df = df.withColumn("obv0", F.sum("_step").over(S.upto())).withColumn("obv", start + F.coalesce("obv0", F.lit(0.0)))
    mean, sd = w.sma("obv0", 20), w.volatility("obv0", 20)
    return df.withColumn("obv_z", (F.col("obv0") - mean) / (sd + 1e-10))


@query("rec08_obv_ticks",
       """WITH d AS (SELECT event_id, event_type, ts, sign(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts)) AS step FROM events)
       SELECT event_id, sum(step) OVER (PARTITION BY event_type ORDER BY ts) AS obv FROM d""",
       "event_id", "obv")
def _(t: Tables) -> DataFrame:
    stepped = ordered.rolling(
        t.ticks(), lambda d, s: d.withColumn("step", F.signum(F.col("price") - F.lag("price").over(s.spec()))), halo=1)
    return ordered.running(stepped, {"obv": ordered.Running("sum", F.col("step"))})


@query("rec09_accumulation",
       f"""WITH {BARS}, f AS (SELECT *, CASE WHEN row_number() OVER {W} = 1 THEN 0.0
         ELSE ((close - low) - (high - close)) / (high - low + 1e-10) * volume END AS step FROM bars)
       SELECT symbol, ts, sum(step) OVER {W} AS ad_line FROM f""",
       "symbol, ts", "ad_line")
def _(t: Tables) -> DataFrame:
    flow = ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / (
        F.col("high") - F.col("low") + 1e-10) * F.col("volume")
    first = F.row_number().over(S.spec()) == 1
    df = t.hourly().withColumn("_flow", F.when(first, 0.0).otherwise(flow))
    return ordered.running(df, {"ad_line": ordered.Running("sum", F.col("_flow"))}, bounded=True)


@query("rec10_indicator_batch",
       f"""WITH RECURSIVE {BARS}, {NUMBERED}, {ewm('close', 12, 'e', False, 'n')},
       d AS (SELECT *, close - lag(close) OVER {W} AS m FROM n), g AS (SELECT *, CASE WHEN m > 0 THEN m ELSE 0.0 END AS gain, CASE WHEN m < 0 THEN -m ELSE 0.0 END AS loss FROM d)
       SELECT g.symbol, g.ts, avg(close) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS 19 PRECEDING) AS sma_20, e.num AS ema_12,
         100 - 100 / (1 + avg(gain) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS 13 PRECEDING) / (avg(loss) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS 13 PRECEDING) + 1e-10)) AS rsi
       FROM g JOIN e USING (symbol, rn)""",
       "symbol, ts", "sma_20, ema_12, rsi")
def _(t: Tables) -> DataFrame:
    from barline.plans.indicators import batch

    return batch(t.hourly(), ["sma_20", "ema_12", "rsi"])
