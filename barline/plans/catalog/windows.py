"""WIN: rolling and analytic windows over hourly bars, and over raw ticks where chunking matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import windows as w
from barline.operators import ordered
from barline.operators.ordered import BARS as S
from barline.plans.catalog import BARS, DAYS, W, query, rows, strict
from barline.sources.tables import Tables

FROM = f"WITH {BARS} SELECT symbol, ts, "


@query("win01_sma_strict", FROM + f"{strict('avg', 'close', 20)} AS sma20, {strict('avg', 'close', 50)} AS sma50 FROM bars",
       "symbol, ts", "sma20, sma50")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumns({"sma20": w.sma("close", 20), "sma50": w.sma("close", 50)})


@query("win01_sma_ticks",
       "SELECT event_id, CASE WHEN count(value) OVER win >= 20 THEN avg(value) OVER win END AS sma20, "
       "max(value) OVER win AS hi20 FROM events "
       "WINDOW win AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
       "event_id", "sma20, hi20")
def _(t: Tables) -> DataFrame:
    def build(d: DataFrame, s: ordered.Series) -> DataFrame:
        return d.withColumns({"sma20": w.sma("price", 20, s), "hi20": F.max("price").over(s.last(20))})

    return ordered.rolling(t.ticks(), build, halo=19)


@query("win02_sma_partial", FROM + f"avg(close) OVER {rows(20)} AS sma20 FROM bars", "symbol, ts", "sma20")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumn("sma20", w.sma_partial("close", 20))


@query("win03_sma_zero", FROM + f"coalesce({strict('avg', 'close', 20)}, 0.0) AS sma20 FROM bars", "symbol, ts", "sma20")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumn("sma20", w.sma_zero("close", 20))


@query("win04_wma",
       FROM + "(" + " + ".join(f"lag(close, {b}) OVER {W} * {10 - b}" for b in range(10)) + ") / 55.0 AS wma10 FROM bars",
       "symbol, ts", "wma10")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumn("wma10", w.wma("close", 10))


@query("win05_volatility",
       f"WITH {BARS}, r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM bars) "
       f"SELECT symbol, ts, {strict('stddev_samp', 'ret', 20)} AS vol20, sqrt(252.0) * ({strict('stddev_samp', 'ret', 20)}) AS vol20_annual FROM r",
       "symbol, ts", "vol20, vol20_annual")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumn("ret", w.change("close")).withColumns(
        {"vol20": w.volatility("ret", 20), "vol20_annual": w.volatility("ret", 20, annual=252)})


RETS = {k: f"close / nullif(lag(close, {k}) OVER {W}, 0) - 1 AS ret{k}" for k in (1, 5, 20, 24, 168)}


@query("win06_returns",
       FROM + ", ".join(RETS.values()) + f", ln(CASE WHEN close > 0 THEN close END / CASE WHEN lag(close) OVER {W} > 0 THEN lag(close) OVER {W} END) AS log1 FROM bars",
       "symbol, ts", "ret1, ret5, ret20, ret24, ret168, log1")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumns(
        {**{f"ret{k}": w.change("close", k) for k in RETS}, "log1": w.log_change("close")})


@query("win07_roc", FROM + f"(close / nullif(lag(close, 10) OVER {W}, 0) - 1) * 100 AS roc, close / nullif(lag(close, 10) OVER {W}, 0) - 1 AS momentum FROM bars",
       "symbol, ts", "roc, momentum")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumns({"roc": w.roc("close", 10), "momentum": w.change("close", 10)})


MOVES = (f"WITH {BARS}, m AS (SELECT *, close - lag(close) OVER {W} AS d FROM bars), "
         "g AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS loss FROM m), "
         f"a AS (SELECT *, avg(gain) OVER {rows(14)} AS ag, avg(loss) OVER {rows(14)} AS al, row_number() OVER {W} AS rn FROM g) "
         "SELECT symbol, ts, ")
RSI = {
    "strict": "CASE WHEN rn >= 14 THEN CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100 END END",
    "partial": "100 - 100 / (1 + ag / (al + 1e-10))",
    "strict_eps": "CASE WHEN rn >= 14 THEN 100 - 100 / (1 + ag / (al + 1e-10)) END",
    "strict_eps8": "CASE WHEN rn >= 14 THEN 100 - 100 / (1 + ag / (al + 1e-8)) END",
    "null_loss": "CASE WHEN rn >= 14 AND al > 0 THEN 100 - 100 / (1 + ag / al) END",
    "last14": "CASE WHEN rn < 15 THEN 50 WHEN al > 0 THEN 100 - 100 / (1 + ag / al) ELSE 100 END",
}


def _rsi(variant: str):
    @query(f"win08_rsi_{variant}", MOVES + RSI[variant] + " AS rsi FROM a", "symbol, ts", "rsi")
    def _(t: Tables) -> DataFrame:
        return w.with_rsi(t.hourly(), variant)


for _v in RSI:
    _rsi(_v)


@query("win09_bollinger",
       FROM + f"{strict('avg', 'close', 20)} AS bb_mid, {strict('avg', 'close', 20)} + 2 * ({strict('stddev_samp', 'close', 20)}) AS bb_upper, "
       f"{strict('avg', 'close', 20)} - 2 * ({strict('stddev_samp', 'close', 20)}) AS bb_lower, "
       f"avg(close) OVER {rows(20)} + 2 * stddev_samp(close) OVER {rows(20)} AS partial_upper FROM bars",
       "symbol, ts", "bb_mid, bb_upper, bb_lower, partial_upper")
def _(t: Tables) -> DataFrame:
    partial = w.bollinger(partial=True)["bb_upper"]
    return t.hourly().withColumns({**w.bollinger(), "partial_upper": partial})


@query("win10_band_features",
       f"WITH {BARS}, b AS (SELECT *, {strict('avg', 'close', 20)} AS m, {strict('stddev_samp', 'close', 20)} AS sd FROM bars), "
       "f AS (SELECT *, (m + 2 * sd - close) / nullif(close, 0) AS bb_upper_dist, (close - m + 2 * sd) / nullif(close, 0) AS bb_lower_dist, "
       "4 * sd / (m + 1e-10) AS bb_width, (close - m) / (2 * sd + 1e-10) AS bb_position FROM b) "
       f"SELECT *, coalesce(bb_width < {strict('avg', 'bb_width', 20)}, false) AS bb_squeeze FROM f",
       "symbol, ts, bb_squeeze", "bb_upper_dist, bb_lower_dist, bb_width, bb_position")
def _(t: Tables) -> DataFrame:
    return w.with_band_features(t.hourly())


@query("win11_stochastic",
       f"WITH {BARS}, k AS (SELECT *, 100 * (close - min(low) OVER {rows(14)}) / (max(high) OVER {rows(14)} - min(low) OVER {rows(14)} + 1e-10) AS stoch_k FROM bars) "
       f"SELECT *, avg(stoch_k) OVER {rows(3)} AS stoch_d FROM k",
       "symbol, ts", "stoch_k, stoch_d")
def _(t: Tables) -> DataFrame:
    return w.with_stochastic(t.hourly())


TR = (f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM bars)")


@query("win12_atr",
       f"WITH {BARS}, {TR} SELECT *, {strict('avg', 'tr', 14)} AS atr, ({strict('avg', 'tr', 14)}) / (close + 1e-10) AS atr_pct FROM tr",
       "symbol, ts", "atr, atr_pct")
def _(t: Tables) -> DataFrame:
    return w.with_atr(t.hourly(), relative=True)


UPTO = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("win13_drawdown", FROM + f"(close - max(close) OVER {UPTO}) / nullif(max(close) OVER {UPTO}, 0) AS drawdown FROM bars",
       "symbol, ts", "drawdown")
def _(t: Tables) -> DataFrame:
    df = ordered.running(t.hourly(), {"peak": ordered.Running("max", F.col("close"))}, bounded=True)
    return df.withColumn("drawdown", F.try_divide(F.col("close") - F.col("peak"), F.col("peak")))


@query("win13_drawdown_ticks",
       "SELECT event_id, (value - max(value) OVER win) / nullif(max(value) OVER win, 0) AS drawdown FROM events "
       "WINDOW win AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
       "event_id", "drawdown")
def _(t: Tables) -> DataFrame:
    df = ordered.running(t.ticks(), {"peak": ordered.Running("max", F.col("price"))})
    return df.withColumn("drawdown", F.try_divide(F.col("price") - F.col("peak"), F.col("peak")))


@query("win14_rolling_drawdown",
       FROM + f"CASE WHEN count(close) OVER {rows(252)} >= 252 THEN (min(close) OVER {rows(252)} - max(close) OVER {rows(252)}) / nullif(max(close) OVER {rows(252)}, 0) END AS rolling_dd FROM bars",
       "symbol, ts", "rolling_dd")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumn("rolling_dd", w.rolling_drawdown("close", 252))


@query("win15_volume",
       FROM + f"{strict('avg', 'volume', 20)} AS volume_sma, volume / ({strict('avg', 'volume', 20)}) AS volume_ratio, "
       f"volume / ({strict('avg', 'volume', 20)} + 1) AS volume_ratio1, "
       f"CASE WHEN lag(volume) OVER {W} IS NOT NULL THEN greatest(-5, least(5, volume / nullif(lag(volume) OVER {W}, 0) - 1)) ELSE 5.0 END AS volume_change FROM bars",
       "symbol, ts", "volume_sma, volume_ratio, volume_ratio1, volume_change")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumns(w.volume_features())


@query("win16_vwap", FROM + f"sum(close * volume) OVER {UPTO} / nullif(sum(volume) OVER {UPTO}, 0) AS vwap FROM bars",
       "symbol, ts", "vwap")
def _(t: Tables) -> DataFrame:
    df = ordered.running(
        t.hourly(),
        {"_pv": ordered.Running("sum", F.col("close") * F.col("volume")), "_v": ordered.Running("sum", F.col("volume"))},
        bounded=True)
    return df.withColumn("vwap", F.try_divide("_pv", "_v"))


HOLES = "CASE WHEN volume >= 3 THEN close END"


@query("win17_fill",
       f"WITH {BARS}, h AS (SELECT *, {HOLES} AS x FROM bars) SELECT symbol, ts, last_value(x IGNORE NULLS) OVER {UPTO} AS ffill, "
       f"coalesce(last_value(x IGNORE NULLS) OVER {UPTO}, first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled FROM h",
       "symbol, ts", "ffill, filled")
def _(t: Tables) -> DataFrame:
    df = t.hourly().withColumn("x", F.expr(HOLES))
    return df.withColumns({"ffill": w.fill_forward("x"), "filled": w.fill_both("x", default=0.0)})


@query("win17_fill_ticks",
       "SELECT event_id, last_value(CASE WHEN value > 90 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts "
       "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill FROM events", "event_id", "ffill")
def _(t: Tables) -> DataFrame:
    spiky = F.when(F.col("price") > 90, F.col("price"))
    return ordered.running(t.ticks(), {"ffill": ordered.Running("last", spiky)})


@query("win18_interpolate",
       f"""WITH {BARS}, h AS (SELECT *, {HOLES} AS x, row_number() OVER {W} AS i FROM bars),
       p AS (SELECT *, last_value(x IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi,
         first_value(x IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni FROM h
         WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT symbol, ts, CASE WHEN x IS NOT NULL THEN x WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
         ELSE pv + (nv - pv) * ((i - pi) / (ni - pi)) END AS line FROM p""",
       "symbol, ts", "line")
def _(t: Tables) -> DataFrame:
    return w.with_interpolation(t.hourly().withColumn("x", F.expr(HOLES)), "x", "line")


@query("win19_rolling_corr",
       f"""WITH {BARS}, b AS (SELECT symbol, ts, close / nullif(lag(close) OVER {W}, 0) - 1 AS r, close / nullif(lag(close, 24) OVER {W}, 0) - 1 AS r24 FROM bars),
       m AS (SELECT ts, r24 AS mr FROM b WHERE symbol = 'view'),
       j AS (SELECT b.*, mr FROM b LEFT JOIN m USING (ts)), k AS (SELECT *, CASE WHEN count(mr) OVER {rows(24)} >= 24 THEN avg(mr) OVER {rows(24)} END AS mm FROM j)
       SELECT symbol, ts, coalesce(CASE WHEN count(CASE WHEN r IS NOT NULL AND mm IS NOT NULL THEN 1 END) OVER {rows(24)} >= 24
         AND min(r) OVER {rows(24)} < max(r) OVER {rows(24)} AND min(mm) OVER {rows(24)} < max(mm) OVER {rows(24)}
         THEN corr(r, mm) OVER {rows(24)} END, 0.5) AS market_corr FROM k""",
       "symbol, ts", "market_corr")
def _(t: Tables) -> DataFrame:
    df = t.hourly_stored().withColumns({"r": w.change("close"), "r24": w.change("close", 24)})
    market = df.filter(F.col("symbol") == "view").select("ts", F.col("r24").alias("mr"))
    return (df.join(market, "ts", "left").withColumn("mm", w.sma("mr", 24))
            .withColumn("market_corr", F.coalesce(w.rolling_corr("r", "mm", 24), F.lit(0.5))))


def _daily_features(name: str, sql_cols: str, values: str, build) -> None:
    @query(name, f"WITH {DAYS} SELECT symbol, ts, {sql_cols} FROM days", "symbol, ts", values)
    def _(t: Tables) -> DataFrame:
        return t.daily().withColumn("x", F.col("close")).withColumns(build("x"))


_daily_features(
    "win20_hash_rate_features",
    f"{strict('avg', 'close', 7)} AS x_ma7, {strict('avg', 'close', 30)} AS x_ma30, close / nullif(lag(close, 7) OVER {W}, 0) - 1 AS x_change_7d, "
    f"close / nullif(lag(close, 30) OVER {W}, 0) - 1 AS x_change_30d, CASE WHEN ({strict('avg', 'close', 7)}) > ({strict('avg', 'close', 30)}) THEN 1 ELSE 0 END AS x_trend",
    "x_ma7, x_ma30, x_change_7d, x_change_30d, x_trend", w.hash_rate_features)
_daily_features(
    "win21_interest_features",
    f"{strict('avg', 'close', 7)} AS x_ma7, {strict('avg', 'close', 30)} AS x_ma30, close - lag(close, 1) OVER {W} AS x_diff_1d, close - lag(close, 7) OVER {W} AS x_diff_7d, "
    f"close / nullif(lag(close, 7) OVER {W}, 0) - 1 AS x_change_7d, CASE WHEN close > ({strict('avg', 'close', 30)}) THEN 1 ELSE 0 END AS x_above_ma",
    "x_ma7, x_ma30, x_diff_1d, x_diff_7d, x_change_7d, x_above_ma", w.interest_features)


@query("win22_derivative_proxies",
       f"""WITH {BARS}, r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS r1, close / nullif(lag(close, 24) OVER {W}, 0) - 1 AS r24 FROM bars),
       v AS (SELECT *, CASE WHEN r1 > 0 THEN volume ELSE 0.0 END AS up, CASE WHEN r1 < 0 THEN volume ELSE 0.0 END AS down FROM r),
       o AS (SELECT *, ({strict('avg', 'r24', 8)}) * 0.01 AS funding_rate, {strict('avg', 'volume', 168)} AS open_interest,
         (({strict('sum', 'up', 24)}) + 1) / (({strict('sum', 'down', 24)}) + 1) AS long_short_ratio FROM v)
       SELECT *, open_interest / nullif(lag(open_interest, 24) OVER {W}, 0) - 1 AS oi_change FROM o""",
       "symbol, ts", "funding_rate, open_interest, long_short_ratio, oi_change")
def _(t: Tables) -> DataFrame:
    return w.with_derivative_proxies(t.hourly())


@query("win23_lead_lag",
       f"""WITH {BARS}, b AS (SELECT symbol, ts, close / nullif(lag(close, 5) OVER {W}, 0) - 1 AS r5, close / nullif(lag(close, 24) OVER {W}, 0) - 1 AS r24 FROM bars),
       m AS (SELECT ts, r24 AS mr FROM b WHERE symbol = 'view'), j AS (SELECT b.*, mr FROM b LEFT JOIN m USING (ts))
       SELECT symbol, ts, coalesce(lag(mr) OVER {W} - lag(r24) OVER {W}, 0) AS lead_lag, r5 - mr AS spread FROM j""",
       "symbol, ts", "lead_lag, spread")
def _(t: Tables) -> DataFrame:
    df = t.hourly_stored().withColumns({"r5": w.change("close", 5), "r24": w.change("close", 24)})
    market = df.filter(F.col("symbol") == "view").select("ts", F.col("r24").alias("mr"))
    return df.join(market, "ts", "left").withColumns(
        {"lead_lag": F.coalesce(F.lag("mr").over(S.spec()) - F.lag("r24").over(S.spec()), F.lit(0.0)),
         "spread": F.col("r5") - F.col("mr")})


@query("win24_forward_labels",
       f"""WITH {BARS}, r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS r1 FROM bars), v AS (SELECT *, {strict('stddev_samp', 'r1', 24)} AS vol FROM r)
       SELECT symbol, ts, CASE WHEN lead(close) OVER {W} > close THEN 1 ELSE 0 END AS target, lead(vol) OVER {W} AS next_volatility,
         lead(close) OVER {W} / nullif(close, 0) - 1 AS next_return, lag(r1) OVER {W} AS previous_return FROM v""",
       "symbol, ts, target", "next_volatility, next_return, previous_return")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumn("r1", w.change("close")).withColumn("vol", w.volatility("r1", 24)).withColumns(
        {"target": w.next_up(), "next_volatility": F.lead("vol").over(S.spec()), "next_return": w.next_change(),
         "previous_return": F.lag("r1").over(S.spec())})


@query("win25_gaps",
       f"""WITH {BARS}, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 60000000.0 AS gap FROM bars),
       m AS (SELECT symbol, quantile_cont(gap, 0.5) AS typical FROM g GROUP BY 1)
       SELECT symbol, ts, gap, coalesce(gap > 60, false) AS over_limit, coalesce(gap > 3 * typical, false) AS over_typical FROM g JOIN m USING (symbol)""",
       "symbol, ts, over_limit, over_typical", "gap")
def _(t: Tables) -> DataFrame:
    gaps = t.hourly_stored().withColumn("gap", w.gap_minutes())
    typical = gaps.groupBy("symbol").agg(F.percentile("gap", 0.5).alias("typical"))
    return gaps.join(typical, "symbol").withColumns(
        {"over_limit": F.coalesce(F.col("gap") > 60, F.lit(False)),
         "over_typical": F.coalesce(F.col("gap") > 3 * F.col("typical"), F.lit(False))})


@query("win26_stable", FROM + f"sum(CASE WHEN close > 20 THEN 1 ELSE 0 END) OVER {rows(5)} >= 5 AS stable FROM bars", "symbol, ts, stable")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumn("stable", w.stable(F.col("close") > 20, 5))


@query("win27_trend",
       FROM + f"CASE WHEN close > ({strict('avg', 'close', 20)}) THEN 1 ELSE 0 END AS trend, abs(close / nullif(lag(close, 24) OVER {W}, 0) - 1) * 100 AS strength FROM bars",
       "symbol, ts, trend", "strength")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumns(
        {"trend": F.coalesce(F.col("close") > w.sma("close", 20), F.lit(False)).cast("int"),
         "strength": F.abs(w.change("close", 24)) * 100})
