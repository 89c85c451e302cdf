"""AGG: bars from ticks and group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import windows as w
from barline.operators import aggregates as agg, resample
from barline.operators.onerow import with_row
from barline.plans import ledger as lg
from barline.plans.catalog import BARS, BRANDS, W, query
from barline.plans.catalog.trades import LEDGER, METRICS
from barline.sources.tables import Tables

R = f"r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM bars)"


@query("agg01_ohlcv_hourly", f"WITH {BARS} SELECT * FROM bars", "symbol, ts", "open, high, low, close, volume")
def _(t: Tables) -> DataFrame:
    return t.hourly()


@query("agg01_ohlcv_brand_daily", f"WITH {BRANDS} SELECT * FROM brands", "symbol, ts", "open, high, low, close, volume")
def _(t: Tables) -> DataFrame:
    return t.brand_daily()


@query("agg01_resample_4h",
       f"""WITH {BARS} SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, bars.ts) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, bars.ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""",
       "symbol, ts", "open, high, low, close, volume")
def _(t: Tables) -> DataFrame:
    return resample.resample(t.hourly(), "4h")


@query("agg01_resample_week",
       f"""WITH {BARS} SELECT symbol, date_trunc('week', bars.ts) AS ts, arg_min(open, bars.ts) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, bars.ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""",
       "symbol, ts", "open, high, low, close, volume")
def _(t: Tables) -> DataFrame:
    return resample.resample(t.hourly(), "1w")


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg02_correlation_matrix",
       " UNION ALL ".join(
           f"SELECT '{a}' AS c1, '{b}' AS c2, round({'1.0' if a == b else f'corr({min(a, b, key=NUMS.index)}, {max(a, b, key=NUMS.index)})'}::DOUBLE + 1e-9, 6) + 0.0 AS corr FROM lineitem"
           for a in NUMS for b in NUMS if a != b))
def _(t: Tables) -> DataFrame:
    m = agg.correlation_matrix(t.lineitem, NUMS).filter("i <> j")
    return m.select("c1", "c2", (F.round(F.col("corr") + 1e-9, 6) + 0.0).alias("corr"))


MARKET = f"{R}, m AS (SELECT ts, ret AS mret FROM r WHERE symbol = 'view'), j AS (SELECT r.symbol, r.ts, ret, mret FROM r JOIN m USING (ts) WHERE ret IS NOT NULL AND mret IS NOT NULL)"


def _market(t: Tables) -> tuple[DataFrame, DataFrame]:
    rets = t.hourly_stored().withColumn("ret", w.change("close"))
    market = rets.filter("symbol = 'view'").select("ts", F.col("ret").alias("mret"))
    return rets, rets.join(market, "ts").dropna(subset=["ret", "mret"])


@query("agg03_beta",
       f"WITH {BARS}, {MARKET} SELECT symbol, coalesce(CASE WHEN var_samp(mret) > 0 THEN covar_samp(ret, mret) / var_samp(mret) END, 1) AS beta FROM j GROUP BY 1",
       "symbol", "beta")
def _(t: Tables) -> DataFrame:
    return _market(t)[1].groupBy("symbol").agg(agg.beta("ret", "mret").alias("beta"))


@query("agg04_alpha",
       f"""WITH {BARS}, {MARKET}, b AS (SELECT symbol, covar_samp(ret, mret) / var_samp(mret) AS beta FROM j GROUP BY 1),
       a AS (SELECT symbol, avg(ret) AS am FROM r GROUP BY 1), v AS (SELECT avg(mret) AS mm FROM m)
       SELECT symbol, am * 252 - (0.02 + beta * (mm * 252 - 0.02)) AS alpha FROM a JOIN b USING (symbol), v""",
       "symbol", "alpha")
def _(t: Tables) -> DataFrame:
    rets, both = _market(t)
    b = both.groupBy("symbol").agg(agg.beta("ret", "mret").alias("beta"))
    a = rets.groupBy("symbol").agg(F.avg("ret").alias("am"))
    market = rets.filter("symbol = 'view'").agg(F.avg("ret").alias("mm"))
    return with_row(a.join(b, "symbol"), market).withColumn(
        "alpha", agg.alpha(F.col("am"), F.col("mm"), F.col("beta")))


@query("agg05_sharpe",
       f"WITH {BARS}, {R} SELECT symbol, (avg(ret) - 0.02 / 252) * 252 / (stddev_samp(ret) * sqrt(252)) AS sharpe FROM r GROUP BY 1",
       "symbol", "sharpe")
def _(t: Tables) -> DataFrame:
    return _market(t)[0].groupBy("symbol").agg(agg.sharpe_samp("ret").alias("sharpe"))


PEAK = "max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("agg06_max_drawdown",
       f"WITH {BARS}, p AS (SELECT symbol, close, {PEAK} AS peak FROM bars) SELECT symbol, abs(min((close - peak) / nullif(peak, 0))) AS max_drawdown FROM p GROUP BY 1",
       "symbol", "max_drawdown")
def _(t: Tables) -> DataFrame:
    from barline.operators.ordered import BARS as S

    d = t.hourly().withColumn("peak", F.max("close").over(S.upto()))
    return d.groupBy("symbol").agg(F.abs(F.min(F.try_divide(F.col("close") - F.col("peak"), F.col("peak")))).alias("max_drawdown"))


@query("agg07_value_at_risk",
       f"""WITH {BARS}, {R}, v AS (SELECT symbol, quantile_cont(ret, 0.05) AS var FROM r GROUP BY 1)
       SELECT symbol, any_value(var) AS var, avg(ret) FILTER (ret <= var) AS cvar, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, arg_max(ret, ts) AS last_return
       FROM r JOIN v USING (symbol) GROUP BY 1""",
       "symbol", "var, cvar, sharpe, last_return")
def _(t: Tables) -> DataFrame:
    from barline.operators.quantiles import exact_quantiles

    rets = t.hourly().withColumn("ret", w.change("close"))
    var = exact_quantiles(rets, ["symbol"], "ret", [0.05], bounded=True).select("symbol", F.col("q")[0].alias("var"))
    return rets.join(var, "symbol").groupBy("symbol").agg(
        F.first("var").alias("var"),
        F.avg(F.when(F.col("ret") <= F.col("var"), F.col("ret"))).alias("cvar"),
        (F.avg("ret") / F.stddev_samp("ret") * F.lit(252**0.5)).alias("sharpe"),
        F.max_by("ret", "ts").alias("last_return"))


@query("agg08_trade_summary",
       f"""WITH {LEDGER} SELECT symbol, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (NOT pnl > 0) AS losses, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS win_rate,
       avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl < 0) AS avg_loss, max(pnl) FILTER (pnl > 0) AS largest_win, min(pnl) FILTER (pnl < 0) AS largest_loss,
       sum(pnl) AS total_pnl, sum(fees) AS total_fees, sum(pnl) AS net_pnl, sum(pnl + fees) AS gross_pnl FROM ledger GROUP BY 1""",
       "symbol, trades, wins, losses", "win_rate, avg_win, avg_loss, largest_win, largest_loss, total_pnl, total_fees, net_pnl, gross_pnl")
def _(t: Tables) -> DataFrame:
    return agg.trade_summary(lg.ledger(t), ["symbol"])


@query("agg09_equity_metrics", f"WITH {METRICS} SELECT * FROM metrics", "symbol",
       "total_return, annualized_return, volatility, sharpe, sortino, max_drawdown, max_drawdown_pct, calmar")
def _(t: Tables) -> DataFrame:
    return agg.equity_metrics(lg.equity(t), ["symbol"])


@query("agg10_performance",
       f"""WITH {LEDGER} SELECT symbol, sum(pnl) AS total_pnl, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS win_rate, avg(pnl) FILTER (pnl > 0) AS avg_win,
       avg(pnl) FILTER (pnl < 0) AS avg_loss, abs(sum(pnl) FILTER (pnl > 0) / sum(pnl) FILTER (pnl < 0)) AS profit_factor FROM ledger GROUP BY 1""",
       "symbol", "total_pnl, win_rate, avg_win, avg_loss, profit_factor")
def _(t: Tables) -> DataFrame:
    return agg.running_performance(lg.ledger(t), ["symbol"])


@query("agg14_missing_shares",
       f"""WITH {BARS}, f AS (SELECT close / nullif(lag(close, 24) OVER {W}, 0) - 1 AS ret24, close / nullif(lag(close, 168) OVER {W}, 0) - 1 AS ret168, CASE WHEN volume >= 3 THEN volume END AS busy FROM bars),
       s AS (SELECT avg(CASE WHEN ret24 IS NULL THEN 1 ELSE 0 END) AS a, avg(CASE WHEN ret168 IS NULL THEN 1 ELSE 0 END) AS b, avg(CASE WHEN busy IS NULL THEN 1 ELSE 0 END) AS c FROM f)
       SELECT 'returns' AS feature_group, 2 AS features, (a + b) / 2 AS missing FROM s UNION ALL SELECT 'volume', 1, c FROM s UNION ALL SELECT 'all', 3, (a + b + c) / 3 FROM s""",
       "feature_group, features", "missing")
def _(t: Tables) -> DataFrame:
    f = t.hourly().withColumns({"ret24": w.change("close", 24), "ret168": w.change("close", 168),
                                "busy": F.when(F.col("volume") >= 3, F.col("volume"))})
    return agg.group_missing_shares(f, {"returns": ["ret24", "ret168"], "volume": ["busy"]})


@query("agg15_run_statistics",
       f"""WITH {BARS}, {R}, d AS (SELECT symbol, ts::DATE AS day, sum(ret) AS x FROM r WHERE ret IS NOT NULL GROUP BY 1, 2), q AS (SELECT symbol, quantile_cont(x, 0.05) AS v FROM d GROUP BY 1)
       SELECT symbol, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_pop(x) AS sd, min(x) AS lowest, max(x) AS highest, quantile_cont(x, 0.025) AS ci_low, quantile_cont(x, 0.975) AS ci_high,
       avg(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS share_positive, avg(x) FILTER (x <= v) AS tail_mean FROM d JOIN q USING (symbol) GROUP BY 1""",
       "symbol", "mean, median, sd, lowest, highest, ci_low, ci_high, share_positive, tail_mean")
def _(t: Tables) -> DataFrame:
    rets = t.hourly().withColumn("ret", w.change("close")).dropna(subset=["ret"])
    runs = rets.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("ret").alias("x"))
    return agg.run_statistics(runs, ["symbol"], "x")


# A fixed score of the text length as probability, the quality label as truth.
SCORED = """scored AS (SELECT l.doc_id, (n_chars % 1000)::DOUBLE / 1000 AS score, quality AS truth, ((n_chars % 37)::DOUBLE - 18) / 1000 AS ret
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def scored(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", ((n % 1000).cast("double") / 1000).alias("score"), F.col("quality").alias("truth"),
        (((n % 37).cast("double") - 18) / 1000).alias("ret"))


def counts_sql(low: float, high: float, points: int) -> str:
    return f"""{SCORED}, t AS (SELECT {low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * i / {points - 1} AS threshold FROM range({points}) x(i)),
      c AS (SELECT threshold, count(*) FILTER (score >= threshold) AS trades, count(*) FILTER (score >= threshold AND truth = 1)::DOUBLE AS tp, count(*) FILTER (score < threshold AND truth = 1)::DOUBLE AS fn,
        count(*) FILTER (score < threshold AND truth = 0)::DOUBLE AS tn, count(*) AS n, coalesce(sum(ret) FILTER (score >= threshold), 0) AS total_return,
        stddev_pop(CASE WHEN score >= threshold THEN ret ELSE 0 END) AS sd FROM scored, t GROUP BY 1),
      p AS (SELECT *, CASE WHEN trades > 0 THEN tp / trades ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, (tp + tn) / n AS accuracy FROM c),
      counts AS (SELECT *, coalesce(1.25 * precision * recall / nullif(0.25 * precision + recall, 0), 0) AS f05, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1,
        coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0) AS f2, total_return / n / (sd + 1e-9) * sqrt(6048) AS sharpe FROM p)"""


@query("agg16_threshold_counts", f"WITH {counts_sql(0.1, 0.9, 9)} SELECT * FROM counts",
       "trades", "threshold, precision, recall, accuracy, f05, f1, f2, total_return, sharpe")
def _(t: Tables) -> DataFrame:
    return agg.threshold_counts(scored(t), [0.1 + (0.9 - 0.1) * i / 8 for i in range(9)])


@query("agg17_fill_statistics",
       """SELECT avg(value) AS mean_value, (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) AS mode_type FROM events""",
       "mode_type", "mean_value")
def _(t: Tables) -> DataFrame:
    from barline.operators.quality import fill_statistics

    return fill_statistics(t.events, {"value": "mean_value"}, {"event_type": "mode_type"})


@query("agg18_daily_report",
       f"""WITH {LEDGER}, d AS (SELECT exit_ts::DATE::TIMESTAMP AS ts, sum(pnl) AS pnl, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, sum(fees) AS fees FROM ledger GROUP BY 1),
       b AS (SELECT *, 10000 + sum(pnl) OVER (ORDER BY ts) AS balance FROM d), p AS (SELECT *, greatest(10000, max(balance) OVER (ORDER BY ts)) AS peak FROM b)
       SELECT ts, trades, wins, pnl, fees, balance, peak, 100.0 * wins / trades AS win_rate, min((balance - peak) / peak) OVER (ORDER BY ts) AS max_drawdown FROM p""",
       "ts, trades, wins", "pnl, fees, balance, peak, win_rate, max_drawdown")
def _(t: Tables) -> DataFrame:
    from barline.plans.reports import daily_report

    return daily_report(lg.ledger(t)).withColumn("ts", F.col("day").cast("timestamp"))
