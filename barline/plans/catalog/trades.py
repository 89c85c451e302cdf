"""TRD: entries, exits, equity and comparison over hourly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import signals as sg
from barline.operators import aggregates as agg, trades as tr
from barline.operators.draws import poisson_steps
from barline.plans import ledger as lg
from barline.plans.catalog import BARS, W, query
from barline.session import durable
from barline.sources.tables import Tables


def entries_sql(stop: float, target: float, quantity: float = 1.0) -> str:
    return f"""{BARS}, mv AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS d FROM bars),
      sd AS (SELECT *, CASE WHEN d > 0.02 THEN 1 WHEN d < -0.02 THEN -1 END AS side FROM mv),
      entries AS (SELECT symbol, ts, side, {quantity}::DOUBLE AS quantity, close * (1 + side * 0.0005::DOUBLE) AS entry_price, close * (1 + side * 0.0005::DOUBLE) * (1 - side * {stop}::DOUBLE) AS stop_price,
        close * (1 + side * 0.0005::DOUBLE) * (1 + side * {target}::DOUBLE) AS target_price FROM sd WHERE side IS NOT NULL)"""


def ledger_sql(stop: float = 0.02, target: float = 0.05, quantity: float = 1.0) -> str:
    return f"""{entries_sql(stop, target, quantity)},
      hits AS (SELECT e.symbol, e.ts, min(b.ts) AS exit_ts, arg_min(b.close, b.ts) AS exit_price FROM entries e JOIN bars b ON b.symbol = e.symbol AND b.ts > e.ts
        AND (b.close <= least(stop_price, target_price) OR b.close >= greatest(stop_price, target_price)) GROUP BY 1, 2),
      fin AS (SELECT symbol, max(ts) AS end_ts, arg_max(close, ts) AS end_close FROM bars GROUP BY 1),
      x AS (SELECT e.*, coalesce(h.exit_ts, end_ts) AS exit_ts, coalesce(h.exit_price, end_close) AS exit_price, CASE WHEN h.exit_ts IS NULL THEN 'END_OF_PERIOD'
        WHEN (side > 0 AND h.exit_price <= stop_price) OR (side < 0 AND h.exit_price >= stop_price) THEN 'STOP_LOSS' ELSE 'TAKE_PROFIT' END AS exit_reason
        FROM entries e LEFT JOIN hits h ON h.symbol = e.symbol AND h.ts = e.ts JOIN fin ON fin.symbol = e.symbol),
      ledger AS (SELECT *, abs(exit_price - entry_price) * quantity * 0.001 AS fees, side * (exit_price - entry_price) * quantity - abs(exit_price - entry_price) * quantity * 0.001 AS pnl FROM x)"""


LEDGER = ledger_sql()
EQUITY = f"""{ledger_sql(0.5, 2.0, 0.01)},
  moves AS (SELECT symbol, ts, sum(k) AS k, sum(q) AS q, sum(c) AS c, sum(r) AS r FROM (
    SELECT symbol, ts, 1 AS k, side * quantity AS q, side * quantity * entry_price AS c, 0.0 AS r FROM ledger
    UNION ALL SELECT symbol, exit_ts, -1, -side * quantity, -side * quantity * entry_price, pnl FROM ledger) GROUP BY 1, 2),
  cur AS (SELECT b.symbol, b.ts, close, sum(coalesce(k, 0)) OVER w AS open_trades, sum(coalesce(q, 0)) OVER w AS q, sum(coalesce(c, 0)) OVER w AS c, sum(coalesce(r, 0)) OVER w AS realized
    FROM bars b LEFT JOIN moves m ON m.symbol = b.symbol AND m.ts = b.ts WINDOW w AS (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  equity AS (SELECT symbol, ts, open_trades::BIGINT AS open_trades, close * q - c AS unrealized, realized, 10000 + realized + close * q - c AS equity FROM cur)"""


METRICS = f"""{EQUITY}, q AS (SELECT symbol, ts, equity, lag(equity) OVER {W} AS prev, max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM equity),
  s AS (SELECT *, equity / nullif(prev, 0) - 1 AS r, (equity - peak) / nullif(peak, 0) AS dd FROM q),
  g AS (SELECT symbol, count(equity) AS n, product(1 + r) AS growth, avg(r) AS mean, stddev_pop(r) AS sd, stddev_pop(r) FILTER (r < 0) AS down, min(dd) AS max_drawdown_pct, min(equity - peak) AS max_drawdown FROM s GROUP BY 1),
  metrics AS (SELECT symbol, growth - 1 AS total_return, pow(growth, 252.0 / n) - 1 AS annualized_return, sd * sqrt(252) AS volatility,
    CASE WHEN sd > 0 THEN (mean - 0.02 / 252) / sd * sqrt(252) ELSE 0 END AS sharpe, CASE WHEN down > 0 THEN (mean - 0.02 / 252) / (down * sqrt(252)) ELSE 0 END AS sortino,
    max_drawdown, max_drawdown_pct, CASE WHEN max_drawdown_pct < 0 AND pow(growth, 252.0 / n) - 1 > 0 THEN (pow(growth, 252.0 / n) - 1) / abs(max_drawdown_pct) ELSE 0 END AS calmar FROM g)"""
BOTH = METRICS + """, ts_ AS (SELECT symbol, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS win_rate,
  sum(pnl) AS net_pnl FROM ledger GROUP BY 1), both_ AS (SELECT * FROM ts_ JOIN metrics USING (symbol))"""


@query("trd01_entries", f"WITH {entries_sql(0.02, 0.05)} SELECT * FROM entries", "symbol, ts, side",
       "quantity, entry_price, stop_price, target_price")
def _(t: Tables) -> DataFrame:
    return lg.move_entries(t.hourly())


LEDGER_KEYS, LEDGER_VALUES = "symbol, ts, side, exit_reason, exit_s", "entry_price, exit_price, fees, pnl"


@query("trd02_first_barrier", f"WITH {LEDGER} SELECT *, epoch(exit_ts)::BIGINT AS exit_s FROM ledger", LEDGER_KEYS, LEDGER_VALUES)
def _(t: Tables) -> DataFrame:
    return lg.ledger(t).withColumn("exit_s", F.unix_seconds("exit_ts"))


@query("trd02_wide_barrier", f"WITH {ledger_sql(0.9, 6.0)} SELECT *, epoch(exit_ts)::BIGINT AS exit_s FROM ledger", LEDGER_KEYS, LEDGER_VALUES)
def _(t: Tables) -> DataFrame:
    return lg.ledger(t, 0.9, 6.0).withColumn("exit_s", F.unix_seconds("exit_ts"))


@query("trd02_barrier_fill",
       f"""WITH {LEDGER}, f AS (SELECT *, CASE exit_reason WHEN 'STOP_LOSS' THEN stop_price WHEN 'TAKE_PROFIT' THEN target_price ELSE exit_price END AS fill FROM ledger)
       SELECT symbol, ts, exit_reason, side * (fill - entry_price) / nullif(entry_price, 0) - 0.003 AS pnl_pct FROM f""",
       "symbol, ts, exit_reason", "pnl_pct")
def _(t: Tables) -> DataFrame:
    return tr.barrier_return(lg.ledger(t))


@query("join09_barrier_join", f"WITH {ledger_sql(0.3, 0.6)} SELECT symbol, ts, epoch(exit_ts)::BIGINT AS exit_s, exit_reason, exit_price FROM ledger",
       "symbol, ts, exit_s, exit_reason", "exit_price")
def _(t: Tables) -> DataFrame:
    bars = t.hourly_stored()
    return tr.first_exit(bars, lg.move_entries(bars, stop=0.3, target=0.6)).withColumn("exit_s", F.unix_seconds("exit_ts"))


@query("trd03_unrealized", f"WITH {EQUITY} SELECT * FROM equity", "symbol, ts, open_trades", "unrealized")
def _(t: Tables) -> DataFrame:
    return lg.equity(t)


@query("trd04_equity", f"WITH {EQUITY} SELECT * FROM equity", "symbol, ts", "realized, equity")
def _(t: Tables) -> DataFrame:
    return lg.equity(t)


def _summary(t: Tables) -> DataFrame:
    bars = t.hourly_stored()
    led = durable(lg.from_bars(bars, 0.5, 2.0, 0.01), "ledger")
    curve = lg.with_peak(tr.equity_curve(bars, led))
    return agg.trade_summary(led, ["symbol"]).join(agg.equity_metrics(curve, ["symbol"]), "symbol")


@query("trd08_signal_proxy",
       f"""WITH {BARS}, m AS (SELECT symbol, close / nullif(lag(close) OVER {W}, 0) - 1 AS d, volume FROM bars),
       r AS (SELECT symbol, CASE WHEN d > 0.02 THEN 0.001 ELSE -0.001 END * least(1, volume / 5) AS r FROM m WHERE abs(d) > 0.02)
       SELECT symbol, avg(r) / (stddev_pop(r) + 1e-8) * sqrt(252) AS sharpe, avg(r) / (coalesce(stddev_pop(r) FILTER (r < 0), 0) + 1e-8) * sqrt(252) AS sortino, sum(r) AS total_return,
         avg(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS win_rate FROM r GROUP BY 1""",
       "symbol", "sharpe, sortino, total_return, win_rate")
def _(t: Tables) -> DataFrame:
    moves = t.hourly().withColumn("side", sg.threshold_move("close", 0.02)).filter("side <> 0")
    signals = moves.withColumns({"direction": F.when(F.col("side") > 0, "long").otherwise("short"),
                                 "strength": F.least(F.lit(1.0), F.col("volume") / 5)})
    return tr.signal_proxy(signals, ["symbol"])


COPIES = " + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in poisson_steps())


@query("trd07_bootstrap",
       f"""WITH {LEDGER}, dr AS (SELECT replicate, pnl, ('0x' || substr(md5(concat_ws('|', '42', symbol, epoch(ts)::BIGINT, replicate)), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u FROM ledger, (SELECT unnest(range(20)) AS replicate)),
       cp AS (SELECT *, {COPIES} AS copies FROM dr) SELECT replicate, sum(copies) AS n, sum(copies * pnl) AS total_pnl FROM cp WHERE copies > 0 GROUP BY 1""",
       "replicate, n", "total_pnl")
def _(t: Tables) -> DataFrame:
    trades = lg.ledger(t).select("symbol", F.unix_seconds("ts").alias("entry_s"), "pnl")
    runs = tr.bootstrap(trades, 20, ["symbol", "entry_s"])
    return runs.groupBy("replicate").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("pnl")).alias("total_pnl"))


@query("trd05_readiness",
       f"""WITH {BOTH}, ck AS (SELECT symbol, trades >= 50 AS ok_trades, win_rate >= 0.55 AS ok_win_rate, abs(max_drawdown_pct) <= 0.15 AS ok_drawdown, sharpe >= 1 AS ok_sharpe, net_pnl > 0 AS ok_net, volatility < 0.5 AS ok_volatility FROM both_),
       sc AS (SELECT *, (ok_trades::INT + ok_win_rate::INT + ok_drawdown::INT + ok_sharpe::INT + ok_net::INT + ok_volatility::INT) / 6 AS readiness FROM ck) SELECT *, readiness >= 0.8 AS ready FROM sc""",
       "symbol, ok_trades, ok_win_rate, ok_drawdown, ok_sharpe, ok_net, ok_volatility, ready", "readiness")
def _(t: Tables) -> DataFrame:
    return tr.readiness(_summary(t))

@query("trd06_comparison",
       f"""WITH {BOTH}, sc AS (SELECT symbol, 0.4 * win_rate + 0.3 * (1 - least(1, abs(max_drawdown_pct))) + 0.3 * greatest(0, least(2, sharpe)) / 2 AS score FROM both_)
       SELECT symbol, score, rank() OVER (ORDER BY score DESC) AS place FROM sc""",
       "symbol, place", "score")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    # One row per strategy and symbol remains: the window ranks a report.
    score = tr.comparison_score(F.col("win_rate"), F.least(F.lit(1.0), F.abs("max_drawdown_pct")), F.col("sharpe"))
    return _summary(t).withColumn("score", score).withColumn(
        "place", F.rank().over(Window.orderBy(F.desc("score"))).cast("long"))
