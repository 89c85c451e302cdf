"""RSK: sizing, plans, limits and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import risk, windows as w
from barline.operators import ordered
from barline.operators.admission import admit
from barline.plans import ledger as lg
from barline.plans.catalog import BARS, query, strict
from barline.plans.catalog.signals import PAIR_SQL, _pair
from barline.plans.catalog.trades import EQUITY, LEDGER, entries_sql
from barline.plans.catalog.windows import TR
from barline.sources.tables import Tables

c = F.col


@query("rsk01_sentiment_kelly",
       f"""WITH {PAIR_SQL}, k AS (SELECT event_id, q AS b, qc AS p, greatest(0.1, least(0.9, qc + 0.3 / (1 + exp(-5 * greatest(-1, least(1, n)))) - 0.15)) AS chance FROM pair),
       f AS (SELECT *, 0.25 * (chance * (b + 1) - 1) / nullif(b, 0) AS f FROM k) SELECT event_id, CASE WHEN b <= 0 OR p <= 0 OR p >= 1 OR f < 0.005 THEN 0 ELSE least(0.1, f) END AS share FROM f""",
       "event_id", "share")
def _(t: Tables) -> DataFrame:
    return _pair(t).withColumn("share", risk.sentiment_kelly(c("qc"), c("q"), c("n")))


@query("rsk02_fractional_kelly",
       f"""WITH {LEDGER}, l AS (SELECT *, row_number() OVER v AS rn, count(*) OVER p AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) OVER p AS wr, avg(CASE WHEN pnl > 0 THEN pnl END) OVER p AS aw, avg(CASE WHEN pnl < 0 THEN -pnl END) OVER p AS al FROM ledger
         WINDOW v AS (PARTITION BY symbol ORDER BY exit_ts, ts), p AS (PARTITION BY symbol ORDER BY exit_ts, ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
       SELECT symbol, ts, CASE WHEN n >= 10 AND wr > 0 AND wr < 1 AND aw > 0 AND al > 0 THEN greatest(0.01, least(0.1, (wr * aw / al - (1 - wr)) / (aw / al) * 0.25)) ELSE 0.01 END AS share FROM l""",
       "symbol, ts", "share")
def _(t: Tables) -> DataFrame:
    s = ordered.Series(("symbol",), ("exit_ts", "ts"))
    past = s.previous(50)
    d = lg.ledger(t).withColumns({
        "_n": F.count("*").over(past), "_wr": F.avg((c("pnl") > 0).cast("int")).over(past),
        "_aw": F.avg(F.when(c("pnl") > 0, c("pnl"))).over(past), "_al": F.avg(F.when(c("pnl") < 0, -c("pnl"))).over(past)})
    share = risk.fractional_kelly(c("_wr"), c("_aw"), c("_al"), low=0.01, high=0.10)
    return d.withColumn("share", F.when((c("_n") >= 10), F.coalesce(share, F.lit(0.01))).otherwise(0.01))


@query("rsk03_position_size",
       f"""WITH {PAIR_SQL}, p AS (SELECT event_id, 10000 * qc * 0.1 AS money, trend * 100 AS price, nc AS strength, vol FROM pair)
       SELECT event_id, money, CASE WHEN price > 0 THEN money / nullif(price, 0) ELSE 0 END AS units, 10000 * 0.1 * strength * CASE WHEN vol > 0 THEN least(1, 0.02 / nullif(vol, 0)) ELSE 1 END / nullif(price, 0) AS strength_units FROM p""",
       "event_id", "money, units, strength_units")
def _(t: Tables) -> DataFrame:
    price = c("trend") * 100
    return _pair(t).withColumn("money", risk.dollars(F.lit(10_000.0), c("qc") * 0.1)).withColumns({
        "units": risk.units(c("money"), price), "strength_units": risk.strength_units(F.lit(10_000.0), c("nc"), c("vol"), price)})


@query("rsk04_volatility_target",
       f"WITH {PAIR_SQL} SELECT event_id, CASE WHEN vol > 0 THEN greatest(0.01, least(0.1, 0.02 / nullif(vol, 0))) ELSE 0.01 END AS share FROM pair", "event_id", "share")
def _(t: Tables) -> DataFrame:
    return _pair(t).withColumn("share", risk.volatility_target(c("vol")))


@query("rsk05_atr_plan",
       f"""WITH {BARS}, {TR}, a AS (SELECT *, {strict('avg', 'tr', 14)} AS atr, CASE WHEN close >= open THEN 1 ELSE -1 END AS side FROM tr)
       SELECT symbol, ts, close - side * 2 * atr AS stop, close + side * 3 * atr AS target, abs(3 * atr) / nullif(abs(2 * atr), 0) AS reward_risk, abs(2 * atr) * volume AS max_loss FROM a""",
       "symbol, ts", "stop, target, reward_risk, max_loss")
def _(t: Tables) -> DataFrame:
    side = F.when(c("close") >= c("open"), 1).otherwise(-1)
    d = w.with_atr(t.hourly()).withColumn("plan", risk.atr_plan(c("close"), c("atr"), side, c("volume")))
    return d.select("symbol", "ts", "plan.*")


@query("rsk06_expectancy",
       f"WITH {PAIR_SQL} SELECT event_id, 1 / (1 + nc / nullif(qc, 0)) AS break_even, trend * nc - (1 - trend) * qc AS expectancy FROM pair", "event_id", "break_even, expectancy")
def _(t: Tables) -> DataFrame:
    return _pair(t).withColumns({"break_even": risk.break_even_rate(c("nc"), c("qc")), "expectancy": risk.expectancy(c("trend"), c("nc"), c("qc"))})


@query("rsk07_limit_checks",
       f"""WITH {PAIR_SQL}, k AS (SELECT event_id, vol * 0.5 <= 0.2 AS ok_drawdown, abs(q * 0.1) <= 0.05 AS ok_pnl, abs(n * 0.1) <= 0.05 AS ok_var FROM pair)
       SELECT *, NOT (ok_drawdown AND ok_pnl AND ok_var) AS stop_trading FROM k""", "event_id, ok_drawdown, ok_pnl, ok_var, stop_trading")
def _(t: Tables) -> DataFrame:
    return _pair(t).withColumns(risk.limit_checks(c("vol") * 0.5, c("q") * 0.1, c("n") * 0.1))


@query("rsk08_account_drawdown",
       f"""WITH {EQUITY}, p AS (SELECT symbol, ts, equity, max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM equity)
       SELECT symbol, ts, peak, (peak - equity) / nullif(peak, 0) AS drawdown FROM p""", "symbol, ts", "peak, drawdown")
def _(t: Tables) -> DataFrame:
    return lg.equity(t).withColumn("drawdown", F.try_divide(c("peak") - c("equity"), c("peak")))


@query("rsk08_order_peak",
       """SELECT o_orderkey, max(o_totalprice) OVER w AS peak, (max(o_totalprice) OVER w - o_totalprice) / max(o_totalprice) OVER w AS drawdown FROM orders
       WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "o_orderkey", "peak, drawdown")
def _(t: Tables) -> DataFrame:
    s = ordered.Series(("o_orderstatus",), ("o_orderdate", "o_orderkey"))
    o = t.orders.select("o_orderstatus", "o_orderdate", "o_orderkey", "o_totalprice")
    d = ordered.running(o, {"peak": ordered.Running("max", c("o_totalprice"))}, s)
    return d.withColumn("drawdown", F.try_divide(c("peak") - c("o_totalprice"), c("peak")))


@query("rsk09_admission",
       f"""WITH RECURSIVE {entries_sql(0.02, 0.05)}, m AS (SELECT symbol, ts, 'open' AS kind, (1 + entry_price::BIGINT % 14) / 100.0::DOUBLE AS size, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM entries),
       f(symbol, ts, rn, exposure, decision, granted) AS (SELECT symbol, ts, rn, least(size, 0.1), CASE WHEN size > 0.1 THEN 'reduced' ELSE 'approved' END, least(size, 0.1) FROM m WHERE rn = 1
         UNION ALL SELECT m.symbol, m.ts, m.rn, CASE WHEN m.size > 0.1 THEN greatest(0, f.exposure - 0.06) + 0.1 WHEN greatest(0, f.exposure - 0.06) + m.size > 0.5 THEN greatest(0, f.exposure - 0.06) ELSE greatest(0, f.exposure - 0.06) + m.size END,
           CASE WHEN m.size > 0.1 THEN 'reduced' WHEN greatest(0, f.exposure - 0.06) + m.size > 0.5 THEN 'rejected' ELSE 'approved' END,
           CASE WHEN m.size > 0.1 THEN 0.1 WHEN greatest(0, f.exposure - 0.06) + m.size > 0.5 THEN 0 ELSE m.size END FROM f JOIN m ON m.symbol = f.symbol AND m.rn = f.rn + 1)
       SELECT symbol, ts, decision, exposure, granted FROM f""", "symbol, ts, decision", "exposure, granted")
def _(t: Tables) -> DataFrame:
    e = lg.move_entries(t.hourly())
    # Every entry releases 6 % of the exposure of earlier trades before it asks for its own size.
    size = (1 + F.pmod(F.round("entry_price").cast("bigint"), F.lit(14))) / F.lit(100.0)
    return admit(e.select("symbol", "ts", size.alias("size"), F.lit(0.06).alias("released"), F.lit(0.0).alias("drawdown")))
