"""PAT and SIG: candle patterns, entry signals, feed classifiers and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import signals as sg, windows as w
from barline.plans.catalog import BARS, W, query, rows, strict
from barline.plans.catalog.windows import MOVES, RSI
from barline.sources.tables import Tables

RSI_CTES = MOVES.removesuffix("SELECT symbol, ts, ").rstrip()


@query("pat01_engulfing",
       f"""WITH {BARS}, p AS (SELECT *, lag(open) OVER {W} AS po, lag(close) OVER {W} AS pc FROM bars)
       SELECT symbol, ts, coalesce(pc < po AND close > open AND close > po AND open < pc, false) AS bull_engulfing,
         coalesce(pc > po AND close < open AND close < po AND open > pc, false) AS bear_engulfing FROM p""",
       "symbol, ts, bull_engulfing, bear_engulfing")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumns(sg.engulfing())


@query("pat02_shadows",
       f"""WITH {BARS}, p AS (SELECT *, greatest(open, close) AS top, least(open, close) AS bottom FROM bars)
       SELECT symbol, ts, (bottom - low) > 2 * (top - bottom) AND (high - top) < (top - bottom) AND (top - bottom) < 0.3 * (high - low) AS hammer,
         (high - top) > 2 * (top - bottom) AND (bottom - low) < (top - bottom) AND (top - bottom) < 0.3 * (high - low) AS shooting_star FROM p""",
       "symbol, ts, hammer, shooting_star")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumns(sg.shadows())


SIGNAL = f"""{RSI_CTES}, r AS (SELECT *, {RSI['partial']} AS rsi, avg(close) OVER {rows(20)} AS sma20 FROM a),
  s AS (SELECT *, CASE WHEN rsi < 30 AND close > sma20 THEN 'buy' WHEN rsi > 70 AND close < sma20 THEN 'sell' ELSE 'hold' END AS signal FROM r)"""


@query("sig01_rsi_sma", SIGNAL + " SELECT * FROM s", "symbol, ts, signal", "rsi, sma20")
def _(t: Tables) -> DataFrame:
    return sg.with_rsi_sma_signal(t.hourly())


@query("sig01_signal_counts", SIGNAL + " SELECT symbol, signal, count(*) AS n, avg(close) AS mean_close FROM s GROUP BY 1, 2",
       "symbol, signal, n", "mean_close")
def _(t: Tables) -> DataFrame:
    return sg.with_rsi_sma_signal(t.hourly()).groupBy("symbol", "signal").agg(
        F.count("*").alias("n"), F.avg("close").alias("mean_close"))


@query("sig02_confidence",
       SIGNAL + """ SELECT symbol, ts, signal, CASE WHEN rsi < 30 THEN least(1, (30 - rsi) / 30) WHEN rsi > 70 THEN least(1, (rsi - 70) / 30) ELSE 0.5 END AS confidence,
       CASE signal WHEN 'buy' THEN printf('RSI oversold (%.1f) + price above SMA20 (%.2f > %.2f)', rsi, close, sma20)
         WHEN 'sell' THEN printf('RSI overbought (%.1f) + price below SMA20 (%.2f < %.2f)', rsi, close, sma20) ELSE printf('Neutral conditions (RSI: %.1f)', rsi) END AS reason FROM s""",
       "symbol, ts, signal, reason", "confidence")
def _(t: Tables) -> DataFrame:
    return sg.with_rsi_sma_signal(t.hourly()).withColumns(sg.confidence_and_reason())


@query("sig03_rsi_events",
       f"""{RSI_CTES}, r AS (SELECT *, {RSI['strict_eps8']} AS rsi FROM a)
       SELECT symbol, ts, CASE WHEN rsi < 30 THEN 'long' ELSE 'short' END AS direction, CASE WHEN rsi < 30 THEN (30 - rsi) / 30 ELSE (rsi - 70) / 30 END AS strength
       FROM r WHERE rn > 14 AND (rsi < 30 OR rsi > 70)""",
       "symbol, ts, direction", "strength")
def _(t: Tables) -> DataFrame:
    return sg.rsi_events(t.hourly())


@query("sig04_threshold_move",
       f"""WITH {BARS}, m AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS d FROM bars)
       SELECT symbol, ts, CASE WHEN d > 0.02 THEN 1 WHEN d < -0.02 THEN -1 ELSE 0 END AS move FROM m""",
       "symbol, ts, move")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumn("move", sg.threshold_move("close", 0.02))


@query("sig05_additive",
       f"""{RSI_CTES}, r AS (SELECT *, {RSI['last14']} AS rsi, {strict('avg', 'close', 20)} AS s20,
         coalesce({strict('avg', 'close', 50)}, {strict('avg', 'close', 20)}) AS s50, close / nullif(lag(close, 4) OVER {W}, 0) - 1 AS mom FROM a),
       q AS (SELECT *, greatest(0, least(1, 0.5::DOUBLE + CASE WHEN rsi < 30 THEN 0.15 WHEN rsi > 70 THEN -0.15 ELSE 0 END::DOUBLE
         + CASE WHEN close > s20 AND s20 > s50 THEN 0.1 WHEN close < s20 AND s20 < s50 THEN -0.1 ELSE 0 END::DOUBLE
         + CASE WHEN mom > 0.02 THEN 0.1 WHEN mom < -0.02 THEN -0.1 ELSE 0 END::DOUBLE)) AS score FROM r)
       SELECT symbol, ts, score, CASE WHEN rn < 30 THEN 'HOLD' WHEN score > 0.65 THEN 'BUY' WHEN score < 0.35 THEN 'SELL' ELSE 'HOLD' END AS action FROM q""",
       "symbol, ts, action", "score")
def _(t: Tables) -> DataFrame:
    return sg.with_additive_signal(t.hourly())


PROB = f"""{RSI_CTES}, r AS (SELECT *, {RSI['null_loss']} AS rsi, coalesce(close / nullif(lag(close, 24) OVER {W}, 0) - 1, 0) AS ret,
    {strict('avg', 'close', 24)} AS sma24, {strict('avg', 'close', 168)} AS sma168,
    greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM a),
  p AS (SELECT *, greatest(0, least(1, 0.5::DOUBLE + CASE WHEN ret > 0.02 THEN 0.1 WHEN ret > 0.01 THEN 0.05 WHEN ret < -0.02 THEN -0.1 ELSE 0 END::DOUBLE
    + CASE WHEN coalesce(rsi, 50) > 40 AND coalesce(rsi, 50) < 60 THEN 0.05 WHEN coalesce(rsi, 50) < 30 THEN 0.1 WHEN coalesce(rsi, 50) > 70 THEN -0.05 ELSE 0 END::DOUBLE
    + CASE WHEN sma24 > sma168 THEN 0.1 ELSE -0.05 END::DOUBLE)) AS probability, {strict('avg', 'tr', 14)} AS atr FROM r)"""


@query("sig06_probability", PROB + " SELECT * FROM p", "symbol, ts", "probability")
def _(t: Tables) -> DataFrame:
    return sg.with_probability_score(t.hourly())


@query("sig07_entry_gate",
       PROB + """, f AS (SELECT symbol, ts, coalesce(probability > 0.55, false) AS ok_probability, coalesce(sma24 > sma168, false) AS ok_trend,
         coalesce(atr / nullif(close, 0) BETWEEN 0.01 AND 0.05, false) AS ok_range, coalesce(volume * 10 < 80, false) AS ok_mood FROM p)
       SELECT *, ok_probability AND ok_trend AND ok_range AND ok_mood AS enter FROM f""",
       "symbol, ts, ok_probability, ok_trend, ok_range, ok_mood, enter")
def _(t: Tables) -> DataFrame:
    df = w.with_atr(sg.with_probability_score(t.hourly())).withColumn("mood", F.col("volume") * 10)
    return df.withColumns(sg.entry_gate("probability", "atr", "mood"))


# One stand-in value per feed, drawn from a tick: (feed, expression).
FEEDS = {
    "long_short_ratio": "value / 40", "funding_rate": "(value - 50) / 400000", "fear_greed": "value",
    "netflow": "(value - 50) / 1000", "hash_rate_change": "(value - 50) / 300", "interest": "value",
    "interest_change": "(value - 50) / 80", "probability": "value / 100",
}


def _class_sql(feed: str) -> str:
    hi, a, lo, b, mid = sg.CLASSIFIERS[feed]
    return f"CASE WHEN {FEEDS[feed]} >= {hi}::DOUBLE THEN '{a}' WHEN {FEEDS[feed]} <= {lo}::DOUBLE THEN '{b}' ELSE '{mid}' END"


@query("sig08_classifiers", "SELECT event_id, " + ", ".join(f"{_class_sql(f)} AS {f}" for f in FEEDS) + " FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[sg.classify(f, F.expr(e)).alias(f) for f, e in FEEDS.items()])


@query("sig09_permissions",
       "SELECT event_id, " + ", ".join(
           f"{_class_sql(f)} NOT IN {sg.BLOCKING} AS {f}_allow, concat({_class_sql(f)}, printf(' (%.2f)', {FEEDS[f]})) AS {f}_reason"
           for f in ("long_short_ratio", "fear_greed", "interest")) + " FROM events")
def _(t: Tables) -> DataFrame:
    cols: dict = {}
    for f in ("long_short_ratio", "fear_greed", "interest"):
        cols |= sg.permission(f, F.expr(FEEDS[f]))
    return t.events.select("event_id", *[c.alias(k) for k, c in cols.items()])


# Two stand-in model outputs per tick, with confidences and a volatility.
PAIR = {
    "q": "(value - 50) / 50", "n": "CAST(event_id % 41 - 20 AS DOUBLE) / 20", "qc": "0.5 + CAST(event_id % 7 AS DOUBLE) / 14",
    "nc": "0.4 + CAST(event_id % 11 AS DOUBLE) / 20", "vol": "CAST(event_id % 13 AS DOUBLE) / 13",
    "trend": "CAST(event_id % 17 AS DOUBLE) / 17",
}
PAIR_SQL = "pair AS (SELECT event_id, " + ", ".join(f"({e})::DOUBLE AS {k}" for k, e in PAIR.items()) + " FROM events)"
CONFLICT = "(sign(q) * sign(n) < 0 AND abs(q - n) > 0.3)"


def _pair(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[F.expr(f"cast({e} as double)").alias(k) for k, e in PAIR.items()])


@query("sig10_conflict",
       f"""WITH {PAIR_SQL} SELECT event_id, {CONFLICT} AS conflict, CASE WHEN NOT {CONFLICT} THEN 'Aligned'
         WHEN q > n THEN printf('Quant bullish (%.2f) vs NLP bearish (%.2f)', q, n) ELSE printf('Quant bearish (%.2f) vs NLP bullish (%.2f)', q, n) END AS conflict_text FROM pair""",
       "event_id, conflict, conflict_text")
def _(t: Tables) -> DataFrame:
    return _pair(t).withColumns(sg.conflict(F.col("q"), F.col("n")))


@query("sig11_regime",
       f"""WITH {PAIR_SQL} SELECT event_id, CASE WHEN vol > 0.7 THEN 'volatile_' ELSE 'calm_' END || CASE WHEN trend > 0.6 THEN 'trending' ELSE 'ranging' END AS regime FROM pair""",
       "event_id, regime")
def _(t: Tables) -> DataFrame:
    return _pair(t).withColumn("regime", sg.regime(F.col("vol"), F.col("trend")))


@query("sig12_risk",
       f"""WITH {PAIR_SQL}, r AS (SELECT event_id, {CONFLICT} AS c, least(1, 1 - (qc + nc) / 2 + CASE WHEN {CONFLICT} THEN 0.3 ELSE 0 END::DOUBLE + 0.5 * vol) AS risk FROM pair)
       SELECT event_id, risk, risk < 0.6 AND NOT (c AND risk > 0.4) AS proceed FROM r""",
       "event_id, proceed", "risk")
def _(t: Tables) -> DataFrame:
    df = _pair(t).withColumns(sg.conflict(F.col("q"), F.col("n")))
    return df.withColumns(sg.risk_score(F.col("qc"), F.col("nc"), F.col("conflict"), F.col("vol")))


FUSED = f"""WITH {PAIR_SQL}, f AS (SELECT *, 0.6::DOUBLE * q + 0.4::DOUBLE * n AS fused_signal, 0.6::DOUBLE * qc + 0.4::DOUBLE * nc AS fused_confidence FROM pair),
  g AS (SELECT *, CASE WHEN fused_signal > 0.3 AND fused_confidence > 0.6 THEN 'LONG' WHEN fused_signal < -0.3 AND fused_confidence > 0.6 THEN 'SHORT' ELSE 'HOLD' END AS action FROM f)"""


@query("sig13_fusion",
       FUSED + """ SELECT event_id, action, fused_signal, fused_confidence, CASE action WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 ELSE 0 END AS direction,
         CASE WHEN action = 'HOLD' THEN 0 ELSE [0.0, 0.25, 0.5, 0.75, 1.0][least(floor(fused_confidence * 5), 4)::INT + 1] END AS position_size,
         2 * vol AS stop_loss, 6 * vol AS take_profit FROM g""",
       "event_id, action, direction", "fused_signal, fused_confidence, position_size, stop_loss, take_profit")
def _(t: Tables) -> DataFrame:
    c = F.col
    return _pair(t).withColumns(sg.fuse(c("q"), c("n"), c("qc"), c("nc"), c("vol")))


@query("sig14_explanation",
       FUSED + """ SELECT event_id, concat_ws(' | ', printf('Quant: %s (%.2f, w=60%%)', CASE WHEN q > 0.1 THEN 'bullish' WHEN q < -0.1 THEN 'bearish' ELSE 'neutral' END, q),
         printf('NLP: %s (%.2f, w=40%%)', CASE WHEN n > 0.1 THEN 'bullish' WHEN n < -0.1 THEN 'bearish' ELSE 'neutral' END, n),
         CASE WHEN sign(q) * sign(n) > 0 THEN 'ALIGNED' ELSE 'MIXED' END, '→ ' || action) AS reasoning FROM g""",
       "event_id, reasoning")
def _(t: Tables) -> DataFrame:
    c = F.col
    df = _pair(t).withColumns(sg.fuse(c("q"), c("n"), c("qc"), c("nc"), c("vol")))
    return df.withColumn("reasoning", sg.explain(c("q"), c("n"), c("action")))


@query("sig15_concat_fusion",
       """SELECT a.vec_id, list_concat(a.embedding[1:len(a.embedding) // 2], b.embedding[1:len(b.embedding) // 2]) AS fused
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t: Tables) -> DataFrame:
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(b, "vec_id").select("vec_id", sg.concat_halves(F.col("embedding"), F.col("other")).alias("fused"))


@query("sig18_adjusted_threshold",
       f"""WITH {BARS}, r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM bars)
       SELECT symbol, greatest(0.4, least(0.9, 0.5 + 0.1 * (stddev_samp(ret) / 50 / 0.02 - 1) + CASE WHEN avg(ret) < 0 THEN 0.1 ELSE 0 END)) AS threshold FROM r GROUP BY 1""",
       "symbol", "threshold")
def _(t: Tables) -> DataFrame:
    stats = t.hourly().withColumn("ret", w.change("close")).groupBy("symbol").agg(
        (F.stddev_samp("ret") / 50).alias("vol"), F.avg("ret").alias("mean"))
    return stats.withColumn("threshold", sg.adjusted_threshold(F.lit(0.5), F.col("vol"), F.col("mean")))


@query("sig19_position_scale",
       "SELECT event_id, CASE WHEN value / 100 >= 0.6::DOUBLE THEN 1.2 WHEN value / 100 <= 0.4::DOUBLE THEN 0.8 ELSE 1.0 END AS scale FROM events",
       "event_id", "scale")
def _(t: Tables) -> DataFrame:
    return t.events.withColumn("scale", sg.position_scale(F.col("value") / 100))
