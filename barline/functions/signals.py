"""Candle patterns, entry signals and feed classifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barline.functions.windows import change, sma, sma_partial, with_rsi
from barline.operators.ordered import BARS, Series


def clip(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col))


def fixed(x: Column, digits: int) -> Column:
    """Decimal text rounded on the exact binary value, without thousands marks."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def engulfing(s: Series = BARS) -> dict[str, Column]:
    """PAT-01: +; the first row is false."""
    o, c = F.col("open"), F.col("close")
    po, pc = F.lag("open").over(s.spec()), F.lag("close").over(s.spec())
    bull = (pc < po) & (c > o) & (c > po) & (o < pc)
    bear = (pc > po) & (c < o) & (c < po) & (o > pc)
    return {
        "bull_engulfing": F.coalesce(bull, F.lit(False)),
        "bear_engulfing": F.coalesce(bear, F.lit(False)),
    }


def shadows() -> dict[str, Column]:
    """PAT-02: hammer and shooting star."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    body, span = top - bottom, F.col("high") - F.col("low")
    upper, lower = F.col("high") - top, bottom - F.col("low")
    small = body < 0.3 * span
    return {
        "hammer": (lower > 2 * body) & (upper < body) & small,
        "shooting_star": (upper > 2 * body) & (lower < body) & small,
    }


def with_rsi_sma_signal(df: DataFrame, s: Series = BARS, variant: str = "partial") -> DataFrame:
    """SIG-01: buy oversold above the mean, sell overbought below it."""
    r, p, m = F.col("rsi"), F.col("close"), F.col("sma20")
    return with_rsi(df, variant, s=s).withColumn("sma20", sma_partial("close", 20, s)).withColumn(
        "signal",
        F.when((r < 30) & (p > m), "buy").when((r > 70) & (p < m), "sell").otherwise("hold"),
    )


def confidence_and_reason() -> dict[str, Column]:
    """SIG-02: how far the RSI is in its zone, and the reason as text."""
    r, p, m = F.col("rsi"), F.col("close"), F.col("sma20")
    return {
        "confidence": F.when(r < 30, F.least(F.lit(1.0), (30 - r) / 30))
        .when(r > 70, F.least(F.lit(1.0), (r - 70) / 30))
        .otherwise(0.5),
        "reason": F.when(
            F.col("signal") == "buy",
            F.format_string(
                "RSI oversold (%s) + price above SMA20 (%s > %s)", fixed(r, 1), fixed(p, 2), fixed(m, 2)
            ),
        )
        .when(
            F.col("signal") == "sell",
            F.format_string(
                "RSI overbought (%s) + price below SMA20 (%s < %s)", fixed(r, 1), fixed(p, 2), fixed(m, 2)
            ),
        )
        .otherwise(F.format_string("Neutral conditions (RSI: %s)", fixed(r, 1))),
    }


def rsi_events(df: DataFrame, s: Series = BARS) -> DataFrame:
    """SIG-03: long / short events with strength, from the 15th row on."""
    r = F.col("rsi")
    return (
        with_rsi(df, "strict_eps8", s=s)
        .withColumn("_i", F.row_number().over(s.spec()))
        .filter((F.col("_i") > 14) & ((r < 30) | (r > 70)))
        .withColumns(
            {
                "direction": F.when(r < 30, "long").otherwise("short"),
                "strength": F.when(r < 30, (30 - r) / 30).otherwise((r - 70) / 30),
            }
        )
        .drop("_i")
    )


def threshold_move(x: str, threshold: float, s: Series = BARS) -> Column:
    """SIG-04: +1 / -1 / 0 by the relative move of one row."""
    move = change(x, 1, s)
    return F.when(move > threshold, 1).when(move < -threshold, -1).otherwise(0)


def with_additive_signal(df: DataFrame, s: Series = BARS) -> DataFrame:
    """SIG-05: score around 0.5 from RSI, mean order and 4-bar momentum."""
    df = with_rsi(df, "last14", s=s).withColumns(
        {
            "sma20": sma("close", 20, s),
            "sma50": F.coalesce(sma("close", 50, s), sma("close", 20, s)),
            "_mom": change("close", 4, s),
            "_i": F.row_number().over(s.spec()),
        }
    )
    r, p = F.col("rsi"), F.col("close")
    score = (
        F.lit(0.5)
        + F.when(r < 30, 0.15).when(r > 70, -0.15).otherwise(0.0)
        + F.when((p > F.col("sma20")) & (F.col("sma20") > F.col("sma50")), 0.10)
        .when((p < F.col("sma20")) & (F.col("sma20") < F.col("sma50")), -0.10)
        .otherwise(0.0)
        + F.when(F.col("_mom") > 0.02, 0.10).when(F.col("_mom") < -0.02, -0.10).otherwise(0.0)
    )
    return (
        df.withColumn("score", clip(score, 0, 1))
        .withColumn(
            "action",
            F.when(F.col("_i") < 30, "HOLD")
            .when(F.col("score") > 0.65, "BUY")
            .when(F.col("score") < 0.35, "SELL")
            .otherwise("HOLD"),
        )
        .drop("_mom", "_i")
    )


def with_probability_score(df: DataFrame, s: Series = BARS) -> DataFrame:
    """SIG-06: 0.5 plus steps for the day's return, RSI zones and trend; clipped to [0, 1]."""
    df = with_rsi(df, "null_loss", s=s).withColumns(
        {"return_24": change("close", 24, s), "sma24": sma("close", 24, s), "sma168": sma("close", 168, s)}
    )
    ret, r = F.coalesce("return_24", F.lit(0.0)), F.coalesce("rsi", F.lit(50.0))
    trend = F.coalesce(F.col("sma24") > F.col("sma168"), F.lit(False))
    score = (
        F.lit(0.5)
        + F.when(ret > 0.02, 0.1).when(ret > 0.01, 0.05).when(ret < -0.02, -0.1).otherwise(0.0)
        + F.when((r > 40) & (r < 60), 0.05).when(r < 30, 0.1).when(r > 70, -0.05).otherwise(0.0)
        + F.when(trend, 0.1).otherwise(-0.05)
    )
    return df.withColumn("probability", clip(score, 0, 1))


def entry_gate(probability: str, atr: str, mood: str) -> dict[str, Column]:
    """SIG-07: one flag per rule and their conjunction."""
    share = F.try_divide(F.col(atr), F.col("close"))
    flags = {
        "ok_probability": F.col(probability) > 0.55,
        "ok_trend": F.col("sma24") > F.col("sma168"),
        "ok_range": (share >= 0.01) & (share <= 0.05),
        "ok_mood": F.col(mood) < 80,
    }
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    every = F.lit(True)
    for f in flags.values():
        every = every & f
    return {**flags, "enter": every}


# Upper bound and its label (>=), lower bound and its label (<=), label between.
CLASSIFIERS = {
    "long_short_ratio": (2.0, "overleveraged_long", 0.5, "overleveraged_short", "neutral"),
    "funding_rate": (0.0001, "overleveraged_long", -0.0001, "overleveraged_short", "neutral"),
    "fear_greed": (75.0, "extreme_greed", 25.0, "extreme_fear", "neutral"),
    "netflow": (0.03, "distribution", -0.03, "accumulation", "neutral"),
    "hash_rate_change": (0.10, "strong_growth", -0.10, "declining", "stable"),
    "interest": (80.0, "high_fomo", 20.0, "low_accumulation", "neutral"),
    "interest_change": (0.50, "spike_up", -0.50, "spike_down", "neutral"),
    "probability": (0.60, "bullish", 0.40, "bearish", "neutral"),
}
# Labels that block a long entry.
BLOCKING = ("overleveraged_long", "extreme_greed", "distribution", "high_fomo")


def classify(feed: str, x: Column) -> Column:
    """SIG-08: threshold class of a feed value."""
    high, above, low, below, middle = CLASSIFIERS[feed]
    return F.when(x >= high, above).when(x <= low, below).otherwise(middle)


def permission(feed: str, x: Column) -> dict[str, Column]:
    """SIG-09: may a long be opened, and the reason as text."""
    label = classify(feed, x)
    return {
        f"{feed}_allow": ~label.isin(*BLOCKING),
        f"{feed}_reason": F.format_string("%s (%s)", label, fixed(x, 2)),
    }


def conflict(a: Column, b: Column) -> dict[str, Column]:
    """SIG-10: opposite signs more than 0.3 apart."""
    hit = (F.signum(a) * F.signum(b) < 0) & (F.abs(a - b) > 0.3)
    return {
        "conflict": hit,
        "conflict_text": F.when(~hit, "Aligned")
        .when(a > b, F.format_string("Quant bullish (%s) vs NLP bearish (%s)", fixed(a, 2), fixed(b, 2)))
        .otherwise(F.format_string("Quant bearish (%s) vs NLP bullish (%s)", fixed(a, 2), fixed(b, 2))),
    }


def regime(volatility: Column, trend: Column) -> Column:
    """SIG-11."""
    return F.when(
        volatility > 0.7, F.when(trend > 0.6, "volatile_trending").otherwise("volatile_ranging")
    ).otherwise(F.when(trend > 0.6, "calm_trending").otherwise("calm_ranging"))


def risk_score(conf_a: Column, conf_b: Column, conflicting: Column, volatility: Column) -> dict[str, Column]:
    """SIG-12."""
    risk = F.least(
        F.lit(1.0),
        1 - (conf_a + conf_b) / 2 + F.when(conflicting, 0.3).otherwise(0.0) + 0.5 * volatility,
    )
    return {"risk": risk, "proceed": (risk < 0.6) & ~(conflicting & (risk > 0.4))}


# Position sizes by confidence step.
SIZE_STEPS = [0.0, 0.25, 0.5, 0.75, 1.0]


def fuse(q: Column, n: Column, qc: Column, nc: Column, atr: Column) -> dict[str, Column]:
    """SIG-13: weighted decision with size and the stop / target distances."""
    signal, conf = 0.6 * q + 0.4 * n, 0.6 * qc + 0.4 * nc
    action = (
        F.when((signal > 0.3) & (conf > 0.6), "LONG")
        .when((signal < -0.3) & (conf > 0.6), "SHORT")
        .otherwise("HOLD")
    )
    step = F.least(F.floor(conf * 5), F.lit(4)).cast("int") + 1
    sizes = F.array(*[F.lit(v) for v in SIZE_STEPS])
    return {
        "fused_signal": signal,
        "fused_confidence": conf,
        "action": action,
        "direction": F.when(action == "LONG", 1).when(action == "SHORT", -1).otherwise(0),
        "position_size": F.when(action == "HOLD", 0.0).otherwise(F.element_at(sizes, step)),
        "stop_loss": 2.0 * atr,
        "take_profit": 6.0 * atr,
    }


def explain(q: Column, n: Column, action: Column) -> Column:
    """SIG-14: direction words, agreement and action joined by ' | '."""

    def word(x: Column) -> Column:
        return F.when(x > 0.1, "bullish").when(x < -0.1, "bearish").otherwise("neutral")

    return F.concat_ws(
        " | ",
        F.format_string("Quant: %s (%s, w=60%%)", word(q), fixed(q, 2)),
        F.format_string("NLP: %s (%s, w=40%%)", word(n), fixed(n, 2)),
        F.when(F.signum(q) * F.signum(n) > 0, "ALIGNED").otherwise("MIXED"),
        F.concat(F.lit("\u2192 "), action),
    )


def concat_halves(a: Column, b: Column) -> Column:
    """SIG-15: first half of each vector, one after the other."""
    return F.concat(
        F.slice(a, 1, F.floor(F.size(a) / 2).cast("int")),
        F.slice(b, 1, F.floor(F.size(b) / 2).cast("int")),
    )


def adjusted_threshold(base: Column, volatility: Column, mean_return: Column) -> Column:
    """SIG-18."""
    return clip(
        base + 0.1 * (volatility / 0.02 - 1) + F.when(mean_return < 0, 0.1).otherwise(0.0), 0.4, 0.9
    )


def position_scale(p: Column) -> Column:
    """SIG-19: more above 0.60, less below 0.40; unknown counts as 1."""
    return F.when(p >= 0.60, 1.2).when(p <= 0.40, 0.8).otherwise(1.0)
