"""Sizing and limit rules as columns (RSK)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barline.functions.signals import clip


def sentiment_kelly(p: Column, b: Column, s: Column, fraction: float = 0.25) -> Column:
    """RSK-01: Kelly share after a bounded shift of the win probability by sentiment."""
    shift = 0.3 / (1 + F.exp(-5 * clip(s, -1, 1))) - 0.15
    chance = clip(p + shift, 0.1, 0.9)
    f = fraction * F.try_divide(chance * (b + 1) - 1, b)
    bad = (b <= 0) | (p <= 0) | (p >= 1)
    return F.when(bad | (f < 0.005), 0.0).otherwise(F.least(F.lit(0.10), f))


def fractional_kelly(
    win_rate: Column, avg_win: Column, avg_loss: Column, fraction: float = 0.25, low: float = 0.0, high: float = 0.10
) -> Column:
    """RSK-02: (p*b - q)/b scaled and clipped; the lower bound if a side is missing."""
    b = F.try_divide(avg_win, avg_loss)
    edge = F.try_divide(win_rate * b - (1 - win_rate), b) * fraction
    usable = (win_rate > 0) & (win_rate < 1) & (avg_win > 0) & (avg_loss > 0)
    return F.when(usable, clip(edge, low, high)).otherwise(F.lit(float(low)))


def dollars(account: Column, share: Column) -> Column:
    """RSK-03: money and units."""
    return account * share


def units(money: Column, price: Column) -> Column:
    return F.when(price > 0, money / F.when(price > 0, price)).otherwise(0.0)


def strength_units(value: Column, strength: Column, vol: Column, price: Column) -> Column:
    """RSK-03, second form: a tenth of the account scaled by strength and calmness."""
    calm = F.when(vol > 0, F.least(F.lit(1.0), F.try_divide(F.lit(0.02), vol))).otherwise(1.0)
    return F.try_divide(value * 0.1 * strength * calm, price)


def volatility_target(vol: Column, target: float = 0.02) -> Column:
    """RSK-04."""
    return F.when(vol > 0, clip(F.try_divide(F.lit(target), vol), 0.01, 0.10)).otherwise(0.01)


def atr_plan(price: Column, atr: Column, side: Column, size: Column) -> Column:
    """RSK-05: stop, target, reward to risk and largest loss."""
    stop, target = price - side * 2 * atr, price + side * 3 * atr
    return F.struct(
        stop.alias("stop"),
        target.alias("target"),
        F.try_divide(F.abs(target - price), F.abs(price - stop)).alias("reward_risk"),
        (F.abs(price - stop) * size).alias("max_loss"),
    )


def break_even_rate(win: Column, loss: Column) -> Column:
    """RSK-06."""
    return F.try_divide(F.lit(1.0), 1 + F.try_divide(win, loss))


def expectancy(p: Column, win: Column, loss: Column) -> Column:
    return p * win - (1 - p) * loss


def limit_checks(drawdown: Column, pnl: Column, var: Column) -> dict[str, Column]:
    """RSK-07."""
    checks = {
        "ok_drawdown": drawdown <= 0.2,
        "ok_pnl": F.abs(pnl) <= 0.05,
        "ok_var": F.abs(var) <= 0.05,
    }
    return {**checks, "stop_trading": ~(checks["ok_drawdown"] & checks["ok_pnl"] & checks["ok_var"])}
