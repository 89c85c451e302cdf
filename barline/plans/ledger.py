"""Signals to trade ledger, the shared first half of the evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import signals as sg
from barline.operators import trades
from barline.sources.tables import Tables


def move_entries(bars: DataFrame, threshold: float = 0.02, **kwargs) -> DataFrame:
    """Entries wherever the close moved by more than the threshold, in the direction of the move."""
    signals = bars.withColumn("side", sg.threshold_move("close", threshold)).filter("side <> 0")
    return trades.entries(signals, **kwargs)


def ledger(t: Tables, stop: float = 0.02, target: float = 0.05, quantity: float = 1.0) -> DataFrame:
    return from_bars(t.hourly_stored(), stop, target, quantity)


def from_bars(bars: DataFrame, stop: float, target: float, quantity: float = 1.0) -> DataFrame:
    entries = move_entries(bars, stop=stop, target=target, quantity=quantity)
    return trades.settle(trades.first_exit(bars, entries))


def equity(t: Tables, stop: float = 0.5, target: float = 2.0, quantity: float = 0.01) -> DataFrame:
    """Equity curve with the previous value and the running peak (bounded by the bars of a symbol)."""
    bars = t.hourly_stored()
    return with_peak(trades.equity_curve(bars, from_bars(bars, stop, target, quantity)))


def with_peak(curve: DataFrame) -> DataFrame:
    from barline.operators.ordered import BARS as S

    return curve.withColumns(
        {"prev_equity": F.lag("equity").over(S.spec()), "peak": F.max("equity").over(S.upto())}
    )
