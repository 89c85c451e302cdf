"""Record types, bar intervals and the row bounds that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

SIGNAL = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("direction", T.StringType()),
        T.StructField("strength", T.DoubleType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    ]
)

TEXT_ITEM = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("type", T.StringType()),
        T.StructField("engagement", T.LongType()),
        T.StructField("is_influencer", T.BooleanType()),
    ]
)

# Interval names and their length in seconds (None: calendar month).
INTERVALS = {
    "1m": 60,
    "3m": 180,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "4h": 14400,
    "6h": 21600,
    "8h": 28800,
    "12h": 43200,
    "1d": 86400,
    "3d": 259200,
    "1w": 604800,
    "1M": None,
}

# A group that one task may hold: a window sorts and spills this many narrow rows easily.
MAX_GROUP_ROWS = 4_000_000
_CENTURY = 100 * 366 * 86400


def calendar_bounded(interval: str) -> bool:
    """True if one symbol cannot exceed MAX_GROUP_ROWS bars of this interval in a century.

    Bars are unique per (symbol, bucket), so the count follows from the calendar
    and not from the number of ticks: an hourly symbol has at most 878,400 bars
    in a hundred years however many ticks it was built from.
    """
    seconds = INTERVALS[interval] or 28 * 86400
    return _CENTURY / seconds <= MAX_GROUP_ROWS


def bucket(ts: str | Column, interval: str) -> Column:
    """Start of the bar bucket of ``ts``: UTC-aligned, weeks from Monday, months by calendar."""
    col = F.col(ts) if isinstance(ts, str) else ts
    if interval == "1M":
        return F.date_trunc("month", col)
    if interval == "1w":
        return F.date_trunc("week", col)
    if interval == "1h":
        return F.date_trunc("hour", col)
    if interval == "1d":
        return F.date_trunc("day", col)
    seconds = INTERVALS[interval]
    return F.timestamp_seconds(F.floor(F.unix_seconds(col) / seconds) * seconds)
