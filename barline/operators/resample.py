"""Ticks to bars (AGG-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barline.schema import bucket


def bars_from_ticks(
    ticks: DataFrame, interval: str, price: str = "price", volume: Column | None = None, order: Column | None = None
) -> DataFrame:
    """OHLCV per (symbol, bucket). Every aggregate combines map-side, so a hot
    symbol ships one partial row per bucket and task. ``order`` breaks ties
    of equal timestamps for first and last; null prices are skipped.
    """
    order = order if order is not None else F.col("ts")
    known = F.when(F.col(price).isNotNull(), order)
    volume = volume if volume is not None else F.lit(1.0)
    return ticks.groupBy("symbol", bucket("ts", interval).alias("ts")).agg(
        F.min_by(price, known).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, known).alias("close"),
        F.sum(volume).alias("volume"),
    )


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Bars to coarser bars; empty buckets do not appear."""
    return bars.groupBy("symbol", bucket("ts", interval).alias("ts")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ts"))).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close"),
        F.sum("volume").alias("volume"),
    )
