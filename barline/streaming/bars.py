"""STR-01, STR-04, STR-08, STR-09: windowed bars, day reports, stale rows, enrichment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from barline.schema import INTERVALS


def stream_bars(ticks: DataFrame, interval: str = "1h", delay: str = "10 minutes") -> DataFrame:
    """STR-01: OHLCV per tumbling window; append mode emits a bar once the watermark passes its end, update mode at every trigger."""
    win = F.window("ts", f"{INTERVALS[interval]} seconds")
    bars = ticks.withWatermark("ts", delay).groupBy("symbol", win.alias("w")).agg(
        F.min_by("price", "ts").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_day_report(trades: DataFrame, delay: str = "1 hour") -> DataFrame:
    """STR-04: one report per day; append mode emits it when the day is over, update mode at every trigger."""
    day = F.window("ts", "1 day")
    out = trades.withWatermark("ts", delay).groupBy(day.alias("w")).agg(
        F.count("*").alias("trades"),
        F.count_if(F.col("pnl") > 0).alias("wins"),
        F.sum("pnl").alias("pnl"),
        F.max_by("balance", "ts").alias("balance"),
    )
    return out.select(F.col("w.start").alias("ts"), "trades", "wins", "pnl", "balance")


def drop_stale(events: DataFrame, as_of: Column, max_hours: float = 24.0) -> DataFrame:
    """STR-08: rows older than ``max_hours`` at ``as_of`` (a column of the row or a fixed time)."""
    return events.filter((F.unix_micros(as_of) - F.unix_micros("ts")) / 3.6e9 <= max_hours)


def enrich(ticks: DataFrame, features: DataFrame, key: list[str]) -> DataFrame:
    """STR-09: latest features per tick by a stream-static left join, with a range flag."""
    joined = ticks.join(features, key, "left")
    ok = F.col("price").between(F.col("low_fence"), F.col("high_fence"))
    return joined.withColumn("in_range", F.coalesce(ok, F.lit(False)))


def foreach_enriched(features: Callable[[], DataFrame], key: list[str]):
    """A ``foreachBatch`` body that reads the newest features for every batch."""

    def handle(batch: DataFrame, path: str) -> None:
        enrich(batch, features(), key).write.mode("overwrite").parquet(path)

    return handle
