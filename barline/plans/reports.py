"""Daily account reports (AGG-18, STR-04 batch twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def daily_report(ledger: DataFrame, capital: float = 10_000.0, ts: str = "exit_ts") -> DataFrame:
    """One row per day: trades, profit, balance, peak and drawdown so far.

    The running columns go over days, so the window holds one row per day.
    """
    day = ledger.groupBy(F.to_date(ts).alias("day")).agg(
        F.sum("pnl").alias("pnl"),
        F.count("*").alias("trades"),
        F.count_if(F.col("pnl") > 0).alias("wins"),
        F.sum("fees").alias("fees"),
    )
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        day.withColumn("balance", capital + F.sum("pnl").over(upto))
        .withColumn("peak", F.greatest(F.lit(capital), F.max("balance").over(upto)))
        .withColumn("win_rate", 100.0 * F.col("wins") / F.col("trades"))
        .withColumn("max_drawdown", F.min((F.col("balance") - F.col("peak")) / F.col("peak")).over(upto))
    )
