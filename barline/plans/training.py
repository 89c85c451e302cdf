"""Training sets (MLP-08, MLP-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barline.functions import windows as w
from barline.operators import joins
from barline.operators.ordered import BARS as S, Running, Series, running
from barline.operators.quality import acceptable_missing
from barline.operators.resample import resample
from barline.plans.indicators import hourly_features

# The feature columns, in order.
FEATURES = [
    "open", "high", "low", "close", "volume",
    "return_1h", "return_24h", "return_7d", "volatility_24h", "volatility_7d",
    "rsi_14", "macd", "macd_signal", "macd_hist",
    "bb_upper", "bb_lower", "bb_width", "atr_14", "adx_14",
    "funding_rate", "open_interest", "oi_change", "long_short_ratio", "volume_ratio",
    "btc_return_24h", "btc_volatility", "btc_correlation", "btc_lead",
    "hour_sin", "hour_cos",
]


def with_market(df: DataFrame, market: str) -> DataFrame:
    """Market columns by bar time.

    The market symbol is one of the rows of each bar time, so a window over ts
    (one row per symbol) spreads its values without a self-join.
    """
    at = Window.partitionBy("ts")
    of_market = F.col("symbol") == market
    df = df.withColumns(
        {
            "btc_return_24h": F.max(F.when(of_market, F.col("return_24h"))).over(at),
            "btc_volatility": F.max(F.when(of_market, F.col("volatility_24h"))).over(at),
        }
    )
    df = df.withColumn("_mean", w.sma("btc_return_24h", 24))
    lead = F.lag("btc_return_24h").over(S.spec()) - F.lag("return_24h").over(S.spec())
    return df.withColumns(
        {
            "btc_correlation": F.coalesce(w.rolling_corr("return_1h", "_mean", 24), F.lit(0.5)),
            "btc_lead": F.coalesce(lead, F.lit(0.0)),
        }
    ).drop("_mean")


def training_set(bars: DataFrame, market: str) -> DataFrame:
    """MLP-08: indicators, market join, derivative stand-ins, label; complete rows only."""
    d = hourly_features(bars)
    d = with_market(d, market)
    d = w.with_derivative_proxies(d)
    d = d.withColumns({"volume_ratio": F.col("volume") / (w.sma("volume", 20) + 1), "target": w.next_up()})
    return d.select("symbol", "ts", *FEATURES, "target").dropna(subset=FEATURES)


def training_files(bars: DataFrame, market: str, path: str, interval: str = "1h") -> DataFrame:
    """MLP-08 from bars of any finer interval: resampled, made a training set, stored by symbol and month, read back.

    Symbol and month are folders, so that a reader of some symbols or a range of months opens their files only.
    Incomplete months of a rerun are replaced by the whole write.
    """
    made = training_set(resample(bars, interval), market).withColumn("month", F.date_format("ts", "yyyy-MM"))
    made.repartition("symbol", "month").sortWithinPartitions("symbol", "month", "ts").write.mode("overwrite").partitionBy("symbol", "month").parquet(path)
    return made.sparkSession.read.schema(made.schema).parquet(path)


def training_range(files: DataFrame, since: str, until: str) -> DataFrame:
    """Rows of stored training sets with since <= ts < until; months outside are not opened."""
    months = (F.col("month") >= since[:7]) & (F.col("month") <= until[:7])
    return files.filter(months & (F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp"))).drop("month")


def daily_set(sources: list[tuple[str, DataFrame, str]], spine: DataFrame, limit: float = 0.20) -> tuple[DataFrame, DataFrame]:
    """MLP-09: fold the sources on the day spine, report missing shares, fill forward, backward, then 0.

    One row per day, so the fill windows are bounded by the calendar.
    """
    merged = joins.fold_sources(spine, sources)
    columns = [c for c in merged.columns if c != "day"]
    report = acceptable_missing(merged, columns, limit)
    days = Series((), ("day",))
    ahead = running(merged, {f"_f_{c}": Running("last", F.col(c)) for c in columns}, days, bounded=True)
    filled = ahead.withColumns(
        {c: F.coalesce(F.col(f"_f_{c}"), w.fill_backward(c, days), F.lit(0.0)) for c in columns}
    )
    return filled.drop(*[f"_f_{c}" for c in columns]), report
