"""Composed indicator sets (WIN-28, REC-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import windows as w
from barline.functions.signals import clip
from barline.operators import recurrence as rec
from barline.operators.ordered import BARS, Series


def batch(bars: DataFrame, names: list[str], series: Series = BARS, bounded: bool = True) -> DataFrame:
    """REC-10: indicators by name (``sma_n``, ``ema_n``, ``rsi``) for every symbol at once."""
    spans = {n: int(n.split("_")[1]) for n in names if n.startswith("ema_")}
    sizes = {n: int(n.split("_")[1]) for n in names if n.startswith("sma_")}

    def before(d: DataFrame, s: Series) -> DataFrame:
        d = d.withColumns({k: w.sma_partial("close", n, s) for k, n in sizes.items()})
        return w.with_rsi(d, "partial", s=s) if "rsi" in names else d

    decays = [rec.ema_decay(n) for n in spans.values()] or [0.5]
    return rec.recur(
        bars, lambda d, scan: scan.means(d, "close", spans, adjust=False), decays, before, max([15, *sizes.values()]), series, bounded
    )


def _adjusted_macd(d: DataFrame, scan: rec.Scan) -> DataFrame:
    return rec.macd_columns(d, scan, "close", adjust=True).drop("ema12", "ema26")


def _hourly_columns(d: DataFrame, s: Series) -> DataFrame:
    d = d.withColumns(
        {
            "return_1h": w.change("close", 1, s),
            "return_24h": w.change("close", 24, s),
            "return_7d": w.change("close", 168, s),
        }
    ).withColumns(
        {"volatility_24h": w.volatility("return_1h", 24, s), "volatility_7d": w.volatility("return_1h", 168, s)}
    )
    d = w.with_rsi(d, "strict_eps", s=s, out="rsi_14")
    mid, sd, p = w.sma("close", 20, s), w.volatility("close", 20, s), F.col("close")
    d = d.withColumns({"_mid": mid, "_sd": sd}).withColumns(
        {
            "bb_upper": F.try_divide(F.col("_mid") + 2 * F.col("_sd") - p, p),
            "bb_lower": F.try_divide(p - F.col("_mid") + 2 * F.col("_sd"), p),
            "bb_width": 4 * F.col("_sd") / (F.col("_mid") + w.EPS),
        }
    )
    d = w.with_atr(d, 14, s, relative=True).withColumnRenamed("atr_pct", "atr_14").drop("atr", "_mid", "_sd")
    return d.withColumn("adx_14", F.abs("return_24h") * 100).withColumns(w.hour_cycle())


def hourly_features(bars: DataFrame, series: Series = BARS, bounded: bool = True) -> DataFrame:
    """WIN-28, training form: returns, volatility, RSI, MACD, bands, ATR, trend stand-in, hour."""
    return rec.recur(bars, _adjusted_macd, rec.MACD_DECAYS, _hourly_columns, 170, series, bounded)


def standard_features(bars: DataFrame, series: Series = BARS, bounded: bool = True) -> DataFrame:
    """WIN-28, general form: means, adjusted EMA and MACD, strict RSI, bands, volume, rate of change, volatility."""

    def before(d: DataFrame, s: Series) -> DataFrame:
        d = d.withColumns({f"sma_{n}": w.sma("close", n, s) for n in (20, 50, 200)})
        d = w.with_rsi(d, "strict", s=s)
        d = d.withColumns(w.bollinger(s=s))
        d = d.withColumns({k: v for k, v in w.volume_features(s).items() if k in ("volume_sma", "volume_ratio")})
        d = d.withColumns({"roc": w.roc("close", 10, s), "_ret": w.change("close", 1, s)})
        return d.withColumn("volatility", w.volatility("_ret", 20, s)).drop("_ret")

    def build(d: DataFrame, scan: rec.Scan) -> DataFrame:
        return rec.macd_columns(d, scan, "close", adjust=True).withColumnsRenamed({"ema12": "ema_12", "ema26": "ema_26"})

    return rec.recur(bars, build, rec.MACD_DECAYS, before, 201, series, bounded)


def bot_features(bars: DataFrame, series: Series = BARS) -> DataFrame:
    """WIN-28, live form: day return, RSI, two means, ATR and its share."""
    d = bars.withColumns(
        {
            "returns_24h": w.change("close", 24, series),
            "sma_24": w.sma("close", 24, series),
            "sma_168": w.sma("close", 168, series),
        }
    )
    d = w.with_rsi(d, "null_loss", s=series)
    d = w.with_atr(d, 14, series)
    return d.withColumn("atr_share", F.try_divide("atr", "close"))


def compact_features(bars: DataFrame, series: Series = BARS, bounded: bool = True) -> DataFrame:
    """WIN-28, study form: returns, RSI, adjusted MACD, band width and position, ATR, volume, momentum."""

    def before(d: DataFrame, s: Series) -> DataFrame:
        d = d.withColumns({f"return_{k}": w.change("close", k, s) for k in (1, 5, 20)})
        d = d.withColumn("volatility", w.volatility("return_1", 20, s))
        d = w.with_rsi(d, "strict_eps", s=s)
        d = w.with_band_features(d, s=s).drop("bb_upper_dist", "bb_lower_dist")
        d = w.with_atr(d, 14, s, relative=True).drop("atr")
        d = d.withColumn("volume_ratio", F.col("volume") / (w.sma("volume", 20, s) + 1))
        d = d.withColumn("volume_change", clip(w.change("volume", 1, s), -5, 5))
        return d.withColumns(
            {
                "momentum": w.change("close", 10, s),
                "trend": F.coalesce(F.col("close") > w.sma("close", 20, s), F.lit(False)).cast("int"),
            }
        )

    return rec.recur(bars, _adjusted_macd, rec.MACD_DECAYS, before, 60, series, bounded)
