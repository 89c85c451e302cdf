"""Rolling indicators as window columns.

Every function takes a frame and a ``Series`` (whole symbols or chunks, see
``operators.ordered``) and adds columns; Catalyst merges the windows of one
chain into a single exchange and sort. ``strict`` windows are null until they
hold n non-null values; ``partial`` ones start at the first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barline.operators.ordered import BARS, Series

EPS = 1e-10


def strict(agg: Column, x: str, n: int, s: Series) -> Column:
    return F.when(F.count(x).over(s.last(n)) >= n, agg.over(s.last(n)))


def sma(x: str, n: int, s: Series = BARS) -> Column:
    """WIN-01."""
    return strict(F.avg(x), x, n, s)


def sma_partial(x: str, n: int, s: Series = BARS) -> Column:
    """WIN-02."""
    return F.avg(x).over(s.last(n))


def sma_zero(x: str, n: int, s: Series = BARS) -> Column:
    """WIN-03: 0.0 until the window is full."""
    return F.coalesce(sma(x, n, s), F.lit(0.0))


def wma(x: str, n: int, s: Series = BARS) -> Column:
    """WIN-04: weights 1..n, newest heaviest."""
    total = None
    for back in range(n):
        step = F.lag(x, back).over(s.spec()) * (n - back)
        total = step if total is None else total + step
    return total / (n * (n + 1) / 2)


def rolling_apply(x: str, n: int, fold, s: Series = BARS) -> Column:
    """UDF-03: a user fold ``array column -> column`` over each full window of n values."""
    values = F.collect_list(x).over(s.last(n))
    return F.when(F.size(values) >= n, fold(values))


def volatility(x: str, n: int, s: Series = BARS, annual: float | None = None) -> Column:
    """WIN-05: sample deviation, optionally scaled by sqrt(annual)."""
    sd = strict(F.stddev_samp(x), x, n, s)
    return sd if annual is None else sd * F.lit(annual**0.5)


def change(x: str | Column, k: int = 1, s: Series = BARS) -> Column:
    """WIN-06: simple return over k rows; null where the base is 0 or missing."""
    col = F.col(x) if isinstance(x, str) else x
    return F.try_divide(col, F.lag(col, k).over(s.spec())) - 1


def log_change(x: str, k: int = 1, s: Series = BARS) -> Column:
    ratio = F.try_divide(F.col(x), F.lag(x, k).over(s.spec()))
    return F.when(ratio > 0, F.ln(ratio))


def roc(x: str, k: int = 10, s: Series = BARS) -> Column:
    """WIN-07: change over k rows in percent."""
    return change(x, k, s) * 100


def with_rsi(
    df: DataFrame, variant: str, price: str = "close", n: int = 14, s: Series = BARS, out: str = "rsi"
) -> DataFrame:
    """WIN-08: RSI on simple averages. The first row counts as a move of 0.

    strict: 100 without losses, null if nothing moved; partial: from row 1;
    strict_eps / strict_eps8: loss + 1e-10 / 1e-8; null_loss: null without losses;
    last14: 50 below n + 1 prices, 100 without losses.
    """
    move = F.col(price) - F.lag(price).over(s.spec())
    df = df.withColumn("_move", move).withColumns(
        {
            "_gain": F.when(F.col("_move") > 0, F.col("_move")).otherwise(0.0),
            "_loss": F.when(F.col("_move") < 0, -F.col("_move")).otherwise(0.0),
        }
    )
    g, l = F.avg("_gain").over(s.last(n)), F.avg("_loss").over(s.last(n))
    filled = F.count("_gain").over(s.last(n)) >= n
    if variant == "last14":
        filled = F.count("_gain").over(s.last(n + 1)) >= n + 1
    df = df.withColumns({"_g": g, "_l": l, "_full": filled})
    g, l = F.col("_g"), F.col("_l")

    def index(loss: Column) -> Column:
        return 100 - 100 / (1 + g / loss)

    if variant == "strict":
        rsi = F.when(l > 0, index(l)).when(g > 0, 100.0)
    elif variant in ("partial", "strict_eps"):
        rsi = index(l + 1e-10)
    elif variant == "strict_eps8":
        rsi = index(l + 1e-8)
    elif variant == "null_loss":
        rsi = F.when(l > 0, index(l))
    elif variant == "last14":
        rsi = F.when(l > 0, index(l)).otherwise(100.0)
    else:
        raise ValueError(f"unknown RSI variant {variant!r}")
    if variant == "last14":
        rsi = F.when(F.col("_full"), rsi).otherwise(50.0)
    elif variant != "partial":
        rsi = F.when(F.col("_full"), rsi)
    return df.withColumn(out, rsi).drop("_move", "_gain", "_loss", "_g", "_l", "_full")


def bollinger(
    x: str = "close", n: int = 20, k: float = 2.0, s: Series = BARS, partial: bool = False
) -> dict[str, Column]:
    """WIN-09: mean and mean +/- k sample deviations."""
    if partial:
        mid, sd = F.avg(x).over(s.last(n)), F.stddev_samp(x).over(s.last(n))
    else:
        mid, sd = sma(x, n, s), strict(F.stddev_samp(x), x, n, s)
    return {"bb_mid": mid, "bb_upper": mid + k * sd, "bb_lower": mid - k * sd}


def with_band_features(df: DataFrame, x: str = "close", n: int = 20, s: Series = BARS) -> DataFrame:
    """WIN-10: distances to the bands, width, position and squeeze."""
    p = F.col(x)
    m, sd = F.col("_mid"), F.col("_sd")
    return (
        df.withColumns({"_mid": sma(x, n, s), "_sd": strict(F.stddev_samp(x), x, n, s)})
        .withColumns(
            {
                "bb_upper_dist": F.try_divide(m + 2 * sd - p, p),
                "bb_lower_dist": F.try_divide(p - m + 2 * sd, p),
                "bb_width": 4 * sd / (m + EPS),
                "bb_position": (p - m) / (2 * sd + EPS),
            }
        )
        .withColumn("bb_squeeze", F.coalesce(F.col("bb_width") < sma("bb_width", n, s), F.lit(False)))
        .drop("_mid", "_sd")
    )


def with_stochastic(df: DataFrame, n: int = 14, d: int = 3, s: Series = BARS) -> DataFrame:
    """WIN-11: %K and %D from the first row on."""
    low, high = F.min("low").over(s.last(n)), F.max("high").over(s.last(n))
    return df.withColumn("stoch_k", 100 * (F.col("close") - low) / (high - low + EPS)).withColumn(
        "stoch_d", F.avg("stoch_k").over(s.last(d))
    )


def true_range(s: Series = BARS) -> Column:
    """Largest of high-low and the two distances to the previous close (nulls skipped)."""
    before = F.lag("close").over(s.spec())
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )


def with_atr(df: DataFrame, n: int = 14, s: Series = BARS, relative: bool = False) -> DataFrame:
    """WIN-12: mean true range; relative divides by the close."""
    df = df.withColumn("_tr", true_range(s)).withColumn("atr", sma("_tr", n, s)).drop("_tr")
    if relative:
        return df.withColumn("atr_pct", F.col("atr") / (F.col("close") + EPS))
    return df


def rolling_drawdown(x: str, n: int, s: Series = BARS) -> Column:
    """WIN-14: (window minimum - window maximum) / window maximum."""
    low, high = F.min(x).over(s.last(n)), F.max(x).over(s.last(n))
    return F.when(F.count(x).over(s.last(n)) >= n, F.try_divide(low - high, high))


def volume_features(s: Series = BARS, n: int = 20) -> dict[str, Column]:
    """WIN-15: mean volume, ratio to it (plain and with + 1), clipped change."""
    mean = sma("volume", n, s)
    return {
        "volume_sma": mean,
        "volume_ratio": F.try_divide(F.col("volume"), mean),
        "volume_ratio1": F.col("volume") / (mean + 1),
        "volume_change": F.greatest(F.lit(-5.0), F.least(F.lit(5.0), change("volume", 1, s))),
    }


def fill_forward(x: str, s: Series = BARS) -> Column:
    """WIN-17."""
    return F.last(x, ignorenulls=True).over(s.upto())


def fill_backward(x: str, s: Series = BARS) -> Column:
    return F.last(x, ignorenulls=True).over(s.backward())


def fill_both(x: str, s: Series = BARS, default: float | None = None) -> Column:
    """Forward, then backward, then the default."""
    parts = [fill_forward(x, s), fill_backward(x, s)]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def with_interpolation(df: DataFrame, x: str, out: str, s: Series = BARS) -> DataFrame:
    """WIN-18: straight lines by row position; the tail repeats the last value, the head stays null."""
    here = F.when(F.col(x).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(x).alias("v")))
    df = (
        df.withColumn("_i", F.row_number().over(s.spec()))
        .withColumn("_here", here)
        .withColumns(
            {
                "_prev": F.last("_here", ignorenulls=True).over(s.upto()),
                "_next": F.last("_here", ignorenulls=True).over(s.backward()),
            }
        )
    )
    share = (F.col("_i") - F.col("_prev.i")) / (F.col("_next.i") - F.col("_prev.i"))
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * share
    value = (
        F.when(F.col(x).isNotNull(), F.col(x))
        .when(F.col("_prev").isNull(), None)
        .when(F.col("_next").isNull(), F.col("_prev.v"))
        .otherwise(line)
    )
    return df.withColumn(out, value).drop("_i", "_here", "_prev", "_next")


def rolling_corr(x: str, y: str, n: int, s: Series = BARS) -> Column:
    """WIN-19: Pearson over n complete pairs; null when a side does not vary."""
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    full = F.count(both).over(s.last(n)) >= n
    varies = (F.min(x).over(s.last(n)) < F.max(x).over(s.last(n))) & (
        F.min(y).over(s.last(n)) < F.max(y).over(s.last(n))
    )
    return F.when(full & varies, F.corr(x, y).over(s.last(n)))


def hash_rate_features(x: str, s: Series = BARS) -> dict[str, Column]:
    """WIN-20."""
    return {
        f"{x}_ma7": sma(x, 7, s),
        f"{x}_ma30": sma(x, 30, s),
        f"{x}_change_7d": change(x, 7, s),
        f"{x}_change_30d": change(x, 30, s),
        f"{x}_trend": F.coalesce(sma(x, 7, s) > sma(x, 30, s), F.lit(False)).cast("int"),
    }


def interest_features(x: str, s: Series = BARS) -> dict[str, Column]:
    """WIN-21."""
    return {
        f"{x}_ma7": sma(x, 7, s),
        f"{x}_ma30": sma(x, 30, s),
        f"{x}_diff_1d": F.col(x) - F.lag(x, 1).over(s.spec()),
        f"{x}_diff_7d": F.col(x) - F.lag(x, 7).over(s.spec()),
        f"{x}_change_7d": change(x, 7, s),
        f"{x}_above_ma": F.coalesce(F.col(x) > sma(x, 30, s), F.lit(False)).cast("int"),
    }


def with_derivative_proxies(df: DataFrame, s: Series = BARS) -> DataFrame:
    """WIN-22: funding, open-interest and long/short stand-ins from price and volume."""
    df = df.withColumn("_ret24", change("close", 24, s)).withColumn("_ret1", change("close", 1, s))
    df = df.withColumn("_up", F.when(F.col("_ret1") > 0, F.col("volume")).otherwise(0.0))
    df = df.withColumn("_down", F.when(F.col("_ret1") < 0, F.col("volume")).otherwise(0.0))
    up, down = (strict(F.sum(c), c, 24, s) for c in ("_up", "_down"))
    return (
        df.withColumns(
            {
                "funding_rate": sma("_ret24", 8, s) * 0.01,
                "open_interest": sma("volume", 168, s),
                "long_short_ratio": (up + 1) / (down + 1),
            }
        )
        .withColumn("oi_change", change("open_interest", 24, s))
        .drop("_ret24", "_ret1", "_up", "_down")
    )


def next_up(x: str = "close", s: Series = BARS) -> Column:
    """WIN-24: 1 if the next close is higher; the last row is 0."""
    return F.coalesce(F.lead(x).over(s.spec()) > F.col(x), F.lit(False)).cast("int")


def next_change(x: str = "close", s: Series = BARS) -> Column:
    return F.try_divide(F.lead(x).over(s.spec()), F.col(x)) - 1


def gap_minutes(ts: str = "ts", s: Series = BARS) -> Column:
    """WIN-25: minutes since the row before."""
    micros = F.unix_micros(F.col(ts))
    return (micros - F.lag(micros).over(s.spec())) / 60_000_000


def stable(flag: Column, n: int = 5, s: Series = BARS) -> Column:
    """WIN-26: the flag held for n rows in a row."""
    return F.sum(flag.cast("int")).over(s.last(n)) >= n


def hour_cycle(ts: str = "ts") -> dict[str, Column]:
    """PRJ-14."""
    angle = 2 * F.pi() * F.hour(ts) / 24
    return {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)}
