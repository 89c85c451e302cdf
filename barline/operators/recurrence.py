"""Exponential and Wilder smoothing without a sequential loop, exact over the whole past.

``y[t] = a*y[t-1] + b[t]`` is a scan over affine maps. A series is cut into blocks; inside a block the recurrence from
zero is a running sum, ``y[t] = a^t * sum(b[i] * a^-i)``, kept in range by the block length. A block as a whole maps
what comes in, y, to ``A*y + e``, with e its last value and A = a^rows; composing these maps over 1, 2, 4, ... blocks
gives every block the exact value that comes in, in as many steps as it takes until A underflows. No row is repeated
and none is left out: a spike of any height fades as in the sequential loop, and NaN or infinity stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barline.operators.ordered import BARS, CHUNK_ROWS, Series, chunk_series, chunked, numbered

RANGE = 240  # decimal exponent the scaled sums may reach
MOST_BLOCKS = 1 << 24  # of a series
BOUNDED_ROWS = 1 << 24  # of a series that the calendar bounds


def ema_decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def wilder_decay(n: int) -> float:
    return (n - 1.0) / n


#: A recurrence: what each row adds, and the decay of the value before.
Step = tuple[Column, float]


@dataclass(frozen=True)
class Scan:
    """Solves recurrences over numbered rows in blocks of ``rows`` rows."""

    rows: int
    series: Series
    bounded: bool

    def ema(self, x: str | Column, span: float, adjust: bool) -> Step:
        """Exponential mean, y0 = x0; adjusted weights are summed here and divided by ``weight``."""
        col = F.col(x) if isinstance(x, str) else x
        a = ema_decay(span)
        scaled = col * F.lit(1.0 - a)
        return (scaled if adjust else F.when(F.col("_pos") == 0, col).otherwise(scaled)), a

    def weight(self, span: float) -> Column:
        return F.lit(1.0) - F.pow(F.lit(ema_decay(span)), F.col("_pos") + 1)

    def seeded(self, x: str, n: int, seed: str, seed_row: int) -> Step:
        """Wilder mean: ``seed`` at ``seed_row``, then (y*(n-1) + x)/n; 0 before."""
        step = (
            F.when(F.col("_pos") < seed_row, F.lit(0.0))
            .when(F.col("_pos") == seed_row, F.col(seed))
            .otherwise(F.col(x) / n)
        )
        return step, wilder_decay(n)

    def means(self, d: DataFrame, x: str, spans: dict[str, float], adjust: bool) -> DataFrame:
        d = self.solve(d, {k: self.ema(x, n, adjust) for k, n in spans.items()})
        return d.withColumns({k: F.col(k) / self.weight(n) for k, n in spans.items()}) if adjust else d

    def solve(self, d: DataFrame, steps: dict[str, Step]) -> DataFrame:
        """Adds one column per recurrence."""
        offset = F.col("_pos") - F.col("_chunk") * F.lit(self.rows)
        inner = chunk_series(self.series)
        local = {
            f"_l_{k}": F.sum(step * F.pow(F.lit(a), -offset)).over(inner.upto()) * F.pow(F.lit(a), offset)
            for k, (step, a) in steps.items()
        }
        decays = {k: a for k, (_, a) in steps.items()}
        d = d.withColumns(local)
        if self.bounded:
            # The last row of each full block stands for it.
            last = offset == self.rows - 1
            d = d.withColumns({f"_e_{k}": F.when(last, F.col(f"_l_{k}")) for k in steps})
            d = self._composed(d, decays, self.series, self.rows)
            before = self.series.before()
            d = d.withColumns({f"_e_{k}": F.last(f"_e_{k}", ignorenulls=True).over(before) for k in steps})
        else:
            ends = d.groupBy(*inner.keys).agg(*[F.max_by(f"_l_{k}", "_pos").alias(f"_e_{k}") for k in steps])
            blocks = Series(self.series.keys, ("_chunk",))
            ends = self._composed(ends, decays, blocks, 1)
            ends = ends.withColumns({f"_e_{k}": F.lag(f"_e_{k}").over(blocks.spec()) for k in steps})
            d = d.join(ends, list(inner.keys))
        zero = F.lit(0.0)
        carried = {
            k: F.col(f"_l_{k}")
            + F.pow(F.lit(a), offset + 1) * F.coalesce(F.col(f"_e_{k}"), zero)
            + F.coalesce(F.col(f"_n_{k}"), zero)
            for k, a in decays.items()
        }
        return d.withColumns(carried).drop(*[f"_{p}_{k}" for p in "len" for k in steps])

    def _composed(self, d: DataFrame, decays: dict[str, float], series: Series, apart: int) -> DataFrame:
        """Turns ``_e_`` from the value a block reaches from zero into that from all blocks up to it.

        Blocks are ``apart`` rows from each other. ``_n_`` sums what earlier blocks held beyond all numbers, which no
        decay makes vanish.
        """
        before = series.before()
        odd = {k: F.isnan(f"_e_{k}") | (F.abs(f"_e_{k}") == float("inf")) for k in decays}
        d = d.withColumns({f"_n_{k}": F.sum(F.when(odd[k], F.col(f"_e_{k}"))).over(before) for k in decays})
        reach, left = 1, {k: a**self.rows for k, a in decays.items()}
        while left and reach < MOST_BLOCKS:
            # An end that is further back than the first block adds nothing.
            d = d.withColumns(
                {
                    f"_e_{k}": F.col(f"_e_{k}")
                    + F.lit(a) * F.coalesce(F.lag(f"_e_{k}", reach * apart).over(series.spec()), F.lit(0.0))
                    for k, a in left.items()
                }
            )
            reach, left = reach * 2, {k: a * a for k, a in left.items() if a * a > 0}
            if self.bounded and reach * self.rows > BOUNDED_ROWS:
                break
        return d


def recur(
    df: DataFrame,
    build: Callable[[DataFrame, Scan], DataFrame],
    decays: list[float],
    before: Callable[[DataFrame, Series], DataFrame] | None = None,
    lookback: int = 0,
    series: Series = BARS,
    bounded: bool = False,
) -> DataFrame:
    """Run ``build``, which solves recurrences, over blocks sized for ``decays``.

    before: adds the columns of plain windows, which look back at most ``lookback`` rows.
    """
    rows = max(64, math.floor(RANGE / -math.log10(min(decays))))
    d = numbered(df, series, bounded)
    if before is not None and bounded:
        d = before(d, series)
    elif before is not None:
        d = before(chunked(d, CHUNK_ROWS, lookback), chunk_series(series)).filter("_own").drop("_own")
    d = d.withColumn("_chunk", F.floor(F.col("_pos") / rows))
    return build(d, Scan(rows, series, bounded)).drop("_chunk", "_pos")


def ema(
    df: DataFrame,
    price: str,
    spans: dict[str, float],
    adjust: bool,
    series: Series = BARS,
    bounded: bool = False,
) -> DataFrame:
    """REC-01 / REC-02: one exponential mean per output name."""
    return recur(
        df,
        lambda d, s: s.means(d, price, spans, adjust),
        [ema_decay(n) for n in spans.values()],
        series=series,
        bounded=bounded,
    )


def macd_columns(d: DataFrame, scan: Scan, price: str, adjust: bool) -> DataFrame:
    """MACD columns inside an open block frame."""
    d = scan.means(d, price, {"ema12": 12, "ema26": 26}, adjust).withColumn("macd", F.col("ema12") - F.col("ema26"))
    return scan.means(d, "macd", {"macd_signal": 9}, adjust).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


MACD_DECAYS = [ema_decay(9), ema_decay(12), ema_decay(26)]


def macd(
    df: DataFrame, price: str = "close", adjust: bool = True, series: Series = BARS, bounded: bool = False
) -> DataFrame:
    """REC-03: 12/26 difference, its 9-row mean and the histogram, in one pass."""
    return recur(
        df,
        lambda d, s: macd_columns(d, s, price, adjust).drop("ema12", "ema26"),
        MACD_DECAYS,
        series=series,
        bounded=bounded,
    )


def wilder_rsi(
    df: DataFrame, price: str = "close", n: int = 14, series: Series = BARS, bounded: bool = False
) -> DataFrame:
    """REC-04: RSI on Wilder means seeded with the first n moves; 0.0 before row n."""

    def before(d: DataFrame, s: Series) -> DataFrame:
        d = d.withColumn("_move", F.col(price) - F.lag(price).over(s.spec())).withColumns(
            {
                "_gain": F.greatest(F.col("_move"), F.lit(0.0)),
                "_loss": F.greatest(-F.col("_move"), F.lit(0.0)),
            }
        )
        return d.withColumns({"_gseed": F.avg("_gain").over(s.last(n)), "_lseed": F.avg("_loss").over(s.last(n))})

    def build(d: DataFrame, scan: Scan) -> DataFrame:
        d = scan.solve(d, {"_g": scan.seeded("_gain", n, "_gseed", n), "_l": scan.seeded("_loss", n, "_lseed", n)})
        rsi = 100 - 100 / (1 + F.col("_g") / (F.col("_l") + 1e-10))
        return d.withColumn("rsi_wilder", F.when(F.col("_pos") >= n, rsi).otherwise(0.0)).drop(
            "_move", "_gain", "_loss", "_gseed", "_lseed", "_g", "_l"
        )

    return recur(df, build, [wilder_decay(n)], before, n + 1, series, bounded)


def atr_smoothed(
    df: DataFrame, n: int = 14, how: str = "wilder", series: Series = BARS, bounded: bool = False
) -> DataFrame:
    """REC-06 (wilder: seeded at row n-1, zeros before) and REC-07 (ewm: recursive EMA of TR)."""
    from barline.functions.windows import true_range

    def before(d: DataFrame, s: Series) -> DataFrame:
        d = d.withColumn("_tr", true_range(s))
        return d if how == "ewm" else d.withColumn("_seed", F.avg("_tr").over(s.last(n)))

    def build(d: DataFrame, scan: Scan) -> DataFrame:
        if how == "ewm":
            return scan.means(d, "_tr", {"atr_ewm": n}, adjust=False).drop("_tr")
        return scan.solve(d, {"atr_wilder": scan.seeded("_tr", n, "_seed", n - 1)}).drop("_tr", "_seed")

    decay = ema_decay(n) if how == "ewm" else wilder_decay(n)
    return recur(df, build, [decay], before, n + 1, series, bounded)
