"""Walk-forward evaluation of a momentum grid over hourly bars (WFO)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barline.operators import search as sr
from barline.operators.ordered import BARS as S, numbered
from barline.session import durable

TRAIN, TEST, STEP = 252, 63, 21


def rows_with_returns(bars: DataFrame) -> DataFrame:
    """(symbol, pos, close, volume, step_return): the next move, bounded to [-1, 1]."""
    ahead = F.lead("close").over(S.spec())
    move = (ahead - F.col("close")) / (ahead + F.col("close") + 1)
    d = numbered(bars, bounded=True).withColumn("step_return", F.coalesce(move, F.lit(0.0)))
    return d.select("symbol", F.col("_pos").alias("pos"), "close", "volume", "step_return")


def grid(bars: DataFrame) -> DataFrame:
    ranges = bars.groupBy("symbol").agg(
        F.min("volume").cast("long").alias("lo"),
        F.max("volume").cast("long").alias("hi"),
        F.min("close").alias("a"),
        F.max("close").alias("b"),
    )
    return sr.parameter_grid(ranges, ["symbol"], {"size": ("lo", "hi", "int"), "level": ("a", "b", "float")}).select(
        "symbol", "combo", "size", "level"
    )


def best_combos(bars: DataFrame) -> DataFrame:
    """WFO-02: per window the best training combination with its training and test metrics.

    A combination is long while the close is below ``level`` and the volume at least ``size``.
    """
    combos = durable(grid(bars), "grid")
    rows = rows_with_returns(bars).select("symbol", "pos", F.col("volume").alias("low"), F.col("close").alias("high"), F.col("step_return").alias("ret"))
    scores = sr.cell_scores(rows, combos.select("symbol", "combo", F.col("size").alias("low"), F.col("level").alias("high")), TRAIN, TEST, STEP)
    both = scores.groupBy("symbol", "window_id", "combo").agg(
        *[
            F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{name}_{short}")
            for role, name in (("train", "in"), ("test", "out"))
            for c, short in (("sharpe", "sharpe"), ("total_return", "return"), ("win_rate", "win_rate"))
        ]
    )
    return sr.best_of(both, ["symbol", "window_id"], "in_sharpe", "combo").join(combos, ["symbol", "combo"])


def window_drawdowns(bars: DataFrame, best: DataFrame) -> DataFrame:
    """Largest fall of the cumulated test return per window (63 rows each)."""
    rows = rows_with_returns(bars)
    lengths = rows.groupBy("symbol").agg((F.max("pos") + 1).alias("n"))
    tagged = sr.assign_windows(rows, sr.walk_windows(lengths, TRAIN, TEST, STEP), TRAIN, TEST, STEP)
    test = tagged.filter("role = 'test'").join(best.select("symbol", "window_id", "size", "level"), ["symbol", "window_id"])
    active = (F.col("close") <= F.col("level")) & (F.col("volume") >= F.col("size"))
    upto = Window.partitionBy("symbol", "window_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = test.withColumn("ret", F.when(active, F.col("step_return")).otherwise(0.0))
    d = d.withColumn("_cum", F.sum("ret").over(upto)).withColumn("_peak", F.greatest(F.lit(0.0), F.max("_cum").over(upto)))
    return d.groupBy("symbol", "window_id").agg(F.max(F.col("_peak") - F.col("_cum")).alias("drawdown"))


def scored_windows(bars: DataFrame) -> DataFrame:
    """WFO-03..05 on the best combination of every window."""
    best = durable(best_combos(bars), "best")
    d = best.join(window_drawdowns(bars, best), ["symbol", "window_id"])
    c = F.col
    return d.withColumns(
        {
            "validation": sr.validation_score(c("in_sharpe"), c("out_sharpe"), c("in_return"), c("out_return"), c("drawdown")),
            "overfit": sr.overfit_risk(
                c("in_sharpe"), c("out_sharpe"), c("in_return"), c("out_return"), c("in_win_rate"), c("out_win_rate")
            ),
            "significance": sr.significance(c("out_sharpe"), c("out_return"), c("drawdown")),
        }
    )
