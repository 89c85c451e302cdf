"""Walk-forward windows, grids and threshold search as joins and aggregates (WFO)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.functions.signals import clip
from barline.functions.special import t_two_sided
from barline.operators.aggregates import threshold_counts


def parameter_grid(
    ranges: DataFrame, keys: list[str], params: dict[str, tuple[str, str, str]]
) -> DataFrame:
    """JOIN-10: four-point ranges per parameter, exploded one after the other; all
    combinations of each key, numbered in parameter order, are the grid.
    """
    out = ranges
    for name, (lo, hi, kind) in params.items():
        if kind == "int":
            step = F.greatest(F.lit(1), F.floor((F.col(hi) - F.col(lo)) / 3)).cast("long")
            out = out.withColumn(name, F.explode(F.sequence(lo, hi, step)))
        else:
            points = F.transform(
                F.sequence(F.lit(0), F.lit(3)), lambda k: F.col(lo) + (F.col(hi) - F.col(lo)) * k / 3
            )
            out = out.withColumn(name, F.explode(points))
    order = Window.partitionBy(*keys).orderBy(*params)
    return out.withColumn("combo", F.row_number().over(order).cast("long"))


def walk_windows(
    lengths: DataFrame, train: int = 252, test: int = 63, step: int = 21
) -> DataFrame:
    """WFO-01: (symbol, window_id, start, split, end) row ranges that fit into n rows."""
    last = F.floor((F.col("n") - train - test) / step)
    return (
        lengths.filter(F.col("n") >= train + test)
        .withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("start", F.col("window_id") * step)
        .withColumn("split", F.col("start") + train)
        .withColumn("end", F.col("split") + test)
    )


def assign_windows(rows: DataFrame, windows: DataFrame, train: int = 252, test: int = 63, step: int = 21) -> DataFrame:
    """Rows (symbol, pos) tagged with every window they are in and their role.

    The windows of a row follow from its position, so this explodes
    (train + test) / step copies and checks them with an equi-join.
    """
    pos = F.col("pos")
    first = F.greatest(F.lit(0), F.ceil((pos - (train + test) + 1) / step)).cast("long")
    tagged = rows.withColumn("window_id", F.explode(F.sequence(first, F.greatest(first, F.floor(pos / step)).cast("long"))))
    joined = tagged.join(windows.select("symbol", "window_id", "start", "split", "end"), ["symbol", "window_id"])
    inside = (pos >= F.col("start")) & (pos < F.col("end"))
    return joined.filter(inside).withColumn("role", F.when(pos < F.col("split"), "train").otherwise("test"))


def grid_scores(
    rows: DataFrame, train: int = 252, test: int = 63, step: int = 21
) -> DataFrame:
    """Metrics of (symbol, combo, window_id, role) from (symbol, combo, pos, ret).

    Windows are runs of whole steps, so rows are folded once into blocks of
    ``step`` rows and every window adds up its blocks: no row is repeated per window.
    """
    if train % step or test % step:
        raise ValueError("train and test must be multiples of step")
    n_train, n_all = train // step, (train + test) // step
    full = rows.groupBy("symbol").agg((F.max("pos") + 1).alias("n"))
    blocks = rows.groupBy("symbol", "combo", F.floor(F.col("pos") / step).alias("block")).agg(
        F.count("*").alias("n"),
        F.sum("ret").alias("s"),
        F.sum(F.col("ret") * F.col("ret")).alias("ss"),
        F.sum((F.col("ret") > 0).cast("int")).alias("wins"),
    )
    first = F.greatest(F.lit(0), F.col("block") - (n_all - 1))
    tagged = blocks.withColumn("window_id", F.explode(F.sequence(first, F.col("block"))))
    windows = walk_windows(full, train, test, step).select("symbol", "window_id")
    role = F.when(F.col("block") - F.col("window_id") < n_train, "train").otherwise("test")
    sums = (
        tagged.join(windows, ["symbol", "window_id"])
        .groupBy("symbol", "combo", "window_id", role.alias("role"))
        .agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "wins")])
    )
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))
    return sums.select(
        "symbol",
        "combo",
        "window_id",
        "role",
        F.when(sd > 1e-9, mean / sd * F.lit(252**0.5)).otherwise(0.0).alias("sharpe"),
        F.col("s").alias("total_return"),
        (F.col("wins") / F.col("n")).alias("win_rate"),
    )


def cell_scores(rows: DataFrame, grid: DataFrame, train: int = 252, test: int = 63, step: int = 21) -> DataFrame:
    """WFO-02: ``grid_scores`` of a threshold grid without a row per combination.

    rows: (symbol, pos, low, high, ret), where a combination counts ``ret`` while ``low`` is at least its ``low`` and
    ``high`` at most its ``high``; grid: (symbol, combo, low, high). The thresholds of a symbol cut both values into a few
    steps; a row is counted once, in its cell of steps and its block of rows. Windows add up their blocks' cells, and a
    combination reads the rectangle of cells that it covers.
    """
    if train % step or test % step:
        raise ValueError("train and test must be multiples of step")
    n_train, n_all = train // step, (train + test) // step
    axes = grid.groupBy("symbol").agg(
        F.collect_set("low").alias("_lows"),
        F.collect_set("high").alias("_highs"),
        F.collect_list(F.struct("combo", "low", "high")).alias("_combos"),
    )

    def below(values: str, x: Column, equal: bool) -> Column:
        return F.size(F.filter(values, lambda v: (v <= x) if equal else (v < x)))

    placed = rows.join(axes.select("symbol", "_lows", "_highs"), "symbol").select(
        "symbol",
        F.floor(F.col("pos") / step).alias("block"),
        # A value that is missing lies in no rectangle.
        F.when(F.col("low").isNull(), -1).otherwise(below("_lows", F.col("low"), True)).alias("i"),
        F.when(F.col("high").isNull(), 1 << 30).otherwise(below("_highs", F.col("high"), False)).alias("j"),
        "ret",
    )
    cells = placed.groupBy("symbol", "block", "i", "j").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ret").alias("s"),
        F.sum(F.col("ret") * F.col("ret")).alias("ss"),
        F.sum((F.col("ret") > 0).cast("int")).alias("wins"),
    )
    first = F.greatest(F.lit(0), F.col("block") - (n_all - 1))
    tagged = cells.withColumn("window_id", F.explode(F.sequence(first, F.col("block"))))
    windows = walk_windows(rows.groupBy("symbol").agg((F.max("pos") + 1).alias("n")), train, test, step).select("symbol", "window_id")
    role = F.when(F.col("block") - F.col("window_id") < n_train, "train").otherwise("test").alias("role")
    sums = tagged.join(windows, ["symbol", "window_id"]).groupBy("symbol", "window_id", role, "i", "j")
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "wins")])
    sums = sums.groupBy("symbol", "window_id", "role").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "j", "s", "ss", "wins"))).alias("_cells")
    )
    each = sums.join(axes, "symbol").withColumn("_c", F.explode("_combos"))
    i, j = below("_lows", F.col("_c.low"), True), below("_highs", F.col("_c.high"), False)
    each = each.withColumns({"_i": i, "_j": j})
    each = each.withColumn("_in", F.filter("_cells", lambda x: (x["i"] >= F.col("_i")) & (x["j"] <= F.col("_j"))))

    def total(name: str) -> Column:
        return F.aggregate("_in", F.lit(0.0), lambda acc, x: acc + x[name])

    each = each.withColumns({name: total(name) for name in ("s", "ss", "wins")})
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))
    return each.select(
        "symbol",
        F.col("_c.combo").alias("combo"),
        "window_id",
        "role",
        F.when(sd > 1e-9, mean / sd * F.lit(252**0.5)).otherwise(0.0).alias("sharpe"),
        F.col("s").alias("total_return"),
        (F.col("wins") / F.col("n")).alias("win_rate"),
    )


def best_of(metrics: DataFrame, keys: list[str], score: str, combo: str) -> DataFrame:
    """WFO-02: highest score per key, the lowest combo number on ties."""
    rest = [c for c in metrics.columns if c not in keys]
    return metrics.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.round(score, 9), -F.col(combo))).alias("_best")
    ).select(*keys, "_best.*")


def validation_score(s_in: Column, s_out: Column, d_in: Column, d_out: Column, drawdown: Column) -> Column:
    """WFO-03."""
    ratio = F.when(s_in > 0, F.least(F.lit(1.0), F.try_divide(s_out, s_in))).otherwise(0.0)
    steady = 1 - F.abs(d_in - d_out) / F.greatest(F.abs(d_in), F.lit(0.01))
    calm = 1 - F.greatest(F.lit(0.0), drawdown - 0.2)
    return clip(0.5 * ratio + 0.3 * steady + 0.2 * calm, 0, 1)


def overfit_risk(s_in: Column, s_out: Column, r_in: Column, r_out: Column, w_in: Column, w_out: Column) -> Column:
    """WFO-04: mean of the Sharpe drop, the drop of the absolute return and the win-rate gap, at most 1."""
    drops = F.array_compact(
        F.array(
            F.when(s_in > 0, F.greatest(F.lit(0.0), F.try_divide(s_in - s_out, s_in))),
            F.when(F.abs(r_in) > 0, F.greatest(F.lit(0.0), F.try_divide(F.abs(r_in) - F.abs(r_out), F.abs(r_in)))),
            F.abs(w_in - w_out),
        )
    )
    return F.least(F.lit(1.0), F.aggregate(drops, F.lit(0.0), lambda a, x: a + x) / F.size(drops))


def significance(sharpe: Column, total: Column, drawdown: Column) -> Column:
    """WFO-05."""
    return (
        F.when(sharpe > 1, 0.4).when(sharpe > 0.5, 0.2).otherwise(0.0)
        + F.when(total > 0, 0.3).otherwise(0.0)
        + F.when(drawdown < 0.15, 0.3).otherwise(0.0)
    )


def overfit_rollup(scored: DataFrame, keys: list[str]) -> DataFrame:
    """WFO-06 over (keys, window_id, validation, overfit, out_sharpe)."""
    d = scored.groupBy(*keys).agg(
        F.count("*").alias("windows"),
        F.avg("validation").alias("mean_validation"),
        F.stddev_pop("validation").alias("sd_validation"),
        F.avg("overfit").alias("mean_overfit"),
        F.avg((F.col("out_sharpe") > 0).cast("int")).alias("share_positive"),
        F.regr_slope("validation", F.col("window_id").cast("double")).alias("_slope"),
    )
    trend = F.when(F.col("windows") >= 3, clip(F.coalesce("_slope", F.lit(0.0)) * F.col("windows"), -1, 1)).otherwise(0.0)
    risk, score = F.col("mean_overfit"), F.col("mean_validation")
    return d.withColumn("trend", trend).drop("_slope").withColumns(
        {
            "overfit_class": F.when(risk > 0.7, "HIGH RISK").when(risk > 0.5, "MEDIUM RISK").otherwise("LOW RISK"),
            "validation_class": F.when(score > 0.8, "EXCELLENT").when(score > 0.6, "GOOD").otherwise("POOR"),
        }
    )


def statistical_validation(df: DataFrame, keys: list[str], sharpe: str, ret: str) -> DataFrame:
    """WFO-07: moments, positive shares, the one-sample t test against 0 (two-sided) and the rating.

    ``significant`` means a p-value below 0.05; without spread or with one window there is no test and both are null.
    """
    d = df.groupBy(*keys).agg(
        F.count(sharpe).alias("n"),
        F.avg(sharpe).alias("sharpe_mean"),
        F.stddev_pop(sharpe).alias("sharpe_sd"),
        F.skewness(sharpe).alias("sharpe_skew"),
        F.avg(ret).alias("return_mean"),
        F.stddev_pop(ret).alias("return_sd"),
        F.avg((F.col(sharpe) > 0).cast("int")).alias("sharpe_positive"),
        F.avg((F.col(ret) > 0).cast("int")).alias("return_positive"),
        F.try_divide(F.avg(sharpe), F.nullif(F.stddev_samp(sharpe), F.lit(0.0)) / F.sqrt(F.count(sharpe))).alias("t_stat"),
    )
    d = d.withColumn("p_value", t_two_sided(F.col("t_stat"), F.col("n") - 1))
    d = d.withColumn("significant", F.col("p_value") < 0.05)
    m, p = F.col("sharpe_mean"), F.col("sharpe_positive")
    return d.withColumn(
        "rating",
        F.when((m > 1.0) & (p > 0.7), "EXCELLENT")
        .when((m > 0.5) & (p > 0.6), "GOOD")
        .when((m > 0) & (p > 0.5), "FAIR")
        .otherwise("POOR"),
    )


def recommendation(rollup: DataFrame, least_windows: int = 5) -> DataFrame:
    """WFO-08 over the roll-up and the rating: use or not, confidence and the warnings."""
    v, o, rating = F.col("mean_validation"), F.col("mean_overfit"), F.col("rating")
    high = (v > 0.7) & (o < 0.5) & rating.isin("EXCELLENT", "GOOD")
    medium = (v > 0.5) & (o < 0.7) & rating.isin("GOOD", "FAIR")
    warnings = F.array_compact(
        F.array(
            F.when(o > 0.7, F.lit("high overfitting risk")),
            F.when(v < 0.5, F.lit("poor out-of-sample validation")),
            F.when(F.col("sharpe_positive") < 0.5, F.lit("inconsistent across periods")),
            F.when(F.col("windows") < least_windows, F.lit("too few windows")),
            F.when(F.col("trend") < -0.5, F.lit("declining validation")),
        )
    )
    return rollup.withColumns(
        {
            "use": high | medium,
            "confidence": F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"),
            "warnings": F.concat_ws("; ", warnings),
        }
    )


def stable_parameters(best: DataFrame, keys: list[str], params: list[str], score: str) -> DataFrame:
    """WFO-09: mean of each parameter over the windows scoring at least the median (few windows per key)."""
    mid = best.groupBy(*keys).agg(F.percentile(score, 0.5).alias("_mid"))
    good = best.join(mid, keys).filter(F.col(score) >= F.col("_mid"))
    return good.groupBy(*keys).agg(*[F.avg(p).alias(p) for p in params], F.count("*").alias("windows"))


def window_summary(scored: DataFrame, keys: list[str], score: str) -> DataFrame:
    """WFO-10."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("windows"),
        F.avg(score).alias("mean_score"),
        F.avg("out_return").alias("mean_return"),
        F.max_by("window_id", F.struct(F.round(score, 9), -F.col("window_id"))).alias("best_window"),
        F.min_by("window_id", F.struct(F.round(score, 9), F.col("window_id"))).alias("worst_window"),
    )


def search_thresholds(scored: DataFrame, score: str, low: float, high: float, points: int = 50, least: int = 10) -> DataFrame:
    """WFO-11: best F-score over evenly spaced thresholds with at least ``least`` positives; first maximum."""
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]
    counts = threshold_counts(scored, grid).filter(F.col("trades") >= least)
    return counts.orderBy(F.desc(F.round(score, 12)), "threshold").limit(1)


def search_by_profit(scored: DataFrame, low: float = 0.3, high: float = 0.95, points: int = 50, cost: float = 0.002) -> DataFrame:
    """WFO-12: per threshold the net return, Sharpe over all rows, mean and win rate over trades.

    Bucketed like ``threshold_counts``: one pass over the rows, sums over the buckets.
    """
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]
    ladder = F.array(*[F.lit(v) for v in grid])
    net = F.col("ret") - F.abs("ret") * cost
    d = scored.withColumn("_net", net).groupBy(
        F.size(F.filter(ladder, lambda v: F.col("score") >= v)).alias("bucket")
    ).agg(
        F.count("*").alias("n"),
        F.sum("_net").alias("s"),
        F.sum(F.col("_net") * F.col("_net")).alias("ss"),
        F.count_if(F.col("_net") > 0).alias("wins"),
    )
    packed = d.agg(F.collect_list(F.struct("bucket", "n", "s", "ss", "wins")).alias("b"), F.sum("n").alias("total"))
    t = packed.select("b", "total", F.posexplode(ladder).alias("i", "threshold"))

    def above(field: str) -> Column:
        return F.aggregate(
            F.filter("b", lambda r: r["bucket"] > F.col("i")), F.lit(0.0), lambda a, r: a + r[field].cast("double")
        )

    t = t.select("threshold", "total", above("n").alias("_n"), above("s").alias("net_return"), above("ss").alias("_ss"), above("wins").alias("_wins"))
    mean = F.col("net_return") / F.col("total")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_ss") / F.col("total") - mean * mean))
    return t.select(
        "threshold",
        F.col("_n").cast("long").alias("trades"),
        "net_return",
        (mean / (sd + 1e-9) * F.lit(6048**0.5)).alias("sharpe"),
        F.coalesce(F.try_divide("net_return", "_n"), F.lit(0.0)).alias("avg_return"),
        F.coalesce(F.try_divide("_wins", "_n"), F.lit(0.0)).alias("win_rate"),
    )


def hash_fractions(df: DataFrame, key: str, fractions: list[float], seed: int = 42) -> DataFrame:
    """WFO-13: repeatable subsamples; a row joins every fraction above its hash."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000 / 10_000
    fits = F.filter(F.array(*[F.lit(f) for f in fractions]), lambda f: u < f)
    return df.withColumn("fraction", F.explode(fits))


def robustness(share_profit: Column, sd: Column, mean: Column) -> Column:
    """WFO-14."""
    return (F.least(F.lit(1.0), 1.5 * share_profit) + (1 - sd / F.greatest(mean, F.lit(0.1)))) / 2
