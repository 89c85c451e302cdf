"""Group statistics (AGG). Everything here is a declarative aggregate with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

YEAR = 252


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-02: pairwise-complete Pearson matrix in long form (i, j, c1, c2, corr), one pass."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    wide = df.agg(*[F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs])
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            value = F.lit(1.0) if i == j else F.col(f"c{min(i, j)}_{max(i, j)}")
            cells.append(
                F.struct(
                    F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(a).alias("c1"), F.lit(b).alias("c2"), value.alias("corr")
                )
            )
    return wide.select(F.inline(F.array(*cells)))


def beta(asset: str, market: str) -> Column:
    """AGG-03: sample covariance over variance; 1.0 below two rows or without variance."""
    return F.coalesce(
        F.when(F.var_samp(market) > 0, F.try_divide(F.covar_samp(asset, market), F.var_samp(market))), F.lit(1.0)
    )


def alpha(mean_asset: Column, mean_market: Column, beta_: Column, rf: float = 0.02) -> Column:
    """AGG-04."""
    return mean_asset * YEAR - (rf + beta_ * (mean_market * YEAR - rf))


def sharpe_samp(r: str, rf: float = 0.02) -> Column:
    """AGG-05: yearly mean excess over sample deviation; 0 when undefined."""
    sd = F.stddev_samp(r)
    return F.coalesce(
        F.when(sd > 0, (F.avg(r) - rf / YEAR) * YEAR / (sd * F.lit(YEAR**0.5))), F.lit(0.0)
    )


def trade_summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-08. ``pnl`` already has the fee taken off and is the net; ``gross_pnl`` adds the fee again."""
    won, lost = F.col("pnl") > 0, F.col("pnl") < 0
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.count_if(won).alias("wins"),
        F.count_if(~won).alias("losses"),
        F.avg(won.cast("int")).alias("win_rate"),
        F.avg(F.when(won, F.col("pnl"))).alias("avg_win"),
        F.avg(F.when(lost, F.col("pnl"))).alias("avg_loss"),
        F.max(F.when(won, F.col("pnl"))).alias("largest_win"),
        F.min(F.when(lost, F.col("pnl"))).alias("largest_loss"),
        F.sum("pnl").alias("total_pnl"),
        F.sum("fees").alias("total_fees"),
        F.sum("pnl").alias("net_pnl"),
        F.sum(F.col("pnl") + F.col("fees")).alias("gross_pnl"),
    )


def equity_metrics(curve: DataFrame, keys: list[str], rf: float = 0.02) -> DataFrame:
    """AGG-09 over (keys, equity, prev_equity, peak): population deviations, 252 periods a year."""
    r = F.when(F.col("prev_equity") != 0, F.col("equity") / F.col("prev_equity") - 1)
    d = curve.withColumn("_r", r).withColumn("_dd", F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))
    d = d.groupBy(*keys).agg(
        F.count("equity").alias("_n"),
        F.product(1 + F.col("_r")).alias("_growth"),
        F.avg("_r").alias("_mean"),
        F.stddev_pop("_r").alias("_sd"),
        F.stddev_pop(F.when(F.col("_r") < 0, F.col("_r"))).alias("_down"),
        F.min("_dd").alias("max_drawdown_pct"),
        F.min(F.col("equity") - F.col("peak")).alias("max_drawdown"),
    )
    excess = F.col("_mean") - rf / YEAR
    root = F.lit(YEAR**0.5)
    return d.select(
        *keys,
        (F.col("_growth") - 1).alias("total_return"),
        F.when(
            F.col("_growth") > 0, F.pow("_growth", F.lit(float(YEAR)) / F.col("_n")) - 1
        ).alias("annualized_return"),
        (F.col("_sd") * root).alias("volatility"),
        F.when(F.col("_sd") > 0, excess / F.col("_sd") * root).otherwise(0.0).alias("sharpe"),
        F.when(F.col("_down") > 0, excess / (F.col("_down") * root)).otherwise(0.0).alias("sortino"),
        "max_drawdown",
        "max_drawdown_pct",
    ).withColumn(
        "calmar",
        F.when(
            (F.col("max_drawdown_pct") < 0) & (F.col("annualized_return") > 0),
            F.col("annualized_return") / F.abs("max_drawdown_pct"),
        ).otherwise(0.0),
    )


def running_performance(trades: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-10: totals and the profit factor; infinite without losses."""
    won, lost = F.col("pnl") > 0, F.col("pnl") < 0
    return trades.groupBy(*keys).agg(
        F.sum("pnl").alias("total_pnl"),
        F.avg(won.cast("int")).alias("win_rate"),
        F.avg(F.when(won, F.col("pnl"))).alias("avg_win"),
        F.avg(F.when(lost, F.col("pnl"))).alias("avg_loss"),
        F.coalesce(
            F.abs(F.try_divide(F.sum(F.when(won, F.col("pnl"))), F.sum(F.when(lost, F.col("pnl"))))),
            F.lit(float("inf")),
        ).alias("profit_factor"),
    )


def missing_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-14: null share per column, one pass, long form."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return wide.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])
        )
    )


def group_missing_shares(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """AGG-14 / MLP-07: feature count and missing share per group and over all columns."""
    every = list(dict.fromkeys(c for cols in groups.values() for c in cols))
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in every])
    cells = [
        F.struct(F.lit(g).alias("feature_group"), F.lit(len(cols)).alias("features"), F.col(c).alias("missing"))
        for g, cols in {**groups, "all": every}.items()
        for c in cols
    ]
    return wide.select(F.inline(F.array(*cells))).groupBy("feature_group").agg(
        F.first("features").alias("features"), F.avg("missing").alias("missing")
    )


def run_statistics(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """AGG-15: summary of run results per key (the number of runs bounds a group)."""
    q = df.groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        F.percentile(x, 0.5).alias("median"),
        F.stddev_pop(x).alias("sd"),
        F.min(x).alias("lowest"),
        F.max(x).alias("highest"),
        F.percentile(x, 0.025).alias("ci_low"),
        F.percentile(x, 0.975).alias("ci_high"),
        F.avg((F.col(x) > 0).cast("int")).alias("share_positive"),
        F.percentile(x, 0.05).alias("var5"),
    )
    tail = df.join(q.select(*keys, "var5"), keys).filter(F.col(x) <= F.col("var5"))
    return q.join(tail.groupBy(*keys).agg(F.avg(x).alias("tail_mean")), keys, "left")


def threshold_counts(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """AGG-16: confusion counts and score metrics per threshold.

    Input: score, truth (0/1), ret. Rows fall into the bucket of the highest
    threshold they reach, buckets are aggregated once, and the counts at or
    above each threshold are running sums over the few buckets.
    """
    ladder = F.array(*[F.lit(float(v)) for v in thresholds])
    bucket = F.size(F.filter(ladder, lambda v: F.col("score") >= v))
    binned = scored.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("truth").cast("long")).alias("pos"),
        F.sum("ret").alias("s"),
        F.sum(F.col("ret") * F.col("ret")).alias("ss"),
    )
    packed = binned.agg(F.collect_list(F.struct("bucket", "n", "pos", "s", "ss")).alias("b"))
    # At most len(thresholds) + 1 buckets.
    t = packed.select("b", F.posexplode(ladder).alias("i", "threshold"))

    def over(field: str, hit: bool) -> Column:
        rows = F.filter("b", lambda r: (r["bucket"] > F.col("i")) if hit else (r["bucket"] <= F.col("i")))
        return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r[field].cast("double"))

    t = t.select(
        "threshold",
        over("n", True).alias("trades"),
        over("pos", True).alias("tp"),
        over("n", False).alias("rest"),
        over("pos", False).alias("fn"),
        over("s", True).alias("total_return"),
        over("ss", True).alias("_ss"),
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("trades")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))

    def f_score(b: float) -> Column:
        return F.coalesce(
            F.try_divide((1 + b * b) * F.col("precision") * F.col("recall"), b * b * F.col("precision") + F.col("recall")),
            F.lit(0.0),
        )

    total = F.col("trades") + F.col("rest")
    # Rows without a trade return 0, so mean and deviation go over all rows.
    mean = F.col("total_return") / total
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_ss") / total - mean * mean))
    return (
        t.withColumns({"precision": precision, "recall": recall})
        .withColumn("accuracy", F.try_divide(F.col("tp") + F.col("rest") - F.col("fn"), total))
        .withColumns({"f05": f_score(0.5), "f1": f_score(1.0), "f2": f_score(2.0)})
        .withColumn("sharpe", mean / (sd + 1e-9) * F.lit(6048**0.5))
        .withColumn("trades", F.col("trades").cast("long"))
        .drop("_ss", "rest", "fn", "tp")
    )
