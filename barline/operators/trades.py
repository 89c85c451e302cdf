"""Entries, exits and equity as set operations (TRD)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.operators.draws import hashed, poisson, share

FANOUT = 32


def entries(
    signals: DataFrame, stop: float = 0.02, target: float = 0.05, slippage: float = 0.0005, quantity: float = 1.0
) -> DataFrame:
    """TRD-01: from (symbol, ts, close, side +1/-1) to fills with stop and target prices."""
    side = F.col("side")
    fill = F.col("close") * (1 + side * slippage)
    return signals.select(
        "symbol",
        "ts",
        side.cast("int").alias("side"),
        F.lit(quantity).alias("quantity"),
        fill.alias("entry_price"),
        (fill * (1 - side * stop)).alias("stop_price"),
        (fill * (1 + side * target)).alias("target_price"),
    )


def _first(rows: Column) -> Column:
    return F.get(rows, F.lit(0))


def _levels(bars: DataFrame, first: int, last: int, interval_seconds: int) -> list[DataFrame]:
    """Level by level (symbol, n, children, lo, hi, end): up to 32 children each, until one node spans the period.

    A node is numbered by the calendar from the first bar on. The children of the lowest level are bars, numbered by their
    second; ``end`` is the last bar below the node.
    """
    rows = bars.select("symbol", F.unix_seconds("ts").alias("n"), F.col("close").alias("lo"), F.col("close").alias("hi"))
    rows = rows.withColumn("end", F.struct("n", F.col("lo").alias("close")))
    width, levels = interval_seconds * FANOUT, []
    while True:
        number = F.floor((F.col("n") - first) / width) if not levels else F.floor(F.col("n") / FANOUT)
        rows = rows.withColumn("_up", number).groupBy("symbol", F.col("_up").alias("n")).agg(
            F.array_sort(F.collect_list(F.struct("n", "lo", "hi"))).alias("children"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.max("end").alias("end"),
        )
        levels.append(rows)
        if first + width > last:
            return levels
        width *= FANOUT


def first_exit(bars: DataFrame, trades: DataFrame, interval_seconds: int = 3600) -> DataFrame:
    """JOIN-09 / TRD-02: the first later bar whose close reaches stop or target, over the whole period.

    A search tree instead of entry x bar pairs. Its height follows the period, its nodes hold at most 32 children with
    their lowest and highest close and are keyed by (symbol, calendar number), so no array and no key grows with the
    history. Climbing takes one join: the later siblings on the way up are put together once for each lowest block that
    has entries, and an entry reads them by its own block. Descending to the bar takes one join a level with at most one
    match. Many entries that leave at the same bar share a key there; such partitions are split by adaptive execution.

    Bars must be unique per (symbol, ts) on the interval. Entries may lie outside the period of the bars.
    """
    span = bars.agg(F.unix_seconds(F.min("ts")).alias("a"), F.unix_seconds(F.max("ts")).alias("b")).first()
    first, last = (span.a, span.b) if span.a is not None else (0, 0)
    levels = _levels(bars, first, last, interval_seconds)

    def crosses(r: Column) -> Column:
        return (r["lo"] <= F.col("_low")) | (r["hi"] >= F.col("_high"))

    def hit(children: str, level: int, after: Column | None) -> Column:
        """The first child that crosses, as (level, n, close)."""
        later = F.filter(children, lambda r: crosses(r) if after is None else (r["n"] > after) & crosses(r))
        return _first(F.transform(later, lambda r: F.struct(F.lit(level).alias("level"), r["n"].alias("n"), r["lo"].alias("close"))))

    inside = F.least(F.greatest(F.col("_e"), F.lit(first)), F.lit(last))
    d = trades.withColumns(
        {
            "_e": F.unix_seconds("ts"),
            "_low": F.least("stop_price", "target_price"),
            "_high": F.greatest("stop_price", "target_price"),
        }
    ).withColumn("_block", F.floor((inside - first) / (interval_seconds * FANOUT)))

    def ancestor(level: int) -> Column:
        return F.floor(F.col("_block") / FANOUT ** (level - 1))

    def later(children: str, number: Column) -> Column:
        return F.filter(children, lambda r: r["n"] > number)

    path = d.select("symbol", "_block").distinct()
    for k, nodes in enumerate(levels, 1):
        node = nodes.select("symbol", F.col("n").alias("_n"), F.col("children").alias(f"_c{k}"), *(["end"] if k == len(levels) else []))
        path = path.withColumn("_n", ancestor(k)).join(node, ["symbol", "_n"], "left").drop("_n")
        if k > 1:
            path = path.withColumn(f"_c{k}", later(f"_c{k}", ancestor(k - 1)))
    path = path.withColumnRenamed("end", "_end")
    d = d.join(path, ["symbol", "_block"], "left")
    up = [hit("_c1", 1, F.col("_e")), *(hit(f"_c{k}", k, None) for k in range(2, len(levels) + 1))]
    d = d.withColumn("_at", F.coalesce(*up)).drop("_block", *(f"_c{k}" for k in range(1, len(levels) + 1)))

    # Keys that must not match spread over many values instead of one null.
    nowhere = F.lit(-(10**12)) - F.pmod(F.col("_e"), F.lit(4096))
    for k in range(len(levels) - 1, 0, -1):
        here = F.coalesce(F.col("_at.level") == k + 1, F.lit(False))
        node = levels[k - 1].select("symbol", F.col("n").alias("_n"), F.col("children").alias("_c"))
        d = d.withColumn("_n", F.when(here, F.col("_at.n")).otherwise(nowhere)).join(node, ["symbol", "_n"], "left")
        d = d.withColumn("_at", F.when(here, hit("_c", k, None)).otherwise(F.col("_at"))).drop("_c", "_n")
    close = F.col("_at.close")
    at_stop = F.when(F.col("side") > 0, close <= F.col("stop_price")).otherwise(close >= F.col("stop_price"))
    return d.select(
        *trades.columns,
        F.timestamp_seconds(F.coalesce("_at.n", "_end.n")).alias("exit_ts"),
        F.coalesce(close, F.col("_end.close")).alias("exit_price"),
        F.when(F.col("_at").isNull(), "END_OF_PERIOD")
        .when(at_stop, "STOP_LOSS")
        .otherwise("TAKE_PROFIT")
        .alias("exit_reason"),
    )


def settle(exits: DataFrame, fee: float = 0.001) -> DataFrame:
    """TRD-02: profit after a fee of ``fee`` on its absolute value."""
    gross = F.col("side") * (F.col("exit_price") - F.col("entry_price")) * F.col("quantity")
    return exits.withColumn("fees", F.abs(gross) * fee).withColumn("pnl", gross - F.col("fees"))


def barrier_return(exits: DataFrame, fee: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """TRD-02, second form: fills at the barrier, costs twice off the return."""
    price = (
        F.when(F.col("exit_reason") == "STOP_LOSS", F.col("stop_price"))
        .when(F.col("exit_reason") == "TAKE_PROFIT", F.col("target_price"))
        .otherwise(F.col("exit_price"))
    )
    gross = F.col("side") * F.try_divide(price - F.col("entry_price"), F.col("entry_price"))
    return exits.withColumn("pnl_pct", gross - 2 * (fee + slippage))


def equity_curve(bars: DataFrame, ledger: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """TRD-03 / TRD-04: open quantity, unrealised and realised profit and equity per bar.

    Unrealised profit is linear in the close, so running sums of signed quantity
    and cost over entry and exit events give it without pairing bars and trades.
    """
    q = F.col("side") * F.col("quantity")
    cost = q * F.col("entry_price")
    def event(ts: str, k: int, sign: int, realized: Column) -> Column:
        return F.struct(
            F.col(ts).alias("ts"), F.lit(k).alias("k"), (sign * q).alias("q"), (sign * cost).alias("c"), realized.alias("r")
        )

    both = F.array(event("ts", 1, 1, F.lit(0.0)), event("exit_ts", -1, -1, F.col("pnl")))
    moves = ledger.select("symbol", F.explode(both).alias("_e")).select("symbol", "_e.*").groupBy("symbol", "ts").agg(
        F.sum("k").alias("k"), F.sum("q").alias("q"), F.sum("c").alias("c"), F.sum("r").alias("r")
    )
    upto = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = bars.select("symbol", "ts", "close").join(moves, ["symbol", "ts"], "left").fillna(0)
    d = d.withColumns({f"_{c}": F.sum(c).over(upto) for c in "kqcr"})
    return d.select(
        "symbol",
        "ts",
        F.col("_k").cast("long").alias("open_trades"),
        (F.col("close") * F.col("_q") - F.col("_c")).alias("unrealized"),
        F.col("_r").alias("realized"),
    ).withColumn("equity", capital + F.col("realized") + F.col("unrealized"))


def readiness(metrics: DataFrame) -> DataFrame:
    """TRD-05: six checks, their share and the verdict."""
    checks = {
        "ok_trades": F.col("trades") >= 50,
        "ok_win_rate": F.col("win_rate") >= 0.55,
        "ok_drawdown": F.abs("max_drawdown_pct") <= 0.15,
        "ok_sharpe": F.col("sharpe") >= 1.0,
        "ok_net": F.col("net_pnl") > 0,
        "ok_volatility": F.col("volatility") < 0.5,
    }
    checks = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    score = sum((v.cast("int") for v in checks.values()), F.lit(0)) / 6
    return metrics.withColumns({**checks, "readiness": score, "ready": score >= 0.8})


def comparison_score(validation: Column, overfit: Column, sharpe: Column) -> Column:
    """TRD-06."""
    return 0.4 * validation + 0.3 * (1 - overfit) + 0.3 * F.greatest(F.lit(0.0), F.least(F.lit(2.0), sharpe)) / 2


def bootstrap(df: DataFrame, replicates: int, keys: list[str], seed: int = 42) -> DataFrame:
    """TRD-07: replicates of the rows drawn with replacement; ``copies`` says how often a replicate holds the row.

    Every row draws its own multiplicity (Poisson, the large-sample form of drawing n of n), so no step needs a row
    count or an order. The draw is a hash of seed, ``keys`` (which tell rows apart) and replicate.
    """
    d = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draw = share(hashed(F.lit(seed), *[F.col(k) for k in keys], F.col("replicate")))
    return d.withColumn("copies", poisson(draw)).filter("copies > 0")


def signal_proxy(signals: DataFrame, keys: list[str]) -> DataFrame:
    """TRD-08: +/-0.001 * strength per signal -> Sharpe, Sortino, total, win rate."""
    r = F.when(F.col("direction") == "long", 0.001).otherwise(-0.001) * F.col("strength")
    d = signals.withColumn("_r", r)
    down = F.stddev_pop(F.when(F.col("_r") < 0, F.col("_r")))
    root = F.lit(252**0.5)
    return d.groupBy(*keys).agg(
        (F.avg("_r") / (F.stddev_pop("_r") + 1e-8) * root).alias("sharpe"),
        (F.avg("_r") / (F.coalesce(down, F.lit(0.0)) + 1e-8) * root).alias("sortino"),
        F.sum("_r").alias("total_return"),
        F.avg((F.col("_r") > 0).cast("int")).alias("win_rate"),
    )
