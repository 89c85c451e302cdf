"""Data-quality rules, outliers, imputation and scores (DQ)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barline.functions.windows import fill_backward, fill_forward
from barline.operators.aggregates import missing_shares
from barline.operators.onerow import with_row
from barline.operators.ordered import BARS, Series
from barline.operators.quantiles import exact_quantiles
from barline.session import durable

# Expected ranges of known features.
FEATURE_RANGES = {
    "open": (0.0, 1_000_000.0),
    "high": (0.0, 1_000_000.0),
    "low": (0.0, 1_000_000.0),
    "close": (0.0, 1_000_000.0),
    "volume": (0.0, 1e15),
    "funding_rate": (-0.01, 0.01),
    "open_interest": (0.0, 1e12),
    "long_short_ratio": (0.1, 10.0),
    "fear_greed": (0.0, 100.0),
    "btc_dominance": (20.0, 80.0),
    "hash_rate": (0.0, 1e21),
    "whale_netflow": (-1.0, 1.0),
}
REQUIRED = ("ts", "open", "high", "low", "close", "volume")


def validate_bars(bars: DataFrame) -> DataFrame:
    """DQ-01: rows failing each rule and the first failing rule, in one pass."""
    missing = [c for c in REQUIRED if c not in bars.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    rules = {
        "negative_prices": F.least("open", "high", "low", "close") < 0,
        "high_below_low": F.col("high") < F.col("low"),
        "close_outside": (F.col("close") < F.col("low")) | (F.col("close") > F.col("high")),
        "null_keys": F.col("ts").isNull() | F.col("close").isNull(),
    }
    counts = bars.agg(*[F.count_if(r).alias(k) for k, r in rules.items()])
    first = reduce(lambda acc, k: F.when(F.col(k) > 0, k).otherwise(acc), reversed(list(rules)), F.lit("valid"))
    return counts.withColumn("first_failure", first)


def attach(df: DataFrame, stats: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """Add statistics to rows.

    Without keys the statistics are one row of a global aggregate. With keys they
    are written first: the planner then knows their size and broadcasts them below
    its threshold or sorts and merges above it, where an estimate from the rows
    would shuffle everything on a few hot keys. bounded rows are few either way.
    """
    if not keys:
        return with_row(df, stats)
    return df.join(stats if bounded else durable(stats, "stats"), keys)


def iqr_fences(df: DataFrame, x: str, keys: list[str], k: float = 1.5, bounded: bool = False) -> DataFrame:
    q = exact_quantiles(df, keys, x, [0.25, 0.5, 0.75], bounded=bounded)
    low, high = F.col("q")[0], F.col("q")[2]
    return q.select(
        *keys,
        (low - k * (high - low)).alias("low_fence"),
        (high + k * (high - low)).alias("high_fence"),
        F.col("q")[1].alias("median"),
    )


def flag_iqr(df: DataFrame, x: str, keys: list[str], k: float = 1.5, bounded: bool = False) -> DataFrame:
    """DQ-02: ``outlier`` beyond k interquartile ranges."""
    d = attach(df, iqr_fences(df, x, keys, k, bounded), keys, bounded)
    return d.withColumn("outlier", (F.col(x) < F.col("low_fence")) | (F.col(x) > F.col("high_fence")))


def flag_zscore(df: DataFrame, x: str, keys: list[str], threshold: float = 3.0, bounded: bool = False) -> DataFrame:
    """DQ-03: beyond ``threshold`` sample deviations; never without spread."""
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_sd"))
    z = F.abs(F.try_divide(F.col(x) - F.col("_m"), F.col("_sd")))
    return attach(df, stats, keys, bounded).withColumn("outlier", F.coalesce(z > threshold, F.lit(False))).drop("_m", "_sd")


def flag_modified_z(df: DataFrame, x: str, keys: list[str], threshold: float = 3.5, bounded: bool = False) -> DataFrame:
    """DQ-04: by the median absolute deviation; never when it is 0."""
    mid = exact_quantiles(df, keys, x, [0.5], bounded=bounded).select(*keys, F.col("q")[0].alias("_med"))
    d = attach(df, mid, keys, bounded).withColumn("_dev", F.abs(F.col(x) - F.col("_med")))
    mad = exact_quantiles(d, keys, "_dev", [0.5], bounded=bounded).select(*keys, F.col("q")[0].alias("_mad"))
    score = F.try_divide(0.6745 * (F.col(x) - F.col("_med")), F.col("_mad"))
    out = attach(d, mad, keys, bounded).withColumn("outlier", F.coalesce(F.abs(score) > threshold, F.lit(False)))
    return out.drop("_med", "_dev", "_mad")


def treat_outliers(
    df: DataFrame, x: str, keys: list[str], how: str = "clip", k: float = 1.5, bounded: bool = False
) -> DataFrame:
    """DQ-05: clip to the fences, or replace by null or the median."""
    d = attach(df, iqr_fences(df, x, keys, k, bounded), keys, bounded)
    outside = (F.col(x) < F.col("low_fence")) | (F.col(x) > F.col("high_fence"))
    value = {
        "clip": F.least(F.greatest(F.col(x), F.col("low_fence")), F.col("high_fence")),
        "null": F.when(~outside, F.col(x)),
        "median": F.when(outside, F.col("median")).otherwise(F.col(x)),
    }[how]
    return d.withColumn(x, F.when(F.col(x).isNotNull(), value)).drop("low_fence", "high_fence", "median")


def impute(df: DataFrame, x: str, how: str, keys: list[str], series: Series = BARS, bounded: bool = False) -> DataFrame:
    """DQ-06: ffill, bfill, mean, median, zero or drop."""
    if how == "drop":
        return df.dropna(subset=[x])
    if how == "zero":
        return df.withColumn(x, F.coalesce(x, F.lit(0.0)))
    if how in ("ffill", "bfill"):
        fill = fill_forward if how == "ffill" else fill_backward
        return df.withColumn(x, fill(x, series))
    if how == "mean":
        stats = df.groupBy(*keys).agg(F.avg(x).alias("_s"))
    else:
        stats = exact_quantiles(df, keys, x, [0.5], bounded=bounded).select(*keys, F.col("q")[0].alias("_s"))
    return attach(df, stats, keys, bounded).withColumn(x, F.coalesce(x, "_s")).drop("_s")


def fill_statistics(df: DataFrame, means: dict[str, str], modes: dict[str, str]) -> DataFrame:
    """AGG-17: mean of numeric columns, most frequent value of others ('unknown' if none)."""
    out = df.agg(*[F.avg(c).alias(name) for c, name in means.items()])
    for c, name in modes.items():
        top = (
            df.filter(F.col(c).isNotNull()).groupBy(c).count().agg(F.min_by(c, F.struct(-F.col("count"), c)).alias(name))
        )
        out = with_row(out, top).withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("unknown")))
    return out


def acceptable_missing(df: DataFrame, columns: list[str], limit: float = 0.10) -> DataFrame:
    """DQ-07."""
    return missing_shares(df, columns).withColumn("acceptable", F.col("missing") <= limit)


def freshness(df: DataFrame, as_of: Column, ts: str = "ts", keys: list[str] | None = None, max_hours: float = 24) -> DataFrame:
    """DQ-08: age of the newest row at ``as_of``."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.max(ts))) / 3.6e9
    out = df.groupBy(*(keys or [])).agg(age.alias("age_hours"))
    return out.withColumn("fresh", F.col("age_hours") <= max_hours)


def validate_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """DQ-09: count and share out of range with the actual bounds, long form, one pass."""
    known = {c: r for c, r in (ranges or FEATURE_RANGES).items() if c in df.columns}
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("out_of_range"),
                F.coalesce(F.try_divide(F.count_if((F.col(c) < lo) | (F.col(c) > hi)), F.count(c)), F.lit(0.0)).alias("share"),
                F.min(c).alias("lowest"),
                F.max(c).alias("highest"),
            ).alias(c)
            for c, (lo, hi) in known.items()
        ]
    )
    return wide.select(F.inline(F.array(*known)))


# Weights of the quality score.
QUALITY_WEIGHTS = {"completeness": 0.3, "validity": 0.25, "freshness": 0.25, "consistency": 0.2}


def quality_score(
    df: DataFrame, columns: list[str], as_of: Column, ranges: dict[str, tuple[float, float]], max_hours: float = 24, threshold: float = 3.0
) -> DataFrame:
    """DQ-10: completeness, validity, freshness and consistency; two passes over the rows."""
    stats = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"_sd_{c}") for c in columns],
    )
    d = with_row(df, stats)
    outlier = {
        c: F.coalesce(F.abs(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_sd_{c}"))) > threshold, F.lit(False))
        for c in columns
    }
    inside = {c: F.col(c).between(*ranges[c]) for c in columns if c in ranges}

    def mean_of(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, parts) / len(parts)

    age = (F.unix_micros(as_of) - F.unix_micros(F.max("ts"))) / 3.6e9
    out = d.agg(
        (1 - mean_of([F.avg(F.col(c).isNull().cast("int")) for c in columns])).alias("completeness"),
        (mean_of([F.avg(F.coalesce(v, F.lit(True)).cast("int")) for v in inside.values()]) if inside else F.lit(1.0)).alias("validity"),
        F.greatest(F.lit(0.0), 1 - age / max_hours).alias("freshness"),
        (1 - mean_of([F.avg(v.cast("int")) for v in outlier.values()])).alias("consistency"),
    )
    total = reduce(lambda a, b: a + b, [F.col(k) * v for k, v in QUALITY_WEIGHTS.items()])
    return out.withColumn("score", total).withColumn("passed", F.col("score") >= 0.7)


def clean(df: DataFrame, columns: list[str], keys: list[str], series: Series = BARS, bounded: bool = True) -> DataFrame:
    """DQ-11: clip outliers of all columns by one join of fences, then fill forward and backward."""
    fences = None
    for c in columns:
        f = iqr_fences(df, c, keys, bounded=bounded).select(
            *keys, F.col("low_fence").alias(f"_lo_{c}"), F.col("high_fence").alias(f"_hi_{c}")
        )
        fences = f if fences is None else attach(fences, f, keys, bounded)
    d = attach(df, fences, keys, bounded)
    clipped = {
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}")))
        for c in columns
    }
    d = d.withColumns(clipped).drop(*[f"_{p}_{c}" for p in ("lo", "hi") for c in columns])
    d = d.withColumns({c: fill_forward(c, series) for c in columns})
    return d.withColumns({c: fill_backward(c, series) for c in columns})


def source_report(bars: DataFrame, columns: list[str], gap_minutes: Column, series_keys: list[str], synthetic: bool = False) -> DataFrame:
    """DQ-12: rows, missing share, range, gaps over 3x the median spacing, and the score."""
    d = bars.withColumn("_gap", gap_minutes)
    mid = d.groupBy(*series_keys).agg(F.percentile("_gap", 0.5).alias("_mid"))
    out = d.join(mid, series_keys).groupBy(*series_keys).agg(
        F.count("*").alias("n_rows"),
        (reduce(lambda a, b: a + b, [F.avg(F.col(c).isNull().cast("int")) for c in columns]) / len(columns)).alias("missing"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if(F.col("_gap") > 3 * F.col("_mid")).alias("gaps"),
    )
    score = (
        1
        - 2 * F.col("missing")
        - F.least(F.lit(0.2), F.col("gaps") / 100)
        - F.when(F.col("n_rows") < 1000, 0.2).when(F.col("n_rows") < 5000, 0.1).otherwise(0.0)
        - F.lit(0.3 if synthetic else 0.0)
    )
    return out.withColumn("score", F.greatest(F.lit(0.0), score))


def drift(current: DataFrame, reference: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """DQ-13: shift of the mean in population deviations of the reference; 0 below 30 rows or without spread."""
    a = current.groupBy(*keys).agg(F.avg(x).alias("_mc"), F.count(x).alias("_nc"))
    b = reference.groupBy(*keys).agg(F.avg(x).alias("_mr"), F.stddev_pop(x).alias("_sr"), F.count(x).alias("_nr"))
    ok = (F.col("_nc") >= 30) & (F.col("_nr") >= 30) & (F.col("_sr") > 0)
    shift = F.try_divide(F.abs(F.col("_mc") - F.col("_mr")), F.col("_sr"))
    return a.join(b, keys).select(*keys, F.when(ok, shift).otherwise(0.0).alias("drift"))
