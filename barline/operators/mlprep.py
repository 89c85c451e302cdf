"""Splits, scaling and sequences for model input (MLP)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barline.operators.draws import hashed, once, share
from barline.operators.onerow import with_row
from barline.operators.ordered import BARS, Series, numbered
from barline.operators.quality import attach
from barline.operators.quantiles import exact_quantiles


def chronological_split(
    df: DataFrame, shares: dict[str, float], series: Series = BARS, bounded: bool = False
) -> DataFrame:
    """MLP-01: ``split`` by position, first share first (for example train .7, validation .15, test .15)."""
    d = numbered(df, series, bounded)
    sizes = d.groupBy(*series.keys).agg((F.max("_pos") + 1).alias("_n"))
    role, edge = None, 0.0
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name]
        hit = F.col("_pos") < F.floor(F.col("_n") * F.lit(round(edge, 10)))
        role = F.when(hit, name) if role is None else role.when(hit, name)
    return attach(d, sizes, list(series.keys), bounded).withColumn("split", role.otherwise(names[-1])).drop("_pos", "_n")


def split_at(df: DataFrame, ts: str, cut: str) -> DataFrame:
    """MLP-01 by date: rows from ``cut`` on are the test rows."""
    return df.withColumn("split", F.when(F.col(ts) < F.lit(cut).cast("timestamp"), "train").otherwise("test"))


def normalize(df: DataFrame, columns: list[str], how: str, keys: list[str], bounded: bool = False) -> DataFrame:
    """MLP-02: ``<col>_normalized`` by z-score, min-max or median and MAD; 0 / 0.5 / 0 without spread."""
    for c in columns:
        x, out = F.col(c), f"{c}_normalized"
        if how == "zscore":
            stats = df.groupBy(*keys).agg(F.avg(c).alias("_a"), F.stddev_samp(c).alias("_b"))
        elif how == "minmax":
            stats = df.groupBy(*keys).agg(F.min(c).alias("_a"), (F.max(c) - F.min(c)).alias("_b"))
        else:
            mid = exact_quantiles(df, keys, c, [0.5], bounded=bounded).select(*keys, F.col("q")[0].alias("_a"))
            off = attach(df.select(*keys, c), mid, keys, bounded).withColumn("_d", F.abs(x - F.col("_a")))
            mad = exact_quantiles(off, keys, "_d", [0.5], bounded=bounded).select(*keys, F.col("q")[0].alias("_b"))
            stats = attach(mid, mad, keys, bounded=True)
        flat = 0.5 if how == "minmax" else 0.0
        value = F.coalesce(F.try_divide(x - F.col("_a"), F.nullif(F.col("_b"), F.lit(0.0))), F.when(x.isNotNull(), flat))
        df = attach(df, stats, keys, bounded).withColumn(out, value).drop("_a", "_b")
    return df


def standard_scale(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """MLP-03: population deviation, fitted on all rows in one pass."""
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    d = attach(df, stats, keys)
    scaled = {
        f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
        for c in columns
    }
    return d.withColumns(scaled).drop(*[f"_{p}_{c}" for p in "ms" for c in columns])


def sequences(df: DataFrame, features: list[str], label: Column, n: int = 60, series: Series = BARS) -> DataFrame:
    """MLP-04: the n rows before each row as an n x features array, with the row's label.

    For long series call it through ``ordered.rolling`` with halo n.
    """
    past = F.collect_list(F.array(*features)).over(series.previous(n))
    return df.withColumn("sequence", past).withColumn("label", label).filter(F.size("sequence") == n)


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """MLP-05: (x - mean) / std with a stored (column, mean, std) table; missing x counts as its mean, std 0 as 1.

    The scaler has one row per feature and joins as one map.
    """
    packed = scaler.agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "std")))).alias("_scaler")
    )
    d = with_row(df, packed)

    def scaled(c: str) -> Column:
        s = F.element_at("_scaler", F.lit(c))
        x = F.col(c) if c in df.columns else F.lit(None).cast("double")
        return (F.coalesce(x, s["mean"]) - s["mean"]) / F.when(s["std"] == 0, 1.0).otherwise(s["std"])

    return d.withColumns({f"{c}_scaled": scaled(c) for c in features}).drop("_scaler")


def augment(
    df: DataFrame, column: str, keys: list[str], seed: int = 42, noise: float = 0.02, low: float = 0.97, high: float = 1.03
) -> DataFrame:
    """MLP-06: each array times one random scale, plus normal noise per element.

    The draws are hashes of seed, ``keys`` (which tell rows apart) and position; the noise is Box-Muller over two parts
    of one hash.
    """
    row = [F.lit(seed), *[F.col(k) for k in keys]]
    d = df.withColumn("_scale", low + (high - low) * share(hashed(*row, F.lit("scale"))))

    def normal(digest: Column) -> Column:
        return F.sqrt(-2 * F.ln(1 - share(digest))) * F.cos(2 * F.pi() * share(digest, 14))

    def element(x: Column, i: Column) -> Column:
        return x * F.col("_scale") + noise * once(hashed(*row, i), normal)

    return d.withColumn(column, F.transform(column, element)).drop("_scale")
