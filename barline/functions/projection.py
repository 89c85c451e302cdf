"""Typing, cleaning and record rules (PRJ)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from barline.operators.ordered import Series, numbered

# Header synonyms.
SYNONYMS = {"datetime": "timestamp", "date": "timestamp", "time": "timestamp", "price": "close", "vol": "volume"}


def standardize_headers(df: DataFrame) -> DataFrame:
    """PRJ-01: lower-case names, synonyms, missing volume 0, missing open / high / low from close."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    names = set(df.columns)
    df = df.withColumnsRenamed({a: b for a, b in SYNONYMS.items() if a in names and b not in names})
    if "volume" not in df.columns:
        df = df.withColumn("volume", F.lit(0.0))
    for c in ("open", "high", "low"):
        if c not in df.columns:
            df = df.withColumn(c, F.col("close"))
    return df


def parse_time(col: Column) -> Column:
    """PRJ-02: epoch milliseconds above 1e12, else seconds; other text as a timestamp; null if neither."""
    n = col.cast("string").try_cast("bigint")
    return F.when(n > 10**12, F.timestamp_millis(n)).when(n.isNotNull(), F.timestamp_seconds(n)).otherwise(
        F.try_to_timestamp(col.cast("string"))
    )


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def drop_incomplete(df: DataFrame, subset: list[str]) -> DataFrame:
    """PRJ-04: NaN counts as null."""
    floats = [c for c, t in df.dtypes if c in subset and t in ("double", "float")]
    return nan_to_null(df, floats).dropna(subset=subset)


def drop_non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-05: infinities and NaN become null, then the rows go."""
    finite = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in columns}
    return df.withColumns(finite).dropna(subset=columns)


def between_dates(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """PRJ-06: optional bounds on a bare column, so the scan sees them."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df


def select_groups(df: DataFrame, groups: dict[str, list[str]], names: list[str], target: str) -> DataFrame:
    """PRJ-07: the available columns of the named groups and the target."""
    cols = [c for g in names for c in groups[g] if c in df.columns]
    return df.select(*dict.fromkeys(cols), target)


def narrow_types(df: DataFrame, prices: list[str] = (), integers: list[str] = ()) -> DataFrame:
    """PRJ-08: prices to float; integral columns to the smallest type their observed range fits.

    One aggregate of min and max reaches the driver: two numbers per column.
    """
    bounds = df.agg(*[F.struct(F.min(c), F.max(c), F.max(F.abs(F.col(c) % 1))).alias(c) for c in integers]).first()
    casts = {c: F.col(c).cast("float") for c in prices}
    for c in integers:
        low, high, part = bounds[c]
        if low is None or (part is not None and part > 0):
            continue
        for kind, limit in (("tinyint", 127), ("smallint", 32767), ("int", 2147483647)):
            if -limit - 1 <= low and high <= limit:
                casts[c] = F.col(c).cast(kind)
                break
    return df.withColumns(casts)


def chunk_rows(df: DataFrame, order: list[str], size: int = 50_000) -> DataFrame:
    """PRJ-09: ``chunk`` = runs of ``size`` rows in order, numbered without one big sort task."""
    return numbered(df, Series((), tuple(order))).withColumn("chunk", F.floor(F.col("_pos") / size)).drop("_pos")


def normalize_symbol(col: Column) -> Column:
    """PRJ-10."""
    s = F.translate(F.upper(col), "/-", "")

    def tail(quote: str) -> Column:
        return F.concat(F.replace(s, F.lit(quote), F.lit("")), F.lit(quote))

    return (
        F.when((F.length(s) > 6) & F.contains(s, F.lit("USDT")), tail("USDT"))
        .when((F.length(s) > 6) & F.contains(s, F.lit("BTC")), tail("BTC"))
        .otherwise(s)
    )


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    """PRJ-11."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def relative_change(old: Column, new: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(new - old, old), F.lit(default))


def round_significant(x: Column, digits: int) -> Column:
    scale = F.pow(F.lit(10.0), digits - F.floor(F.log10(F.abs(x))) - 1)
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """PRJ-12: raise with the missing names, else the frame itself."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def market_violations() -> Column:
    """PRJ-13: names of the broken rules of a market record (symbol, close, timestamp)."""
    s = F.trim("symbol")
    return F.array_compact(
        F.array(
            F.when(~F.length(s).between(3, 20), F.lit("symbol_length")),
            F.when(s != F.upper(s), F.lit("symbol_case")),
            F.when(F.contains(s, F.lit(" ")), F.lit("symbol_space")),
            F.when((F.col("close") < 0.01) | (F.col("close") > 1_000_000), F.lit("close_range")),
            F.when(F.col("timestamp") <= 0, F.lit("timestamp")),
        )
    )


def signal_violations() -> Column:
    """PRJ-13: names of the broken rules of a signal record (symbol, side, price, strength)."""
    s = F.trim("symbol")
    return F.array_compact(
        F.array(
            F.when(~F.length(s).between(3, 20), F.lit("symbol_length")),
            F.when(~F.trim("side").isin("buy", "sell"), F.lit("side")),
            F.when(F.col("price") <= 0, F.lit("price")),
            F.when(~F.col("strength").between(0.0, 1.0), F.lit("strength")),
        )
    )


def split_valid(df: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows with their violations."""
    d = df.withColumn("violations", violations)
    return d.filter(F.size("violations") == 0).drop("violations"), d.filter(F.size("violations") > 0)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """PRJ-03: the columns of ``schema`` in order, cast leniently; absent ones are null."""
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )
