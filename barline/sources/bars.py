"""Bar files (SRC-01, SRC-02) and sinks (SNK)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barline.functions.projection import parse_time, standardize_headers
from barline.operators.sets import keep_first


def read_csv_bars(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """SRC-01: CSV with any of the known headers; incomplete rows dropped, first row per time kept.

    Columns are read as text by header name and cast leniently, so neither an
    inference pass nor a bad cell stops the read.
    """
    raw = standardize_headers(spark.read.option("header", True).csv(path))
    prices = ["open", "high", "low", "close", "volume"]
    d = raw.select(
        *keys,
        parse_time(F.col("timestamp")).alias("ts"),
        *[F.col(c).cast("string").try_cast("double").alias(c) for c in prices],
    ).dropna(subset=["ts", *prices])
    return keep_first(d, [*keys, "ts"], F.struct(*prices))


def read_parquet_bars(spark: SparkSession, path: str, as_of: Column | None = None, cache_hours: float = 24.0) -> DataFrame:
    """SRC-02: parquet bars; with ``as_of``, files older than ``cache_hours`` are ignored."""
    df = spark.read.parquet(path)
    if as_of is None:
        return df
    age = (F.unix_micros(as_of) - F.unix_micros("_metadata.file_modification_time")) / 3.6e9
    return df.filter(age <= cache_hours)


def write_parquet(df: DataFrame, path: str, ts: str = "ts") -> None:
    """SNK-01: snappy parquet, one folder per date.

    Rows of a date spread over the tasks of their hash, so hot days do not pile up in one writer.
    """
    df.withColumn("date", F.to_date(ts)).write.mode("overwrite").partitionBy("date").parquet(path)


def write_json_reports(df: DataFrame, path: str, day: str = "day") -> None:
    """SNK-02: one nested JSON document per row, one folder per day."""
    df.withColumn("date", F.col(day)).write.mode("overwrite").partitionBy("date").json(path)


# Columns of the trade file.
TRADE_COLUMNS = ["timestamp", "action", "price", "confidence", "position", "balance", "pnl", "pnl_pct", "reason"]


def format_trades(df: DataFrame) -> DataFrame:
    """Decimals as fixed text: money with 2 places, quantities and shares with 4 to 8."""
    places = {"price": 2, "confidence": 4, "position": 8, "balance": 4, "pnl": 4, "pnl_pct": 6}
    plain = {c: F.replace(F.format_number(c, n), F.lit(","), F.lit("")) for c, n in places.items()}
    return df.withColumns(plain).select(*TRADE_COLUMNS)


def append_trades(df: DataFrame, path: str) -> None:
    """SNK-03: append-only CSV files with a header each; also the body of a ``foreachBatch``."""
    format_trades(df).write.mode("append").option("header", True).csv(path)
