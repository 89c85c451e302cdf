"""The analytics tables and the bar series derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barline.operators.resample import bars_from_ticks
from barline.session import durable


class Tables:
    """Parquet tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # One time type everywhere: instants, shown in UTC. A cast would hide ts from the scan's filters.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def ticks(self) -> DataFrame:
        """Events as ticks: the type is the symbol, the value the price."""
        return self.events.select(
            F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), "event_id"
        )

    def hourly(self) -> DataFrame:
        """Hourly bars of the event types; volume is the number of ticks."""
        return bars_from_ticks(self.ticks(), "1h")

    def hourly_stored(self) -> DataFrame:
        """Hourly bars written once, for queries that branch: the ticks are scanned a single time."""
        return durable(self.hourly(), "hourly")

    def daily(self) -> DataFrame:
        """Daily bars of the event types."""
        return bars_from_ticks(self.ticks(), "1d")

    def brand_daily(self) -> DataFrame:
        """Daily bars per brand: unit price and quantity of the order lines."""
        lines = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_brand").alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            "l_quantity",
            # Line order within a day as one number: a struct would force a sort-based aggregate.
            (F.col("l_orderkey") * 1024 + F.col("l_linenumber")).alias("_order"),
        )
        return bars_from_ticks(lines, "1d", volume=F.col("l_quantity"), order=F.col("_order"))

    def daily_index(self) -> DataFrame:
        """A side feed: the mean order value of each day."""
        return self.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(
            F.avg("o_totalprice").alias("value")
        )
