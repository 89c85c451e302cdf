"""STR-03, batch form: one position at a time per symbol, as joins.

A loop over the rows of a symbol is replaced by two lookups and a walk along links:

* The exit of an entry at any row. The target is the first later row at or above its price. Stop and trailing stop
  together are the first row ``i`` that lies the trailing share below *some* row since the entry, so it is the smallest
  such exit over the entry's row and all later rows: a running minimum read from the end. Both lookups use the search
  tree of ``trades.first_exit``.
* Which rows are entries. Every row links to the first row after its exit; from the first row of a symbol the links are
  followed by doubling (1, 2, 4, ... links at once), so the number of joins follows the logarithm of the positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barline.operators.ordered import BARS as S
from barline.operators.trades import first_exit
from barline.session import durable

# Stop, target and trailing distance as shares of the price.
STOP, TARGET, TRAIL = 0.02, 0.04, 0.02


def exits(bars: DataFrame, interval_seconds: int = 3600) -> DataFrame:
    """(symbol, ts, price) -> the exit and the following entry of a position opened at each row with a positive price."""
    far = F.lit(float("inf"))
    prices = F.col("price")
    sides = F.explode(F.array(
        F.struct(F.lit("fall").alias("kind"), (prices * (1 - TRAIL)).alias("stop_price"), far.alias("target_price")),
        F.struct(F.lit("rise").alias("kind"), (-far).alias("stop_price"), (prices * (1 + TARGET)).alias("target_price")),
    ))
    asked = bars.filter("price > 0").withColumn("_s", sides).select("symbol", "ts", F.lit(1).alias("side"), "_s.*")
    found = first_exit(bars.withColumnRenamed("price", "close"), asked, interval_seconds)
    reached = F.when(F.col("exit_reason") != "END_OF_PERIOD", F.col("exit_ts"))
    each = found.groupBy("symbol", "ts").agg(
        *[F.max(F.when(F.col("kind") == k, reached)).alias(f"_{k}") for k in ("fall", "rise")])
    rows = bars.join(each, ["symbol", "ts"], "left").withColumns({
        "_fall": F.min("_fall").over(S.backward()),
        "_next": F.min(F.when(F.col("price") > 0, F.col("ts"))).over(S.backward().rowsBetween(Window.unboundedPreceding, -1)),
    })
    rows = durable(rows.withColumn("exit_ts", F.least("_fall", "_rise")), "exits")
    at = rows.select("symbol", F.col("ts").alias("exit_ts"), F.col("price").alias("exit_price"), F.col("_next").alias("next_ts"))
    entry = rows.filter("price > 0").select("symbol", "ts", "price", "exit_ts")
    return entry.join(at, ["symbol", "exit_ts"], "left")


def followed(links: DataFrame, first: DataFrame) -> DataFrame:
    """The (symbol, ts) that links (symbol, ts, next_ts) reach from ``first``, itself included."""
    links = durable(links.filter("next_ts IS NOT NULL"), "links")
    while not links.isEmpty():
        step = first.join(links, ["symbol", "ts"]).select("symbol", F.col("next_ts").alias("ts"))
        first = durable(first.unionByName(step), "reached")
        then = links.select("symbol", F.col("ts").alias("next_ts"), F.col("next_ts").alias("_then"))
        links = durable(links.join(then, ["symbol", "next_ts"]).select("symbol", "ts", F.col("_then").alias("next_ts")), "links")
    return first


def positions(bars: DataFrame, interval_seconds: int = 3600) -> DataFrame:
    """(symbol, ts, price) -> one row per closed position: entry, exit and reason.

    Enter at the first row with a positive price when flat; leave at the first later row that meets stop, target or
    trailing stop, in this order; the row of the exit is not entered again. Bars are unique per (symbol, ts) on the
    interval, which bounds a symbol's rows by the calendar. Rows without a price (null, NaN) are passed over.
    """
    bars = durable(bars.select("symbol", "ts", F.col("price").cast("double").alias("price")).filter(
        "price IS NOT NULL AND NOT isnan(price)"), "prices")
    trips = durable(exits(bars, interval_seconds), "trips")
    first = trips.groupBy("symbol").agg(F.min("ts").alias("ts"))
    entered = followed(trips.select("symbol", "ts", "next_ts"), first)
    entry, price = F.col("price"), F.col("exit_price")
    reason = (
        F.when(price <= entry * (1 - STOP), "STOP_LOSS")
        .when(price >= entry * (1 + TARGET), "TAKE_PROFIT")
        .otherwise("TRAILING_STOP")
    )
    return trips.filter("exit_ts IS NOT NULL").join(entered, ["symbol", "ts"]).select(
        "symbol", F.col("ts").alias("entry_ts"), entry.alias("entry_price"), "exit_ts", "exit_price", reason.alias("reason"))
