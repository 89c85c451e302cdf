"""Ordered work over series of any length.

``Window.partitionBy("symbol")`` puts a whole symbol in one task. That is right
for bars whose number is bounded by the calendar (``schema.calendar_bounded``),
and wrong for ticks, where one symbol may hold a third of the table. For those
this module numbers the rows with a range shuffle, cuts every symbol into chunks
of fixed size and runs the same window code per (symbol, chunk):

* finite windows read a *halo*: the last rows of the chunk before;
* running totals, maxima and fills add a *carry* from the chunks before.

Both are exact; no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barline.session import durable

CHUNK_ROWS = 1 << 18


@dataclass(frozen=True)
class Series:
    """Which rows form a series and how they are ordered."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)

    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        """The current row and the n - 1 rows before it."""
        return self.spec().rowsBetween(-(n - 1), 0)

    def previous(self, n: int) -> WindowSpec:
        """The n rows before the current one."""
        return self.spec().rowsBetween(-n, -1)

    def upto(self) -> WindowSpec:
        return self.spec().rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.spec().rowsBetween(Window.unboundedPreceding, -1)

    def backward(self) -> WindowSpec:
        """This row and all later ones, read from the end: a frame that only grows costs one pass."""
        latest_first = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])
        return latest_first.rowsBetween(Window.unboundedPreceding, 0)


BARS = Series()


def numbered(df: DataFrame, series: Series = BARS, bounded: bool = False) -> DataFrame:
    """Add ``_pos``, the 0-based position of each row in its series.

    bounded: the series fits one task, so ``row_number`` does it. Otherwise rows
    are range-partitioned on (keys, order), which splits hot keys and hot
    timestamps alike, and written once; partition sizes give the offsets.
    The order columns must identify a row within its series.
    """
    if bounded:
        return df.withColumn("_pos", F.row_number().over(series.spec()).cast("long") - 1)
    cols = [*series.keys, *series.order]
    ranged = durable(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", 33)),
        "numbered",
    )
    # At most one row per range partition and series in it. Written, so that the planner
    # knows how small it is and broadcasts it instead of shuffling the rows again.
    earlier = (
        Window.partitionBy(*series.keys)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = durable(
        ranged.groupBy(*series.keys, "_part")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(
            *series.keys,
            "_part",
            (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        ),
        "offsets",
    )
    return (
        ranged.join(offsets, [*series.keys, "_part"])
        .withColumn("_pos", F.col("_row") + F.col("_shift"))
        .drop("_row", "_part", "_shift")
    )


def chunked(df: DataFrame, rows: int = CHUNK_ROWS, halo: int = 0) -> DataFrame:
    """Cut numbered series into ``_chunk``s of ``rows`` rows.

    The last ``halo`` rows before a chunk are repeated in it with ``_own`` false.
    """
    home = F.floor(F.col("_pos") / rows)
    if halo == 0:
        return df.withColumn("_chunk", home).withColumn("_own", F.lit(True))
    reach = F.sequence(home, F.floor((F.col("_pos") + halo) / rows))
    return df.withColumn("_chunk", F.explode(reach)).withColumn("_own", F.col("_chunk") == home)


def chunk_series(series: Series = BARS) -> Series:
    return Series((*series.keys, "_chunk"), ("_pos",))


def owned(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_chunk", "_own", "_pos")


def rolling(
    df: DataFrame,
    build: Callable[[DataFrame, Series], DataFrame],
    halo: int,
    series: Series = BARS,
    bounded: bool = False,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Run window code that looks back at most ``halo`` rows over series of any length."""
    if bounded:
        return build(df, series)
    split = chunked(numbered(df, series), rows, halo)
    return owned(build(split, chunk_series(series)))


@dataclass(frozen=True)
class Running:
    """A running aggregate: ``value`` folded by sum, max, min or last (non-null) up to each row."""

    how: str
    value: Column

    def fold(self, col: Column) -> Column:
        if self.how == "last":
            return F.last(col, ignorenulls=True)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.how](col)

    def join(self, carry: Column, here: Column) -> Column:
        if self.how == "sum":
            return F.when(carry.isNull() & here.isNull(), None).otherwise(
                F.coalesce(carry, F.lit(0.0)) + F.coalesce(here, F.lit(0.0))
            )
        if self.how == "max":
            return F.greatest(carry, here)
        if self.how == "min":
            return F.least(carry, here)
        return F.coalesce(here, carry)


def running(
    df: DataFrame,
    aggs: dict[str, Running],
    series: Series = BARS,
    bounded: bool = False,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add running aggregates over series of any length (chunk fold, carry, in-chunk window)."""
    if bounded:
        return df.withColumns({k: a.fold(a.value).over(series.upto()) for k, a in aggs.items()})
    split = chunked(
        numbered(df.withColumns({f"_v_{k}": a.value for k, a in aggs.items()}), series), rows
    )
    inner = chunk_series(series)
    totals = split.groupBy(*inner.keys).agg(
        *[
            (
                F.max_by(F.col(f"_v_{k}"), F.when(F.col(f"_v_{k}").isNotNull(), F.col("_pos")))
                if a.how == "last"
                else a.fold(F.col(f"_v_{k}"))
            ).alias(f"_c_{k}")
            for k, a in aggs.items()
        ]
    )
    # rows / CHUNK_ROWS summary rows per series.
    earlier = (
        Window.partitionBy(*series.keys)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *inner.keys,
        *[a.fold(F.col(f"_c_{k}")).over(earlier).alias(f"_c_{k}") for k, a in aggs.items()],
    )
    out = split.withColumns(
        {f"_h_{k}": a.fold(F.col(f"_v_{k}")).over(inner.upto()) for k, a in aggs.items()}
    ).join(carry, list(inner.keys))
    out = out.withColumns(
        {k: a.join(F.col(f"_c_{k}"), F.col(f"_h_{k}")) for k, a in aggs.items()}
    )
    return owned(out.drop(*[f"_{p}_{k}" for p in "vch" for k in aggs]))
