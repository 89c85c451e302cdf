"""One-row results (global aggregates) as columns of another frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame through a scalar subquery.

    The subquery runs once and its row becomes a constant of the plan, so there is
    no join; a second row would fail the query instead of multiplying ``df``.
    """
    packed = row.select(F.struct(*[F.col(c) for c in row.columns]).alias("_row"))
    return df.withColumn("_row", packed.scalar()).select(
        *df.columns, *[F.col("_row")[c].alias(c) for c in row.columns]
    )
