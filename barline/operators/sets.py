"""Ordering, latest rows, keep-first/last and unions (SET)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.operators.onerow import with_row
from barline.operators.ordered import Series, numbered


def keep_first(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """SET-07: one row per key, the first (or last) by ``order``.

    An aggregate, not a window: it combines map-side, so a key with a third of
    the rows ships one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), order)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def ranked(df: DataFrame, score: str, key: str, name: str = "rank") -> DataFrame:
    """SET-04: every row with its rank by score, best first; equal scores share the first place among them.

    Rows are numbered by a range shuffle, so no task sorts the whole table; ``key`` identifies a row. A score meets
    its first place by a join on the score, whose right side has each score once. Null scores rank last.
    """
    at = numbered(df.withColumn("_down", -F.col(score)).withColumn("_none", F.col(score).isNull()), Series((), ("_none", "_down", key)))
    first = at.groupBy(F.col(score).alias("_s")).agg((F.min("_pos") + 1).alias(name))
    return at.join(first, F.col(score).eqNullSafe(F.col("_s"))).drop("_s", "_pos", "_down", "_none")


def latest(df: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """SET-03: the newest row of a feed, or of each key."""
    return keep_first(df, keys or [], F.col(order), last=True)


def newest_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """SET-02: the last n rows of each key.

    Spark prunes a ``row_number <= n`` window to n rows per key and task before
    the shuffle, so hot keys stay small.
    """
    spec = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_i", F.row_number().over(spec)).filter(F.col("_i") <= n).drop("_i")


def overlay(history: DataFrame, recent: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """SET-06: history plus the recent rows after its end; equal keys keep the last stored row.

    An empty side gives the other one.
    """
    end = history.agg(F.max(ts).alias("_end"))
    fresh = with_row(recent, end).filter(
        F.col("_end").isNull() | (F.col(ts) > F.col("_end"))
    ).drop("_end")
    both = history.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)))
    value = F.struct("_side", *[c for c in history.columns if c not in (ts, *keys)])
    return keep_first(both, [*keys, ts], value, last=True).drop("_side")
