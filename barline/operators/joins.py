"""Joins of bars with side feeds.

No join is hinted: feeds below ``spark.sql.autoBroadcastJoinThreshold`` are
broadcast by Spark after its own size check (again at run time by AQE), larger
ones become sort-merge joins with skew splitting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barline.operators.ordered import BARS, Running, Series, running
from barline.operators.sets import keep_first


def join_feed(
    bars: DataFrame,
    feed: DataFrame,
    key: Column,
    columns: list[str],
    order: Column | None = None,
    default: float | None = None,
    series: Series = BARS,
    bounded: bool = False,
    fill: bool = True,
) -> DataFrame:
    """JOIN-01..05: left join on ``key`` (feed column ``_key``), then forward fill in time order.

    The feed keeps its first row per key by ``order``, so duplicates never multiply bars.
    """
    side = feed.select("_key", *columns, *([order.alias("_o")] if order is not None else []))
    if order is not None:
        side = keep_first(side, ["_key"], F.col("_o")).select("_key", *columns)
    out = bars.withColumn("_key", key).join(side, "_key", "left").drop("_key")
    if fill:
        out = running(out, {f"_f_{c}": Running("last", F.col(c)) for c in columns}, series, bounded)
        out = out.drop(*columns).withColumnsRenamed({f"_f_{c}": c for c in columns})
    if default is not None:
        out = out.fillna(default, subset=columns)
    return out


def day_spine(df: DataFrame, ts: str) -> DataFrame:
    """Every calendar day between the first and the last row."""
    ends = df.agg(F.to_date(F.min(ts)).alias("a"), F.to_date(F.max(ts)).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))


def fold_sources(spine: DataFrame, sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """JOIN-06: left-join each (name, frame, time column) on its calendar day, first row per day."""

    def step(acc: DataFrame, source: tuple[str, DataFrame, str]) -> DataFrame:
        _, df, ts = source
        fresh = [c for c in df.columns if c != ts and c not in acc.columns]
        daily = keep_first(
            df.select(F.to_date(ts).alias("day"), F.col(ts).alias("_ts"), *fresh),
            ["day"],
            F.struct("_ts", *fresh),
        ).drop("_ts")
        return acc.join(daily, "day", "left")

    return reduce(step, [s for s in sources if s[2] in s[1].columns], spine)


def align(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """JOIN-07: rows both series have, without nulls."""
    return a.join(b, on).dropna(subset=columns)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    ts: str,
    values: list[str],
    tie: str,
    max_age_seconds: float | None = None,
    bounded: bool = False,
) -> DataFrame:
    """JOIN-08: the last right row at or before each left row, in one pass over the union.

    ``tie`` orders left rows of equal time. max_age_seconds drops values that are too old (STR-07).
    """
    rest = [c for c in left.columns if c not in (*keys, ts)]
    lhs = left.select(
        *keys, ts, F.struct(*rest).alias("_left"), F.lit(1).alias("_side"), F.col(tie).cast("string").alias("_tie")
    )
    rhs = right.select(
        *keys, ts, F.struct(F.col(ts).alias("_at"), *values).alias("_right"), F.lit(0).alias("_side")
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    series = Series(tuple(keys), (ts, "_side", "_tie"))
    found = running(both, {"_hit": Running("last", F.col("_right"))}, series, bounded).filter("_side = 1")
    if max_age_seconds is not None:
        age = (F.unix_micros(F.col(ts)) - F.unix_micros("_hit._at")) / 1e6
        found = found.withColumn("_hit", F.when(age <= max_age_seconds, F.col("_hit")))
    return found.select(*keys, ts, "_left.*", *[F.col(f"_hit.{v}").alias(v) for v in values])


def correlated_pairs(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    """JOIN-11: column pairs i < j of a long correlation matrix with abs(corr) >= threshold."""
    return matrix.filter((F.col("i") < F.col("j")) & (F.abs("corr") >= threshold))
