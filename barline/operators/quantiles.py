"""Exact, linearly interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here a sketch brackets each quantile, counts below the bracket and the few
values inside it give the exact order statistics; all steps combine map-side. The
brackets are written once: both later passes read them, and their known size
lets the planner broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barline.operators.onerow import with_row
from barline.session import durable

ACCURACY = 100_000


def exact_quantiles(
    df: DataFrame, keys: list[str], x: str, probs: list[float], out: str = "q", accuracy: int = ACCURACY, bounded: bool = False
) -> DataFrame:
    """One row per group: ``n`` (non-null values) and the array ``out`` of quantiles.

    bounded: every group is known to be small (bars of a symbol), so the exact
    ``percentile`` aggregate may hold it.
    """
    if bounded:
        return df.groupBy(*keys).agg(F.count(x).alias("n"), F.percentile(x, F.array(*[F.lit(p) for p in probs])).alias(out))
    slack = 3.0 / accuracy
    grid = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    k = len(probs)
    data = df.select(*keys, F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    sketch = data.groupBy(*keys).agg(
        F.count("_x").alias("n"),
        F.min("_x").alias("_lo"),
        F.max("_x").alias("_hi"),
        F.percentile_approx("_x", grid, accuracy).alias("_grid"),
    )
    # Groups no larger than the sketch are their own bracket.
    whole = F.col("n") <= accuracy
    brackets = durable(sketch.select(
        *keys,
        "n",
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"),
                    F.when(whole, F.col("_lo")).otherwise(F.col("_grid")[i]).alias("lo"),
                    F.when(whole, F.col("_hi")).otherwise(F.col("_grid")[k + i]).alias("hi"),
                )
                for i in range(k)
            ]
        ).alias("_b"),
    ), "brackets")
    joined = data.join(brackets, keys) if keys else with_row(data, brackets)
    below = joined.groupBy(*keys).agg(
        *[F.count_if(F.col("_x") < F.col("_b")[i]["lo"]).alias(f"_below{i}") for i in range(k)]
    )
    below = below.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_below{i}").alias("below")) for i in range(k)])
        ).alias("_s"),
    ).select(*keys, F.col("_s.i").alias("_i"), F.col("_s.below").alias("_below"))
    inside = (
        joined.select(
            *keys,
            "n",
            "_x",
            F.explode(F.filter("_b", lambda b: F.col("_x").between(b["lo"], b["hi"]))).alias("_b"),
        )
        .groupBy(*keys, F.col("_b.i").alias("_i"), "_x")
        .agg(F.first("n").alias("n"), F.count("_x").alias("_c"))
    )
    upto = Window.partitionBy(*keys, "_i").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_cum", F.sum("_c").over(upto)).join(below, [*keys, "_i"])
    p = F.element_at(F.array(*[F.lit(float(v)) for v in probs]), F.col("_i") + 1)
    rank = (F.col("n") - 1) * p
    reach = F.col("_cum") + F.col("_below")
    values = ranked.groupBy(*keys, "_i").agg(
        F.first("n").alias("n"),
        F.min(F.when(reach > F.floor(rank), F.col("_x"))).alias("_a"),
        F.min(F.when(reach > F.ceil(rank), F.col("_x"))).alias("_z"),
    )
    rank = (F.col("n") - 1) * p
    line = F.col("_a") + (F.coalesce("_z", "_a") - F.col("_a")) * (rank - F.floor(rank))
    return values.withColumn("_q", line).groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias(out),
    )
