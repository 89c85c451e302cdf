import numpy as np
from pyspark.sql import functions as F

from barline.operators import search as sr


def test_cells_score_like_a_row_per_combination(spark):
    rng = np.random.default_rng(4)
    n = 400
    rows = [("A", i, float(rng.integers(0, 9)), float(rng.integers(0, 9)), float(rng.normal())) for i in range(n)]
    rows += [("B", i, None if i % 5 == 0 else 2.0, None if i % 7 == 0 else 3.0, 0.5) for i in range(330)]
    d = spark.createDataFrame(rows, "symbol string, pos long, low double, high double, ret double")
    points = [(s, k, float(a), float(b)) for s in "AB" for k, (a, b) in enumerate([(0, 8), (0, 3), (2, 3), (3, 0), (8, 8), (9, 9), (2, 3)])]
    grid = spark.createDataFrame(points, "symbol string, combo long, low double, high double")
    active = (F.col("r.low") >= F.col("g.low")) & (F.col("r.high") <= F.col("g.high"))
    ret = F.when(active, F.col("r.ret")).otherwise(0.0).alias("ret")
    pairs = d.alias("r").join(grid.alias("g"), "symbol").select("symbol", "combo", "pos", ret)
    keys = ["symbol", "combo", "window_id", "role"]
    want, got = (x.toPandas().sort_values(keys, ignore_index=True) for x in (sr.grid_scores(pairs), sr.cell_scores(d, grid)))
    assert len(want) and got[keys].equals(want[keys])
    for c in ("sharpe", "total_return", "win_rate"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9)


def test_a_row_meets_no_combination(spark):
    d = spark.createDataFrame([("A", i, 1.0, 1.0, 0.1) for i in range(320)], "symbol string, pos long, low double, high double, ret double")
    grid = spark.range(5000).select(F.lit("A").alias("symbol"), F.col("id").alias("combo"), F.lit(1.0).alias("low"), F.col("id").cast("double").alias("high"))
    found = sr.cell_scores(d, grid)
    assert found.count() == 2 * 5000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(_combos") == 1
