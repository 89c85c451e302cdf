import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import topk


def brute(rows, k, step):
    ok = [(i, np.floor(64 * np.array(v, np.float64)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % step == 0:
            best = sorted(((-int(q @ c), j) for j, c in ok if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def check(spark, rows, k=5, step=4):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, norm string")
    got = topk.top_k(df, lambda i: F.col(i) % step == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, k, step)


@pytest.mark.parametrize("block", [16, 2048])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        v = rng.normal(size=8) * rng.choice([0.1, 1, 3])
        rows.append((i, np.float32(v if i % 10 else np.ones(8)).tolist()))
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [])
    rows = [(0, None), (4, [1.0, None]), (8, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (16, []), (20, [0.0, 0.0]), (None, [1.0, 1.0]), (24, [1.0, 2.0]), (3, [-1.0, -2.0])]
    check(spark, rows)
    check(spark, [(4, [1.0, 2.0])])
