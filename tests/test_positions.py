import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from barline.operators.positions import positions
from barline.streaming.state import follow

START = datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, price double"


def walk(rng, symbol, n, step):
    price, out = 100.0, []
    for i in range(n):
        price *= 1 + rng.uniform(-step, step)
        if rng.random() > 0.2:
            out.append((symbol, START + timedelta(hours=i), 0.0 if rng.random() < 0.02 else round(price, 2)))
    return out


def loop(rows):
    """The rules row by row, as the stream applies them."""
    out = []
    for symbol in sorted({r[0] for r in rows}):
        own = pd.DataFrame(sorted(r[1:] for r in rows if r[0] == symbol), columns=["ts", "price"])
        out += [(s, a, p, b, q, r) for s, a, p, b, q, r in follow(symbol, own, None)[0]]
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r) for r in positions(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_positions_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = walk(rng, "HOT", 1500, 0.02) + walk(rng, "CALM", 300, 0.002) + walk(rng, "WILD", 80, 0.1) + [("ONE", START, 5.0)]
    want = loop(rows)
    assert run(spark, rows) == want
    assert {r[5] for r in want} == {"STOP_LOSS", "TAKE_PROFIT", "TRAILING_STOP"}


def test_positions_pass_over_rows_without_price(spark):
    h = [START + timedelta(hours=i) for i in range(6)]
    rows = [("A", h[0], None), ("A", h[1], -1.0), ("A", h[2], 100.0), ("A", h[3], float("nan")), ("A", h[4], 98.0), ("A", h[5], 100.0)]
    assert run(spark, rows) == [("A", h[2], 100.0, h[4], 98.0, "STOP_LOSS")]
    assert run(spark, rows[:2]) == []
