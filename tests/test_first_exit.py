import random
import re
from datetime import datetime, timedelta

import pytest

from barline.operators import trades

START = datetime(2024, 1, 1)


def brute(bars, entries):
    out = []
    for symbol, ts, side, stop, target in entries:
        own = sorted((t, c) for s, t, c in bars if s == symbol)
        low, high = min(stop, target), max(stop, target)
        found = next(((t, c) for t, c in own if t > ts and (c <= low or c >= high)), None)
        if found is None:
            end = own[-1] if own else (None, None)
            out.append((symbol, ts, side, stop, target, *end, "END_OF_PERIOD"))
        else:
            stopped = found[1] <= stop if side > 0 else found[1] >= stop
            out.append((symbol, ts, side, stop, target, *found, "STOP_LOSS" if stopped else "TAKE_PROFIT"))
    return sorted(out, key=repr)


def walk(rng, symbol, n, gap):
    price, out = 100.0, []
    for i in range(n):
        price *= 1 + rng.uniform(-0.02, 0.02)
        if rng.random() > gap:
            out.append((symbol, START + timedelta(hours=i), round(price, 6)))
    return out


def run(spark, bars, entries):
    b = spark.createDataFrame(bars, "symbol string, ts timestamp, close double").repartition(3)
    e = spark.createDataFrame(entries, "symbol string, ts timestamp, side int, stop_price double, target_price double").repartition(2)
    return trades.first_exit(b, e)


@pytest.mark.parametrize("n,gap", [(1, 0), (20, 0.2), (700, 0.1), (3000, 0.6)])
def test_equals_brute_force(spark, n, gap):
    rng = random.Random(n)
    bars = walk(rng, "HOT", n, gap) + walk(rng, "MID", n // 9, gap) + [("ONE", START + timedelta(hours=3), 5.0)]
    entries = []
    for _ in range(60):
        ts = START + timedelta(minutes=rng.randrange(-3000, 60 * n + 3000))
        side, wide = rng.choice([1, -1]), rng.choice([0.01, 0.2, 0.6, 5.0])
        entries.append((rng.choice(["HOT", "HOT", "MID", "ONE", "NONE"]), ts, side, 100 * (1 - side * wide), 100 * (1 + side * wide)))
    entries += entries[:3]
    got = [tuple(r) for r in run(spark, bars, entries).collect()]
    assert sorted(got, key=repr) == brute(bars, entries)


def test_empty_tables(spark):
    entry = ("HOT", START, 1, 1.0, 2.0)
    assert [tuple(r) for r in run(spark, [], [entry]).collect()] == [(*entry, None, None, "END_OF_PERIOD")]
    assert run(spark, [("HOT", START, 1.0)], []).count() == 0


def test_no_join_on_the_symbol_alone_and_no_long_array(spark):
    bars = walk(random.Random(1), "HOT", 40_000, 0)
    found = run(spark, bars, [("HOT", START, 1, 0.0, 1e9)] * 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join LeftOuter, (.*)", plan)
    assert joins and all(c.count(" = ") == 2 for c in joins)
    b = spark.createDataFrame(bars, "symbol string, ts timestamp, close double")
    levels = trades._levels(b, int(bars[0][1].timestamp()), int(bars[-1][1].timestamp()), 3600)
    assert len(levels) == 4 and max(r.n for x in levels for r in x.selectExpr("size(children) AS n").collect()) == 32
