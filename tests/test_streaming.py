"""Streams over several files equal their batch twins."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators.positions import positions
from barline.streaming import bars as sb, dedup, runner, state, tails


@pytest.fixture(scope="module")
def landed(spark, bars, tmp_path_factory):
    """The bars as ticks in four files, in time order."""
    folder = str(tmp_path_factory.mktemp("ticks"))
    ticks = bars.select("symbol", "ts", F.col("close").alias("price"), F.xxhash64("symbol", "ts").alias("event_id"))
    edges = [r.t for r in ticks.select(F.percentile_approx(F.unix_seconds("ts"), F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("q")).select(F.explode("q").alias("t")).collect()]
    lows, highs = [0, *edges], [*edges, 10**12]
    for i, (a, b) in enumerate(zip(lows, highs)):
        part = ticks.filter((F.unix_seconds("ts") >= a) & (F.unix_seconds("ts") < b))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder, ticks


def stream(spark, landed):
    folder, ticks = landed
    return spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_positions(spark, landed):
    got = runner.run_to_parquet(state.monitor_positions(stream(spark, landed)), "t")
    want = positions(landed[1])
    key = lambda df: sorted((r.symbol, r.entry_ts, r.exit_ts, r.reason) for r in df.collect())
    assert key(got) == key(want) and len(key(want)) > 10


class Held:
    """A key's state outside a stream."""

    def __init__(self, value=None):
        self.get, self.exists = value, value is not None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False


@pytest.mark.parametrize("gaps", [False, True])
def test_a_hot_key_is_walked_in_steps_of_few_bytes(monkeypatch, gaps):
    monkeypatch.setattr(state, "STEP_ROWS", 1000, raising=False)
    rng, n = np.random.default_rng(3), 100_000
    rows = pd.DataFrame({"symbol": "HOT", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, n // 2, n), unit="s"),
                         "price": rng.uniform(0, 100, n).round(2), "event_id": rng.permutation(n)})
    if gaps:
        rows["event_id"] = rows["event_id"].mask(rows.index % 7 == 0)
        rows["price"], rows["ts"] = rows["price"].mask(rows.index % 11 == 0), rows["ts"].mask(rows.index % 10_001 == 0)
    want, last = state.follow("HOT", rows.sort_values(["ts", "event_id"], ignore_index=True), None)

    def batches():
        for at in range(0, n, 5000):
            yield rows.iloc[at : at + 5000].copy()

    held, got, sizes, most = Held(), [], [], 0
    tracemalloc.start()
    for frame in state._monitor(("HOT",), batches(), held):
        most = most or tracemalloc.get_traced_memory()[1]
        got += list(frame.itertuples(index=False, name=None))
        sizes.append(len(frame))
    tracemalloc.stop()
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]
    assert max(sizes) <= 1000 and most < 70 * n
    assert held.get == (None if last is None else (last[0].to_pydatetime(), last[1], last[2]))


def test_exit_rules():
    assert state.exit_reason(97.9, 100, 100) == "STOP_LOSS"
    assert state.exit_reason(104, 100, 104) == "TAKE_PROFIT"
    assert state.exit_reason(100.9, 100, 103) == "TRAILING_STOP"
    assert state.exit_reason(101.5, 100, 103) is None


def test_stream_bars_equal_batch(spark, landed):
    from barline.operators.resample import bars_from_ticks

    got = runner.run_to_parquet(sb.stream_bars(stream(spark, landed), "4h", "0 seconds"), "t")
    want = bars_from_ticks(landed[1], "4h")
    last = landed[1].agg(F.max("ts")).first()[0]
    closed = want.filter(F.col("ts") + F.expr("interval 4 hours") <= F.lit(last))
    key = lambda df: sorted(tuple(r) for r in df.select("symbol", "ts", "open", "high", "low", "close", "volume").collect())
    assert key(got) == key(closed)
    whole = runner.run_updates(sb.stream_bars(stream(spark, landed), "4h", "0 seconds"), "t", ["symbol", "ts"])
    assert key(whole) == key(want)


def by_time(landed):
    rows = {}
    for r in landed[1].orderBy("symbol", "ts").collect():
        rows.setdefault(r.symbol, []).append(r)
    return rows


def test_rolling_buffer_crosses_triggers(spark, landed):
    got = {r.event_id: r.buffer for r in tails.run_tails(stream(spark, landed), "t", tails.rolling_buffer(7)).collect()}
    want = {own[i].event_id: [r.price for r in own[i - 6 : i + 1]] for own in by_time(landed).values() for i in range(6, len(own))}
    assert got == want


def test_experience_buffer_counts_across_triggers(spark, landed):
    out = tails.run_tails(stream(spark, landed), "t", tails.experience_buffer(150, 100)).filter("symbol = 'HOT'").orderBy("seen").collect()
    prices = [r.price for r in by_time(landed)["HOT"]]
    assert [(r.seen, r.held) for r in out] == [(100, 100)] + [(i * 100, 150) for i in range(2, 8)]
    for r in out:
        assert r.recent_mean == pytest.approx(sum(prices[r.seen - 100 : r.seen]) / 100) and r.total == pytest.approx(sum(prices[: r.seen]))


def test_hold_rows_equal_the_batch_form(spark, landed):
    action = F.when(F.col("price") > 100, "BUY").otherwise("HOLD")
    got = tails.run_tails(stream(spark, landed).withColumn("action", action), "t", tails.hold_rows(["symbol", "event_id"], 5))
    want = state.hold_rows(landed[1].withColumn("action", action), 5)
    ids = lambda d: sorted(r.event_id for r in d.select("event_id").collect())
    assert ids(got) == ids(want) and len(ids(want)) > 20


def test_a_replayed_trigger_gives_the_same_rows(spark):
    schema = "symbol string, ts timestamp, event_id long, price double"
    rows = spark.range(40).select(F.lit("A").alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), F.when(F.col("id") != 9, F.col("id") * 1.0).alias("price"))
    empty = spark.createDataFrame([], schema + ", seen long, total double")
    spec = tails.rolling_buffer(3)
    _, kept = tails.advance(rows.filter("event_id < 11"), empty, spec)
    once, again = (tails.advance(rows.filter("event_id >= 11"), kept, spec) for _ in range(2))
    key = lambda d: sorted((str(r) for r in d.collect()))
    assert key(once[0]) == key(again[0]) and key(once[1]) == key(again[1])
    first = once[0].orderBy("event_id").first()
    assert (first.event_id, first.buffer) == (11, [None, 10.0, 11.0])
    nothing, still = tails.advance(rows.limit(0), kept, spec)
    assert nothing.count() == 0 and key(still) == key(kept)


def test_unique_texts(spark, tmp_path):
    d = spark.createDataFrame([(i, f"Text  {i % 5}") for i in range(20)], "id int, text string").withColumn("ts", F.timestamp_seconds("id"))
    for i in range(2):
        d.filter(F.col("id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path))
    texts = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    assert runner.run_to_parquet(dedup.stream_unique_texts(texts), "t").count() == 5
