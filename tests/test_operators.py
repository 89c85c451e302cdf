"""Joins, exits, quantiles, quality and search against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import info, joins, mlprep, quality as dq, search as sr, sets, trades as tr
from barline.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_quantiles_are_exact_under_skew(spark, accuracy):
    rng = np.random.default_rng(3)
    pdf = pd.concat(
        [
            pd.DataFrame({"k": "hot", "x": np.concatenate([np.full(2000, 7.0), rng.exponential(1e6, 4000)])}),
            pd.DataFrame({"k": "small", "x": rng.normal(size=5)}),
            pd.DataFrame({"k": "one", "x": [3.0]}),
            pd.DataFrame({"k": "same", "x": [2.0] * 500}),
        ]
    )
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf).repartition(6), ["k"], "x", probs, accuracy=accuracy).collect()
    assert len(got) == 4
    for r in got:
        np.testing.assert_allclose(r.q, np.quantile(pdf.x[pdf.k == r.k], probs), rtol=1e-12)
    whole = exact_quantiles(spark.createDataFrame(pdf), [], "x", probs, accuracy=accuracy).first()
    np.testing.assert_allclose(whole.q, np.quantile(pdf.x, probs), rtol=1e-12)


@pytest.mark.parametrize("stop,target", [(0.01, 0.02), (0.1, 0.3), (0.9, 9.0)])
def test_first_exit_matches_a_scan(bars, pbars, stop, target):
    signals = bars.withColumn("side", F.when(F.col("volume") > 20, 1).otherwise(-1))
    got = tr.first_exit(bars, tr.entries(signals, stop, target)).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert len(got) == len(pbars)
    for symbol, g in pbars.groupby("symbol"):
        ts, close = g.ts.to_numpy(), g.close.to_numpy()
        rows = got[got.symbol == symbol].reset_index(drop=True)
        for i in range(len(g)):
            lo, hi = sorted((rows.stop_price[i], rows.target_price[i]))
            later = [j for j in range(i + 1, len(g)) if close[j] <= lo or close[j] >= hi]
            j = later[0] if later else len(g) - 1
            assert rows.exit_ts[i] == pd.Timestamp(ts[j]) and rows.exit_price[i] == close[j]
            assert (rows.exit_reason[i] == "END_OF_PERIOD") == (not later)


def test_equity_curve_adds_up(bars, pbars):
    signals = bars.withColumn("side", F.lit(1))
    led = tr.settle(tr.first_exit(bars, tr.entries(signals, 0.05, 0.05, quantity=0.5)))
    curve = tr.equity_curve(bars, led).toPandas()
    ledger = led.toPandas()
    for r in curve.sample(40, random_state=2).itertuples():
        t = ledger[ledger.symbol == r.symbol]
        held = t[(t.ts <= r.ts) & (t.exit_ts > r.ts)]
        close = pbars.close[(pbars.symbol == r.symbol) & (pbars.ts == r.ts)].iloc[0]
        assert r.open_trades == len(held)
        assert r.unrealized == pytest.approx(((close - held.entry_price) * held.quantity).sum(), abs=1e-6)
        assert r.realized == pytest.approx(t.pnl[t.exit_ts <= r.ts].sum(), abs=1e-6)


def test_as_of_matches_merge_asof(spark):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 5000, 300)), unit="s"), "id": range(300)})
    right = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(5000, 60, replace=False)), unit="s"), "v": rng.normal(size=60)})
    got = joins.as_of(spark.createDataFrame(left), spark.createDataFrame(right), [], "ts", ["v"], tie="id").toPandas().sort_values("id")
    want = pd.merge_asof(left, right, on="ts")
    np.testing.assert_allclose(got.v.astype(float), want.v)


def test_feed_join_keeps_bars_once(spark, bars):
    feed = spark.createDataFrame([("2024-01-02", 2, 5.0), ("2024-01-02", 1, 4.0), ("2024-01-05", 1, 9.0)], "_key string, o int, v double").withColumn("_key", F.to_date("_key"))
    out = joins.join_feed(bars, feed, F.to_date("ts"), ["v"], order=F.col("o"), bounded=True)
    assert out.count() == bars.count()
    by_day = {str(r.d): r.v for r in out.filter("symbol = 'HOT'").groupBy(F.to_date("ts").alias("d")).agg(F.max("v").alias("v")).collect()}
    assert by_day["2024-01-01"] is None and by_day["2024-01-02"] == 4.0 and by_day["2024-01-04"] == 4.0 and by_day["2024-01-06"] == 9.0
    assert sorted(map(str, out.collect())) == sorted(map(str, joins.join_feed(bars, feed, F.to_date("ts"), ["v"], order=F.col("o")).collect()))


def test_outliers_and_treatment(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 100)], "x double")
    assert [r.x for r in dq.flag_iqr(d, "x", []).filter("outlier").collect()] == [100.0]
    assert [r.x for r in dq.flag_modified_z(d, "x", []).filter("outlier").collect()] == [100.0]
    assert max(r.x for r in dq.treat_outliers(d, "x", []).collect()) == pytest.approx(8.5)
    assert [r.x for r in dq.treat_outliers(d, "x", [], "median").filter("x > 5").collect()] == []
    flat = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert not dq.flag_zscore(flat, "x", []).filter("outlier").count()
    assert not dq.flag_modified_z(flat, "x", []).filter("outlier").count()


def test_drift(spark):
    a = spark.range(100).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("x"))
    b = a.withColumn("x", F.col("x") + 100)
    assert dq.drift(a, a, "x", ["k"]).first().drift == 0
    assert dq.drift(b, a, "x", ["k"]).first().drift == pytest.approx(100 / np.arange(100).std())
    assert dq.drift(a.limit(5), a, "x", ["k"]).first().drift == 0


def test_overlay_and_keep_first(spark):
    h = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "ts int, v string")
    r = spark.createDataFrame([(2, "x"), (3, "y")], "ts int, v string")
    assert sorted((x.ts, x.v) for x in sets.overlay(h, r).collect()) == [(1, "a"), (2, "c"), (3, "y")]
    assert sorted((x.ts, x.v) for x in sets.overlay(h.limit(0), r).collect()) == [(2, "x"), (3, "y")]
    assert sorted((x.ts, x.v) for x in sets.keep_first(h, ["ts"], F.col("v")).collect()) == [(1, "a"), (2, "b")]


def test_information_identities(bars):
    s = info.with_states(bars, "close", ["symbol"], "a").withColumn("b", F.col("a"))
    mi = {r.symbol: r.mutual_information for r in info.mutual_information(s, ["symbol"], "a", "b").collect()}
    h = {r.symbol: r.entropy for r in info.entropy(s, ["symbol"], ["a"]).collect()}
    assert mi == pytest.approx(h) and h["HOT"] == pytest.approx(2.0, abs=1e-3) and h["ONE"] == 0
    t = info.transition_matrix(s, ["symbol"], "a").groupBy("symbol", "state").agg(F.sum("share").alias("x"))
    assert all(r.x == pytest.approx(1.0) for r in t.collect())


def test_phi_kernels_agree(bars):
    """The Arrow kernel and the array expressions are two forms of one measure."""
    from barline.functions.phi import phi_of_prices

    d = info.trailing_arrays(bars, {"closes": "close"}, 100).withColumn("r", F.expr(info.changes("closes")))
    for r in info.phi_columns(d, "r").withColumn("again", phi_of_prices("closes")).collect():
        assert r.again == pytest.approx(r.phi, abs=1e-9)


def test_lempel_ziv_and_sample_entropy_by_hand(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=60)
    d = spark.createDataFrame([(x.tolist(),)], "r array<double>")
    row = info.sample_entropy(d.withColumn("lz", F.expr(info.lempel_ziv("r"))), "r", "se").first()
    s = "".join("1" if v > np.median(x) else "0" for v in x)
    i, count = 0, 1
    for end in range(1, len(s) + 1):
        if s[i:end] not in s[:i]:
            count, i = count + 1, end
    assert row.lz == pytest.approx(min(1, count / (60 / np.log2(60))))
    tol = 0.2 * x.std()

    def matches(m):
        n = len(x) - m
        return sum(max(abs(x[a + k] - x[b + k]) for k in range(m)) < tol for a in range(n) for b in range(a + 1, n))

    a, b = matches(2), matches(3)
    assert row.se == pytest.approx(np.clip(1 - b / a, 0, 1) if a and b else 0.5)


def test_grid_blocks_equal_row_windows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"symbol": "A", "combo": 1, "pos": range(500), "ret": rng.normal(size=500)})
    rows = spark.createDataFrame(pdf)
    got = sr.grid_scores(rows).toPandas()
    assert set(got.window_id) == set(range((500 - 315) // 21 + 1))
    for r in got.itertuples():
        a = r.window_id * 21 + (0 if r.role == "train" else 252)
        x = pdf.ret[a : a + (252 if r.role == "train" else 63)]
        assert r.sharpe == pytest.approx(x.mean() / x.std(ddof=0) * 252**0.5)
        assert r.total_return == pytest.approx(x.sum())
    lengths = rows.groupBy("symbol").agg((F.max("pos") + 1).alias("n"))
    tagged = sr.assign_windows(rows, sr.walk_windows(lengths)).groupBy("window_id", "role").count().collect()
    assert all(r["count"] == (252 if r.role == "train" else 63) for r in tagged) and len(tagged) == len(got)


def test_splits_and_scaling(spark, bars):
    d = mlprep.chronological_split(bars, {"train": 0.7, "validation": 0.15, "test": 0.15}).groupBy("symbol", "split").count()
    n = {(r.symbol, r.split): r["count"] for r in d.collect()}
    first, second = int(700 * 0.7), int(700 * 0.85)  # 489: the product is just below 490
    assert (n["HOT", "train"], n["HOT", "validation"], n["HOT", "test"]) == (first, second - first, 700 - second)
    flat = spark.createDataFrame([("A", 2.0)] * 3, "symbol string, x double")
    for how, want in (("zscore", 0.0), ("minmax", 0.5), ("robust", 0.0)):
        assert {r.x_normalized for r in mlprep.normalize(flat, ["x"], how, ["symbol"]).collect()} == {want}


def test_augment_stays_close(spark):
    d = spark.createDataFrame([(i, [1.0] * 50) for i in range(200)], "id int, v array<double>")
    x = np.array([r.v for r in mlprep.augment(d, "v", ["id"]).orderBy("id").collect()])
    assert x.shape == (200, 50) and 0.96 < x.mean() < 1.04
    assert 0.015 < (x - x.mean(axis=1, keepdims=True)).std() < 0.025
    again = mlprep.augment(d.repartition(7, F.rand()), "v", ["id"]).orderBy("id").collect()
    assert (x == np.array([r.v for r in again])).all()


def test_bootstrap_draws_like_poisson(spark):
    from barline.operators.trades import bootstrap

    d = spark.range(3000).withColumn("x", F.lit(1.0))
    runs = bootstrap(d, 5, ["id"]).groupBy("replicate").agg(
        F.count("*").alias("held"), F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("copies")).alias("q")).collect()
    assert len(runs) == 5 and len({r.n for r in runs}) > 1
    for r in runs:  # mean 1, variance 1, a share of 1 - 1/e held at all
        assert abs(r.n / 3000 - 1) < 0.08 and abs(r.q / 3000 - 2) < 0.25 and abs(r.held / 3000 - 0.632) < 0.04
    assert bootstrap(d.limit(0), 5, ["id"]).count() == 0


def test_admission_rules(spark):
    from barline.operators.admission import admit

    rows = [("A", i, 0.2 if i == 0 else 0.1, 0.0, 0.06 if i == 7 else 0.0) for i in range(9)]
    d = spark.createDataFrame(rows, "symbol string, i int, size double, released double, drawdown double")
    out = admit(d.withColumn("ts", F.timestamp_seconds("i")).drop("i")).orderBy("ts").collect()
    assert [r.decision for r in out] == ["reduced", "approved", "approved", "approved", "approved", "rejected", "rejected", "halted", "rejected"]
    assert max(r.exposure for r in out) == pytest.approx(0.5)


def test_backward_fill_and_interpolation_are_linear(spark):
    """100,000 rows of one symbol; a frame that ended in unbounded following took minutes."""
    from barline.functions import windows as w

    n = 100_000
    df = spark.range(n).select(F.lit("A").alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 1000 == 999, F.col("id").cast("double")).alias("x"))
    filled = df.withColumn("b", w.fill_backward("x"))
    assert filled.agg(F.sum("b")).first()[0] == sum((i // 1000) * 1000 + 999 for i in range(n))
    line = w.with_interpolation(df, "x", "y").agg(F.count("y"), F.max(F.abs(F.col("y") - F.unix_seconds("ts")))).first()
    assert line[0] == n - 999 and line[1] < 1e-6


def test_parameter_grid_has_all_combinations(spark):
    from barline.operators.search import parameter_grid

    ranges = spark.createDataFrame([("A", 1, 30, 0.0, 1.0)], "symbol string, lo long, hi long, a double, b double")
    params = {"p": ("lo", "hi", "int"), "q": ("a", "b", "float"), "r": ("a", "b", "float")}
    got = parameter_grid(ranges, ["symbol"], params)
    assert got.count() == 64 and got.select("combo").distinct().count() == 64
