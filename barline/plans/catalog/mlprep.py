"""MLP and WIN-28: splits, scaling, sequences and composed feature sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import windows as w
from barline.operators import aggregates as agg, joins, mlprep as ml
from barline.operators.ordered import Series, rolling
from barline.plans import indicators as ind, training as tn
from barline.plans.catalog import BARS, W, query, rows, strict
from barline.plans.catalog.recurrence import NUMBERED, ewm
from barline.plans.catalog.windows import RSI
from barline.operators.resample import bars_from_ticks
from barline.session import scratch_path
from barline.sources.tables import Tables


@query("mlp01_split",
       """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, CASE WHEN p < floor(n * 0.7::DOUBLE) THEN 'train' WHEN p < floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM n""")
def _(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderdate")
    d = ml.chronological_split(o, {"train": 0.7, "validation": 0.15, "test": 0.15}, Series((), ("o_orderdate", "o_orderkey")))
    return d.select("o_orderkey", "split")


@query("mlp01_split_by_date", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS split FROM events")
def _(t: Tables) -> DataFrame:
    return ml.split_at(t.events, "ts", "2024-01-20").select("event_id", "split")


@query("mlp02_normalize",
       """WITH s AS (SELECT event_type AS k, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1),
       d AS (SELECT event_type AS k, quantile_cont(abs(value - med), 0.5) AS mad FROM events JOIN s ON k = event_type GROUP BY 1)
       SELECT event_id, (value - m) / sd AS z, (value - lo) / (hi - lo) AS mm, (value - med) / mad AS robust FROM events JOIN s ON s.k = event_type JOIN d ON d.k = event_type""",
       "event_id", "z, mm, robust")
def _(t: Tables) -> DataFrame:
    d = t.events.select("event_id", "event_type", *[F.col("value").alias(c) for c in ("a", "b", "c")])
    for c, how in (("a", "zscore"), ("b", "minmax"), ("c", "robust")):
        d = ml.normalize(d, [c], how, ["event_type"])
    return d.withColumnsRenamed({"a_normalized": "z", "b_normalized": "mm", "c_normalized": "robust"})


@query("mlp03_standard_scale",
       """WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_tax) AS c, stddev_pop(l_tax) AS d FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - a) / b AS l_quantity_scaled, (l_tax - c) / d AS l_tax_scaled FROM lineitem, s""",
       "l_orderkey, l_linenumber, l_partkey", "l_quantity_scaled, l_tax_scaled")
def _(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    return ml.standard_scale(d, ["l_quantity", "l_tax"], [])


@query("mlp04_sequences",
       """WITH s AS (SELECT event_id, count(*) OVER v AS n, list(value) OVER v AS seq, value AS label FROM events WINDOW v AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
       SELECT event_id, seq[1] AS oldest, seq[60] AS newest, list_sum(seq) AS total, label FROM s WHERE n = 60""",
       "event_id", "oldest, newest, total, label")
def _(t: Tables) -> DataFrame:
    d = t.ticks().withColumn("size", F.lit(1.0))
    d = rolling(d, lambda x, s: ml.sequences(x, ["price", "size"], F.col("price"), 60, s), halo=60)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0])
    return d.select("event_id", F.col("sequence")[0][0].alias("oldest"), F.col("sequence")[59][0].alias("newest"), total.alias("total"), "label")


@query("mlp05_apply_scaler",
       """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
       SELECT event_id, (coalesce(CASE WHEN event_id % 9 <> 0 THEN value END, m) - m) / sd AS value_scaled, 0.0 AS absent_scaled FROM events, s""",
       "event_id", "value_scaled, absent_scaled")
def _(t: Tables) -> DataFrame:
    from barline.sources.feeds import scaler_table

    stats = t.events.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    means = F.create_map(F.lit("value"), F.col("m"), F.lit("absent"), F.lit(3.0))
    stds = F.create_map(F.lit("value"), F.col("sd"), F.lit("absent"), F.lit(0.0))
    doc = stats.select(F.to_json(F.struct(means.alias("mean"), stds.alias("std"))).alias("payload"))
    d = t.events.select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))
    return ml.apply_scaler(d, scaler_table(doc), ["value", "absent"])


def drawn_sql(text: str, start: int = 1) -> str:
    return f"('0x' || substr(md5({text}), {start}, 13))::BIGINT / 4503599627370496::DOUBLE"


@query("mlp06_augment",
       f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i, 0.97::DOUBLE + (1.03::DOUBLE - 0.97::DOUBLE) * {drawn_sql("concat_ws('|', '42', vec_id, 'scale')")} AS scale FROM embeddings),
       y AS (SELECT vec_id, i, x * scale + 0.02::DOUBLE * sqrt(-2 * ln(1 - {drawn_sql("concat_ws('|', '42', vec_id, i)")})) * cos(2 * pi() * {drawn_sql("concat_ws('|', '42', vec_id, i)", 14)}) AS value FROM x) SELECT * FROM y""",
       "vec_id, i", "value")
def _(t: Tables) -> DataFrame:
    d = ml.augment(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding", ["vec_id"])
    return d.select("vec_id", F.posexplode("embedding").alias("i", "value"))


@query("mlp07_ablation",
       f"""WITH {BARS}, f AS (SELECT close / nullif(lag(close) OVER {W}, 0) - 1 AS r1, close / nullif(lag(close, 168) OVER {W}, 0) - 1 AS r168, {strict('avg', 'close', 20)} AS s20 FROM bars),
       s AS (SELECT avg((r1 IS NULL)::INT) AS a, avg((r168 IS NULL)::INT) AS b, avg((s20 IS NULL)::INT) AS c FROM f)
       SELECT 'returns' AS feature_group, 2 AS features, (a + b) / 2 AS missing FROM s UNION ALL SELECT 'means', 1, c FROM s UNION ALL SELECT 'all', 3, (a + b + c) / 3 FROM s""",
       "feature_group, features", "missing")
def _(t: Tables) -> DataFrame:
    d = t.hourly().withColumns({"r1": w.change("close"), "r168": w.change("close", 168), "s20": w.sma("close", 20)})
    return agg.group_missing_shares(d, {"returns": ["r1", "r168"], "means": ["s20"]})


# --- composed sets ---------------------------------------------------------

E12, E26 = ewm("close", 12, "e12", True, "n"), ewm("close", 26, "e26", True, "n")
MACD = f"""{E12}, {E26}, mc AS (SELECT e12.symbol, e12.ts, e12.rn, e12.num / e12.den AS ema_12, e26.num / e26.den AS ema_26, e12.num / e12.den - e26.num / e26.den AS macd FROM e12 JOIN e26 USING (symbol, rn)), {ewm('macd', 9, 'e9', True, 'mc')},
  md AS (SELECT mc.symbol, mc.ts, ema_12, ema_26, macd, num / den AS macd_signal, macd - num / den AS macd_hist FROM mc JOIN e9 USING (symbol, rn))"""
BASE = f"""mv AS (SELECT *, close - lag(close) OVER {W} AS d, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr, """ + ", ".join(
    f"close / nullif(lag(close, {k}) OVER {W}, 0) - 1 AS r{k}" for k in (1, 5, 10, 20, 24, 168)) + f""" FROM bars),
  gl AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS loss FROM mv),
  fx AS (SELECT *, avg(gain) OVER {rows(14)} AS ag, avg(loss) OVER {rows(14)} AS al, row_number() OVER {W} AS rn, {strict('avg', 'close', 20)} AS s20, {strict('stddev_samp', 'close', 20)} AS sd20, {strict('avg', 'tr', 14)} AS atr FROM gl)"""


@query("win28_standard_set",
       f"""WITH RECURSIVE {BARS}, {NUMBERED}, {MACD}, {BASE} SELECT symbol, ts, s20 AS sma_20, {strict('avg', 'close', 50)} AS sma_50, {strict('avg', 'close', 200)} AS sma_200, ema_12, ema_26, macd, macd_signal, macd_hist,
       {RSI['strict']} AS rsi, s20 AS bb_mid, s20 + 2 * sd20 AS bb_upper, s20 - 2 * sd20 AS bb_lower, {strict('avg', 'volume', 20)} AS volume_sma, volume / ({strict('avg', 'volume', 20)}) AS volume_ratio, r10 * 100 AS roc, {strict('stddev_samp', 'r1', 20)} AS volatility
       FROM fx JOIN md USING (symbol, ts)""",
       "symbol, ts", "sma_20, sma_50, sma_200, ema_12, ema_26, macd, macd_signal, macd_hist, rsi, bb_mid, bb_upper, bb_lower, volume_sma, volume_ratio, roc, volatility")
def _(t: Tables) -> DataFrame:
    return ind.standard_features(t.hourly())


HOURLY = f"""{MACD}, {BASE}, hf AS (SELECT symbol, ts, open, high, low, close, volume, r1 AS return_1h, r24 AS return_24h, r168 AS return_7d, {strict('stddev_samp', 'r1', 24)} AS volatility_24h, {strict('stddev_samp', 'r1', 168)} AS volatility_7d,
  {RSI['strict_eps']} AS rsi_14, macd, macd_signal, macd_hist, (s20 + 2 * sd20 - close) / nullif(close, 0) AS bb_upper, (close - s20 + 2 * sd20) / nullif(close, 0) AS bb_lower, 4 * sd20 / (s20 + 1e-10) AS bb_width, atr / (close + 1e-10) AS atr_14, abs(r24) * 100 AS adx_14,
  sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos FROM fx JOIN md USING (symbol, ts))"""
HOURLY_COLS = "return_1h, return_24h, return_7d, volatility_24h, volatility_7d, rsi_14, macd, macd_signal, macd_hist, bb_upper, bb_lower, bb_width, atr_14, adx_14, hour_sin, hour_cos"


@query("win28_hourly_set", f"WITH RECURSIVE {BARS}, {NUMBERED}, {HOURLY} SELECT * FROM hf", "symbol, ts", HOURLY_COLS)
def _(t: Tables) -> DataFrame:
    return ind.hourly_features(t.hourly())


@query("win28_compact_set",
       f"""WITH RECURSIVE {BARS}, {NUMBERED}, {MACD}, {BASE}, bw AS (SELECT *, 4 * sd20 / (s20 + 1e-10) AS bb_width FROM fx)
       SELECT symbol, ts, r1 AS return_1, r5 AS return_5, r20 AS return_20, {strict('stddev_samp', 'r1', 20)} AS volatility, {RSI['strict_eps']} AS rsi, macd, macd_signal, macd_hist, bb_width, (close - s20) / (2 * sd20 + 1e-10) AS bb_position,
       coalesce(bb_width < {strict('avg', 'bb_width', 20)}, false) AS bb_squeeze, atr / (close + 1e-10) AS atr_pct, volume / ({strict('avg', 'volume', 20)} + 1) AS volume_ratio,
       CASE WHEN lag(volume) OVER {W} IS NOT NULL THEN greatest(-5, least(5, volume / nullif(lag(volume) OVER {W}, 0) - 1)) ELSE 5 END AS volume_change, r10 AS momentum, CASE WHEN close > s20 THEN 1 ELSE 0 END AS trend FROM bw JOIN md USING (symbol, ts)""",
       "symbol, ts, bb_squeeze, trend", "return_1, return_5, return_20, volatility, rsi, macd, macd_signal, macd_hist, bb_width, bb_position, atr_pct, volume_ratio, volume_change, momentum")
def _(t: Tables) -> DataFrame:
    return ind.compact_features(t.hourly())


@query("win28_live_set",
       f"""WITH {BARS}, {BASE} SELECT symbol, ts, r24 AS returns_24h, {strict('avg', 'close', 24)} AS sma_24, {strict('avg', 'close', 168)} AS sma_168, {RSI['null_loss']} AS rsi, atr, atr / nullif(close, 0) AS atr_share FROM fx""",
       "symbol, ts", "returns_24h, sma_24, sma_168, rsi, atr, atr_share")
def _(t: Tables) -> DataFrame:
    return ind.bot_features(t.hourly())


TRAINING = f"""{HOURLY}, mk AS (SELECT ts, return_24h AS btc_return_24h, volatility_24h AS btc_volatility FROM hf WHERE symbol = 'view'),
  jm AS (SELECT hf.*, btc_return_24h, btc_volatility FROM hf LEFT JOIN mk USING (ts)), jn AS (SELECT *, {strict('avg', 'btc_return_24h', 24)} AS mm, CASE WHEN return_1h > 0 THEN volume ELSE 0.0 END AS up, CASE WHEN return_1h < 0 THEN volume ELSE 0.0 END AS down FROM jm),
  tf AS (SELECT *, coalesce(CASE WHEN count(CASE WHEN return_1h IS NOT NULL AND mm IS NOT NULL THEN 1 END) OVER {rows(24)} >= 24 AND min(return_1h) OVER {rows(24)} < max(return_1h) OVER {rows(24)} AND min(mm) OVER {rows(24)} < max(mm) OVER {rows(24)} THEN corr(return_1h, mm) OVER {rows(24)} END, 0.5) AS btc_correlation,
    coalesce(lag(btc_return_24h) OVER {W} - lag(return_24h) OVER {W}, 0) AS btc_lead, ({strict('avg', 'return_24h', 8)}) * 0.01 AS funding_rate, {strict('avg', 'volume', 168)} AS open_interest, (({strict('sum', 'up', 24)}) + 1) / (({strict('sum', 'down', 24)}) + 1) AS long_short_ratio,
    volume / ({strict('avg', 'volume', 20)} + 1) AS volume_ratio, CASE WHEN lead(close) OVER {W} > close THEN 1 ELSE 0 END AS target FROM jn),
  tz AS (SELECT *, open_interest / nullif(lag(open_interest, 24) OVER {W}, 0) - 1 AS oi_change FROM tf)"""


@query("mlp08_training_set",
       f"WITH RECURSIVE {BARS}, {NUMBERED}, {TRAINING} SELECT * FROM tz WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in tn.FEATURES),
       "symbol, ts, target", ", ".join(tn.FEATURES))
def _(t: Tables) -> DataFrame:
    return tn.training_set(t.hourly(), "view")


COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in tn.FEATURES)


@query("mlp08_training_files", f"WITH RECURSIVE {BARS}, {NUMBERED}, {TRAINING} SELECT * FROM tz WHERE ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-29' AND {COMPLETE}",
       "symbol, ts, target", ", ".join(tn.FEATURES))
def _(t: Tables) -> DataFrame:
    minutes = bars_from_ticks(t.ticks(), "1m")
    files = tn.training_files(minutes, "view", scratch_path(t.spark, "training"))
    return tn.training_range(files, "2024-01-12", "2024-01-29")


SPINE = "spine AS (SELECT unnest(generate_series(min(o_orderdate)::DATE::TIMESTAMP, max(o_orderdate)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS ts FROM orders)"
DAILY = f"""{SPINE}, o AS (SELECT o_orderdate::DATE AS day, arg_min(o_totalprice, (o_orderdate, o_totalprice)) AS total FROM orders GROUP BY 1),
  l AS (SELECT l_shipdate::DATE AS day, arg_min(l_quantity, (l_shipdate, l_quantity)) AS quantity FROM lineitem GROUP BY 1),
  mg AS (SELECT ts, total, quantity FROM spine LEFT JOIN o ON o.day = ts::DATE LEFT JOIN l ON l.day = ts::DATE)"""


def _daily_sources(t: Tables):
    totals = t.orders.select("o_orderdate", F.col("o_totalprice").alias("total"))
    quantities = t.lineitem.select("l_shipdate", F.col("l_quantity").alias("quantity"))
    return [("orders", totals, "o_orderdate"), ("lines", quantities, "l_shipdate")], joins.day_spine(t.orders, "o_orderdate")


@query("mlp09_daily_set",
       f"""WITH {DAILY} SELECT ts, coalesce(last_value(total IGNORE NULLS) OVER a, first_value(total IGNORE NULLS) OVER b, 0) AS total, coalesce(last_value(quantity IGNORE NULLS) OVER a, first_value(quantity IGNORE NULLS) OVER b, 0) AS quantity FROM mg
       WINDOW a AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
       "ts", "total, quantity")
def _(t: Tables) -> DataFrame:
    return tn.daily_set(*_daily_sources(t))[0].withColumn("ts", F.col("day").cast("timestamp"))


@query("mlp09_daily_report",
       f"""WITH {DAILY} SELECT 'total' AS feature, avg((total IS NULL)::INT) AS missing, avg((total IS NULL)::INT) <= 0.2 AS acceptable FROM mg UNION ALL SELECT 'quantity', avg((quantity IS NULL)::INT), avg((quantity IS NULL)::INT) <= 0.2 FROM mg""",
       "feature, acceptable", "missing")
def _(t: Tables) -> DataFrame:
    return tn.daily_set(*_daily_sources(t))[1].withColumnRenamed("column", "feature")
