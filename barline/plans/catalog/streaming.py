"""STR: streams over the tables, drained once; the SQL is the batch result they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import signals as sg
from barline.operators import quality as dq
from barline.operators.positions import positions
from barline.plans.catalog import BARS, query
from barline.plans.catalog.text import HASH
from barline.sources.tables import Tables
from barline.streaming import bars as sb, dedup, runner, state, tails


def stream_ticks(t: Tables) -> DataFrame:
    events = runner.read_table(t.spark, t.folder, "events", t.events.schema)
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), "event_id")


@query("str01_stream_bars", f"WITH {BARS} SELECT * FROM bars", "symbol, ts", "open, high, low, close, volume")
def _(t: Tables) -> DataFrame:
    return runner.run_updates(sb.stream_bars(stream_ticks(t)), "bars", ["symbol", "ts"])


@query("str02_stream_dedup", f"SELECT {HASH} AS hash FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    docs = runner.read_table(t.spark, t.folder, "documents", t.documents.schema)
    timed = docs.select("doc_id", "text", F.timestamp_seconds(1_700_000_000 + F.col("doc_id") % 86_400).alias("ts"))
    return runner.run_to_parquet(dedup.stream_unique_texts(timed), "dedup").select("hash")


def walk_sql(source: str, order: str) -> str:
    """One position at a time, row by row: a held position is tested on each later row, a closed one leaves the next row free."""
    held = "(f.entry IS NOT NULL AND f.reason IS NULL)"
    return f"""m AS (SELECT symbol, ts, price, row_number() OVER (PARTITION BY symbol ORDER BY {order}) AS rn FROM {source}),
      f(symbol, rn, entry_ts, entry, peak, exit_ts, exit_price, reason) AS (SELECT symbol, 0::BIGINT, NULL::TIMESTAMP, NULL::DOUBLE, NULL::DOUBLE, NULL::TIMESTAMP, NULL::DOUBLE, NULL::VARCHAR FROM m GROUP BY 1
        UNION ALL SELECT m.symbol, m.rn, CASE WHEN {held} THEN f.entry_ts WHEN m.price > 0 THEN m.ts END, CASE WHEN {held} THEN f.entry WHEN m.price > 0 THEN m.price END,
          CASE WHEN {held} THEN greatest(f.peak, m.price) WHEN m.price > 0 THEN m.price END, m.ts, m.price,
          CASE WHEN NOT {held} THEN NULL WHEN m.price <= f.entry * 0.98::DOUBLE THEN 'STOP_LOSS' WHEN m.price >= f.entry * 1.04::DOUBLE THEN 'TAKE_PROFIT'
            WHEN greatest(f.peak, m.price) > f.entry AND m.price <= greatest(f.peak, m.price) * 0.98::DOUBLE THEN 'TRAILING_STOP' END
        FROM f JOIN m ON m.symbol = f.symbol AND m.rn = f.rn + 1)
      SELECT symbol, floor(epoch(entry_ts))::BIGINT AS entry_s, entry AS entry_price, floor(epoch(exit_ts))::BIGINT AS exit_s, exit_price, reason FROM f WHERE reason IS NOT NULL"""


def _seconds(out: DataFrame) -> DataFrame:
    return out.select("symbol", F.unix_seconds("entry_ts").alias("entry_s"), "entry_price", F.unix_seconds("exit_ts").alias("exit_s"), "exit_price", "reason")


TICKS = "(SELECT event_type AS symbol, ts, value AS price, event_id FROM events)"


@query("str03_position_monitor", f"WITH RECURSIVE {walk_sql(TICKS, 'ts, event_id')}")
def _(t: Tables) -> DataFrame:
    return _seconds(runner.run_to_parquet(state.monitor_positions(stream_ticks(t)), "positions"))


@query("str03_position_batch", f"WITH RECURSIVE {BARS}, {walk_sql('(SELECT symbol, ts, close AS price FROM bars)', 'ts')}")
def _(t: Tables) -> DataFrame:
    return _seconds(positions(t.hourly().withColumnRenamed("close", "price")))


@query("str04_day_report",
       """WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS trades, count(*) FILTER (value - 50 > 0) AS wins, sum(value - 50) AS pnl, arg_max(value, ts) AS balance FROM events GROUP BY 1)
       SELECT day AS ts, trades, wins, pnl, balance FROM d""",
       "ts, trades, wins", "pnl, balance")
def _(t: Tables) -> DataFrame:
    trades = stream_ticks(t).select("ts", (F.col("price") - 50).alias("pnl"), F.col("price").alias("balance"))
    return runner.run_updates(sb.stream_day_report(trades), "days", ["ts"])


@query("str05_rolling_buffer",
       """SELECT event_type AS symbol, event_id, list(value) OVER w AS buffer FROM events
       WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS 6 PRECEDING) QUALIFY count(*) OVER w = 7""")
def _(t: Tables) -> DataFrame:
    return tails.run_tails(stream_ticks(t), "buffer", tails.rolling_buffer(7))


@query("str06_experience_buffer",
       """WITH n AS (SELECT event_type AS symbol, row_number() OVER w AS seen, avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS 99 PRECEDING) AS recent_mean, sum(value) OVER w AS total FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))
       SELECT symbol, seen, least(seen, 1000) AS held, recent_mean, total FROM n WHERE seen % 100 = 0""",
       "symbol, seen, held", "recent_mean, total")
def _(t: Tables) -> DataFrame:
    return tails.run_tails(stream_ticks(t), "experience", tails.experience_buffer(1000))


@query("str07_ttl_lookup",
       """SELECT p.event_id, CASE WHEN epoch_us(p.ts) - epoch_us(v.ts) <= 3600000000 THEN v.value END AS last_view
       FROM (SELECT * FROM events WHERE event_type = 'click') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.ts >= v.ts""",
       "event_id", "last_view")
def _(t: Tables) -> DataFrame:
    from barline.operators.joins import as_of

    left = t.events.filter("event_type = 'click'").select("event_id", "ts")
    right = t.events.filter("event_type = 'view'").select("ts", F.col("value").alias("last_view"))
    return as_of(left, right, [], "ts", ["last_view"], tie="event_id", max_age_seconds=3600)


@query("str08_drop_stale", "SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-30') - epoch_us(ts) <= 86400000000")
def _(t: Tables) -> DataFrame:
    fresh = sb.drop_stale(stream_ticks(t), F.lit("2024-01-30").cast("timestamp"))
    return runner.run_to_parquet(fresh, "fresh").select("event_id")


@query("str09_enriched",
       """WITH q AS (SELECT event_type AS k, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
       SELECT event_id, value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AS in_range, a - 1.5 * (b - a) AS low_fence, b + 1.5 * (b - a) AS high_fence FROM events JOIN q ON k = event_type""",
       "event_id, in_range", "low_fence, high_fence")
def _(t: Tables) -> DataFrame:
    from barline.session import durable

    stored = durable(dq.iqr_fences(t.ticks(), "price", ["symbol"]).drop("median"), "fences")
    ticks = stream_ticks(t)
    schema = sb.enrich(t.ticks(), stored, ["symbol"]).schema
    return runner.run_batches(ticks, "enriched", schema, sb.foreach_enriched(lambda: stored, ["symbol"]))


@query("str10_hold_rows",
       f"""WITH {BARS}, a AS (SELECT symbol, ts, close, CASE WHEN close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 > 0.5 THEN 'BUY' ELSE 'HOLD' END AS action FROM bars),
       h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM a WHERE action = 'HOLD') SELECT symbol, ts, close FROM h WHERE i % 12 = 0""",
       "symbol, ts", "close")
def _(t: Tables) -> DataFrame:
    action = F.when(sg.threshold_move("close", 0.5) > 0, "BUY").otherwise("HOLD")
    return state.hold_rows(t.hourly().withColumn("action", action))


@query("str10_hold_stream",
       """WITH h AS (SELECT event_type AS symbol, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value <= 100) SELECT symbol, event_id FROM h WHERE i % 12 = 0""")
def _(t: Tables) -> DataFrame:
    actions = stream_ticks(t).withColumn("action", F.when(F.col("price") > 100, "BUY").otherwise("HOLD"))
    return tails.run_tails(actions, "holds", tails.hold_rows(["symbol", "event_id"]))
