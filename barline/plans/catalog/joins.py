"""JOIN: bars with side feeds, as-of and barrier joins, grids and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import windows as w
from barline.operators import aggregates as agg, joins, sets
from barline.plans.catalog import BARS, BRANDS, DAYS, W, query
from barline.sources.tables import Tables

UPTO = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("join01_daily_index_fill",
       f"""WITH {BRANDS}, f AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1),
       j AS (SELECT symbol, ts, close, value FROM brands LEFT JOIN f ON ts::DATE = day)
       SELECT symbol, ts, close, last_value(value IGNORE NULLS) OVER {UPTO} AS value FROM j""",
       "symbol, ts", "close, value")
def _(t: Tables) -> DataFrame:
    feed = t.orders.groupBy(F.to_date("o_orderdate").alias("_key")).agg(F.avg("o_totalprice").alias("value"))
    return joins.join_feed(t.brand_daily(), feed, F.to_date("ts"), ["value"], bounded=True)


@query("join02_netflow_fill",
       f"""WITH {DAYS}, f AS (SELECT ts::DATE AS day, arg_min(value, ts) - 50 AS netflow FROM events WHERE event_type = 'purchase' GROUP BY 1),
       j AS (SELECT symbol, days.ts, close, netflow / 2000000 AS whale_netflow FROM days LEFT JOIN f ON days.ts::DATE = day)
       SELECT symbol, ts, close, last_value(whale_netflow * 1000 IGNORE NULLS) OVER {UPTO} AS whale_netflow FROM j""",
       "symbol, ts", "close, whale_netflow")
def _(t: Tables) -> DataFrame:
    flows = t.events.filter(F.col("event_type") == "purchase").select(
        F.to_date("ts").alias("_key"), "ts", ((F.col("value") - 50) / 2_000_000 * 1000).alias("whale_netflow"))
    return joins.join_feed(t.daily(), flows, F.to_date("ts"), ["whale_netflow"], order=F.col("ts"), bounded=True)


@query("join03_eight_hour_fill",
       f"""WITH {BARS}, f AS (SELECT time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') AS p, arg_min((value - 50) / 400000, ts) AS rate FROM events WHERE event_type = 'signup' GROUP BY 1),
       j AS (SELECT symbol, ts, close, rate FROM bars LEFT JOIN f ON time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '1970-01-01') = p)
       SELECT symbol, ts, close, last_value(rate IGNORE NULLS) OVER {UPTO} * 1e6 AS rate FROM j""",
       "symbol, ts", "close, rate")
def _(t: Tables) -> DataFrame:
    from barline.schema import bucket

    rates = t.events.filter(F.col("event_type") == "signup").select(
        bucket("ts", "8h").alias("_key"), "ts", ((F.col("value") - 50) / 400_000 * 1e6).alias("rate"))
    return joins.join_feed(t.hourly(), rates, bucket("ts", "8h"), ["rate"], order=F.col("ts"), bounded=True)


@query("join04_exact_time",
       f"""WITH {BARS}, m AS (SELECT ts, close AS market FROM bars WHERE symbol = 'view'),
       j AS (SELECT symbol, bars.ts, close, market FROM bars LEFT JOIN m USING (ts))
       SELECT symbol, ts, close, coalesce(last_value(market IGNORE NULLS) OVER {UPTO}, 0) AS market FROM j""",
       "symbol, ts", "close, market")
def _(t: Tables) -> DataFrame:
    bars = t.hourly_stored()
    market = bars.filter(F.col("symbol") == "view").select(
        F.col("ts").alias("_key"), F.col("close").alias("market"))
    return joins.join_feed(bars, market, F.col("ts"), ["market"], default=0.0, bounded=True)


@query("join05_market_day",
       f"""WITH {DAYS}, r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret, (high - low) / nullif(open, 0) AS vol FROM days),
       m AS (SELECT ts::DATE AS day, arg_min(ret, ts) AS market_return, arg_min(vol, ts) AS market_vol FROM r WHERE symbol = 'view' GROUP BY 1)
       SELECT symbol, ts, coalesce(market_return, 0) AS market_return, coalesce(market_vol, vol) AS market_vol FROM r LEFT JOIN m ON ts::DATE = day""",
       "symbol, ts", "market_return, market_vol")
def _(t: Tables) -> DataFrame:
    days = t.daily().withColumns(
        {"ret": w.change("close"), "vol": F.try_divide(F.col("high") - F.col("low"), F.col("open"))})
    market = days.filter(F.col("symbol") == "view").select(
        F.to_date("ts").alias("_key"), "ts", F.col("ret").alias("market_return"), F.col("vol").alias("market_vol"))
    out = joins.join_feed(days, market, F.to_date("ts"), ["market_return", "market_vol"], order=F.col("ts"), fill=False)
    return out.withColumns({"market_return": F.coalesce("market_return", F.lit(0.0)), "market_vol": F.coalesce("market_vol", "vol")})


@query("join06_source_fold",
       """WITH spine AS (SELECT unnest(generate_series(min(o_orderdate)::DATE::TIMESTAMP, max(o_orderdate)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS ts FROM orders),
       o AS (SELECT o_orderdate::DATE AS day, arg_min(o_totalprice, (o_orderdate, o_totalprice)) AS first_total FROM orders GROUP BY 1),
       l AS (SELECT l_shipdate::DATE AS day, arg_min(l_quantity, (l_shipdate, l_quantity, l_tax)) AS first_quantity, arg_min(l_tax, (l_shipdate, l_quantity, l_tax)) AS first_tax FROM lineitem GROUP BY 1)
       SELECT ts, first_total, first_quantity, first_tax FROM spine LEFT JOIN o ON o.day = ts::DATE LEFT JOIN l ON l.day = ts::DATE""",
       "ts", "first_total, first_quantity, first_tax")
def _(t: Tables) -> DataFrame:
    spine = joins.day_spine(t.orders, "o_orderdate")
    sources = [
        ("orders", t.orders.select("o_orderdate", F.col("o_totalprice").alias("first_total")), "o_orderdate"),
        ("lines", t.lineitem.select("l_shipdate", F.col("l_quantity").alias("first_quantity"), F.col("l_tax").alias("first_tax")), "l_shipdate"),
    ]
    return joins.fold_sources(spine, sources).withColumn("ts", F.col("day").cast("timestamp"))


@query("join07_inner_align",
       f"""WITH {BARS}, r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM bars)
       SELECT a.ts, a.ret AS asset, b.ret AS market FROM r a JOIN r b USING (ts) WHERE a.symbol = 'click' AND b.symbol = 'view' AND a.ret IS NOT NULL AND b.ret IS NOT NULL""",
       "ts", "asset, market")
def _(t: Tables) -> DataFrame:
    rets = t.hourly_stored().withColumn("ret", w.change("close"))
    a = rets.filter("symbol = 'click'").select("ts", F.col("ret").alias("asset"))
    b = rets.filter("symbol = 'view'").select("ts", F.col("ret").alias("market"))
    return joins.align(a, b, ["ts"], ["asset", "market"])


@query("join08_as_of",
       """SELECT p.event_id, p.value AS price, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.ts >= v.ts""",
       "event_id", "price, last_view")
def _(t: Tables) -> DataFrame:
    left = t.events.filter("event_type = 'purchase'").select("event_id", "ts", F.col("value").alias("price"))
    right = t.events.filter("event_type = 'view'").select("ts", F.col("value").alias("last_view"))
    return joins.as_of(left, right, [], "ts", ["last_view"], tie="event_id")


@query("join08_as_of_user",
       """SELECT p.event_id, CASE WHEN epoch_us(p.ts) - epoch_us(v.ts) <= 86400000000 THEN v.value END AS last_view
       FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
       "event_id", "last_view")
def _(t: Tables) -> DataFrame:
    left = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return joins.as_of(left, right, ["user_id"], "ts", ["last_view"], tie="event_id", max_age_seconds=86400)


GRID = f"""g AS (SELECT symbol, min(volume)::BIGINT AS lo, max(volume)::BIGINT AS hi, min(close) AS a, max(close) AS b FROM bars GROUP BY 1),
  p AS (SELECT symbol, unnest(generate_series(lo, hi, greatest(1, (hi - lo) // 3)))::BIGINT AS size, a, b FROM g),
  q AS (SELECT symbol, size, a + (b - a) * k / 3 AS level, k FROM p, (SELECT unnest(generate_series(0, 3)) AS k))"""


@query("join10_parameter_grid",
       f"WITH {BARS}, {GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY size, level) AS combo FROM q) SELECT symbol, combo, size, level FROM r",
       "symbol, combo, size", "level")
def _(t: Tables) -> DataFrame:
    from barline.operators.search import parameter_grid

    ranges = t.hourly().groupBy("symbol").agg(
        F.min("volume").cast("long").alias("lo"), F.max("volume").cast("long").alias("hi"),
        F.min("close").alias("a"), F.max("close").alias("b"))
    return parameter_grid(ranges, ["symbol"], {"size": ("lo", "hi", "int"), "level": ("a", "b", "float")})


OHLC = ["open", "high", "low", "close", "volume"]
PAIRS = [(a, b) for i, a in enumerate(OHLC) for b in OHLC[i + 1:]]


@query("join11_correlated_pairs",
       f"WITH {BARS}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS c1, '{b}' AS c2, corr({a}, {b}) AS corr FROM bars" for a, b in PAIRS)
       + ") SELECT * FROM p WHERE abs(corr) >= 0.3",
       "c1, c2", "corr")
def _(t: Tables) -> DataFrame:
    return joins.correlated_pairs(agg.correlation_matrix(t.hourly(), OHLC), 0.3)


@query("set01_time_sort", f"WITH {BARS} SELECT symbol, ts, close FROM bars ORDER BY symbol, ts", "symbol, ts", "close")
def _(t: Tables) -> DataFrame:
    return t.hourly().orderBy("symbol", "ts")


@query("set02_tail",
       "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) <= 100")
def _(t: Tables) -> DataFrame:
    return sets.newest_rows(t.events, ["event_type"], ["ts"], 100).select("event_id", "event_type")


@query("set03_latest", "SELECT event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1",
       "event_type, event_id", "value")
def _(t: Tables) -> DataFrame:
    return sets.latest(t.events.select("event_type", "ts", "event_id", "value"), "ts", ["event_type"])


@query("set04_ranking",
       """WITH s AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1)
       SELECT o_custkey, cents, rank() OVER (ORDER BY cents DESC) AS place FROM s""",
       "o_custkey, cents, place")
def _(t: Tables) -> DataFrame:
    scores = t.orders.groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return sets.ranked(scores, "cents", "o_custkey", "place")


@query("set05_union_all",
       "SELECT l_shipdate AS ts, l_orderkey AS k, l_quantity AS amount, 'line' AS kind FROM lineitem UNION ALL SELECT o_orderdate, o_orderkey, o_totalprice, 'order' FROM orders",
       "ts, k, kind", "amount")
def _(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("amount"), F.lit("line").alias("kind"))
    b = t.orders.select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"), F.lit("order").alias("kind"))
    return a.unionByName(b)


@query("set06_overlay",
       f"""WITH {BARS}, h AS (SELECT * FROM bars WHERE ts < TIMESTAMP '2024-01-20'), r AS (SELECT symbol, ts, open, high, low, close + 1 AS close, volume FROM bars WHERE ts >= TIMESTAMP '2024-01-15')
       SELECT symbol, ts, close FROM h UNION ALL SELECT symbol, ts, close FROM r WHERE ts > (SELECT max(ts) FROM h)""",
       "symbol, ts", "close")
def _(t: Tables) -> DataFrame:
    bars = t.hourly()
    history = bars.filter("ts < timestamp'2024-01-20'")
    recent = bars.filter("ts >= timestamp'2024-01-15'").withColumn("close", F.col("close") + 1)
    return sets.overlay(history, recent, keys=("symbol",))


@query("set07_keep_first_last",
       """SELECT o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS first_total, arg_max(o_totalprice, o_orderkey) AS last_total FROM orders GROUP BY 1""",
       "ts", "first_total, last_total")
def _(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderdate").alias("ts"), "o_orderkey", "o_totalprice")
    first = sets.keep_first(o, ["ts"], F.col("o_orderkey")).select("ts", F.col("o_totalprice").alias("first_total"))
    last = sets.keep_first(o, ["ts"], F.col("o_orderkey"), last=True).select("ts", F.col("o_totalprice").alias("last_total"))
    return first.join(last, "ts")
