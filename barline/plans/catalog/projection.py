"""PRJ: headers, times, casts, rules and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import projection as pj, text as tx, windows as w
from barline.plans.catalog import BARS, W, query
from barline.schema import INTERVALS, bucket
from barline.sources.tables import Tables


@query("prj01_headers", "SELECT o_orderkey, o_orderdate AS ts, o_totalprice AS open, o_totalprice AS close, 0.0 AS volume FROM orders",
       "o_orderkey, ts", "open, close, volume")
def _(t: Tables) -> DataFrame:
    messy = t.orders.select("o_orderkey", F.col("o_orderdate").alias(" DateTime"), F.col("o_totalprice").alias("Price "))
    return pj.standardize_headers(messy).withColumnRenamed("timestamp", "ts")


@query("prj02_epoch_units", "SELECT event_id, (CASE WHEN event_id % 11 = 3 THEN NULL ELSE date_trunc('second', ts) END) AS ts FROM events", "event_id, ts")
def _(t: Tables) -> DataFrame:
    sec = F.unix_seconds("ts")
    raw = (F.when(F.col("event_id") % 11 == 3, "never").when(F.col("event_id") % 3 == 0, sec.cast("string"))
           .when(F.col("event_id") % 3 == 1, (sec * 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return t.events.withColumn("raw", raw).withColumn("ts", pj.parse_time(F.col("raw")))


@query("prj03_casts",
       """SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE regexp_extract(props, '\\d+') END AS BIGINT) AS k,
       TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS v FROM events""", "event_id, k", "v")
def _(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select(
        "event_id", F.when(F.col("event_id") % 5 == 0, "bad").otherwise(k).try_cast("bigint").alias("k"),
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).try_cast("double").alias("v"))


@query("prj04_drop_incomplete",
       f"WITH {BARS}, r AS (SELECT symbol, ts, close / nullif(lag(close, 24) OVER {W}, 0) - 1 AS ret FROM bars) SELECT * FROM r WHERE ret IS NOT NULL",
       "symbol, ts", "ret")
def _(t: Tables) -> DataFrame:
    ret = F.coalesce(w.change("close", 24), F.lit(float("nan")))
    return pj.drop_incomplete(t.hourly().withColumn("ret", ret), ["ret"])


@query("prj05_drop_non_finite",
       "SELECT event_id, value / nullif(event_id % 4, 0) AS ratio FROM events WHERE event_id % 4 <> 0", "event_id", "ratio")
def _(t: Tables) -> DataFrame:
    k = (F.col("event_id") % 4).cast("double")
    ratio = F.when(k == 0, F.lit(float("inf"))).otherwise(F.col("value") / F.nullif(k, F.lit(0.0)))
    return pj.drop_non_finite(t.events.withColumn("ratio", ratio), ["ratio"])


@query("prj06_date_range",
       "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12 12:00:00'", "event_id", "value")
def _(t: Tables) -> DataFrame:
    return pj.between_dates(t.events, "ts", "2024-01-05", "2024-01-12 12:00:00")


@query("prj07_column_groups", "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber FROM lineitem",
       "l_linenumber", "l_quantity, l_extendedprice, l_discount, l_tax")
def _(t: Tables) -> DataFrame:
    groups = {"price": ["l_extendedprice", "missing_one"], "size": ["l_quantity"], "rate": ["l_discount", "l_tax", "l_quantity"]}
    return pj.select_groups(t.lineitem, groups, ["size", "price", "rate"], "l_linenumber")


@query("prj08_narrow_types",
       """SELECT l_returnflag, 'float' AS price_type, CASE WHEN max(max(l_linenumber)) OVER () <= 127 THEN 'tinyint' WHEN max(max(l_linenumber)) OVER () <= 32767 THEN 'smallint' ELSE 'int' END AS line_type,
       CASE WHEN max(max(l_partkey)) OVER () <= 127 THEN 'tinyint' WHEN max(max(l_partkey)) OVER () <= 32767 THEN 'smallint' ELSE 'int' END AS part_type,
       sum(l_linenumber)::BIGINT AS lines, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    d = pj.narrow_types(t.lineitem, ["l_extendedprice"], ["l_linenumber", "l_partkey"])
    return d.groupBy("l_returnflag").agg(
        F.first(F.typeof("l_extendedprice")).alias("price_type"), F.first(F.typeof("l_linenumber")).alias("line_type"),
        F.first(F.typeof("l_partkey")).alias("part_type"), F.sum("l_linenumber").alias("lines"), F.sum("l_partkey").alias("parts"))


@query("prj09_chunks", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS chunk FROM events")
def _(t: Tables) -> DataFrame:
    return pj.chunk_rows(t.events.select("event_id", "ts"), ["ts", "event_id"], 1000).select("event_id", "chunk")


RAW_SYMBOL = "event_type || CASE event_id % 4 WHEN 0 THEN '/usdt' WHEN 1 THEN '-Btc' WHEN 2 THEN 'usdt' ELSE '' END"


@query("prj10_symbols",
       f"""WITH s AS (SELECT event_id, replace(replace(upper({RAW_SYMBOL}), '/', ''), '-', '') AS s FROM events)
       SELECT event_id, CASE WHEN length(s) > 6 AND contains(s, 'USDT') THEN replace(s, 'USDT', '') || 'USDT' WHEN length(s) > 6 AND contains(s, 'BTC') THEN replace(s, 'BTC', '') || 'BTC' ELSE s END AS symbol FROM s""")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", pj.normalize_symbol(F.expr(RAW_SYMBOL)).alias("symbol"))


@query("prj11_safe_maths",
       """SELECT event_id, coalesce(value / nullif(event_id % 3, 0), -1) AS ratio, coalesce((value - event_id % 5) / nullif(event_id % 5, 0), 0) AS change,
       CASE WHEN value = 0 THEN 0 ELSE round(value * pow(10, 1 - floor(log10(abs(value))))) / pow(10, 1 - floor(log10(abs(value)))) END AS two_digits FROM events""",
       "event_id", "ratio, change, two_digits")
def _(t: Tables) -> DataFrame:
    v, k = F.col("value"), F.col("event_id")
    return t.events.select("event_id", pj.safe_divide(v, (k % 3).cast("double"), -1.0).alias("ratio"),
                           pj.relative_change((k % 5).cast("double"), v).alias("change"), pj.round_significant(v, 2).alias("two_digits"))


@query("prj12_required_columns", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return pj.require_columns(t.events, ["event_type", "ts", "value"]).groupBy("event_type").agg(F.count("*").alias("n"))


RECORD = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ab' WHEN 1 THEN 'btcusdt' WHEN 2 THEN 'BTC USD' ELSE ' BTCUSDT ' END AS symbol, value / 8 AS close,
  event_id - 20 AS timestamp, CASE event_id % 4 WHEN 0 THEN 'buy' WHEN 1 THEN ' sell' ELSE 'hold' END AS side, value - 5 AS price, value / 100 AS strength FROM events"""


@query("prj13_record_rules",
       f"""WITH r AS ({RECORD}) SELECT event_id, array_to_string(list_filter([CASE WHEN length(trim(symbol)) NOT BETWEEN 3 AND 20 THEN 'symbol_length' END, CASE WHEN trim(symbol) <> upper(trim(symbol)) THEN 'symbol_case' END,
         CASE WHEN contains(trim(symbol), ' ') THEN 'symbol_space' END, CASE WHEN close < 0.01 OR close > 1000000 THEN 'close_range' END, CASE WHEN timestamp <= 0 THEN 'timestamp' END], lambda x: x IS NOT NULL), ',') AS market,
       array_to_string(list_filter([CASE WHEN length(trim(symbol)) NOT BETWEEN 3 AND 20 THEN 'symbol_length' END, CASE WHEN trim(side) NOT IN ('buy', 'sell') THEN 'side' END, CASE WHEN price <= 0 THEN 'price' END,
         CASE WHEN strength NOT BETWEEN 0 AND 1 THEN 'strength' END], lambda x: x IS NOT NULL), ',') AS signal FROM r""")
def _(t: Tables) -> DataFrame:
    t.events.createOrReplaceTempView("barline_events")
    r = t.spark.sql(RECORD.replace("FROM events", "FROM barline_events"))
    return r.select("event_id", F.concat_ws(",", pj.market_violations()).alias("market"), F.concat_ws(",", pj.signal_violations()).alias("signal"))


@query("prj14_hour_cycle", f"WITH {BARS} SELECT symbol, ts, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos FROM bars",
       "symbol, ts", "hour_sin, hour_cos")
def _(t: Tables) -> DataFrame:
    return t.hourly().withColumns(w.hour_cycle())


def _interval_sql(name: str) -> str:
    if name in ("1w", "1M"):
        return f"date_trunc('{'week' if name == '1w' else 'month'}', ts)"
    return f"time_bucket(INTERVAL {INTERVALS[name]} SECOND, ts, TIMESTAMP '1970-01-01')"


@query("prj15_intervals", " UNION ALL ".join(f"SELECT '{i}' AS interval_name, count(DISTINCT (event_type, {_interval_sql(i)})) AS bars FROM events" for i in INTERVALS))
def _(t: Tables) -> DataFrame:
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("interval_name"), bucket("ts", i).alias("b")) for i in INTERVALS]))
    return (t.events.select("event_type", named.alias("x")).groupBy("event_type", "x").agg(F.lit(1).alias("one"))
            .groupBy(F.col("x.interval_name").alias("interval_name")).agg(F.count("one").alias("bars")))


SPACES = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"


@query("prj16_markup",
       rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&[a-z]+;', '', 'g'), '{SPACES}', ' ', 'g'), '^ | $', '', 'g') AS body FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.strip_markup(F.col("html")).alias("body"))
