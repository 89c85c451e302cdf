"""SRC and SNK: feed documents derived from the bars, files written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barline.plans import ledger as lg, reports
from barline.plans.catalog import BARS, BRANDS, DAYS, W, query, strict
from barline.plans.catalog.trades import LEDGER
from barline.session import scratch_path
from barline.sources import bars as files, feeds
from barline.sources.tables import Tables

c = F.col


def millis() -> Column:
    return F.unix_millis("ts")


def documents(t: Tables, element: Column, wrap=lambda items: items) -> DataFrame:
    """One JSON document per symbol and day of hourly bars (at most 24 elements)."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ts", element.alias("e")))), lambda s: s["e"])
    return t.hourly().groupBy("symbol", F.to_date("ts").alias("day")).agg(F.to_json(wrap(items)).alias("payload")).drop("day")


def text(x: Column) -> Column:
    return x.cast("string")


@query("src01_csv_bars", f"WITH {BRANDS} SELECT * FROM brands WHERE close IS NOT NULL", "symbol, ts", "open, high, low, close, volume")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    raw = t.brand_daily().select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(" DateTime"), c("open").alias("Open"), c("high").alias("HIGH"),
                                 c("low").alias("Low"), c("close").alias("Price"), c("volume").alias("Vol"))
    raw.write.option("header", True).csv(path)
    return files.read_csv_bars(t.spark, path, ("symbol",))


@query("src02_parquet_bars", f"WITH {BARS} SELECT * FROM bars", "symbol, ts", "open, high, low, close, volume")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "bars")
    t.hourly().write.parquet(path)
    return files.read_parquet_bars(t.spark, path, F.current_timestamp())


@query("src03_candles", f"WITH {BARS} SELECT * FROM bars", "symbol, ts", "open, high, low, close, volume")
def _(t: Tables) -> DataFrame:
    row = F.array(text(millis()), *[text(c(k)) for k in ("open", "high", "low", "close", "volume")])
    return feeds.candles(documents(t, row), ["symbol"])


@query("src04_open_interest",
       f"WITH {BARS} SELECT symbol, ts, volume AS open_interest, volume * close AS open_interest_value, volume / nullif(lag(volume) OVER {W}, 0) - 1 AS oi_change_pct FROM bars",
       "symbol, ts", "open_interest, open_interest_value, oi_change_pct")
def _(t: Tables) -> DataFrame:
    item = F.struct(millis().alias("timestamp"), text(c("volume")).alias("sumOpenInterest"), text(c("volume") * c("close")).alias("sumOpenInterestValue"))
    return feeds.open_interest(documents(t, item))


def ratio_item() -> Column:
    return F.struct(millis().alias("timestamp"), text(c("close") / 40).alias("longShortRatio"), text(c("close") / (c("close") + 40)).alias("longAccount"), text(40 / (c("close") + 40)).alias("shortAccount"))


@query("src05_long_short", f"WITH {BARS} SELECT symbol, ts, close / 40 AS long_short_ratio, close / (close + 40) AS long_account_pct, 40 / (close + 40) AS short_account_pct FROM bars",
       "symbol, ts", "long_short_ratio, long_account_pct, short_account_pct")
def _(t: Tables) -> DataFrame:
    return feeds.long_short_ratio(documents(t, ratio_item()))


def _funding_docs(t: Tables) -> DataFrame:
    item = F.struct(text(millis()).alias("fundingTime"), text((c("close") - 50) / 1000).alias("fundingRate"))
    nested = documents(t, item, lambda x: F.struct(x.alias("data"))).filter("symbol < 'p'")
    return nested.unionByName(documents(t, item).filter("symbol >= 'p'"))


@query("src06_latest_record",
       f"""WITH {BARS} SELECT symbol, arg_max(close / 40, ts) AS ratio, arg_max(close / (close + 40), ts) AS long_pct, arg_max((close - 50) / 1000, ts) AS funding, 0.5 AS silent FROM bars GROUP BY 1""",
       "symbol", "ratio, long_pct, funding, silent")
def _(t: Tables) -> DataFrame:
    ratio = feeds.long_short_ratio(documents(t, ratio_item()))
    fund = feeds.funding(_funding_docs(t))
    return feeds.latest_record({"ratio": (ratio, "long_short_ratio", 1.0), "long_pct": (ratio, "long_account_pct", 0.5), "funding": (fund, "funding_rate", 0.0),
                                "silent": (ratio.filter("false"), "short_account_pct", 0.5)}, keys=["symbol"])


@query("src07_funding", f"WITH {BARS} SELECT symbol, ts, (close - 50) / 1000 AS funding_rate FROM bars", "symbol, ts", "funding_rate")
def _(t: Tables) -> DataFrame:
    return feeds.funding(_funding_docs(t))


MOOD = "CASE WHEN close >= 75 THEN 'greed' WHEN close <= 25 THEN 'fear' ELSE 'neutral' END"


@query("src08_fear_greed", f"WITH {BARS} SELECT symbol, ts, floor(close)::INT AS value, {MOOD} AS classification FROM bars", "symbol, ts, value, classification")
def _(t: Tables) -> DataFrame:
    item = F.struct(text(F.floor("close")).alias("value"), F.expr(MOOD).alias("value_classification"), text(F.unix_seconds("ts")).alias("timestamp"))
    return feeds.fear_greed(documents(t, item, lambda x: F.struct(x.alias("data"))))


@query("src09_netflow", f"WITH {BARS} SELECT symbol, ts, close * 1000 AS netflow, close * 1000 / 2000000 AS netflow_pct FROM bars", "symbol, ts", "netflow, netflow_pct")
def _(t: Tables) -> DataFrame:
    return feeds.netflow(documents(t, F.struct(F.unix_seconds("ts").alias("t"), (c("close") * 1000).alias("v"))))


def _xy(t: Tables) -> DataFrame:
    """Daily closes as x/y documents, one per symbol and month of days (at most 31 points)."""
    items = F.array_sort(F.collect_list(F.struct(F.unix_seconds("ts").alias("x"), c("close").alias("y"))))
    return t.daily().groupBy("symbol", F.date_trunc("month", "ts").alias("m")).agg(F.to_json(F.struct(items.alias("values"))).alias("payload")).drop("m")


@query("src10_hash_rate",
       f"WITH {DAYS} SELECT symbol, ts, close AS hash_rate, {strict('avg', 'close', 7)} AS hash_rate_ma7, {strict('avg', 'close', 30)} AS hash_rate_ma30, close / nullif(lag(close, 7) OVER {W}, 0) - 1 AS hash_rate_change_7d, CASE WHEN ({strict('avg', 'close', 7)}) > ({strict('avg', 'close', 30)}) THEN 1 ELSE 0 END AS hash_rate_trend FROM days",
       "symbol, ts, hash_rate_trend", "hash_rate, hash_rate_ma7, hash_rate_ma30, hash_rate_change_7d")
def _(t: Tables) -> DataFrame:
    return feeds.hash_rate(_xy(t))


@query("src11_difficulty", f"WITH {DAYS} SELECT symbol, ts, close AS difficulty, close / nullif(lag(close) OVER {W}, 0) - 1 AS difficulty_change FROM days", "symbol, ts", "difficulty, difficulty_change")
def _(t: Tables) -> DataFrame:
    return feeds.difficulty(_xy(t))


@query("src12_network_stats",
       f"WITH {BARS} SELECT symbol, ts, close AS hash_rate, 0.0 AS difficulty, volume::BIGINT AS n_tx, high * 1e6 / 1e8 AS total_fees_btc, CASE WHEN volume > 2 THEN low * 1e7 / 1e8 ELSE 0 END AS miners_revenue_btc FROM bars",
       "symbol, ts, n_tx", "hash_rate, difficulty, total_fees_btc, miners_revenue_btc")
def _(t: Tables) -> DataFrame:
    doc = F.struct(c("close").alias("hash_rate"), c("volume").cast("long").alias("n_tx"), (c("high") * 1e6).alias("total_fees_btc"), F.when(c("volume") > 2, c("low") * 1e7).alias("miners_revenue_btc"))
    return feeds.network_stats(t.hourly().select("symbol", "ts", F.to_json(doc).alias("payload")))


def _market_docs(t: Tables) -> DataFrame:
    share = F.when(c("volume") > 2, F.create_map(F.lit("btc"), c("close"), F.lit("eth"), c("open"))).otherwise(F.create_map(F.lit("eth"), c("open")))
    doc = F.struct(F.struct(share.alias("market_cap_percentage"), F.create_map(F.lit("usd"), c("high") * 1e9).alias("total_market_cap")).alias("data"))
    return t.hourly().select("symbol", "ts", F.to_json(doc).alias("payload"))


def _coin_docs(t: Tables) -> DataFrame:
    def cap(x: Column) -> Column:
        return F.struct(x.alias("usd_market_cap"))

    doc = F.create_map(F.lit("tether"), cap(c("high")), F.lit("usd-coin"), cap(c("low")), F.lit("other"), cap(c("open")))
    return t.hourly().select("symbol", "ts", F.to_json(doc).alias("payload"))


@query("src13_global_market", f"WITH {BARS} SELECT symbol, ts, CASE WHEN volume > 2 THEN close ELSE 0 END AS btc_dominance, high * 1e9 AS total_market_cap_usd FROM bars", "symbol, ts", "btc_dominance, total_market_cap_usd")
def _(t: Tables) -> DataFrame:
    return feeds.global_market(_market_docs(t))


@query("src14_stablecoins", f"WITH {BARS} SELECT symbol, ts, high AS tether, low AS usd_coin, 0 AS dai, high + low AS stablecoin_total FROM bars", "symbol, ts", "tether, usd_coin, dai, stablecoin_total")
def _(t: Tables) -> DataFrame:
    return feeds.stablecoins(_coin_docs(t))


@query("src15_market_caps", f"WITH {BARS} SELECT symbol, ts, close * 1e6 AS btc_mcap_usd FROM bars", "symbol, ts", "btc_mcap_usd")
def _(t: Tables) -> DataFrame:
    return feeds.market_caps(documents(t, F.array(millis().cast("double"), c("close") * 1e6), lambda x: F.struct(x.alias("market_caps"))))


@query("src16_macro", f"WITH {BARS} SELECT symbol, ts, CASE WHEN volume > 2 THEN close ELSE 0 END AS btc_dominance, high + low AS stablecoin_total FROM bars", "symbol, ts", "btc_dominance, stablecoin_total")
def _(t: Tables) -> DataFrame:
    return feeds.macro(feeds.global_market(_market_docs(t)), feeds.stablecoins(_coin_docs(t)), ["symbol", "ts"])


@query("src17_search_interest",
       f"WITH {DAYS} SELECT symbol, ts, close AS interest, {strict('avg', 'close', 7)} AS interest_ma7, close - lag(close, 7) OVER {W} AS interest_diff_7d FROM days", "symbol, ts", "interest, interest_ma7, interest_diff_7d")
def _(t: Tables) -> DataFrame:
    table = t.daily().select("symbol", c("ts").alias("date"), c("close").alias("bitcoin"), F.lit(False).alias("isPartial"))
    return feeds.search_interest(table, "bitcoin")


def _forum(t: Tables) -> DataFrame:
    """Documents as forum listings: one listing per document, its source as the forum."""
    post = F.struct(F.struct(c("text").alias("title"), c("n_chars").alias("score"), (c("doc_id") % 17).alias("num_comments"),
                             (F.lit(1_700_000_000.0) + c("doc_id") * 60).alias("created_utc"), c("source").alias("subreddit")).alias("data"))
    d = t.documents.select("doc_id", F.to_json(F.struct(F.struct(F.array(post).alias("children")).alias("data"))).alias("payload"))
    return feeds.forum_listing(d)


def _news(t: Tables) -> DataFrame:
    """Conversation turns as news responses, one per block of eight turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", "role", "conv_id")))
    rows = F.transform(turns, lambda r: F.struct(
        r["text"].alias("title"), F.struct(r["role"].alias("title")).alias("source"), F.lit("2023-11-20 10:00:00").alias("published_at"),
        F.create_map(F.lit("positive"), r["turn"]).alias("votes"), F.concat(F.lit("u"), r["conv_id"]).alias("url")))
    return t.conversations.groupBy("conv_id", F.floor(c("turn") / 8).alias("part")).agg(F.to_json(F.struct(rows.alias("results"))).alias("payload"))


@query("src18_forum", "SELECT doc_id, md5(text) AS h, n_chars AS score, doc_id % 17 AS num_comments, 1700000000 + doc_id * 60 AS ts_s, source AS subreddit, 'reddit' AS source FROM documents")
def _(t: Tables) -> DataFrame:
    return _forum(t).select("doc_id", F.md5("text").alias("h"), "score", "num_comments", F.unix_seconds("ts").alias("ts_s"), "subreddit", "source")


@query("src19_news", "SELECT conv_id, md5(text) AS h, role AS source, turn AS positive, 'u' || conv_id AS url FROM conversations")
def _(t: Tables) -> DataFrame:
    return feeds.news_results(_news(t)).select("conv_id", F.md5("text").alias("h"), "source", c("votes")["positive"].alias("positive"), "url")


@query("src20_rss",
       """SELECT conv_id, turn // 8 AS part, (row_number() OVER (PARTITION BY conv_id, turn // 8 ORDER BY turn) - 1)::INT AS pos, 'Day ' || turn AS published, conv_id % 3 = 0 AS is_influencer FROM conversations""")
def _(t: Tables) -> DataFrame:
    clean = F.regexp_replace("text", "[<>&]", " ")
    item = F.concat(F.lit("<item>\n<title>"), clean, F.lit("</title>\n<pubDate>Day "), c("turn"), F.lit("</pubDate></item>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("e")))), lambda s: s["e"])
    user = F.when(c("conv_id") % 3 == 0, "known").otherwise("other").alias("username")
    d = t.conversations.groupBy("conv_id", F.floor(c("turn") / 8).alias("part"), user).agg(F.concat(F.lit("<rss>"), F.array_join(rows, ""), F.lit("</rss>")).alias("payload"))
    return feeds.rss_items(d, "username", ["known"]).select("conv_id", "part", "pos", "published", "is_influencer")


@query("src21_social_metrics",
       "SELECT event_id, value AS galaxy_score, 100.0 AS alt_rank, user_id::DOUBLE AS social_volume, CASE WHEN event_id % 3 = 0 THEN 4.0 ELSE 3.0 END AS average_sentiment FROM events",
       "event_id", "galaxy_score, alt_rank, social_volume, average_sentiment")
def _(t: Tables) -> DataFrame:
    doc = F.struct(F.array(F.struct(c("value").alias("galaxy_score"), c("user_id").cast("double").alias("social_volume"), F.when(c("event_id") % 3 == 0, 4.0).alias("average_sentiment"))).alias("data"))
    return feeds.social_metrics(t.events.select("event_id", F.to_json(doc).alias("payload")))


UNIFIED = """p AS (SELECT md5(text) AS h, 'reddit' AS source, n_chars + doc_id % 17 AS engagement FROM documents WHERE 1700000000 + doc_id * 60 >= 1700050000 - 24 * 3600 + 50000), n AS (SELECT md5(text) AS h, role AS source, 0 AS engagement FROM conversations)"""


def _unified(t: Tables) -> DataFrame:
    return feeds.unified_news(_forum(t), feeds.news_results(_news(t)), F.timestamp_seconds(F.lit(1_700_100_000)), 24)


@query("src22_unified_news", f"WITH {UNIFIED} SELECT * FROM p UNION ALL SELECT * FROM n")
def _(t: Tables) -> DataFrame:
    return _unified(t).select(F.md5("text").alias("h"), "source", "engagement")


@query("src23_text_feed",
       f"WITH {UNIFIED} SELECT h, source, 'news' AS type, engagement, NULL::BOOLEAN AS is_influencer FROM p UNION ALL SELECT h, source, 'news', engagement, NULL FROM n UNION ALL SELECT md5(text), role, 'tweet', NULL, role = 'assistant' FROM conversations")
def _(t: Tables) -> DataFrame:
    tweets = t.conversations.select("text", c("role").alias("source"), (c("role") == "assistant").alias("is_influencer"))
    feed = feeds.unified_text(news=_unified(t), tweet=tweets)
    return feed.select(F.md5("text").alias("h"), "source", "type", "engagement", "is_influencer")


@query("src24_snapshot",
       f"""WITH {BARS} SELECT symbol, arg_max(close / 40, ts) AS ratio, arg_max(close * 1000, ts) AS netflow, floor(arg_max(close, ts))::DOUBLE AS mood, 50.0 AS galaxy FROM bars GROUP BY 1""",
       "symbol", "ratio, netflow, mood, galaxy")
def _(t: Tables) -> DataFrame:
    ratio = feeds.long_short_ratio(documents(t, ratio_item()))
    flow = feeds.netflow(documents(t, F.struct(F.unix_seconds("ts").alias("t"), (c("close") * 1000).alias("v"))))
    mood = t.hourly().withColumn("mood", F.floor("close").cast("double"))
    return feeds.feature_snapshot({"ratio": (ratio, "long_short_ratio", 1.0), "netflow": (flow, "netflow", 0.0), "mood": (mood, "mood", 50.0),
                                   "galaxy": (mood.filter("false"), "mood", 50.0)}, keys=["symbol"])


@query("src25_fallback",
       f"WITH {BARS}, {DAYS} SELECT symbol, ts, close, TRUE AS daily FROM days UNION ALL SELECT symbol, ts, close, FALSE FROM bars ANTI JOIN days USING (symbol, ts)",
       "symbol, ts, daily", "close")
def _(t: Tables) -> DataFrame:
    days, hours = (df.select("symbol", "ts", "close", F.lit(daily).alias("daily")) for df, daily in ((t.daily(), True), (t.hourly(), False)))
    return feeds.preferred([days, hours], ["symbol", "ts"])


@query("src26_scaler_file",
       "SELECT 'l_quantity' AS feature, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std FROM lineitem UNION ALL SELECT 'l_tax', avg(l_tax), stddev_samp(l_tax) FROM lineitem", "feature", "mean, std")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "scaler")
    cols = ["l_quantity", "l_tax"]
    s = t.lineitem.agg(*[F.avg(k).alias(f"m_{k}") for k in cols], *[F.stddev_samp(k).alias(f"s_{k}") for k in cols])
    s.select(*[F.create_map(*[x for k in cols for x in (F.lit(k), c(f"{p}_{k}"))]).alias(name) for p, name in (("m", "mean"), ("s", "std"))]).write.json(path)
    docs = feeds.read_documents(t.spark, f"{path}/*.json")
    return feeds.scaler_table(docs).withColumnRenamed("column", "feature")


@query("snk01_parquet", f"WITH {BARS} SELECT symbol, ts, strftime(ts, '%Y-%m-%d') AS date, close FROM bars", "symbol, ts, date", "close")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "parquet")
    files.write_parquet(t.hourly(), path)
    return t.spark.read.parquet(path).withColumn("date", c("date").cast("string"))


@query("snk02_json_reports",
       f"WITH {LEDGER} SELECT strftime(exit_ts, '%Y-%m-%d') AS day, count(*) AS trades, sum(pnl) AS pnl, sum(fees) AS fees FROM ledger GROUP BY 1", "day, trades", "pnl, fees")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "reports")
    r = reports.daily_report(lg.ledger(t)).withColumn("day", c("day").cast("string"))
    nested = r.select("day", F.struct("trades", "wins", "pnl").alias("result"), F.struct("fees", "balance", "max_drawdown").alias("account"))
    files.write_json_reports(nested, path)
    schema = "day string, result struct<trades:bigint,wins:bigint,pnl:double>, account struct<fees:double,balance:double,max_drawdown:double>"
    return t.spark.read.schema(schema).json(path).select("day", "result.trades", "result.pnl", "account.fees")


@query("snk03_trade_csv",
       f"""WITH {LEDGER} SELECT symbol, printf('%.2f', exit_price) AS price, printf('%.4f', pnl) AS pnl, exit_reason AS reason FROM ledger""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "trades")
    zero = F.lit(0.0)
    led = lg.ledger(t).select(c("exit_ts").alias("timestamp"), c("symbol").alias("action"), c("exit_price").alias("price"), zero.alias("confidence"), c("quantity").alias("position"),
                              zero.alias("balance"), "pnl", zero.alias("pnl_pct"), c("exit_reason").alias("reason"))
    files.append_trades(led.filter("action < 'p'"), path)
    files.append_trades(led.filter("action >= 'p'"), path)
    schema = ", ".join(f"{k} string" for k in files.TRADE_COLUMNS)
    back = t.spark.read.schema(schema).option("header", True).csv(path)
    return back.select(c("action").alias("symbol"), "price", "pnl", "reason")
