"""Feed payloads as tables (SRC).

A landed feed is a folder of JSON documents; ``read_documents`` gives one
document per row in ``payload``, any other column (symbol, landing time) rides
along. Every reader parses with an explicit schema, so bad documents become
nulls and nothing is inferred.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barline.functions.windows import change, hash_rate_features, interest_features
from barline.operators.onerow import with_row
from barline.operators.ordered import BARS, Series
from barline.operators.sets import keep_first, latest


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def _rest(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "payload"]


def _explode(df: DataFrame, schema: str, path: str = "") -> DataFrame:
    doc = F.from_json("payload", schema)
    return df.select(*_rest(df), F.explode(doc[path] if path else doc).alias("_r"))


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def candles(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """SRC-03: [[ms, o, h, l, c, v], ..] as numbers or strings; the first bar of each time stays."""
    d = _explode(df, "array<array<string>>")
    fields = [F.element_at("_r", i + 2).try_cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))]
    d = d.select(*_rest(df), F.timestamp_millis(F.element_at("_r", 1).try_cast("bigint")).alias("ts"), *fields)
    return keep_first(d, [*keys, "ts"], F.struct("open", "high", "low", "close", "volume"))


def open_interest(df: DataFrame, series: Series = BARS) -> DataFrame:
    """SRC-04."""
    d = _explode(df, "array<struct<timestamp:bigint,sumOpenInterest:string,sumOpenInterestValue:string>>")
    d = d.select(
        *_rest(df),
        F.timestamp_millis("_r.timestamp").alias("ts"),
        _number("_r.sumOpenInterest").alias("open_interest"),
        _number("_r.sumOpenInterestValue").alias("open_interest_value"),
    )
    return d.withColumn("oi_change_pct", change("open_interest", 1, series))


def long_short_ratio(df: DataFrame) -> DataFrame:
    """SRC-05."""
    d = _explode(df, "array<struct<timestamp:bigint,longShortRatio:string,longAccount:string,shortAccount:string>>")
    return d.select(
        *_rest(df),
        F.timestamp_millis("_r.timestamp").alias("ts"),
        _number("_r.longShortRatio").alias("long_short_ratio"),
        _number("_r.longAccount").alias("long_account_pct"),
        _number("_r.shortAccount").alias("short_account_pct"),
    )


def latest_record(feeds: dict[str, tuple[DataFrame, str, float]], ts: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """SRC-06: the newest value of each (feed, column, default) in one row, or one row per key of any feed."""
    if keys:
        newest = [df.groupBy(*keys).agg(F.max_by(column, ts).alias(name)) for name, (df, column, _) in feeds.items()]
        found = reduce(lambda a, b: a.join(b, keys, "full"), newest)
        return found.fillna({name: default for name, (_, _, default) in feeds.items()})
    parts = [
        df.agg(F.max_by(column, ts).alias("_v")).select(F.coalesce("_v", F.lit(default)).alias(name))
        for name, (df, column, default) in feeds.items()
    ]
    return reduce(with_row, parts)


def funding(df: DataFrame) -> DataFrame:
    """SRC-07: nested ``data`` with string milliseconds, or a flat array."""
    item = "array<struct<fundingTime:string,fundingRate:string>>"
    nested = F.from_json("payload", f"struct<data:{item}>")["data"]
    d = df.select(*_rest(df), F.explode(F.coalesce(nested, F.from_json("payload", item))).alias("_r"))
    return d.select(
        *_rest(df),
        F.timestamp_millis(F.col("_r.fundingTime").try_cast("bigint")).alias("ts"),
        _number("_r.fundingRate").alias("funding_rate"),
    )


def fear_greed(df: DataFrame) -> DataFrame:
    """SRC-08: string seconds and values."""
    d = _explode(df, "struct<data:array<struct<value:string,value_classification:string,timestamp:string>>>", "data")
    return d.select(
        *_rest(df),
        F.timestamp_seconds(F.col("_r.timestamp").try_cast("bigint")).alias("ts"),
        F.col("_r.value").try_cast("int").alias("value"),
        F.col("_r.value_classification").alias("classification"),
    )


def netflow(df: DataFrame) -> DataFrame:
    """SRC-09."""
    d = _explode(df, "array<struct<t:bigint,v:double>>")
    return d.select(
        *_rest(df),
        F.timestamp_seconds("_r.t").alias("ts"),
        F.col("_r.v").alias("netflow"),
        (F.col("_r.v") / 2_000_000).alias("netflow_pct"),
    )


def xy_series(df: DataFrame, name: str) -> DataFrame:
    """``{values: [{x, y}]}`` with seconds in x."""
    d = _explode(df, "struct<values:array<struct<x:bigint,y:double>>>", "values")
    return d.select(*_rest(df), F.timestamp_seconds("_r.x").alias("ts"), F.col("_r.y").alias(name))


def hash_rate(df: DataFrame, series: Series = BARS) -> DataFrame:
    """SRC-10 with its moving features (WIN-20)."""
    d = xy_series(df, "hash_rate")
    return d.withColumns(hash_rate_features("hash_rate", series))


def difficulty(df: DataFrame, series: Series = BARS) -> DataFrame:
    """SRC-11."""
    return xy_series(df, "difficulty").withColumn("difficulty_change", change("difficulty", 1, series))


def network_stats(df: DataFrame) -> DataFrame:
    """SRC-12: defaults 0; satoshi to coins."""
    r = F.from_json("payload", "struct<hash_rate:double,difficulty:double,n_tx:bigint,total_fees_btc:double,miners_revenue_btc:double>")
    d = df.select(*_rest(df), r.alias("_r"))
    return d.select(
        *_rest(df),
        *[F.coalesce(F.col(f"_r.{c}"), F.lit(0.0)).alias(c) for c in ("hash_rate", "difficulty")],
        F.coalesce("_r.n_tx", F.lit(0)).cast("long").alias("n_tx"),
        *[(F.coalesce(F.col(f"_r.{c}"), F.lit(0.0)) / 1e8).alias(c) for c in ("total_fees_btc", "miners_revenue_btc")],
    )


def global_market(df: DataFrame) -> DataFrame:
    """SRC-13: map lookups, 0 when the key is missing."""
    r = F.from_json("payload", "struct<data:struct<market_cap_percentage:map<string,double>,total_market_cap:map<string,double>>>")["data"]
    return df.select(
        *_rest(df),
        F.coalesce(F.try_element_at(r["market_cap_percentage"], F.lit("btc")), F.lit(0.0)).alias("btc_dominance"),
        F.coalesce(F.try_element_at(r["total_market_cap"], F.lit("usd")), F.lit(0.0)).alias("total_market_cap_usd"),
    )


# The coins counted as stable.
STABLECOINS = ["tether", "usd-coin", "dai"]


def stablecoins(df: DataFrame, coins: list[str] = STABLECOINS) -> DataFrame:
    """SRC-14: cap of each listed coin and their total."""
    r = F.from_json("payload", "map<string,struct<usd_market_cap:double>>")
    caps = {c: F.coalesce(F.try_element_at(r, F.lit(c))["usd_market_cap"], F.lit(0.0)) for c in coins}
    total = reduce(lambda a, b: a + b, caps.values())
    return df.select(*_rest(df), *[v.alias(c.replace("-", "_")) for c, v in caps.items()], total.alias("stablecoin_total"))


def market_caps(df: DataFrame) -> DataFrame:
    """SRC-15: [[ms, value], ..]."""
    d = _explode(df, "struct<market_caps:array<array<double>>>", "market_caps")
    return d.select(*_rest(df), F.timestamp_millis(F.element_at("_r", 1).cast("bigint")).alias("ts"), F.element_at("_r", 2).alias("btc_mcap_usd"))


def macro(market: DataFrame, stable: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-16: both records side by side; a missing stablecoin part is 0."""
    joined = market.join(stable.select(*keys, "stablecoin_total"), keys, "left")
    return joined.withColumn("stablecoin_total", F.coalesce("stablecoin_total", F.lit(0.0)))


def search_interest(df: DataFrame, keyword: str, series: Series = BARS) -> DataFrame:
    """SRC-17: ``date`` and keyword column renamed, ``isPartial`` dropped, WIN-21 added."""
    d = df.withColumnsRenamed({"date": "ts", keyword: "interest"}).drop("isPartial")
    return d.withColumns(interest_features("interest", series))


def forum_listing(df: DataFrame) -> DataFrame:
    """SRC-18: ``data.children[].data``."""
    item = "struct<title:string,score:bigint,num_comments:bigint,created_utc:double,subreddit:string>"
    doc = F.from_json("payload", f"struct<data:struct<children:array<struct<data:{item}>>>>")
    d = df.select(*_rest(df), F.explode(doc["data"]["children"]).alias("_r"))
    r = "_r.data"
    return d.select(
        *_rest(df),
        F.col(f"{r}.title").alias("text"),
        F.coalesce(f"{r}.score", F.lit(0)).cast("long").alias("score"),
        F.coalesce(f"{r}.num_comments", F.lit(0)).cast("long").alias("num_comments"),
        F.timestamp_seconds(F.col(f"{r}.created_utc").cast("bigint")).alias("ts"),
        F.col(f"{r}.subreddit").alias("subreddit"),
        F.lit("reddit").alias("source"),
    )


def news_results(df: DataFrame) -> DataFrame:
    """SRC-19: the results of each response; ``pos`` is the place in it."""
    r = F.from_json(
        "payload",
        "struct<results:array<struct<title:string,source:struct<title:string>,published_at:string,votes:map<string,bigint>,url:string>>>",
    )["results"]
    d = df.select(*_rest(df), F.posexplode(r).alias("pos", "_r"))
    return d.select(
        *_rest(df),
        "pos",
        F.col("_r.title").alias("text"),
        F.col("_r.source.title").alias("source"),
        F.try_to_timestamp("_r.published_at").alias("ts"),
        F.col("_r.votes").alias("votes"),
        F.col("_r.url").alias("url"),
    )


# One RSS item with its title and date, across lines.
RSS_ITEM = r"(?s)<item>.*?<title>(.*?)</title>.*?<pubDate>(.*?)</pubDate>.*?</item>"


def rss_items(df: DataFrame, user: str = "username", influencers: list[str] = ()) -> DataFrame:
    """SRC-20: (title, pubDate) of the items of each raw document; ``pos`` is the place in it."""
    from barline.functions.text import strip_markup

    titles = F.regexp_extract_all("payload", F.lit(RSS_ITEM), F.lit(1))
    dates = F.regexp_extract_all("payload", F.lit(RSS_ITEM), F.lit(2))
    d = df.select(*_rest(df), F.posexplode(F.arrays_zip(titles.alias("title"), dates.alias("date"))).alias("pos", "_r"))
    return d.select(
        *_rest(df),
        "pos",
        strip_markup(F.col("_r.title")).alias("text"),
        F.col("_r.date").alias("published"),
        F.lit("twitter").alias("source"),
        F.col(user).isin(*influencers).alias("is_influencer") if influencers else F.lit(False).alias("is_influencer"),
    )


# Defaults of the social metrics.
SOCIAL_DEFAULTS = {
    "galaxy_score": 50.0,
    "alt_rank": 100.0,
    "social_volume": 0.0,
    "social_engagement": 0.0,
    "social_contributors": 0.0,
    "social_dominance": 0.0,
    "average_sentiment": 3.0,
    "bullish_sentiment": 0.0,
    "bearish_sentiment": 0.0,
    "price": 0.0,
    "market_cap": 0.0,
}


def social_metrics(df: DataFrame) -> DataFrame:
    """SRC-21: eleven fields with defaults."""
    schema = "struct<data:array<struct<" + ",".join(f"{c}:double" for c in SOCIAL_DEFAULTS) + ">>>"
    r = F.get(F.from_json("payload", schema)["data"], F.lit(0))
    return df.select(*_rest(df), *[F.coalesce(r[c], F.lit(v)).alias(c) for c, v in SOCIAL_DEFAULTS.items()])


def unified_news(posts: DataFrame, news: DataFrame, as_of: Column, hours: float) -> DataFrame:
    """SRC-22: recent posts and all news; engagement is score + comments, 0 for news."""
    recent = posts.filter(F.col("ts") >= as_of - F.expr(f"interval {int(hours * 3600)} seconds"))
    a = recent.select("text", "source", "ts", (F.col("score") + F.col("num_comments")).alias("engagement"))
    return a.unionByName(news.select("text", "source", "ts", F.lit(0).cast("long").alias("engagement")))


def unified_text(**parts: DataFrame) -> DataFrame:
    """SRC-23: every part tagged with its type; absent columns are null."""
    tagged = [df.withColumn("type", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def preferred(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """SRC-25: the row of the first source that has the key; later sources fill the keys it lacks.

    The choice is made per key, not by counting rows, so that two runs on a growing folder agree on the keys both
    saw. A source is expected to hold a key once. An aggregate with map-side combine, no window.
    """
    tagged = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    return keep_first(reduce(lambda a, b: a.unionByName(b), tagged), keys, F.col("_source")).drop("_source")


def scaler_table(df: DataFrame) -> DataFrame:
    """SRC-26: ``{mean: {col: x}, std: {col: x}}`` as (column, mean, std)."""
    r = F.from_json("payload", "struct<mean:map<string,double>,std:map<string,double>>")
    d = df.select(r.alias("_r")).select(F.explode("_r.mean").alias("column", "mean"), "_r.std")
    return d.select("column", "mean", F.try_element_at("std", F.col("column")).alias("std"))


def feature_snapshot(feeds: dict[str, tuple[DataFrame, str, float]], ts: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """SRC-24: the last value of every feature, one row (or one per key), defaults for silent feeds."""
    return latest_record(feeds, ts, keys)


def latest_snapshots(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    return latest(df, ts, keys)
