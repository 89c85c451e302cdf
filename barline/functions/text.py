"""Text rules as columns: spam, credibility, relevance, hashes, keyword sentiment (TXT, PRJ-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


# Whitespace as Unicode defines it.
SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"
WORD = r"[^\s\x0B\x1c-\x1f\x85\p{Z}]+"

# Default keyword lists.
SPAM_KEYWORDS = [
    "free money", "guaranteed profit", "100x", "1000x",
    "send btc", "dm for signals", "join telegram",
    "pump group", "insider info", "free giveaway",
]
TRUSTED_SOURCES = [
    "coindesk", "cointelegraph", "decrypt", "theblock",
    "bitcoin", "cryptocurrency", "cryptomarkets",
    "reuters", "bloomberg", "cnbc",
]
LOW_CREDIBILITY = ["moonshot", "gem", "100x", "pump"]
RELEVANCE_KEYWORDS = [
    "bitcoin", "btc", "crypto", "cryptocurrency",
    "ethereum", "eth", "blockchain", "defi",
    "altcoin", "trading", "market", "price",
    "bull", "bear", "whale", "hodl",
]
BULLISH = [
    "bullish", "surge", "rally", "breakout", "all-time high", "ath",
    "moon", "pump", "adoption", "institutional", "buy", "accumulation",
    "etf approved", "halving", "bull run", "recovery",
]
BEARISH = [
    "bearish", "crash", "dump", "plunge", "sell-off", "correction",
    "fear", "panic", "ban", "regulation", "hack", "scam", "fraud",
    "sec lawsuit", "bubble", "collapse", "bankruptcy",
]
SHORT_BULLISH = ["bullish", "moon", "pump", "buy", "rally", "ath"]
SHORT_BEARISH = ["bearish", "crash", "dump", "sell", "drop", "rekt"]


def found(text: Column, words: list[str]) -> Column:
    """The listed words that occur in the lower-cased text, which is lowered once."""
    listed = F.array(*[F.lit(w) for w in words])
    return F.transform(
        F.array(F.lower(text)), lambda low: F.filter(listed, lambda w: F.contains(low, w))
    )[0]


def spam_reasons(text: Column, keywords: list[str]) -> Column:
    """TXT-01: names of the rules a text breaks."""
    n = F.length(text)
    caps = F.regexp_count(text, F.lit(r"\p{Lu}"))
    return F.array_compact(
        F.array(
            F.when(n < 10, F.lit("too_short")),
            F.when(n > 5000, F.lit("too_long")),
            F.when(F.size(found(text, keywords)) > 0, F.lit("spam_keywords")),
            F.when((n > 20) & (F.try_divide(caps, n) > 0.5), F.lit("excessive_caps")),
            F.when(n - F.length(F.replace(text, F.lit("!"), F.lit(""))) > 5, F.lit("excessive_exclamation")),
            F.when(text.rlike(r"([^\n])\1{4,}"), F.lit("repeated_chars")),
        )
    )


def _any(text: Column, words: list[str]) -> Column:
    return F.size(found(text, words)) > 0


def credibility(source: Column, trusted: list[str], low: list[str]) -> Column:
    """TXT-02: trusted wins over low credibility."""
    return F.when(_any(source, trusted), 1.0).when(_any(source, low), 0.2).otherwise(0.6)


def relevance(text: Column, keywords: list[str]) -> Column:
    """TXT-03: distinct keywords against a tenth of the words."""
    words = F.regexp_count(text, F.lit(WORD))
    hits = F.size(found(text, keywords))
    return F.least(F.lit(1.0), hits / F.greatest(words * F.lit(0.1), F.lit(1.0)))


def text_hash(text: Column) -> Column:
    """TXT-04: md5 of the lower-cased text with single spaces."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), SPACE, " ")))


def flag_duplicates(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """TXT-04: ``is_duplicate`` for every copy but the one with the smallest key.

    First keys come from an aggregate and go back by key, not by hash: a text
    with a third of all copies never gathers in one task.
    """
    firsts = df.groupBy(text_hash(F.col(text)).alias("_h")).agg(F.min(key).alias(key))
    firsts = firsts.select(key, F.lit(False).alias("_first"))
    return (
        df.join(firsts, key, "left")
        .withColumn("is_duplicate", F.col("_first").isNull())
        .drop("_first")
    )


def unique_texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """TXT-05: the first row of every text."""
    firsts = df.groupBy(text_hash(F.col(text)).alias("_h")).agg(F.min(key).alias(key))
    return df.join(firsts.select(key), key, "left_semi")


def score_texts(
    df: DataFrame, key: str, spam: list[str], trusted: list[str], low: list[str], keywords: list[str]
) -> DataFrame:
    """TXT-06: component scores, the weighted sum and pass / fail at 0.6."""
    # Text columns are reduced to scores before the join, so it does not move whole texts.
    d = df.withColumns(
        {
            "is_spam": F.size(spam_reasons(F.col("text"), spam)) > 0,
            "credibility": credibility(F.col("source"), trusted, low),
            "relevance": relevance(F.col("text"), keywords),
        }
    )
    d = flag_duplicates(d, key)
    overall = (
        0.3 * (~F.col("is_spam")).cast("int")
        + 0.25 * F.col("credibility")
        + 0.25 * F.col("relevance")
        + 0.2 * (~F.col("is_duplicate")).cast("int")
    )
    return d.withColumn("overall", overall).withColumn("passed", F.col("overall") >= 0.6)


def filter_report(scored: DataFrame) -> DataFrame:
    """TXT-07: counts over scored texts; the kept rows are ``scored.filter('passed')``."""
    return scored.agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("kept"),
        F.count_if("is_spam").alias("spam"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(F.col("relevance") < 0.3).alias("low_relevance"),
        F.avg((~F.col("passed")).cast("int")).alias("filter_rate"),
        F.avg("overall").alias("mean_quality"),
    )


def keyword_sentiment(text: Column, bullish: list[str], bearish: list[str], high: float = 0.7, low: float = 0.3) -> dict[str, Column]:
    """TXT-08 / TXT-09: share of bullish hits, 0.5 without hits, and its class."""
    up, down = F.size(found(text, bullish)), F.size(found(text, bearish))
    score = F.coalesce(F.try_divide(up, up + down), F.lit(0.5))
    return {
        "score": score,
        "bullish_hits": up,
        "bearish_hits": down,
        "sentiment": F.when(score >= high, "bullish").when(score <= low, "bearish").otherwise("neutral"),
    }


def sentiment_class(score: Column) -> Column:
    """TXT-10."""
    return F.when(score >= 0.65, "bullish").when(score <= 0.35, "bearish").otherwise("neutral")


def social_features(galaxy: Column, volume: Column, engagement: Column, relative: Column) -> dict[str, Column]:
    """TXT-11."""
    return {
        "galaxy": galaxy / 100,
        "volume": F.least(F.lit(1.0), volume / 100_000),
        "engagement": F.least(F.lit(1.0), engagement / 500_000),
        "relative": relative / 100,
    }


def strip_markup(html: Column) -> Column:
    """PRJ-16: without tags, named entities and repeated whitespace."""
    bare = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), "&[a-z]+;", "")
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def source_sentiment(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-11: roll-up of text scores."""
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean_score"),
        F.count_if(F.col("score") > 0.6).alias("bullish"),
        F.count_if(F.col("score") < 0.4).alias("bearish"),
        F.count_if(F.col("score").between(0.4, 0.6)).alias("neutral"),
    )
    s = F.col("mean_score")
    return out.withColumn("sentiment", F.when(s >= 0.7, "bullish").when(s <= 0.3, "bearish").otherwise("neutral"))


def weighted_sentiment(df: DataFrame, keys: list[str], influencer_weight: float = 2.0) -> DataFrame:
    """AGG-12: sum(score * weight) / sum(weight), influencers heavier; 0.5 without texts."""
    weight = F.when(F.col("is_influencer"), influencer_weight).otherwise(1.0)
    return df.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.col("score") * weight), F.sum(weight)), F.lit(0.5)).alias("tweet_sentiment"),
        F.count_if("is_influencer").alias("influencers"),
    )


def final_sentiment(average: Column, galaxy: Column, tweets: Column) -> Column:
    return 0.4 * (average - 1) / 4 + 0.3 * galaxy / 100 + 0.3 * tweets


def label_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-13 over per-text class probabilities (pos, neg, neu)."""
    confidence = F.greatest("pos", "neg", "neu")
    label = F.when(F.col("pos") == confidence, "positive").when(F.col("neg") == confidence, "negative").otherwise("neutral")
    out = df.withColumn("_l", label).groupBy(*keys).agg(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.sum("pos") - F.sum("neg")) / F.count("*"))).alias("signal"),
        F.avg(confidence).alias("mean_confidence"),
        *[F.count_if(F.col("_l") == v).alias(f"n_{v}") for v in ("positive", "negative", "neutral")],
    )
    pos, neg = F.col("n_positive"), F.col("n_negative")
    return out.withColumn("dominant", F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral"))


