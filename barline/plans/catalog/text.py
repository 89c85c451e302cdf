"""TXT and the text roll-ups AGG-11..13, over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import text as tx
from barline.plans.catalog import query
from barline.plans.catalog.projection import SPACES
from barline.sources.tables import Tables

# Words that occur in the documents stand in for the domain lists.
SPAM = ["free money", "guaranteed profit", "click here", "buy now", "api_key"]
TRUSTED, LOW = ["src1", "src7"], ["src3", "src17"]
WORDS = ["the", "that", "sch", "eau", "ich", "tion", "hou", "market"]
UP, DOWN = ["the", "her", "eau", "tion"], ["sch", "ich", "ung", "ment"]


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _hits(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({col}), '{w}')::INT" for w in words) + ")"


FLAT = rf"regexp_replace(regexp_replace(text, '{SPACES}', ' ', 'g'), '^ | $', '', 'g')"
HASH = rf"md5(regexp_replace(regexp_replace(lower(text), '{SPACES}', ' ', 'g'), '^ | $', '', 'g'))"
REASONS = rf"""array_to_string(list_filter([CASE WHEN length(text) < 10 THEN 'too_short' END, CASE WHEN length(text) > 5000 THEN 'too_long' END,
  CASE WHEN {_hits('text', SPAM)} > 0 THEN 'spam_keywords' END, CASE WHEN length(text) > 20 AND len(regexp_extract_all(text, '\p{{Lu}}')) / length(text) > 0.5 THEN 'excessive_caps' END,
  CASE WHEN length(text) - length(replace(text, '!', '')) > 5 THEN 'excessive_exclamation' END,
  CASE WHEN len(list_filter(range(1, len(c) - 3), lambda i: c[i] <> chr(10) AND c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] = c[i + 4])) > 0 THEN 'repeated_chars' END], lambda x: x IS NOT NULL), ',')"""
CREDIBILITY = f"CASE WHEN {_hits('source', TRUSTED)} > 0 THEN 1.0 WHEN {_hits('source', LOW)} > 0 THEN 0.2 ELSE 0.6 END"
NWORDS = f"CASE WHEN {FLAT} = '' THEN 0 ELSE len(string_split({FLAT}, ' ')) END"
RELEVANCE = f"CASE WHEN {NWORDS} = 0 THEN 0 ELSE least(1, {_hits('text', WORDS)} / greatest(({NWORDS}) * 0.1::DOUBLE, 1)) END"
SCORED = f"""base AS (SELECT doc_id, source, {REASONS} AS reasons, {CREDIBILITY} AS credibility, {RELEVANCE} AS relevance, {HASH} AS h FROM (SELECT *, string_split(text, '') AS c FROM documents)),
  f AS (SELECT *, doc_id <> min(doc_id) OVER (PARTITION BY h) AS is_duplicate FROM base),
  scored AS (SELECT *, reasons <> '' AS is_spam, 0.3 * (reasons = '')::INT + 0.25 * credibility + 0.25 * relevance + 0.2 * (NOT is_duplicate)::INT AS overall FROM f)"""


def _scored(t: Tables) -> DataFrame:
    return tx.score_texts(t.documents.select("doc_id", "text", "source"), "doc_id", SPAM, TRUSTED, LOW, WORDS)


@query("txt01_spam_rules", f"WITH {SCORED} SELECT doc_id, reasons FROM scored")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat_ws(",", tx.spam_reasons(F.col("text"), SPAM)).alias("reasons"))


@query("txt02_credibility", f"SELECT doc_id, {CREDIBILITY} AS credibility FROM documents", "doc_id", "credibility")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.credibility(F.col("source"), TRUSTED, LOW).alias("credibility"))


@query("txt03_relevance", f"SELECT doc_id, {RELEVANCE} AS relevance FROM documents", "doc_id", "relevance")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.relevance(F.col("text"), WORDS).alias("relevance"))


@query("txt04_duplicate_flag", f"SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY {HASH}) AS is_duplicate FROM documents")
def _(t: Tables) -> DataFrame:
    return tx.flag_duplicates(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "is_duplicate")


@query("txt05_unique_texts", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {HASH}")
def _(t: Tables) -> DataFrame:
    return tx.unique_texts(t.documents.select("doc_id", "text"), "doc_id").select("doc_id")


@query("txt06_text_score", f"WITH {SCORED} SELECT *, overall >= 0.6 AS passed FROM scored", "doc_id, is_spam, is_duplicate, passed", "overall")
def _(t: Tables) -> DataFrame:
    return _scored(t)


@query("txt07_filter_report",
       f"""WITH {SCORED}, s AS (SELECT *, overall >= 0.6 AS passed FROM scored) SELECT count(*) AS total, count(*) FILTER (passed) AS kept, count(*) FILTER (is_spam) AS spam, count(*) FILTER (is_duplicate) AS duplicates,
       count(*) FILTER (relevance < 0.3) AS low_relevance, avg((NOT passed)::INT) AS filter_rate, avg(overall) AS mean_quality FROM s""",
       "total, kept, spam, duplicates, low_relevance", "filter_rate, mean_quality")
def _(t: Tables) -> DataFrame:
    return tx.filter_report(_scored(t))


def _sentiment_sql(high: float, low: float, alias: str = "documents", key: str = "doc_id") -> str:
    u, d = _hits("text", UP), _hits("text", DOWN)
    return f"""SELECT *, CASE WHEN score >= {high} THEN 'bullish' WHEN score <= {low} THEN 'bearish' ELSE 'neutral' END AS sentiment
      FROM (SELECT *, {u} AS bullish_hits, {d} AS bearish_hits, coalesce({u} / nullif({u} + {d}, 0), 0.5) AS score FROM {alias})"""


@query("txt08_keyword_sentiment", _sentiment_sql(0.7, 0.3), "doc_id, bullish_hits, bearish_hits, sentiment", "score")
def _(t: Tables) -> DataFrame:
    return t.documents.withColumns(tx.keyword_sentiment(F.col("text"), UP, DOWN))


def _turns(t: Tables) -> DataFrame:
    """Conversation turns as short posts; assistants stand in for influencers."""
    return t.conversations.withColumns(tx.keyword_sentiment(F.col("text"), UP, DOWN, 0.65, 0.35)).withColumn(
        "is_influencer", F.col("role") == "assistant")


@query("txt09_short_sentiment",
       f"""SELECT conv_id, sum(score * CASE WHEN role = 'assistant' THEN 2 ELSE 1 END) / sum(CASE WHEN role = 'assistant' THEN 2 ELSE 1 END) AS tweet_sentiment, count(*) FILTER (role = 'assistant') AS influencers
       FROM ({_sentiment_sql(0.65, 0.35, 'conversations')}) GROUP BY 1""", "conv_id, influencers", "tweet_sentiment")
def _(t: Tables) -> DataFrame:
    return tx.weighted_sentiment(_turns(t), ["conv_id"])


@query("txt10_sentiment_class", f"SELECT conv_id, turn, sentiment FROM ({_sentiment_sql(0.65, 0.35, 'conversations')})")
def _(t: Tables) -> DataFrame:
    return _turns(t).select("conv_id", "turn", tx.sentiment_class(F.col("score")).alias("sentiment"))


@query("txt11_social_features",
       "SELECT event_id, value / 100 AS galaxy, least(1, value * 2000 / 100000) AS volume, least(1, value * 9000 / 500000) AS engagement, user_id / 100 AS relative FROM events",
       "event_id", "galaxy, volume, engagement, relative")
def _(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", *[c.alias(k) for k, c in tx.social_features(v, v * 2000, v * 9000, F.col("user_id")).items()])


@query("agg11_source_sentiment",
       f"""WITH s AS ({_sentiment_sql(0.7, 0.3)}) SELECT source, count(*) AS n, avg(score) AS mean_score, count(*) FILTER (score > 0.6) AS bullish, count(*) FILTER (score < 0.4) AS bearish,
       count(*) FILTER (score BETWEEN 0.4 AND 0.6) AS neutral, CASE WHEN avg(score) >= 0.7 THEN 'bullish' WHEN avg(score) <= 0.3 THEN 'bearish' ELSE 'neutral' END AS sentiment FROM s GROUP BY 1""",
       "source, n, bullish, bearish, neutral, sentiment", "mean_score")
def _(t: Tables) -> DataFrame:
    return tx.source_sentiment(t.documents.withColumns(tx.keyword_sentiment(F.col("text"), UP, DOWN)), ["source"])


@query("agg12_final_sentiment",
       f"""WITH w AS (SELECT conv_id, sum(score * CASE WHEN role = 'assistant' THEN 2 ELSE 1 END) / sum(CASE WHEN role = 'assistant' THEN 2 ELSE 1 END) AS tw FROM ({_sentiment_sql(0.65, 0.35, 'conversations')}) GROUP BY 1),
       f AS (SELECT conv_id, 0.4 * (1 + conv_id % 5 - 1) / 4 + 0.3 * (conv_id % 100) / 100 + 0.3 * tw AS final FROM w)
       SELECT conv_id, final, CASE WHEN final >= 0.65 THEN 'bullish' WHEN final <= 0.35 THEN 'bearish' ELSE 'neutral' END AS sentiment FROM f""",
       "conv_id, sentiment", "final")
def _(t: Tables) -> DataFrame:
    c = F.col("conv_id")
    final = tx.final_sentiment((1 + c % 5).cast("double"), (c % 100).cast("double"), F.col("tweet_sentiment"))
    return tx.weighted_sentiment(_turns(t), ["conv_id"]).withColumn("final", final).withColumn("sentiment", tx.sentiment_class(F.col("final")))


PROBS = {"pos": "CAST(n_chars % 7 AS DOUBLE)", "neg": "CAST(n_chars % 5 AS DOUBLE)", "neu": "CAST(n_chars % 3 AS DOUBLE)"}
TOTAL = "(" + " + ".join(PROBS.values()) + " + 1)"


@query("agg13_label_rollup",
       f"""WITH p AS (SELECT lang, {', '.join(f'{e} / {TOTAL} AS {k}' for k, e in PROBS.items())} FROM documents), c AS (SELECT *, greatest(pos, neg, neu) AS conf, CASE WHEN pos = greatest(pos, neg, neu) THEN 'p' WHEN neg = greatest(pos, neg, neu) THEN 'n' ELSE 'u' END AS l FROM p),
       g AS (SELECT lang, greatest(-1, least(1, (sum(pos) - sum(neg)) / count(*))) AS signal, avg(conf) AS mean_confidence, count(*) FILTER (l = 'p') AS n_positive, count(*) FILTER (l = 'n') AS n_negative, count(*) FILTER (l = 'u') AS n_neutral FROM c GROUP BY 1)
       SELECT *, CASE WHEN n_positive > n_negative THEN 'positive' WHEN n_negative > n_positive THEN 'negative' ELSE 'neutral' END AS dominant FROM g""",
       "lang, n_positive, n_negative, n_neutral, dominant", "signal, mean_confidence")
def _(t: Tables) -> DataFrame:
    return tx.label_rollup(t.documents.select("lang", *[F.expr(f"{e} / {TOTAL}").alias(k) for k, e in PROBS.items()]), ["lang"])
