"""Text rules, record rules, files and feeds."""

import pytest
from pyspark.sql import functions as F

from barline.functions import projection as pj, text as tx
from barline.operators import sets
from barline.sources import bars as files, feeds


def test_spam_rules(spark):
    texts = ["short", "a" * 6000, "FREE MONEY for everyone today", "THIS IS ALL CAPS TEXT HERE", "wow!!!!!! what a day it is", "a plain sentence about things", "sooooo long but fine text", "line\n\n\n\n\n\nbreaks are no letters"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r.x for r in d.select("id", tx.spam_reasons(F.col("text"), tx.SPAM_KEYWORDS).alias("x")).orderBy("id").collect()]
    assert got == [["too_short"], ["too_long", "repeated_chars"], ["spam_keywords"], ["excessive_caps"], ["excessive_exclamation", "repeated_chars"], [], ["repeated_chars"], []]


def test_scores_and_duplicates(spark):
    rows = [(1, "Bitcoin  price UP today", "Reuters"), (2, " bitcoin price up today\n", "blog"), (3, "a quiet walk home", "gem hunters")]
    d = spark.createDataFrame(rows, "id int, text string, source string")
    s = {r.id: r for r in tx.score_texts(d, "id", tx.SPAM_KEYWORDS, tx.TRUSTED_SOURCES, tx.LOW_CREDIBILITY, tx.RELEVANCE_KEYWORDS).collect()}
    assert [s[i].is_duplicate for i in (1, 2, 3)] == [False, True, False]
    assert (s[1].credibility, s[2].credibility, s[3].credibility) == (1.0, 0.6, 0.2)
    assert s[1].passed and s[1].relevance == 1.0 and s[3].relevance == 0.0
    assert [r.id for r in tx.unique_texts(d, "id").orderBy("id").collect()] == [1, 3]


def test_one_text_may_dominate(spark):
    d = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id"))).otherwise("same text").alias("text"))
    flagged = tx.flag_duplicates(d, "id")
    assert flagged.count() == 3000 and flagged.filter("is_duplicate").count() == 999


def test_keyword_sentiment(spark):
    d = spark.createDataFrame([("a rally and a surge",), ("panic and crash",), ("nothing",)], "text string")
    got = [(r.score, r.sentiment) for r in d.select(*[c.alias(k) for k, c in tx.keyword_sentiment(F.col("text"), tx.BULLISH, tx.BEARISH).items()]).collect()]
    assert got == [(1.0, "bullish"), (0.0, "bearish"), (0.5, "neutral")]


def test_times_and_numbers(spark):
    d = spark.createDataFrame([("1704067200",), ("1704067200000",), ("2024-01-01 00:00:00",), ("later",)], "t string")
    assert [r.x for r in d.select(F.unix_seconds(pj.parse_time(F.col("t"))).alias("x")).collect()] == [1704067200] * 3 + [None]
    n = spark.createDataFrame([(1234.5,), (-0.012345,), (0.0,)], "x double")
    assert [r.y for r in n.select(pj.round_significant(F.col("x"), 3).alias("y")).collect()] == pytest.approx([1230.0, -0.0123, 0.0])
    with pytest.raises(ValueError):
        pj.require_columns(n, ["x", "close"])


def test_record_rules(spark):
    rows = [("BTCUSDT", 100.0, 1), ("bt", 0.001, 0), ("BTC USD", 2e6, 5)]
    d = spark.createDataFrame(rows, "symbol string, close double, timestamp long")
    good, bad = pj.split_valid(d, pj.market_violations())
    assert good.count() == 1
    assert [r.violations for r in bad.orderBy("close").collect()] == [["symbol_length", "symbol_case", "close_range", "timestamp"], ["symbol_space", "close_range"]]


def test_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DateTime, Open ,High,Low,Price,Vol\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n2024-01-01 00:00:00,9,9,9,9,9\n1704070800000,1,x,1,1,1\n1704074400,2,3,1,2,5\n")
    got = files.read_csv_bars(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(1.0, 1.5, 10.0), (2.0, 2.0, 5.0)]


def test_cache_age(spark, tmp_path, bars):
    path = str(tmp_path / "b")
    bars.write.parquet(path)
    now = F.current_timestamp()
    assert files.read_parquet_bars(spark, path, now).count() == bars.count()
    assert files.read_parquet_bars(spark, path, now + F.expr("interval 2 days")).count() == 0


def test_landed_documents(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"data": [{"fundingTime": "1704067200000", "fundingRate": "0.0001"},\n {"fundingTime": "1704096000000", "fundingRate": "bad"}]}')
    (tmp_path / "2.json").write_text('[{"fundingTime": "1704124800000", "fundingRate": "-0.0002"}]')
    (tmp_path / "3.json").write_text("not json")
    got = feeds.funding(feeds.read_documents(spark, str(tmp_path))).orderBy("ts").collect()
    assert [r.funding_rate for r in got] == [0.0001, None, -0.0002]


def test_source_choice(spark):
    first = spark.createDataFrame([("a", 1, 10.0), ("b", 1, None)], "symbol string, ts int, close double")
    second = spark.createDataFrame([("a", 1, 20.0), ("a", 2, 21.0), ("b", 1, 22.0)], "symbol string, ts int, close double")
    got = feeds.preferred([first, second], ["symbol", "ts"]).orderBy("symbol", "ts").collect()
    assert [tuple(r) for r in got] == [("a", 1, 10.0), ("a", 2, 21.0), ("b", 1, None)]
    assert feeds.preferred([first.limit(0), second], ["symbol", "ts"]).count() == 3


def test_ranks_share_places(spark):
    d = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, None), (5, 1)], "k int, score int")
    got = {r.k: r["rank"] for r in sets.ranked(d, "score", "k").collect()}
    assert got == {2: 1, 1: 2, 3: 2, 5: 4, 4: 5}


def test_hash_reads_all_spaces_alike(spark):
    d = spark.createDataFrame([("a\u3000\t b \n",), (" A b",), ("a\xa0b",), ("ab",), (None,)], "t string")
    got = [r[0] for r in d.select(tx.text_hash(F.col("t"))).collect()]
    assert got[0] == got[1] == got[2] != got[3] and got[4] is None


def test_narrowing(spark):
    d = spark.createDataFrame([(1.0, 5.0, 300000), (2.0, 5.5, 1)], "a double, b double, c long")
    assert dict(pj.narrow_types(d, ["b"], ["a", "c"]).dtypes) == {"a": "tinyint", "b": "float", "c": "int"}
    assert dict(pj.narrow_types(d, [], ["b"]).dtypes)["b"] == "double"


def test_sinks_round_trip(spark, tmp_path, bars):
    files.write_parquet(bars, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("date = '2024-01-01'").count() == bars.filter("to_date(ts) = '2024-01-01'").count()
