import random

import duckdb
import pytest
from pyspark.sql import functions as F

from barline.llm import mixing


def rows(spark, seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + ["a", "b", "é", None, "tiny"]) if i else "none"
        text = rng.choice([None, "", " "]) if source == "none" or rng.random() < 0.1 else "\t".join(["w"] * rng.randrange(1, 3 if source == "tiny" else 300))
        out.append((i if rng.random() < 0.95 else None, text, source, i, "x"))
    return spark.createDataFrame(out, "doc_id long, text string, source string, size int, _b string")


@pytest.mark.parametrize("seed,n,block", [(1, 300, 16), (2, 60, 4096), (3, 1, 16), (4, 0, 16)])
def test_mix(spark, monkeypatch, seed, n, block):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
    docs = rows(spark, seed, n)
    mix = mixing.mixed(docs, shards=4).collect()
    assert len(mix) == n
    con = duckdb.connect()
    con.register("docs", docs.toPandas().astype({"doc_id": "Int64"}))
    got = sorted(((r.doc_id, r._mix["size"], r._mix.source_size, r._mix.target, sum(d.words for d in r._mix.draws)) for r in mix), key=repr)
    want = sorted(con.execute(mixing.TAKEN_SQL.format(docs="docs")).fetchall(), key=repr)
    assert got == want
    by, shards = {}, {}
    for r in mix:
        taken = sum(d.words for d in r._mix.draws)
        assert taken <= 3 * r._mix["size"] and all(0 <= d.shard < 4 for d in r._mix.draws)
        by.setdefault((r.source, r._mix.target), []).append(taken)
        for d in r._mix.draws:
            shards[d.shard] = shards.get(d.shard, 0) + d.words
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.5
    if n == 300:
        assert len(shards) == 4


def test_written_copies(spark):
    docs = rows(spark, 5, 120)
    mix = mixing.mixed(docs)
    want = sum(d.words for r in mix.collect() for d in r._mix.draws)
    out = mixing.written(mix, docs.columns)
    got = out.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert got == want and out.columns[:5] == docs.columns


def test_documents_stay_where_they_are(spark):
    """Only the documents of the blocks in which a quota ends are exchanged."""
    docs = rows(spark, 6, 300)
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_repeated_rows_share_the_quota(spark, monkeypatch):
    """Equal rows are taken one by one where a quota ends among them."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    docs = spark.createDataFrame([(i % 3, "w " * 7, s) for i in range(90) for s in ("a", "b", None)], "doc_id long, text string, source string")
    mix = mixing.mixed(docs).collect()
    got = {s: sum(d.words for r in mix if r.source == s for d in r._mix.draws) for s in ("a", "b", None)}
    assert len(mix) == 270 and got == {"a": 315, "b": 630, None: 945}


def test_hypergeometric(spark):
    df = spark.range(4000).select(((F.col("id") * 1597 % 4000 + 0.5) / 4000).alias("u"))
    df = df.select(mixing.hypergeometric(F.lit(60), F.lit(25), F.lit(20), F.col("u")).alias("x"))
    x = [r.x for r in df.collect()]
    mean, var = sum(x) / len(x), sum(v * v for v in x) / len(x) - (sum(x) / len(x)) ** 2
    assert abs(mean - 20 * 25 / 60) < 0.15 and abs(var - 20 * 25 / 60 * 35 / 60 * 40 / 59) < 0.25
    edge = spark.range(1).select(mixing.hypergeometric(F.lit(5), F.lit(5), F.lit(3), F.lit(0.99)), mixing.hypergeometric(F.lit(0), F.lit(0), F.lit(0), F.lit(0.5)))
    assert tuple(edge.first()) == (3, 0)


def test_pipeline_writes_shards_in_order(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(i, f"w{i} " * (i % 7 + 1), "en", "ab"[i % 2], 0) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    made = mixing.written(mixing.mixed(docs), cp.COLUMNS).collect()
    shards = {}
    for r in sorted(made, key=lambda r: (r._shard, r._order, r.doc_id)):
        shards.setdefault(r._shard, []).append((r.doc_id, r.text))
    parts = cp.mix_sources(spark, docs, "").rdd.map(lambda r: (r.doc_id, r.text)).glom().collect()
    assert [row for p in parts for row in p] == [row for rows in shards.values() for row in rows] and len(shards) > 1
    words = {}
    for r in mixing.mixed(docs).collect():
        for d in r._mix.draws:
            words[d.shard] = words.get(d.shard, 0) + d.words
    assert words == {k: sum(len(t.split()) for _, t in rows) for k, rows in shards.items()}


def test_a_column_of_the_results_name_is_replaced(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 7)], "doc_id long, text string, source string, _mix int")
    row = mixing.mixed(df).first()
    assert row._mix.size == 3 and row.text == "a b c"
