import zlib

from barline.llm import toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    hit = sum(r.predicted and r.toxic for r in out)
    # A tenth of the toxic labels sits on junk without a toxic word.
    assert hit / sum(r.predicted for r in out) > 0.97 and hit / sum(r.toxic for r in out) > 0.7


def test_odd_rows(spark):
    docs = [(i, "you are a foul thing" if i % 2 else "a good thing it is", "x", 1) for i in range(60)] + [(None, None, "x", 1), (70, "", "x", 1), (70, "", "x", 1), (71, "foul " * 20_000, "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (500, 1), (4, 0)], "doc_id long, toxic int")
    rows = toxicity.scored(df, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert next(r.predicted for r in rows if r.doc_id == 71) == 1
    assert {r.score for r in toxicity.scored(df, labels.limit(0)).collect()} == {0.5}
    assert toxicity.scored(df.limit(0), labels).collect() == []


def test_fit_is_not_cut():
    # Bounded, so that its cost does not grow with the corpus; a cheaper figure is no reason to learn from less.
    assert toxicity.SAMPLE_ROWS >= 12_000 and toxicity.EPOCHS >= 8
