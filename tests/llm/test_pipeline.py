import hashlib
from collections import Counter

import duckdb
import public_tokenizers
from test_quality import brute as quality_brute
from test_simhash import plain_groups, plain_print
from test_suffixes import brute as suffix_brute
from tokenizers import Tokenizer

import corpus_pipeline as cp
from barline.llm import mixing, quality

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.quality == 1}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {v[0] for v in quality_brute(rows, labels, quality.THRESHOLD) if v[-2]}
    one = cp.STAGES[0][1](spark, docs, FOLDER).cache()
    assert {r.doc_id for r in one.collect()} == kept and one.columns == cp.COLUMNS

    rows = [r for r in rows if r[0] in kept]
    groups = plain_groups({i: plain_print(t) for i, t in rows})
    two = cp.STAGES[1][1](spark, one, FOLDER).cache()
    assert {r.doc_id for r in two.collect()} == set(groups.values()) and two.columns == cp.COLUMNS

    rows = [r for r in rows if groups[r[0]] == r[0]]
    left = {v[0]: v[-1].decode("utf-8", "ignore") for v in suffix_brute(rows)}
    three = cp.STAGES[2][1](spark, two, FOLDER).cache()
    assert {r.doc_id: r.text for r in three.collect()} == left and three.columns == cp.COLUMNS
    assert all(r.n_chars == len(r.text) for r in three.collect())

    con = duckdb.connect()
    con.register("docs", three.toPandas())
    taken = {r[0]: r[4] for r in con.execute(mixing.TAKEN_SQL.format(docs="docs")).fetchall()}
    four = cp.STAGES[3][1](spark, three, FOLDER).cache()
    got = Counter()
    for r in four.collect():
        got[r.doc_id] += len(r.text.encode().split())
    assert got == Counter({i: n for i, n in taken.items() if n}) and four.columns == cp.COLUMNS

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in four.collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    five = cp.STAGES[4][1](spark, four, FOLDER)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in five.collect()) == want
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in cp.run(spark, FOLDER).collect()) == want


def test_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0), (5, "", "en", None, 0)], docs.schema)
    for rows in (odd, docs.limit(0)):
        for _, stage in cp.STAGES[1:]:
            stage(spark, rows, FOLDER).collect()
        assert cp.STAGES[0][1](spark, rows, FOLDER).count() == 0
