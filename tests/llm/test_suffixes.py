import random

import numpy as np

from barline.llm import suffixes


def brute(rows):
    big = 2**63
    order = sorted(((big if i is None else i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    seen, out = {}, []
    for i, raw in order:
        for s in range(len(raw) - 99):
            seen.setdefault(raw[s : s + 100], (i, s))
    for i, raw in order:
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - 99):
            if seen[raw[s : s + 100]] != (i, s):
                gone[s : s + 100] = True
        spans = sum(gone[n] and (n == 0 or not gone[n - 1]) for n in range(len(raw)))
        kept = bytes(b for n, b in enumerate(raw) if not gone[n])
        out.append((None if i == big else i, len(raw), int(gone.sum()), int(spans), kept))
    return sorted(out, key=repr)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, body string, at int").repartition(parts)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.deduplicated(df).collect()]
    assert sorted(got, key=repr) == brute(rows)


def corpus(seed, n):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choices("abcdé \n", k=k))
    passages = [make(rng.randrange(60, 400)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            t += make(rng.randrange(0, 120)) + (p[cut:] if rng.random() < 0.5 else p[:cut])
        if rng.random() < 0.2:
            t += rng.choice(["x", "ab", "Der "]) * rng.randrange(20, 150)
        rows.append((i * 7 % 1009, t))
    return rows


def test_equals_brute_force(spark):
    for seed in range(3):
        check(spark, corpus(seed, 80))


def test_many_batches_build_levels(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        check(spark, corpus(7, 90))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_family_merges_equal_ranks():
    f = suffixes.Family()
    for n in range(7):
        keys = np.arange(n * 10, n * 10 + 10, dtype=np.uint64)[::-1].copy()
        ids = np.full(10, n)
        assert not f.scan(keys, ids, np.arange(10), ids).any()
    assert [x.rank for x in f.levels] == [2, 1, 0] and [len(x.keys) for x in f.levels] == [40, 20, 10]
    again = f.scan(np.arange(0, 70, dtype=np.uint64), np.full(70, 9), np.arange(70), np.full(70, 9))
    assert again.all() and sum(len(x.keys) for x in f.levels) == 70


def test_odd_rows(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh ", k=60_000))
    check(spark, [(1, None), (2, ""), (4, long), (4, long), (5, long), (None, long), (6, "x" * 99), (7, "x" * 100), (8, "x" * 300)])
    check(spark, [])


def test_other_columns_ride_along(spark):
    df = spark.createDataFrame([(1, "abc", "de", 3), (2, None, None, None)], "doc_id long, text string, id string, kept int")
    got = {r.doc_id: r._rest for r in suffixes.deduplicated(df, rest=True).collect()}
    assert got[1].id == "de" and got[1].kept == 3 and got[2].id is None
