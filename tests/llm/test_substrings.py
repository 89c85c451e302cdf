import random

from barline.llm import substrings


def brute(rows):
    big = 2**63
    firsts, split = {}, []
    for i, text in rows:
        w = (text or "").encode().split()
        split.append((big if i is None else i, w))
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            firsts[key] = min(firsts.get(key, big + 1), split[-1][0])
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - 12):
            if firsts[tuple(w[s : s + 13])] < i:
                gone |= set(range(s, s + 13))
        out.append((None if i == big else i, len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return sorted(out, key=repr)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, id string, at int").repartition(parts)
    got = [tuple(r) for r in substrings.deduplicated(df).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=repr) == brute(rows)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["a", "b", "the", "of", "é", "word"] + [f"v{i}" for i in range(40)]
    passages = [rng.choices(vocab, k=rng.randrange(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += rng.choices(vocab, k=rng.randrange(0, 30))
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            w += p[cut:] if rng.random() < 0.5 else p[:cut]
        if rng.random() < 0.2:
            w += ["x"] * rng.randrange(10, 40)
        rows.append((rng.randrange(n * 2), rng.choice([" ", "\n", "\t "]).join(w)))
    return list({r[0]: r for r in rows}.values())


def test_equals_brute_force(spark):
    for seed in range(3):
        check(spark, corpus(seed, 120))


def test_hot_phrase_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, corpus(9, 150))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    long = " ".join(f"q{i % 977}" for i in range(30_000))
    check(spark, [(1, None), (2, ""), (3, " \n "), (4, long), (4, long), (5, long), (None, long), (6, "x " * 13), (7, "x " * 12)])
    check(spark, [])


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(25))
    check(spark, [(1, a), (2, a + " " + b), (2, b), (3, b)])
