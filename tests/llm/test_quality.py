import math
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from barline.llm import quality


def h64(*parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<q", p) if isinstance(p, int) else struct.pack("<i", p[0])
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, trusted, threshold):
    grams = []
    for _, text in rows:
        h = [h64(w) for w in split(text or "")]
        pairs = [h64((2,), a, *([h[i + 1]] if i + 1 < len(h) else [])) for i, a in enumerate(h)]
        grams.append([x % quality.BUCKETS for x in h] + [quality.BUCKETS + x % quality.BUCKETS for x in pairs])
    raw, own = Counter(), Counter()
    for (i, _), g in zip(rows, grams):
        raw.update(g)
        if i in trusted:
            own.update(g)
    r, o, s = sum(raw.values()), sum(own.values()), quality.SMOOTHING
    out = []
    for (i, text), g in zip(rows, grams):
        text = text or ""
        w = split(text)
        five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        many, cover = Counter(five), set()
        for k, f in enumerate(five):
            if many[f] > 1:
                cover |= set(range(k, k + 5))
        lines = [x for x in text.split("\n") if split(x)]
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        score = None
        if g:
            score = sum(math.log((own[b] + s * o / r) / (o / r * (raw[b] + s))) if o else 0 for b in g) / len(g)
        kept = not failed and score >= threshold
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), failed, kept, score))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    good, bad = [f"wörd{i}" for i in range(60)], [f"bad{i}&%" for i in range(60)]
    rows = []
    for i in range(80):
        v = good if i % 3 else bad
        w = rng.choices(v, k=rng.randrange(0, 80))
        if i % 7 == 0:
            w += w[: rng.randrange(0, 12)] * 2
        rows.append((i, rng.choice([" ", "\n", " \t", "\x0b"]).join(w) + rng.choice(["", "\n \n", "\nx\nx"])))
    return rows + [(90, None), (91, ""), (92, " \n\r"), (None, rows[1][1]), (2, rows[2][1]), (93, "\n".join(["l l l l l l l l l l l"] * 3))]


def check(spark, rows, labels):
    quiet = "doc_id long, text string, score int, kept string"
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], quiet)
    got = quality.judged(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert got.columns[:4] == df.columns
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept score".split()
    got = sorted(((r.doc_id, *(r._quality[n] for n in names)) for r in got.collect()), key=repr)
    want = brute(rows, {i for i, q in labels if q == 1 and i is not None}, quality.THRESHOLD)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    for g, w in zip(got, want):
        assert g[-1] is None and w[-1] is None or abs(g[-1] - w[-1]) < 1e-9
    return got


def test_equals_brute_force(spark):
    labels = [(i, 1 if i % 3 else 0) for i in range(80)] + [(1, 0), (None, 1), (1000, 1)]
    got = check(spark, corpus(), labels)
    assert {g[-2] for g in got} == {True, False}


def test_without_trusted_documents_and_empty(spark):
    check(spark, corpus()[:20], [])
    check(spark, [], [(1, 1)])


def test_more_trusted_ids_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(quality, "SENT_IDS", 3)
    check(spark, corpus(), [(i, 1 if i % 3 else 0) for i in range(80)])


def test_long_text_and_a_column_of_the_verdicts_name(spark):
    rows = [(1, " ".join(f"w{i % 9000}" for i in range(20_000))), (2, "plain words " * 4)]
    check(spark, rows, [(1, 1)])
    df = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, _quality int")
    assert quality.judged(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).first()._quality.n_words == 2


@pytest.mark.parametrize("folder,times", [("sf0.01", 1), ("sf0.01", 10), ("sf0.1", 1)])
def test_labelled_junk_goes_and_clean_text_stays(spark, folder, times):
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{t}.parquet") for t in ("documents", "labels"))
    many = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy"))
    got = quality.judged(many, labels).filter("not _quality.base_failed").join(labels, "doc_id")
    rates = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("_quality.kept").cast("int")).alias("kept")).collect()}
    assert rates[1] == 1 and rates[0] < (0.02 if folder == "sf0.1" else 0.08)


def test_a_word_costs_few_lambda_steps(spark):
    """Lambdas are interpreted: neither looks neighbours up by index nor takes a remainder for each word."""
    df = spark.createDataFrame([(1, "a b c d e a b c d e", "")], "doc_id long, text string, x string")
    rows = quality.base_counts(quality.with_words(df)).withColumn("_b", quality.buckets("_h", "_p"))
    plan = rows.select("_b", "_n_repeat_words")._jdf.queryExecution().analyzed().toString()
    assert "pmod" not in plan and "zip_with" in plan.lower().replace("zipwith", "zip_with")
    assert rows.first()._n_repeat_words == 10
