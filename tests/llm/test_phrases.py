import random
import re
from collections import Counter

from pyspark.sql import functions as F

from barline.llm import phrases


def brute(rows, least, longest, reported):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in found.items():
        longer = [b for (other, v), b in found.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right, total[lang]))
    ranks, result = Counter(), []
    for lang, score, a, phrase, left, right, n in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= reported:
            result.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return sorted(result)


def check(spark, rows, least, longest=5, reported=2000, shards=3):
    df = spark.createDataFrame([(t, x, 1, "p") for x, t in rows], "text string, lang string, n int, phrase string").repartition(3)
    got = phrases.collocations(df, least, longest, reported, shards=shards).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least, longest, reported)
    return got


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["a", "The", "of", "é", "日本", "x\x0by"] + [f"v{i}" for i in range(12)]
    fixed = [" ".join(rng.choices(vocab, k=rng.randrange(2, 8))) for _ in range(6)]
    rows = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += rng.choices(vocab, k=rng.randrange(0, 6)) + [rng.choice(fixed)]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([" ", "\t ", ". ", "\n"]).join(w)))
    return rows


def test_equals_brute_force(spark):
    assert check(spark, corpus(1, 150), 6)
    assert check(spark, corpus(2, 200), 9, longest=4, reported=3, shards=2)


def test_shared_slots_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLOT_BITS", 4)
    monkeypatch.setattr(phrases, "STEP_WORDS", 50)
    check(spark, corpus(3, 150), 6)


def test_odd_rows(spark):
    long = " ".join(f"q{i % 30}" for i in range(30_000))
    check(spark, [("en", long), ("en", long), ("de", None), (None, ""), ("en", " ,;\t\n"), ("", "a b a b a b a b"), ("fr", "x x x x x x x")], 4)
    check(spark, [("en", "a b c")], 4)
    check(spark, [], 4)


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    given = spark.createDataFrame(
        [("en", 0, "", 10**14 + 7), ("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big)], "lang string, size int, phrase string, n long"
    )
    real = phrases.frequent
    phrases.frequent = lambda *_: given
    try:
        row = phrases.collocations(given).select(F.col("score")).first()
    finally:
        phrases.frequent = real
    assert row.score == 1000 * big * (10**14 + 7) // ((big + 1) * (big + 3))
