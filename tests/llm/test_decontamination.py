import hashlib
import random
import re

import pytest

from barline.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = "doc_id long, text string, item_id int, n_words string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            n = min(10, len(p))
            if not n:
                continue
            own = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in own:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], KINDS).repartition(3)
    return d, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


def check(spark, docs, items):
    got = [tuple(r) for r in decontamination.report(*frames(spark, docs, items)).collect()]
    assert sorted(got, key=repr) == brute(docs, items)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["a", "The", "of", "é", "naïve", "日本", "x1"] + [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 11, 40])))) for i in range(12)]
    docs = []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randrange(60))
        if rng.random() < 0.6:
            p = rng.choice(items)[1].upper().split()
            cut = rng.randrange(len(p))
            w += p[cut:] if rng.random() < 0.5 else p
        docs.append((i, rng.choice([" ", ", ", "\n-", "\x7f"]).join(w + rng.choices(vocab, k=3))))
    return docs, items


def test_equals_brute_force(spark):
    for seed in range(3):
        check(spark, *corpus(seed, 80))


def test_a_large_benchmark_is_scanned_in_several_sets(spark, monkeypatch):
    docs, items = corpus(5, 60)
    monkeypatch.setattr(decontamination.marked, "__defaults__", (300,))
    check(spark, docs, items)


def test_odd_rows(spark):
    ten = "one two three four five six seven eight nine ten"
    long = " ".join(f"q{i % 977}" for i in range(30_000)) + " " + ten
    docs = [(1, None), (2, ""), (3, " .,;\n"), (4, long), (4, long), (5, ten), (None, ten.upper()), (6, ten[:-1]), (7, "ONE-two"), (8, "É é")]
    items = [(10, ten), (9, ten + " eleven"), (9, "one two"), (3, None), (4, ""), (5, "..."), (None, "é"), (11, "q1 q2"), (12, "q1 q2")]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)


@pytest.mark.parametrize("remove", ["spans", "documents"])
def test_removal(spark, remove):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, f"Before, {ten.title()}! After é."), (2, "clean text"), (3, None)]
    out = decontamination.decontaminated(*frames(spark, docs, [(1, ten)]), remove)
    assert out.columns == ["doc_id", "text", "item_id", "n_words"]
    got = {r.doc_id: r.text for r in out.collect()}
    kept = {2: "clean text", 3: None}
    assert got == (kept | {1: "Before, ! After é."} if remove == "spans" else kept)
