import random

import numpy as np
import pytest
import xxhash

from barline.llm import simhash
from barline.llm.common import components


def plain_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    ids, parent = list(prints), {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    got = simhash.near_groups(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    prints = {r[0]: plain_print(r[1]) for r in rows}
    want = plain_groups(prints)
    for r in got:
        assert r.fp % 2**64 == prints[r.doc_id] and r.component_id == want[r.doc_id]


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(400)]
    base = [rng.choices(vocab, k=300) for _ in range(6)]
    rows = []
    for i in range(220):
        w = list(base[i % 6])
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i * 3, " ".join(w) if i % 10 else "A\tShort\nText", "x", 1))
    rows += [(1, None, "x", 1), (2, "", "x", 1), (4, " \n", "x", None), (5, "one", None, 1), (7, "ONE", None, 1), (8, "İ ONE é", None, 1)]
    check(spark, rows)


def test_hot_list_and_empty(spark):
    check(spark, [])
    rng = np.random.default_rng(0)
    root = int(rng.integers(0, 2**63))
    prints = {root}
    for _ in range(150):
        x = root
        for b in rng.choice(64, 3, replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    label = components(edges).collect()
    assert len(label) == len(prints) and len({r.root for r in label}) == 1


@pytest.mark.parametrize("n", [2, 65])
def test_components_of_a_chain(spark, n):
    df = spark.createDataFrame([(i, i + 1) for i in range(10, 10 + n)], "a long, b long")
    assert {r.root for r in components(df).collect()} == {10}


def test_deduplicated_keeps_one_row_of_a_group(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (9, "other words stand here now"), (4, None), (6, "")]
    rows += [(None, "a b c d e"), (None, "only a null id has this"), (None, "only a null id has this")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [
        (0, "only a null id has this"), (1, "a b c d e"), (4, None), (9, "other words stand here now")
    ]
