import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from barline.llm import alignment
from barline.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: b for b, c in byte_letters().items()}

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    every, holds = [], Counter()
    for doc_id, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        parts_a, parts_b = [bytes(byte[c] for c in first.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
        raw = (" " + (text or "")).encode()
        groups, links = [], Counter()
        if text and b"".join(parts_a) == raw and b"".join(parts_b) == raw:
            i = j = at_a = at_b = 0
            group = ([], [])
            while i < len(a) or j < len(b):
                if at_a <= at_b:
                    group[0].append(a[i])
                    at_a, i = at_a + len(parts_a[i]), i + 1
                else:
                    group[1].append(b[j])
                    at_b, j = at_b + len(parts_b[j]), j + 1
                if at_a == at_b:
                    groups.append(group)
                    group = ([], [])
            for x, y in groups:
                links.update((p, q) for p in x for q in y)
        else:
            a = b = []
        holds.update(links.keys())
        every.append((doc_id, len(a), len(b), groups, links))
    most = Counter()
    for (p, _), n in holds.items():
        most[p] = max(most[p], n)
    out = []
    for doc_id, n_a, n_b, groups, links in every:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for pair, n in links.items() if holds[pair] == most[pair[0]])
        total = sum(n * holds[pair] for pair, n in links.items())
        out.append((doc_id, n_a, n_b, len(groups), links.total(), best, total, hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, a int, links string").repartition(3)
    got = alignment.alignment(df, A, B, public_tokenizers.PATTERN, **options).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def corpus(seed, n):
    rng = random.Random(seed)
    bits = ["the", "The cat", "naïve", "日本語", "🙂", "don't", "1234", "&&&", "\n\n", "\t", "  ", "x\x00y", "ééé", "<s>", "<|endoftext|>", "\x85", "　", "\x1c"]
    return [(i, rng.choice([" ", "", ", "]).join(rng.choices(bits, k=rng.randrange(30)))) for i in range(n)]


def test_equals_brute_force(spark):
    check(spark, corpus(1, 120))


def test_pairs_are_sent_in_parts(spark):
    check(spark, corpus(2, 60), sent=40)


def test_odd_rows(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(1, 12))) for _ in range(20_000))
    solid = "".join(rng.choices("ab", k=4000))
    check(spark, [(1, None), (2, ""), (3, " "), (4, long), (4, long), (5, solid), (None, "no id"), (6, "a ▁ mark"), (7, "a" * 3000), (8, "<unk> </s>")])
    check(spark, [])
    check(spark, [(1, None)])


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = alignment.alignment(docs, A, B, public_tokenizers.PATTERN).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute([tuple(r) for r in docs.collect()])
