import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from barline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  a  b \n\n c\t", "don't we'll I'd", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>", "naïve Übung 日本語 🙂🙂",
    "a" * 5000, "x1x2 \x1c\x1d \x85  y​", "é" * 300 + " " * 200, "1234 5678", "The cat" * 50, "\r\n\r\n \x00\x01",
    "Licensed &&& thesin$$$ inlyhe$$$", "same", "same",
]


@pytest.mark.parametrize("texts", [TEXTS, []])
def test_same_as_the_library(spark, texts):
    t = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    got = {r.doc_id: r for r in bpe.digests(bpe.round_trip(df, PATH)).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), x
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), x
        back = t.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest(), x


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for r in bpe.round_trip(docs, PATH).join(docs, "doc_id").collect():
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids and r.decoded == r.text


def test_cuts_are_those_of_the_pattern():
    rng, pattern = random.Random(7), regex.compile(bpe.PIECES)
    letters = ["'", "'", " ", " ", "\n", "\t", "\xa0", "\u3000", "\x1c", "\x85", *"strevmldSTaé日", "1", "²", "٣", "Ⅷ", "-", "&", "🙂", "\u0301", "\u200b", "\udc80", "\x00"]
    texts = ["", "'", "'s", "'l", "''s", " 's", "x'll 'llo'd've're'm't", "  ", "a  ", "\n 's", "".join(map(chr, range(0x110000)))]
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(20_000)]
    for text in texts:
        starts, at = bpe.cuts(text)
        want = pattern.findall(text)
        assert [text[i:j] for i, j in zip(starts, starts[1:])] == want, text[:40]
        raw = text.encode("utf-8", "surrogatepass")
        assert [raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(at, at[1:])] == want, text[:40]


def test_few_and_many_bytes_merge_alike():
    rng, v, t = random.Random(8), bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
    for _ in range(3000):
        data = "".join(rng.choices("aaaetthinorsäß日🙂", k=rng.randrange(0, 45)))
        want = t.encode(data, add_special_tokens=False).ids
        ids = v.scanned(data.encode()), v.queued(data.encode())
        assert ids[0] == ids[1]
        assert v.encode([data])[0].tolist() == want


@pytest.mark.parametrize("chars", [1, 40, 1 << 22])
def test_texts_cut_together_do_not_touch(monkeypatch, chars):
    monkeypatch.setattr(bpe, "STEP_CHARS", chars)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 200)
    rng, v, t = random.Random(9), bpe.Vocabulary(PATH), Tokenizer.from_file(PATH)
    parts = ["<|endoftext|>", "<|endoftext|>", " ", "  ", "\n", "'", "'s", "s", "'l", "l", "don", "\x00", "Übung", "🙂", "1", "<|", ""]
    texts = [None, "", ""] + ["".join(rng.choices(parts, k=rng.randrange(0, 9))) for _ in range(3000)] + ["x" * 300, ""]
    got = [v.encode(some) for some in bpe.steps(pa.array(texts, pa.string()))]
    flat = [i for ids, _ in got for i in ids.tolist()]
    sizes = [n for _, counts in got for n in counts.tolist()]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert sizes == [len(w) for w in want] and flat == [i for w in want for i in w]
    assert max(len(counts) for _, counts in got) > 1 or chars == 1


def test_remembered_pieces_are_few():
    """What a worker remembers stays small however many different words it meets."""
    v = bpe.Vocabulary(PATH)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(600_000)]
    texts = pa.array([" ".join(words[k : k + 100_000]) for k in range(0, 600_000, 100_000)])
    sizes = [n for some in bpe.steps(texts) for n in v.encode(some)[1]]
    assert len(sizes) == 6 and all(sizes) and len(v) <= 400_000
