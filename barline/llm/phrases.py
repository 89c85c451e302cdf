"""Phrase collocation mining by dynamic itemset counting.

The texts are dealt into shards, which are scanned in a circle. Counting starts with all words; at the end of each scan,
phrases whose running count has reached the threshold are noted, and a longer phrase is counted from the next shard on
once both its subphrases (without the last and without the first word) have been noted. So lengths overlap instead of
taking one pass each, and every phrase is counted over exactly one full cycle of shards, wherever it started. The texts
are cut into words once; the shards hold their hashes.

What has been noted goes to the tasks as a table of fixed size, one byte for each hash slot: the scan from which the
phrases of the slot count as noted. A slot that several phrases share only makes more phrases be counted, never fewer:
the scan at which a phrase starts depends on slots that are never changed once set.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from barline.llm.common import WordHashes, mix, signed, stored
from barline.session import scratch_path

#: Least occurrences of a phrase, words of the longest, phrases reported per language.
LEAST, LONGEST, REPORTED = 100, 5, 2000
#: Shards of a cycle; the slots of the noted phrases are two to this power, 16 MB whatever the input.
SHARDS, SLOT_BITS = 3, 24
#: Words that a task holds at a time.
STEP_WORDS = 1 << 20

#: A-Z to a-z, tabs to blanks, the characters that end a piece to a byte that no UTF-8 text holds.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
NORMAL = bytes(0xFF if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15 // 8 * 8 + 5)

_hashes = WordHashes(seed=12)
_END = np.uint64(WordHashes(seed=12)[b"\xff"])


def tokens(text: str) -> list[bytes]:
    """The words of a text, with an end mark after each piece."""
    raw = text.encode("utf-8", "surrogatepass").translate(NORMAL)
    return raw.replace(b"\xff", b" \xff ").split() + [b"\xff"]


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(_hashes[lang.encode("utf-8", "surrogatepass")])


def keys_of(sums: np.ndarray, langs: np.ndarray | np.uint64, size: int) -> np.ndarray:
    """The hash of phrases in their language; its highest bits are their slot."""
    return mix(mix(sums + np.uint64(size)) + langs)


def slot_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The place in a table of ``n`` slots, a power of two."""
    return (keys >> np.uint64(65 - n.bit_length())).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpacked(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def hashed(rows: DataFrame) -> DataFrame:
    """(_shard, lang, words, codes): runs of tokens of one shard and language, as distinct hashes and their numbers."""

    def pack(held):
        out = {"_shard": [], "lang": [], "words": [], "codes": []}
        for (shard, lang), parts in held.items():
            words, codes = np.unique(np.concatenate(parts), return_inverse=True)
            out["_shard"].append(shard)
            out["lang"].append(lang)
            out["words"].append(packed(words))
            out["codes"].append(packed(codes.astype(np.uint32)))
        return pa.RecordBatch.from_pydict(out, pa.schema([("_shard", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("codes", pa.binary())]))

    def run(batches):
        held, n = defaultdict(list), 0
        for batch in batches:
            for shard, lang, text in zip(*(batch.column(c) for c in ("_shard", "lang", "text"))):
                held[shard.as_py(), lang.as_py()].append(_hashes.of(tokens(text.as_py())))
                n += len(held[shard.as_py(), lang.as_py()][-1])
                if n >= STEP_WORDS:
                    yield pack(held)
                    held, n = defaultdict(list), 0
        if held:
            yield pack(held)

    return rows.select("_shard", "lang", "text").mapInArrow(run, "_shard long, lang string, words binary, codes binary")


def counted(lang: np.uint64, words: np.ndarray, codes: np.ndarray, noted: np.ndarray, scan: int, cycle: int, longest: int):
    """(keys, since, n) of the phrases that this scan counts in a run of tokens.

    A last row without occurrences gives the latest scan from which a phrase of this run is to be counted, be it the
    next one.
    """
    end = words == _END
    keys = keys_of(words, lang, 1)
    if scan < cycle:
        yield keys[~end], np.zeros(len(words), np.int32)[~end], np.bincount(codes, minlength=len(words))[~end]
    slot = np.where(end, 0, noted[slot_of(keys, len(noted))]).astype(np.int32)
    at = np.flatnonzero(slot[codes])  # starts of noted phrases: ends are none, so no phrase runs across one
    seen, h, known = slot[codes[at]], words[codes], 0
    sums = h[at]
    for size in range(2, longest + 1):
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        since, at = np.maximum(seen[both], seen[both + 1]), at[both]
        sums = sums[both] * BASE + h[at + size - 1]
        known = max(known, since.max(initial=0))
        now = since <= scan
        at, sums, since = at[now], sums[now], since[now]
        keys = keys_of(sums, lang, size)
        open_ = since > scan - cycle
        found, first, n = np.unique(keys[open_], return_index=True, return_counts=True)
        yield found, since[open_][first], n
        # Noted from its slot's scan on, but never before the scan after the one that began to count it.
        slot = noted[slot_of(keys, len(noted))]
        seen = np.maximum(slot, since + 1)
        at, sums, seen = at[slot > 0], sums[slot > 0], seen[slot > 0]
    yield np.zeros(1, np.uint64), np.array([known], np.int32), np.zeros(1, np.int64)


def scanned(shard: DataFrame, shared: Broadcast, scan: int, cycle: int, longest: int) -> DataFrame:
    """(key, since, n) of one shard, a row for each phrase and run of tokens; ``shared`` holds the packed slots."""

    def run(batches):
        noted = unpacked(shared.value, np.uint8)
        for batch in batches:
            for lang, words, codes in zip(*(batch.column(c) for c in ("lang", "words", "codes"))):
                run_of = unpacked(words.as_py(), np.uint64), unpacked(codes.as_py(), np.uint32)
                for keys, since, n in counted(lang_hash(lang.as_py()), *run_of, noted, scan, cycle, longest):
                    cols = [pa.array(signed(keys)), pa.array(since.astype(np.int32)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "since", "n"])

    return shard.select("lang", "words", "codes").mapInArrow(run, "key long, since int, n long")


def noted_phrases(rows: DataFrame, least: int, longest: int, shards: int) -> np.ndarray:
    """The slots of all phrases of up to ``longest`` words that reach ``least`` in their cycle."""
    spark = rows.sparkSession
    path = scratch_path(spark, "phrase-shards")
    hashed(rows).write.partitionBy("_shard").parquet(path)
    runs = spark.read.schema("lang string, words binary, codes binary, _shard long").parquet(path)
    noted = np.zeros(1 << SLOT_BITS, np.uint8)
    pending, scan, last = None, 0, 0
    while scan < last + shards:
        shared = spark.sparkContext.broadcast(packed(noted))
        found = scanned(runs.filter(F.col("_shard") == scan % shards), shared, scan, shards, longest)
        if pending is not None:
            found = found.unionByName(pending)
        total = found.groupBy("key", "since").agg(F.sum("n").alias("n"))
        unfinished = F.col("since") > scan - shards + 1
        counts = stored(total.filter(unfinished | (F.col("n") >= least)), "phrase-counts")
        shared.destroy()
        pending = counts.filter(unfinished)
        slot = F.shiftrightunsigned("key", 64 - SLOT_BITS).cast("int").alias("slot")
        # At most as many as there are slots.
        new = counts.filter(F.col("n") >= least).select(slot).distinct().toArrow().column("slot").to_numpy()
        new = new[noted[new] == 0]
        scan += 1
        if len(new):
            noted[new] = last = scan
        # A slot set by other phrases starts a phrase without a slot of its own; its cycle has to end as well.
        last = max(last, pending.agg(F.max("since")).first()[0] or 0)
    return noted


def spelled(rows: DataFrame, noted: np.ndarray, longest: int) -> DataFrame:
    """(lang, size, phrase, n) of the phrases whose slots are set, a row for each phrase and run of tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(packed(noted))

    def spell(words, langs, lengths, noted):
        h = _hashes.of(words)
        which = np.repeat(np.arange(len(langs)), lengths)
        by_lang = np.array([lang_hash(x) for x in langs], np.uint64)
        n_words = np.bincount(which[h != _END], minlength=len(langs))
        lang, size, phrase, n = [np.arange(len(langs))], [np.zeros(len(langs), np.int32)], [b""] * len(langs), [n_words]
        at = np.flatnonzero(h != _END)
        sums = h[at]
        for k in range(1, longest + 1):
            if k > 1:
                both = np.flatnonzero(at[1:] == at[:-1] + 1)
                at = at[both]
                sums = sums[both] * BASE + h[at + k - 1]
            keys = keys_of(sums, by_lang[which[at]], k)
            alive = noted[slot_of(keys, len(noted))] > 0
            at, sums = at[alive], sums[alive]
            _, first, c = np.unique(keys[alive], return_index=True, return_counts=True)
            starts = at[first]
            lang.append(which[starts])
            size.append(np.full(len(starts), k, np.int32))
            phrase += [b" ".join(words[i : i + k]) for i in starts.tolist()]
            n.append(c)
        names = pa.array(langs, pa.string()).take(pa.array(np.concatenate(lang)))
        cols = [names, pa.array(np.concatenate(size)), pa.array(phrase, pa.string()), pa.array(np.concatenate(n).astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["lang", "size", "phrase", "n"])

    def run(batches):
        table = unpacked(shared.value, np.uint8)
        words, langs, lengths = [], [], []
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                own = tokens(text.as_py())
                words += own
                langs.append(lang.as_py())
                lengths.append(len(own))
                if len(words) >= STEP_WORDS // 4:
                    yield spell(words, langs, lengths, table)
                    words, langs, lengths = [], [], []
        if words:
            yield spell(words, langs, lengths, table)

    return rows.select("lang", "text").mapInArrow(run, "lang string, size int, phrase string, n long")


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of up to ``longest`` words with ``least`` occurrences or more.

    The scans count by 64-bit hashes; a last one counts what they noted by its words, so that no phrase has a count that
    a hash or a slot has mixed with another's. Rows of size 0 hold the number of all words of a language. A null lang is
    ``und``; a null or empty text has no words. Repeated rows count as often as they come; other columns do not matter.
    """
    if shards * longest > 250:
        raise ValueError("a slot holds the number of a scan in one byte: take fewer shards or shorter phrases")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"))
    noted = noted_phrases(rows.withColumn("_shard", F.pmod(F.xxhash64("text"), F.lit(shards))), least, longest, shards)
    counts = spelled(rows, noted, longest).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return stored(counts.filter((F.col("n") >= least) | (F.col("size") == 0)), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, reported: int = REPORTED, absorbed: int = 100, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``reported`` phrases of each language.

    The score is 1000 a n / (l r), rounded down, at the cut where it is least (the first of equal ones): n words, a
    occurrences of the phrase, l and r of its parts. A phrase is dropped if a longer one around it has at least
    ``absorbed`` percent of its occurrences. Ties go to the more frequent phrase, then by UTF-8 bytes.
    """
    every = frequent(docs, least, longest, shards)
    words = every.filter("size = 0").select("lang", F.col("n").alias("_all"))
    phrases = every.filter("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"))

    inner = F.expr("""explode(flatten(transform(sequence(2, size - 1), k ->
        transform(sequence(1, size - k + 1), i -> array_join(slice(_w, i, k), ' ')))))""")
    around = phrases.filter("size > 2").select("lang", F.col("a").alias("_longer"), inner.alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = phrases.join(around, ["lang", "phrase"], "left")
    kept = kept.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < absorbed * F.col("a")))

    cuts = kept.join(words, "lang").select("lang", "phrase", "a", F.col("_all").alias("n"), "_w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("_left", F.expr("array_join(slice(_w, 1, k), ' ')"))
    cuts = cuts.withColumn("_right", F.expr("array_join(slice(_w, k + 1, size - k), ' ')")).drop("_w", "size")
    part = every.filter("size > 0").select("lang", "phrase", "n")
    cuts = cuts.join(part.toDF("lang", "_left", "l"), ["lang", "_left"]).join(part.toDF("lang", "_right", "r"), ["lang", "_right"])
    score = F.expr("(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_best"))
    order = Window.partitionBy("lang").orderBy(F.desc("_best.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= reported)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "_best.l", "_best.r", "n", "_best.score")


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM s),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 100),
sub AS (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM c),
sub2 AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM sub),
big AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM sub2 GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN big USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cut AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM kept),
parts AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, n.n,
    (1000::HUGEINT * cut.a * n.n) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN n USING (lang) JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1 : j], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[j + 1 : cut.k], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS b FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE b = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
