"""Benchmark decontamination: training texts are scanned for the normalised n-grams of a benchmark.

A window is ten consecutive words of an item, or the whole of a shorter item. The benchmark's windows go to all tasks
as a set of 64-bit hashes with their words; a task rolls the hash over the words of each text, looks every window up,
and compares words where the hash is found. A set is sent only up to ``SET_BYTES``, which is counted first; a larger
benchmark is dealt by hash into as many sets as that takes, and the texts are scanned once for each.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barline.llm.common import STEP_ROWS, WordHashes, map_rows, mix, rolling, signed, stored

#: Words of a window.
WINDOW = 10
#: Most bytes of window words in one broadcast set.
SET_BYTES = 32 << 20
#: Bits of the table that most windows of clean text fail at.
TABLE_BITS = 22

#: A-Z to a-z, and blanks for all ASCII characters but letters and digits.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
BASE = 0x9E3779B97F4A7C15 // 8 * 8 + 5

FOUND = "struct<n_words:bigint,spans:array<struct<first:int,last:int>>,items:array<string>>"
_hashes = WordHashes(seed=11)


def normalised(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def fingerprints(hashes: np.ndarray, n: int) -> np.ndarray:
    return mix(rolling(hashes, n, BASE) + np.uint64(n))


def windows(benchmark: DataFrame) -> DataFrame:
    """(key, words, item) of every window of the benchmark; an item without words has none."""

    def cut(rows: dict[str, list]) -> dict[str, list]:
        out = {"key": [], "words": [], "item": []}
        for item, text in zip(rows["item"], rows["text"]):
            w = normalised(text)
            if not w:
                continue
            n = min(WINDOW, len(w))
            out["key"] += signed(fingerprints(_hashes.of(w), n)).tolist()
            out["words"] += [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
            out["item"] += [item] * (len(w) - n + 1)
        return out

    given = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return map_rows(given, cut, "key long, words binary, item string").distinct()


class WindowSet:
    """Windows by hash: ``keys`` sorted, ``texts`` and ``items`` beside them, ``lengths`` in words."""

    def __init__(self, found: pa.Table):
        items = defaultdict(list)
        for key, words, item in zip(*(found.column(c).to_pylist() for c in ("key", "words", "item"))):
            items[key % 2**64, words].append(item)
        every = sorted(items)
        self.keys = np.array([k for k, _ in every], np.uint64)
        self.texts = [t for _, t in every]
        self.items = [[i for i in items[e] if i is not None] for e in every]
        self.lengths = sorted({t.count(b" ") + 1 for t in self.texts})

    def table(self) -> np.ndarray:
        seen = np.zeros(1 << TABLE_BITS, bool)
        seen[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return seen


class Scanner:
    """Looks all windows of a step's texts up at once."""

    def __init__(self, found: WindowSet):
        self.found, self.table = found, found.table()

    def __call__(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """For each text, True for each word that is hit, and the items found."""
        flat = [w for t in texts for w in t]
        hashes, ends = _hashes.of(flat), np.cumsum([len(t) for t in texts])
        hit, items = np.zeros(len(flat), bool), [set() for _ in texts]
        for n in self.found.lengths:
            for at, row in self.candidates(hashes, ends, n):
                if ends[row] - at < n:
                    continue
                words = b" ".join(flat[at : at + n])
                key = np.uint64(fingerprints(hashes[at : at + n], n)[0])
                first = int(np.searchsorted(self.found.keys, key))
                while first < len(self.found.keys) and self.found.keys[first] == key:
                    if self.found.texts[first] == words:
                        hit[at : at + n] = True
                        items[row].update(self.found.items[first])
                    first += 1
        return list(zip(np.split(hit, ends[:-1]), items)) if texts else []

    def candidates(self, hashes: np.ndarray, ends: np.ndarray, n: int):
        keys = fingerprints(hashes, n)
        at = np.flatnonzero(self.table[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        place = np.searchsorted(self.found.keys, keys[at])
        at = at[self.found.keys[np.minimum(place, len(self.found.keys) - 1)] == keys[at]]
        return zip(at.tolist(), np.searchsorted(ends, at, side="right").tolist())


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def scan(found: WindowSet, spark):
    """A column function (text, what earlier sets found) -> what has been found so far."""
    shared = spark.sparkContext.broadcast(found)
    state = {}

    @F.arrow_udf(FOUND)
    def look(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        if "scanner" not in state:
            state["scanner"] = Scanner(shared.value)
        out = []
        for start in range(0, len(texts), STEP_ROWS):
            step = [normalised(t) for t in texts.slice(start, STEP_ROWS).to_pylist()]
            before = earlier.slice(start, STEP_ROWS).to_pylist()
            for words, old, (hit, items) in zip(step, before, state["scanner"](step)):
                if old:
                    for s in old["spans"]:
                        hit[s["first"] : s["last"] + 1] = True
                    items = items.union(old["items"])
                spans = [{"first": a, "last": b} for a, b in runs(hit)] if hit.any() else []
                out.append({"n_words": len(words), "spans": spans, "items": sorted(items)})
        return pa.array(out, look_type)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    look_type = to_arrow_type(_parse_datatype_string(FOUND))
    return look


def marked(docs: DataFrame, benchmark: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """(_doc, _found): the row of ``docs``, and n_words, the maximal spans of words hit, and the sorted ids of items found.

    Spans count words from 0 and include both ends. A null or empty text has no words and is never hit. Items that share
    an id are named once, an item without id hits words without being named, equal windows of several items name all of
    them. Each row is judged by itself, so repeated rows get equal results; columns of any name ride along in ``_doc``.
    """
    spark = docs.sparkSession
    every = stored(windows(benchmark), "benchmark-windows")
    size = every.agg(F.coalesce(F.sum(F.length("words") + 8), F.lit(0))).first()[0]
    sets = max(1, -(-size // set_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_doc"), F.lit(None).cast(FOUND).alias("_found"))
    for k in range(sets):
        if k:
            rows = stored(rows, "scanned")
        part = WindowSet(every.filter(F.pmod("key", F.lit(sets)) == k).toArrow())
        rows = rows.select("_doc", scan(part, spark)(F.col("_doc.text"), F.col("_found")).alias("_found"))
    return rows


def hit_words(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans") -> DataFrame:
    """``docs`` without the documents that hold benchmark windows, or without the words that are hit.

    ``remove="spans"`` cuts a text from the first to the last word of each span and keeps all else as it stands.
    """
    rows = marked(docs, benchmark)
    if remove == "documents":
        # A generator keeps the filter from being pushed below and the scan from being done twice.
        rows = rows.select("_doc", F.explode(F.array("_found")).alias("_found"))
        return rows.filter(F.size("_found.spans") == 0).select("_doc.*")
    if remove != "spans":
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    text = without(F.col("_doc.text"), F.col("_found.spans"))
    return rows.select(F.col("_doc").withField("text", text).alias("_doc")).select("_doc.*")


def without(text: Column, spans: Column) -> Column:
    """The text without its bytes from the first to the last word of each span."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts.to_pylist(), found.to_pylist()):
            if text and gone:
                raw = text.encode("utf-8", "surrogatepass")
                blank = np.frombuffer(raw.translate(NORMAL), np.uint8) == 32
                edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
                start, end, at, kept = edges[::2], edges[1::2], 0, []
                for s in gone:
                    kept.append(raw[at : start[s["first"]]])
                    at = end[s["last"]]
                text = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
            out.append(text)
        return pa.array(out, pa.string())

    return cut(text, spans)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    rows = marked(docs.select("doc_id", "text"), benchmark).select("_doc.doc_id", "_found")
    return rows.select(
        "doc_id",
        "_found.n_words",
        hit_words(F.col("_found")).alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_found.spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM p),
lens AS (SELECT DISTINCT n FROM win),
s AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
g AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM s),
h AS (SELECT g.r, g.i, g.n, win.item_id FROM g JOIN win ON g.n = win.n AND g.t = win.t),
hw AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
