"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, over a whole corpus.

A step's texts are encoded by both tokenizers and stay in Arrow from there on: token lists are flattened with their
parents, segmented cumulative sums give each token its end within its document, an Acero hash join of both sides on the
(document, end) key finds the ends they share, and a second one on the groups between them makes the links. Tables are
grouped per document and per batch; Spark merges these partial counts into the corpus-wide number of documents of a pair.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from barline.llm.bpe import byte_letters
from barline.llm.common import map_rows, stored

#: Most id pairs that are sent to all tasks at once; more are sent in parts, by the id of the first vocabulary.
SENT_PAIRS = 2_000_000
#: Links of a group up to which its tokens are joined as they stand.
DIRECT_LINKS = 64
#: Rows whose links are counted at a time.
COUNT_ROWS = 2_000

LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<a:int,b:int,n:bigint>>"


class Side:
    """A tokenizer: ``encode`` gives lists of ids, ``bytes`` the bytes of each id, ``sizes`` their number, at least one."""

    def __init__(self, encode, strings: list[bytes]):
        self.encode = encode
        self.bytes = pa.array(strings, pa.large_binary())
        self.sizes = np.array([len(s) for s in strings], np.int64)


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str) -> Side:
    """A byte-level vocabulary whose ids are in the order of its merges; strings of special tokens are plain text."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in byte_letters().items()}
    ids = spec["model"]["vocab"]
    strings = [b""] * (1 + max(ids.values()))
    for token, i in ids.items():
        strings[i] = bytes(byte[c] for c in token)
    coder = tiktoken.Encoding("side", pat_str=pattern, mergeable_ranks={s: i for i, s in enumerate(strings) if s}, special_tokens={})
    return Side(lambda texts: [coder.encode_ordinary(" " + t) for t in texts], strings)


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """A piece vocabulary with byte fallback, which puts a space before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    strings = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        strings.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Side(lambda texts: model.encode(texts, num_threads=1) if texts else [], strings)


def joined(side: Side, ids: np.ndarray) -> memoryview:
    taken = side.bytes.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64)
    return memoryview(taken.buffers()[2] or b"").cast("B")[: int(ends[len(taken)]) if len(taken) else 0]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, parents) of token lists."""
    a = pa.array(lists, pa.list_(pa.int32()))
    return pc.list_flatten(a).to_numpy(), pc.list_parent_indices(a).to_numpy()


def faithful(side: Side, ids: np.ndarray, parents: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Whether the tokens' bytes are those of each text."""
    sizes = np.bincount(parents, weights=side.sizes[ids], minlength=len(raw)).astype(np.int64)
    ends, all_bytes = np.cumsum(sizes), joined(side, ids)
    return np.array([n == len(r) and all_bytes[e - n : e] == r for n, e, r in zip(sizes.tolist(), ends.tolist(), raw)], bool)


def numbered(table: pa.Table, *keys: str) -> pa.Table:
    """Rows of equal keys as one, with their number."""
    return table.group_by(list(keys), use_threads=False).aggregate([([], "count_all")])


@lru_cache(maxsize=1)
def spelled(n_a: int, n_b: int) -> pa.Array:
    """Ids with what follows them: a comma, or the mark that ends a group's side; those of the second side come last."""
    both = [f"{i}{c}" for i in range(n_a) for c in ",|"] + [f"{i}{c}" for i in range(n_b) for c in ",;"]
    return pa.array(both, pa.large_string())


def digests(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_tokens: np.ndarray, sizes: tuple[int, int]) -> list[str]:
    """SHA-256 of each document's groups, written as ``a1,a2|b1;a3|b2,b3``."""
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=n_groups)), np.cumsum(np.bincount(group_b, minlength=n_groups))
    order = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
    last_a[:-1], last_b[:-1] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
    order[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = a.astype(np.int64) * 2 + last_a
    order[np.arange(len(b)) + upto_a[group_b]] = sizes[0] * 2 + b.astype(np.int64) * 2 + last_b
    text = spelled(*sizes).take(pa.array(order))
    at = np.frombuffer(text.buffers()[1], np.int64)
    whole = memoryview(text.buffers()[2] or b"").cast("B")
    ends = np.cumsum(n_tokens)
    return [hashlib.sha256(whole[at[e - n] : at[e] - 1]).hexdigest() if n else "" for n, e in zip(n_tokens.tolist(), ends.tolist())]


def align(ids: list, texts: list[str | None], a: Side, b: Side) -> pa.RecordBatch:
    """One row of ``LINKED`` for each text."""
    texts = [t or "" for t in texts]
    raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    (ids_a, doc_a), (ids_b, doc_b) = (flat([x if t else [] for x, t in zip(side.encode(texts), texts)]) for side in (a, b))
    whole = faithful(a, ids_a, doc_a, raw) & faithful(b, ids_b, doc_b, raw)
    ids_a, doc_a, ids_b, doc_b = ids_a[whole[doc_a]], doc_a[whole[doc_a]], ids_b[whole[doc_b]], doc_b[whole[doc_b]]

    n = len(texts)
    # Ends within the document: running sums less what stood before the document. Texts here have the same bytes on both sides.
    base = np.concatenate([[0], np.cumsum([len(r) if w else 0 for r, w in zip(raw, whole)])])
    end_a, end_b = np.cumsum(a.sizes[ids_a]) - base[doc_a], np.cumsum(b.sizes[ids_b]) - base[doc_b]
    ends_a, ends_b = (pa.table({"doc": d, "end": e}) for d, e in ((doc_a, end_a), (doc_b, end_b)))
    shared = ends_a.join(ends_b, ["doc", "end"], join_type="inner", use_threads=False)
    cut_doc = shared.column("doc").to_numpy()
    cuts = np.sort(base[cut_doc] + shared.column("end").to_numpy())
    group_a, group_b = np.searchsorted(cuts, base[doc_a] + end_a), np.searchsorted(cuts, base[doc_b] + end_b)

    # In a group of many tokens, ids that repeat are linked as often as their numbers multiply, not occurrence by occurrence.
    many = np.bincount(group_a, minlength=len(cuts)) * np.bincount(group_b, minlength=len(cuts)) > DIRECT_LINKS
    left, right = pa.table({"group": group_a, "doc": doc_a, "a": ids_a}), pa.table({"group": group_b, "b": ids_b})
    pairs = [left.filter(pa.array(~many[group_a])).join(right.filter(pa.array(~many[group_b])), "group", join_type="inner", use_threads=False)]
    pairs[0] = pairs[0].append_column("n", pa.array(np.ones(len(pairs[0]), np.int64)))
    if many.any():
        left, right = numbered(left.filter(pa.array(many[group_a])), "group", "doc", "a"), numbered(right.filter(pa.array(many[group_b])), "group", "b")
        found = left.join(right, "group", join_type="inner", right_suffix="_b", use_threads=False)
        pairs.append(found.append_column("n", pc.multiply(found.column("count_all"), found.column("count_all_b"))))
    links = pa.concat_tables([x.select(["doc", "a", "b", "n"]) for x in pairs])
    code = (links.column("doc").to_numpy() * len(a.sizes) + links.column("a").to_numpy()) * len(b.sizes) + links.column("b").to_numpy()
    links = pa.table({"code": code, "n": links.column("n")}).group_by("code", use_threads=False).aggregate([("n", "sum")])
    code = links.column("code").to_numpy()
    doc, pair = np.divmod(code, len(a.sizes) * len(b.sizes))
    links = links.append_column("a", pa.array(pair // len(b.sizes))).append_column("b", pa.array(pair % len(b.sizes)))
    order = np.argsort(doc, kind="stable")
    offsets = np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)
    cols = [links.column(c).combine_chunks().take(pa.array(order)) for c in ("a", "b", "n_sum")]
    n_links = np.bincount(doc, weights=links.column("n_sum").to_numpy(), minlength=n).astype(np.int64)

    n_a, n_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
    kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(cols, kind)], fields=list(kind)))
    made = [pa.array(ids, pa.int64()), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, np.bincount(cut_doc, minlength=n), n_links))]
    made += [pa.array(digests(ids_a, ids_b, group_a, group_b, n_a + n_b, (len(a.sizes), len(b.sizes)))), listed]
    return pa.RecordBatch.from_arrays(made, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def linked(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """The rows of ``LINKED``: token numbers, groups and the linked id pairs of every document, with their occurrences.

    A null or empty text, and one whose bytes a tokenizer does not give back, has no tokens: zeros, no links and an empty
    digest. Each row is a document of its own, also where ids repeat; other columns do not matter.
    """

    def step(rows: dict[str, list]) -> pa.RecordBatch:
        return align(rows["doc_id"], rows["text"], byte_level(a_path, pattern), pieces(b_path))

    return map_rows(docs.select("doc_id", "text"), step, LINKED)


def pair_documents(links: DataFrame) -> DataFrame:
    """(a, b, docs, best): in how many documents a pair is linked, and whether no other pair of its ``a`` has more."""

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, COUNT_ROWS):
                flat_links = pc.list_flatten(batch.slice(at, COUNT_ROWS).column("links"))
                if len(flat_links):
                    found = numbered(pa.table({"a": flat_links.field("a"), "b": flat_links.field("b")}), "a", "b")
                    yield from found.rename_columns(["a", "b", "docs"]).combine_chunks().to_batches()

    counts = links.select("links").mapInArrow(count, "a int, b int, docs long").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(Window.partitionBy("a"))  # at most the second vocabulary's size
    return counts.select("a", "b", "docs", (F.col("docs") == most).alias("best"))


def scored(rows: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Adds to ``n_best`` and ``count_sum`` what the given pairs contribute; ``width`` exceeds every id of ``b``."""
    table = pairs.select((F.col("a").cast("long") * width + F.col("b")).alias("key"), "docs", "best").toArrow().sort_by("key")
    shared = rows.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("key", "docs", "best")])
    kind = pa.struct([("n_best", pa.int64()), ("count_sum", pa.int64())])

    @F.arrow_udf("struct<n_best:bigint,count_sum:bigint>")
    def look(links: pa.Array) -> pa.Array:
        keys, docs, best = shared.value
        parts = []
        for start in range(0, len(links), COUNT_ROWS):
            part = links.slice(start, COUNT_ROWS)
            every, doc = pc.list_flatten(part), pc.list_parent_indices(part).to_numpy()
            key = every.field("a").to_numpy().astype(np.int64) * width + every.field("b").to_numpy()
            n = every.field("n").to_numpy()
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            at, n, doc = at[known], n[known], doc[known]
            sums = [np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)]
            np.add.at(sums[0], doc, n * best[at])
            np.add.at(sums[1], doc, n * docs[at])
            parts.append(pa.StructArray.from_arrays([pa.array(x) for x in sums], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    rows = rows.withColumn("_more", look(F.col("links")))
    return rows.withColumns({c: F.col(c) + F.col(f"_more.{c}") for c in ("n_best", "count_sum")}).drop("_more")


def alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str, sent: int = SENT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, links) of every document.

    ``count_sum`` adds up, over all links, the number of documents that hold their pair; ``n_best`` counts the links whose
    pair has the highest such number of its first id, ties included.
    """
    rows = stored(linked(docs, a_path, b_path, pattern), "token-links")
    pairs = stored(pair_documents(rows), "pair-documents")
    n, width = pairs.agg(F.count(F.lit(1)), F.coalesce(F.max("b"), F.lit(0)) + 1).first()
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    parts = max(1, -(-n // sent))
    for k in range(parts):
        if k:
            rows = stored(rows, "scored-links")
        rows = scored(rows, pairs.filter(F.pmod("a", F.lit(parts)) == k), width)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "links")
