"""BPE encoding and decoding with the vocabulary of a public byte-level tokenizer."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: The pattern that cuts a text into pieces before any merge.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The pattern's kinds of characters; all others are of kind 0.
KINDS = r"\p{L}+", r"\p{N}+", r"\p{White_Space}+"
WHITE, APART = 3, 4
#: Pieces up to so many bytes find their lowest rank by a look at all; longer ones keep a queue.
SCANNED_BYTES = 32
NEVER = 1 << 62
#: Pieces up to this many bytes are remembered, and so many of them: a worker keeps them between tasks, beside other workers.
CACHED_BYTES, CACHED_PIECES = 96, 400_000
#: Characters that are cut at a time; a longer text is cut by itself.
STEP_CHARS = 1 << 20
#: A queue entry is rank and position in one number; no piece reaches 2^40 bytes.
POSITION_BITS = 40
LAST_POSITION = (1 << POSITION_BITS) - 1


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point, by the same properties as the pattern."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), np.uint8)
    for kind, pattern in enumerate(KINDS, 1):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def cuts(text: str, apart: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of ``PIECES`` start in a text, and at which byte; then its ends.

    The whole text is cut at once, where the kind of its characters changes. Spans that are ``apart`` are one piece each,
    and what lies between them is cut by itself.
    """
    n = len(text)
    codes = np.zeros(n + 3, np.uint32)
    codes[:n] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[codes]
    edges = np.array(apart, np.int64).reshape(-1, 2)
    for a, b in apart:
        kind[a:b] = APART
    cut = np.ones(n + 3, bool)
    cut[1:n] = kind[1:n] != kind[: n - 1] if n else True
    cut[edges] = True
    # The last of the white characters before another one stands alone; a space joins what follows.
    last = np.flatnonzero(cut[1:n] & (kind[: n - 1] == WHITE) & (kind[1:n] != APART)) if n else np.empty(0, np.int64)
    cut[last] = True
    cut[last[codes[last] == 32] + 1] = False
    at = np.flatnonzero((codes[:n] == 39) & (kind[:n] == 0) & cut[:n])
    if len(at):
        a, b = (np.where(kind[at + i] == 1, codes[at + i], 0) for i in (1, 2))
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        cut[at[one | two] + 1] = False
        cut[at[one] + 2] = True
        cut[at[two] + 3] = True
    starts = np.append(np.flatnonzero(cut[:n]), n)
    if text.isascii():
        return starts, starts.astype(np.int32)
    sizes = np.ones(n + 1, np.int32)
    for limit in (0x7F, 0x7FF, 0xFFFF):
        sizes[1:] += codes[:n] > limit
    sizes[0] = 0
    return starts, np.cumsum(sizes, dtype=np.int32)[starts]


class Vocabulary(dict):
    """Piece as bytes -> token ids as the bytes of 32-bit numbers, filled on demand; ``strings[i]`` is token ``i``."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        byte = {c: b for b, c in letter.items()}
        ids = spec["model"]["vocab"]
        self.unit = [ids[letter[b]] for b in range(256)]
        self.size = size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        #: left id * size + right id -> rank from 1, shifted to make room for a position; ``made[rank]`` is the new id
        self.ranks: dict[int, int] = {}
        self.made = [-1]
        for rank, pair in enumerate(spec["model"]["merges"], 1):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[left] * size + ids[right], rank << POSITION_BITS)
            self.made.append(ids[left + right])
        #: the same for two bytes, 0 where no merge joins them
        self.byte_ranks = [[self.ranks.get(a * size + b, 0) for b in self.unit] for a in self.unit]
        strings: list[bytes] = [b""] * size
        for token, i in ids.items():
            strings[i] = bytes(byte[c] for c in token)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            strings[i] = token
        self.strings = pa.array(strings, pa.binary())
        marks = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None

    def __missing__(self, piece: bytes) -> bytes:
        # A piece that is a special token's string is always a mark: no other piece can hold it whole.
        ids = array("i", [self.special[piece]] if piece in self.special else self.merge(piece)).tobytes()
        if len(piece) <= CACHED_BYTES:
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Merge the lowest rank first, leftmost among equals."""
        return self.scanned(data) if len(data) <= SCANNED_BYTES else self.queued(data)

    def scanned(self, data: bytes) -> list[int]:
        """``merge`` of few bytes: the lowest of all pairs' ranks, one after the other."""
        rank_of, made, size, byte_ranks = self.ranks.get, self.made, self.size, self.byte_ranks
        ids = [self.unit[b] for b in data]
        due = [byte_ranks[a][b] or NEVER for a, b in zip(data, data[1:])]
        while due:
            low = min(due)
            if low == NEVER:
                break
            i = due.index(low)
            ids[i] = merged = made[low >> POSITION_BITS]
            del ids[i + 1], due[i]
            if i < len(due):
                due[i] = rank_of(merged * size + ids[i + 1], NEVER)
            if i:
                due[i - 1] = rank_of(ids[i - 1] * size + merged, NEVER)
        return ids

    def queued(self, data: bytes) -> list[int]:
        """``merge`` of any number of bytes.

        Symbols form a doubly linked list; the queue holds (rank, position) as one number. ``due`` is the rank of
        the pair that starts at each position now: an entry that differs from it is stale and skipped, so nothing is
        ever searched or moved: n log n for n bytes.
        """
        rank_of, made, size, byte_ranks = self.ranks.get, self.made, self.size, self.byte_ranks
        ids = [self.unit[b] for b in data]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        due = [byte_ranks[a][b] for a, b in zip(data, data[1:])] + [0]
        queue = [rank | i for i, rank in enumerate(due) if rank]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & LAST_POSITION
            if due[i] != entry - i:
                continue
            j = after[i]
            ids[i] = merged = made[entry >> POSITION_BITS]
            ids[j] = -1
            due[i] = due[j] = 0
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if rank := rank_of(merged * size + ids[k]):
                    due[i] = rank
                    heappush(queue, rank | i)
            h = before[i]
            if h >= 0:
                due[h] = rank = rank_of(ids[h] * size + merged, 0)
                if rank:
                    heappush(queue, rank | h)
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has.

        All texts are cut together and equal pieces are brought together by Arrow, so that each is looked up once.
        """
        if len(self) > CACHED_PIECES:
            self.clear()
        text = "\0".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        gaps = ends[:-1]
        # Strings of special tokens are cut out first; what lies between is cut into pieces on its own.
        marks = [m.span() for m in self.marks.finditer(text)] if self.marks else []
        starts, offsets = cuts(text, [*zip(gaps.tolist(), (gaps + 1).tolist()), *marks])
        raw = pa.py_buffer(text.encode("utf-8", "surrogatepass"))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), raw]).dictionary_encode()
        ids = [self[p] for p in pieces.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), np.frombuffer(b"".join(ids), np.int32))
        own = np.isin(starts[:-1], gaps, invert=True)
        which = pieces.indices.to_numpy()[own]
        upto = np.append(0, np.cumsum(sizes[which]))[np.searchsorted(starts[:-1][own], ends)]
        return lists.take(pa.array(which)).flatten().to_numpy(), np.diff(upto, prepend=0)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def steps(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of at most ``STEP_CHARS`` characters, or of one text."""
    some, chars = [], 0
    for t in texts:
        t = t.as_py() or ""
        if some and chars + len(t) > STEP_CHARS:
            yield some
            some, chars = [], 0
        some.append(t)
        chars += len(t)
    if some:
        yield some


def id_lists(flat: np.ndarray, sizes: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), pa.array(flat))


def encode(text: Column, path: str) -> Column:
    """Token ids of a text column, array<int>; a null or empty text has none.

    Whole texts of any length; a text that holds the string of a special token gets that token. Each row is
    encoded by itself, so ties, repeated rows and other columns do not matter.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        v = vocabulary(path)
        parts = [v.encode(some) for some in steps(texts)]
        return id_lists(np.concatenate([np.empty(0, np.int32), *(ids for ids, _ in parts)]), [*chain(*(sizes for _, sizes in parts))])

    return ids(text)


def texts_of(lists: pa.ListArray, v: Vocabulary) -> pa.Array:
    out = []
    for row in range(len(lists)):
        values = lists[row].values
        if values is None or not len(values):
            out.append("")
            continue
        joined = v.strings.take(values)
        start, end = joined.offset, joined.offset + len(joined)
        offsets = np.frombuffer(joined.buffers()[1], np.int32)
        raw = joined.buffers()[2].to_pybytes()[offsets[start] : offsets[end]]
        out.append(raw.decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def decode(ids: Column, path: str) -> Column:
    """The text of a column of token ids: vocabulary strings joined, bytes that are no UTF-8 replaced.

    A null or empty array decodes to the empty string; an id outside the vocabulary is an error.
    """

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return texts_of(lists, vocabulary(path))

    return text(ids)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document, each step of texts encoded, decoded and given out before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            at = 0
            for some in steps(batch.column(1)):
                ids = id_lists(*v.encode(some))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), ids, texts_of(ids, v)], ["doc_id", "ids", "decoded"])
                at += len(some)

    kind = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip`` rows."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
