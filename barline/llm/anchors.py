"""Winnowed anchors: a content-chosen position in every window of symbols, and fingerprints of ranges of symbols."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from barline.llm.common import map_rows, mix, rolling

#: Odd, and 5 modulo 8, so that powers run through as many values as possible modulo 2^64.
BASE = 0x9E3779B97F4A7C15 // 8 * 8 + 5
UNBASE = pow(BASE, -1, 2**64)
LOW = np.uint64(0xFFFFFFFF)


def own_anchors(symbols: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint of the gram, its position, first window start, number of windows) of each chosen gram.

    Every window of ``window`` symbols chooses the gram in it with the least mixed fingerprint, the leftmost of equal
    ones. The choice depends on the window's content alone, so equal windows choose the same gram at the same place.
    """
    n = len(symbols) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    grams = mix(rolling(symbols, gram, BASE))
    key = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    span, width = window - gram + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if rest := span - width:
        key = np.minimum(key[:-rest], key[rest:])
    at = (key[:n] & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]], at[first], first, np.diff(np.append(first, n))


class Ranges:
    """Fingerprints of any ranges of one symbol sequence, from running sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        power = np.full(n, BASE, np.uint64)
        power[:1] = 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * np.cumprod(power, dtype=np.uint64), out=sums[1:], dtype=np.uint64)
        back = np.full(n + 1, UNBASE, np.uint64)
        back[0] = 1
        self.sums, self.back = sums, np.cumprod(back, dtype=np.uint64)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length).astype(np.uint64))


def covered(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """True for each of ``n`` positions that lies in one of the ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:n]) > 0


#: Ids that are null sort last and count as one document.
NO_ID = 2**63 - 1


def place(text: bytes, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A place in a text as one number: 24 bits of the text's CRC, 32 of the first window, 8 of the window count.

    The CRC keeps rows apart that share a doc_id but not their text; places of one text sort by position.
    """
    return (np.int64(zlib.crc32(text) & 0x7FFFFF) << 40) | (first << 8) | count


def placed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC, first window, window count) of places."""
    return at >> 40, (at >> 8) & 0xFFFFFFFF, at & 0xFF


def seeds(docs: DataFrame, symbols: Callable[[bytes], np.ndarray], window: int, gram: int, within: bool) -> DataFrame:
    """(deal, anchor, ctx, id, at, settled) of every chosen gram.

    ``ctx`` is the fingerprint of all symbols its windows cover. Where some documents of one task share a context, all
    but its first occurrence are settled at once and need not meet the others: ``deal`` spreads them, and names the
    anchor for the rest. ``within``: a repeat in the same document counts.
    """

    def find(rows: dict[str, list]) -> pa.RecordBatch:
        parts = []
        for i, text in zip(rows["id"], rows["text"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            s = symbols(raw)
            grams, _, first, count = own_anchors(s, window, gram)
            if len(grams):
                ctx = Ranges(s).of(first, count + window - 1)
                parts.append((grams, ctx, np.full(len(grams), i), place(raw, first, count)))
        anchor, ctx, ids, at = [np.concatenate(c).view(np.int64) for c in zip(*parts)] or [np.empty(0, np.int64)] * 4
        order = np.lexsort((at, ids, ctx, anchor))
        a, c, i, t = anchor[order], ctx[order], ids[order], at[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        settled = i > i[head]
        if within:
            settled |= t != t[head]
        deal = np.where(settled, np.arange(len(a)), a)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, a, c, i, t, settled)], SEED_COLUMNS)

    given = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    return map_rows(given, find, "deal long, anchor long, ctx long, id long, at long, settled boolean")


SEED_COLUMNS = ["deal", "anchor", "ctx", "id", "at", "settled"]


def packed(docs: DataFrame, rest: bool = False) -> DataFrame:
    """(doc_id, id, body): texts compressed once, for the joins that bring places back to their texts.

    With ``rest`` the other columns of ``docs`` ride along in one struct, so that their names clash with nothing.
    """
    cols = [F.col("doc_id"), F.col("text")]
    if rest:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest"))
    given = docs.select(*cols)
    kind = "doc_id long, id long, body binary" + (f", _rest {given.schema['_rest'].dataType.simpleString()}" if rest else "")

    def pack(rows: dict[str, list]) -> dict[str, list]:
        tight = zstandard.ZstdCompressor(level=3)
        body = [tight.compress((t or "").encode("utf-8", "surrogatepass")) for t in rows["text"]]
        ids = [NO_ID if i is None else i for i in rows["doc_id"]]
        return {"doc_id": rows["doc_id"], "id": ids, "body": body} | ({"_rest": rows["_rest"]} if rest else {})

    return map_rows(given, pack, kind)


def by_document(places: DataFrame, value: str = "at") -> DataFrame:
    """(id, list of ``value``): at most a few per symbol of one document."""
    return places.groupBy("id").agg(F.collect_list(value).alias("places"))


def contexts(bodies: DataFrame, places: DataFrame, cut: Callable[[bytes], Callable[[int, int], bytes]], window: int) -> DataFrame:
    """(anchor, id, at, body) of the given places: the piece of text that the windows of each place cover."""
    listed = places.groupBy("id").agg(F.collect_list(F.struct("at", "anchor")).alias("places"))

    def slices(rows: dict[str, list]) -> dict[str, list]:
        loose = zstandard.ZstdDecompressor()
        out = {"anchor": [], "id": [], "at": [], "body": []}
        for i, body, found in zip(rows["id"], rows["body"], rows["places"]):
            raw = loose.decompress(body)
            crc, piece = zlib.crc32(raw) & 0x7FFFFF, cut(raw)
            for p in found:
                own, first, count = p["at"] >> 40, (p["at"] >> 8) & 0xFFFFFFFF, p["at"] & 0xFF
                if own == crc:
                    out["anchor"].append(p["anchor"])
                    out["id"].append(i)
                    out["at"].append(p["at"])
                    out["body"].append(piece(first, first + count + window - 1))
        return out

    # Repeated rows give the same pieces again; they are of one document and never remove each other.
    return map_rows(bodies.join(listed, "id").select("id", "body", "places"), slices, "anchor long, id long, at long, body binary")
