"""Substring deduplication over bytes with a logarithmic family of suffix arrays.

Suffixes are taken at winnowed positions: each string of 100 bytes chooses one gram of 20 bytes in it by content alone,
and the suffix that starts there stands for all its windows. (A suffix for every byte would need eight times the text
on disk; these are about one for 40 bytes, and no window is without one.) Suffixes are dealt out by their first 20
bytes. In each partition they arrive in the order of documents; every Arrow batch becomes a sorted array of suffixes,
which is merge-scanned against the levels of the family, and levels of equal rank are merged, so that a suffix is
moved once for each doubling. What the levels hold is always earlier than the batch: a match with them is a repeat.
Suffixes are ordered by fingerprints of their bytes: any order brings equal ones together, and a fingerprint has a
fixed size.

A suffix whose whole reach was seen before is settled. Suffixes that share their first bytes but not their reach are
fetched as bytes and scanned once more, window by window, by the same family. A partition keeps 32 bytes for each
distinct suffix dealt to it; more partitions make it smaller.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from barline.llm.anchors import Ranges, by_document, contexts, covered, packed, placed, seeds
from barline.llm.common import map_rows, mix, stored

WINDOW, GRAM = 100, 20


def symbols(raw: bytes) -> np.ndarray:
    return _SYMBOLS[np.frombuffer(raw, np.uint8)]


_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))


class Level:
    """A suffix array: keys in order, with the first place (id, at) of each and the anchor it belongs to."""

    def __init__(self, keys, ids, at, anchors, rank=0):
        self.keys, self.ids, self.at, self.anchors, self.rank = keys, ids, at, anchors, rank

    def merged(self, other: Level) -> Level:
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
        both = [np.concatenate([getattr(self, c), getattr(other, c)])[order] for c in ("ids", "at", "anchors")]
        return Level(keys[order], *both, rank=self.rank + 1)


class Family:
    """Levels of suffix arrays whose ranks all differ; keys are distinct over all levels."""

    def __init__(self):
        self.levels: list[Level] = []

    def scan(self, keys: np.ndarray, ids: np.ndarray, at: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """True for each suffix of a batch that was seen at an earlier place; the others become a new level.

        Batches come in the order of (id, at), and so do the suffixes of one.
        """
        order = np.argsort(keys, kind="stable")
        k, i, t = keys[order], ids[order], at[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        head = np.flatnonzero(new)
        first_id, first_at = i[head], t[head]
        known = np.zeros(len(head), bool)
        heads = k[head]
        for level in self.levels:
            spot = np.searchsorted(level.keys, heads)
            spot[spot == len(level.keys)] = 0
            hit = level.keys[spot] == heads
            first_id = np.where(hit, level.ids[spot], first_id)
            first_at = np.where(hit, level.at[spot], first_at)
            known |= hit
        run = np.cumsum(new) - 1
        seen = np.empty(len(k), bool)
        # The place itself is not an earlier one: rows that are repeated whole do not remove each other.
        seen[order] = (i != first_id[run]) | (t != first_at[run])
        fresh = head[~known]
        if len(fresh):
            self.push(Level(k[fresh], i[fresh], t[fresh], anchors[order][fresh]))
        return seen

    def push(self, level: Level) -> None:
        while self.levels and self.levels[-1].rank <= level.rank:
            level = self.levels.pop().merged(level)
        self.levels.append(level)


def key_of(anchor: np.ndarray, reach: np.ndarray) -> np.ndarray:
    return mix(anchor.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + reach.view(np.uint64))


def longs(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def matched(ordered: DataFrame) -> DataFrame:
    """(anchor, id, at, settled) of (anchor, ctx, id, at, settled): repeats, then the open ones of the partition."""

    def scan(batches):
        family = Family()
        names = ["anchor", "id", "at", "settled"]
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, ctx, ids, at, done = longs(batch)
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[done]) for c in (anchor, ids, at, done)], names)
                anchor, ctx, ids, at = (c[~done] for c in (anchor, ctx, ids, at))
            if not len(anchor):
                continue
            seen = family.scan(key_of(anchor, ctx), ids, at, anchor)
            if seen.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[seen]) for c in (anchor, ids, at)] + [pa.array(np.ones(seen.sum(), bool))], names)
        if not family.levels:
            return
        anchors = np.concatenate([x.anchors for x in family.levels])
        order = np.argsort(anchors, kind="stable")
        a = anchors[order]
        same = np.zeros(len(a), bool)
        same[1:] = a[1:] == a[:-1]
        same[:-1] |= a[1:] == a[:-1]
        pick = order[same]
        ids, at = (np.concatenate([getattr(x, c) for x in family.levels])[pick] for c in ("ids", "at"))
        for s in range(0, len(pick), 10_000):
            part = slice(s, s + 10_000)
            cols = [anchors[pick[part]], ids[part], at[part], np.zeros(len(ids[part]), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return ordered.mapInArrow(scan, "anchor long, id long, at long, settled boolean")


def extended(pieces: DataFrame) -> DataFrame:
    """(id, at) of the runs of windows, in fetched pieces that come by (id, at), that were seen earlier."""

    def scan(batches):
        family = Family()
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, ids, at = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "id", "at"))
            reach, many = [], []
            for body in batch.column("body").to_pylist():
                s = symbols(body)
                n = len(s) - WINDOW + 1
                reach.append(Ranges(s).of(np.arange(n), WINDOW))
                many.append(n)
            many = np.array(many)
            row = np.repeat(np.arange(len(many)), many)
            step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            spot = ((at[row] >> 8) + step) << 8
            seen = family.scan(key_of(anchor[row], np.concatenate(reach)), ids[row], spot, anchor[row])
            # Windows of one piece that follow each other make one run.
            starts = seen.copy()
            starts[1:] &= ~(seen[:-1] & (row[1:] == row[:-1]))
            head = np.flatnonzero(starts)
            if len(head):
                run = np.cumsum(starts)[seen] - 1
                count = np.bincount(run, minlength=len(head))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[head]]), pa.array(spot[head] | count)], ["id", "at"])

    return pieces.mapInArrow(scan, "id long, at long")


def repeats(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, at) of every run of windows that also start earlier: in a smaller doc_id, or before in the same text."""
    dealt = seeds(docs, symbols, WINDOW, GRAM, within=True).repartition("deal").sortWithinPartitions("id", "at")
    hits = stored(matched(dealt.select("anchor", "ctx", "id", "at", "settled")), "suffixes")
    pieces = contexts(bodies, hits.filter("NOT settled"), lambda raw: lambda a, b: raw[a:b], WINDOW)
    return hits.filter("settled").select("id", "at").union(extended(pieces.repartition("anchor").sortWithinPartitions("id", "at")))


def deduplicated(docs: DataFrame, rest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row, ``kept`` being the remaining bytes.

    A null or empty text has no bytes. Rows that are repeated whole come back as often as they came and do not remove
    each other. Rows that share a doc_id but not their text are ordered by the CRC of the text; null ids come last.
    """
    bodies = packed(docs, rest)
    runs = by_document(repeats(docs, bodies))
    extra = ["_rest"] if rest else []

    def remove(rows: dict[str, list]) -> dict[str, list]:
        loose = zstandard.ZstdDecompressor()
        out = {c: rows[c] for c in ["doc_id", *extra]} | {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept")}
        for body, places in zip(rows["body"], rows["places"]):
            raw = loose.decompress(body)
            mask = np.zeros(len(raw), bool)
            if places:
                own, first, count = placed(np.array(places, np.int64))
                mine = own == zlib.crc32(raw) & 0x7FFFFF
                mask = covered(len(raw), first[mine], count[mine] + WINDOW - 1)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            out["kept"].append(np.frombuffer(raw, np.uint8)[~mask].tobytes() if places else raw)
        return out

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    if rest:
        kind += f", _rest {bodies.schema['_rest'].dataType.simpleString()}"
    return map_rows(bodies.join(runs, "id", "left").select("doc_id", "body", "places", *extra), remove, kind)
