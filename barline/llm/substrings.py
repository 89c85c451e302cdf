"""Substring deduplication over words: seed, extend, and keep the maximal repeats.

Documents meet on winnowed anchors: of every window of 13 words one gram of five words is chosen, by content alone,
so two documents that share a window share its anchor. The anchors are sorted by (anchor, context, document); a
stream over that order settles every occurrence whose whole context stood in a smaller document. Only occurrences
with a context of their own, in anchors that have several, are extended: the words around the anchor are fetched,
matched window by window to both sides, and runs of matched windows make the maximal repeats.

No step holds more than one Arrow batch and one carried row; hot anchors are longer streams, not larger groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
import zlib
from pyspark.sql import DataFrame, functions as F

from barline.llm.anchors import Ranges, by_document, contexts, covered, packed, placed, seeds
from barline.llm.common import WordHashes, map_rows, stored

WINDOW, GRAM = 13, 5

_hashes = WordHashes(seed=13)


def symbols(raw: bytes) -> np.ndarray:
    return _hashes.of(raw.split())


def words_between(raw: bytes):
    w = raw.split()
    return lambda a, b: b" ".join(w[a:b])


def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def joined(sorted_seeds: DataFrame) -> DataFrame:
    """Sort-merge of occurrences: (anchor, id, at, settled), in the order (anchor, ctx, id, at).

    ``settled``: the whole context stands in a smaller document. Otherwise the row is the first document of its
    context, in an anchor that has other contexts.
    """

    def scan(batches):
        last = None  # (anchor, ctx, first id) of the run that the last batch ended in
        held = None  # rows of the last anchor's only context so far, which count if another context follows
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, ctx, ids, at, done = columns(batch)
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[done]) for c in (anchor, ids, at, done)], ["anchor", "id", "at", "settled"])
                anchor, ctx, ids, at = (c[~done] for c in (anchor, ctx, ids, at))
            n = len(anchor)
            if not n:
                continue
            new_anchor, new_ctx = np.ones(n, bool), np.ones(n, bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_ctx[1:] = new_anchor[1:] | (ctx[1:] != ctx[:-1])
            if last is not None:
                new_anchor[0] = anchor[0] != last[0]
                new_ctx[0] = new_anchor[0] or ctx[0] != last[1]
            run = np.cumsum(new_ctx)
            heads = ids[new_ctx] if new_ctx[0] else np.concatenate([[last[2]], ids[new_ctx]])
            first = heads[run - (1 if new_ctx[0] else 0)]
            settled = ids > first
            group = np.cumsum(new_anchor)
            lead = group[0]
            # Contexts of each anchor within this batch, and whether the first anchor had one before.
            several = np.bincount(group - lead, weights=new_ctx & ~new_anchor).astype(bool)
            out_a, out_i, out_t, out_s = [], [], [], []
            if held is not None and not new_anchor[0] and (held["several"] or several[0]):
                several[0] = True
                out_a, out_i, out_t = [held["anchor"]], [held["id"]], [held["at"]]
                out_s = [np.zeros(len(held["at"]), bool)]
                held = {"several": True, "anchor": np.empty(0, np.int64), "id": np.empty(0, np.int64), "at": np.empty(0, np.int64)}
            keep = settled | several[group - lead]
            tail = group == group[-1]
            alone = tail & ~settled & ~several[group - lead]
            fresh = {"anchor": anchor[alone], "id": ids[alone], "at": at[alone]}
            if held is not None and not new_anchor[-1] and group[-1] == lead and not new_anchor[0]:
                fresh = {k: np.concatenate([held[k], v]) for k, v in fresh.items()}
            held = fresh | {"several": bool(several[-1])}
            last = (anchor[-1], ctx[-1], first[-1])
            cols = [np.concatenate([*a, b[keep]]) for a, b in ((out_a, anchor), (out_i, ids), (out_t, at), (out_s, settled))]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "id", "at", "settled"])

    return sorted_seeds.mapInArrow(scan, "anchor long, id long, at long, settled boolean")


def windows(pieces: DataFrame) -> DataFrame:
    """(anchor, window, id, at) of every window of the fetched contexts; ``at`` names the single window."""

    def cut(rows: dict[str, list]) -> pa.RecordBatch:
        parts = []
        for anchor, i, at, body in zip(rows["anchor"], rows["id"], rows["at"], rows["body"]):
            s = symbols(body)
            n = len(s) - WINDOW + 1
            start = np.arange(n)
            single = ((at >> 8) + start) << 8 | 1
            parts.append((np.full(n, anchor), Ranges(s).of(start, WINDOW).view(np.int64), np.full(n, i), single))
        cols = [np.concatenate(c) for c in zip(*parts)] or [np.empty(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "window", "id", "at"])

    return map_rows(pieces, cut, "anchor long, window long, id long, at long")


def later(sorted_windows: DataFrame) -> DataFrame:
    """(id, at) of the windows that stand in a smaller document; rows come by (anchor, window, id)."""

    def scan(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, window, ids, at = columns(batch)
            new = np.ones(len(ids), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
            if last is not None and (anchor[0], window[0]) == last[:2]:
                new[0] = False
            heads = ids[new] if new[0] else np.concatenate([[last[2]], ids[new]])
            first = heads[np.cumsum(new) - (1 if new[0] else 0)]
            last = (anchor[-1], window[-1], first[-1])
            hit = ids > first
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(at[hit])], ["id", "at"])

    return sorted_windows.mapInArrow(scan, "id long, at long")


def repeats(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, at) of every run of windows that also stand in a document with a smaller doc_id."""
    found = seeds(docs, symbols, WINDOW, GRAM, within=False).repartition("deal").sortWithinPartitions("anchor", "ctx", "id", "at")
    hits = stored(joined(found.select("anchor", "ctx", "id", "at", "settled")), "seeds")
    open_ = contexts(bodies, hits.filter("NOT settled"), words_between, WINDOW)
    spread = windows(open_.repartition("anchor")).sortWithinPartitions("anchor", "window", "id")
    return hits.filter("settled").select("id", "at").union(later(spread))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; ``kept`` holds the words left, joined by one space.

    A null or empty text has no words. Repeated rows come back as often as they came and do not remove each other;
    rows that share a doc_id are one document. A null doc_id counts as larger than any other.
    """
    bodies = packed(docs)
    runs = by_document(repeats(docs, bodies))

    def remove(rows: dict[str, list]) -> dict[str, list]:
        loose = zstandard.ZstdDecompressor()
        out = {"doc_id": rows["doc_id"], "n_words": [], "n_removed": [], "kept": []}
        for body, places in zip(rows["body"], rows["places"]):
            raw = loose.decompress(body)
            w = raw.split()
            gone = 0
            if places:
                own, first, count = placed(np.array(places, np.int64))
                mine = own == zlib.crc32(raw) & 0x7FFFFF
                mask = covered(len(w), first[mine], count[mine] + WINDOW - 1)
                gone = int(mask.sum())
                w_left = [x for x, m in zip(w, mask.tolist()) if not m]
            else:
                w_left = w
            out["n_words"].append(len(w))
            out["n_removed"].append(gone)
            out["kept"].append(b" ".join(w_left).decode("utf-8", "replace"))
        return out

    return map_rows(bodies.join(runs, "id", "left").select("doc_id", "body", "places"), remove, "doc_id long, n_words long, n_removed long, kept string")
